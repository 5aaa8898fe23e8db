"""Golden values of the demo case, state matrix, counterfactuals, reports."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import writer
from plumbline.operators import assurance, counterfactual, fusion, lineage
from plumbline.operators.assurance import AssuranceConfig
from plumbline.plans import fixtures
from plumbline.plans.dims import FusionConfig


@pytest.fixture(scope="module")
def demo(spark):
    return fixtures.demo(spark)


@pytest.fixture(scope="module")
def inv(demo):
    return assurance.investigate(demo)


def test_scores(inv):
    got = {r.hypothesis: (r.base, r.corr, r.contra, r.raw, r.support) for r in inv.scores.collect()}
    want = {
        "DATASET_POISONING": (1.903453, 1.216683, 0, 3.120136, 0.875081), "BACKDOOR": (1.742594, 0.886370, 0, 2.628965, 0.826685), "INFERENCE_TAMPERING": (0.511459, 0.015240, 0, 0.526699, 0.296110),
        "MODEL_SUBSTITUTION": (0.426454, 0.074316, 0, 0.500770, 0.283836), "CLEAN": (1.142857, 0, 6.789978, 0, 0), "BENIGN_DISTRIBUTION_SHIFT": (0.522299, 0.045944, 1.445630, 0, 0),
    }
    assert got == {h: pytest.approx(v, abs=1e-6) for h, v in want.items()}


def test_report(inv):
    r = assurance.report(inv, "demo")
    assert (r["assurance_state"], r["risk_score"], r["confidence"], r["coverage"], r["implicated_source"]) == ("RED", 87.5, 73.7, 57.1, "B17")
    assert r["attack_path_evidence_nodes"] == ["B17", "S184", "V4", "O982"] and r["attack_path"][0] == "B17"
    assert r["integrity_checks"] == {"dataset_integrity": "FAIL", "model_integrity": "UNKNOWN", "trigger_sensitivity": "FAIL", "provenance": "FAIL"}
    assert "quarantine Batch B17; review Training Run 42; do not deploy Model V4" in r["human_readable_summary"]
    done = writer.write(r)
    assert done["grounded"] and done["generator"] == "template" and done["headline"] == "Compromise strongly indicated"
    assert writer.write(r, lambda facts: "Risk is 12 percent [F1].")["generator"] == "template"
    assert writer.violations("", writer.facts_of(r)) == ["empty report"]
    assert writer.violations("Model X99 is bad [F1].", writer.facts_of(r))[0].startswith("identifiers not in cited facts")


def test_origins_in_order(inv):
    got = [(r.node_id, round(r.fraction, 4), r.closure_size) for r in inv.candidates.orderBy("rank").collect()]
    assert got[:8] == [("B17", 1.0, 8), ("C_B", 1.0, 9), ("DS01", 1.0, 11), ("V4", 0.5265, 4), ("TR42", 0.5265, 5), ("B03", 0.5265, 7), ("C_A", 0.5265, 8), ("S184", 0.1337, 1)]
    assert [g[0] for g in got[8:]] == ["O982", "I982", "D7", "IN982"]


def test_relations(spark, demo):
    pairs = spark.createDataFrame([("demo", a, b) for a, b in (("B03", "B17"), ("B17", "V4"), ("V4", "B17"), ("V4", "V4"), ("IN982", "DS01"))], "case_id string, a string, b string")
    got = {(r.a, r.b): (r.kind, r.dist, r.via) for r in lineage.relation(demo, pairs).collect()}
    assert got[("B03", "B17")] == ("COMMON_ORIGIN", 2, "DS01") and got[("B17", "V4")] == ("UPSTREAM", 2, None) and got[("V4", "B17")] == ("DOWNSTREAM", 2, None)
    assert got[("V4", "V4")] == ("SAME_NODE", 0, None) and got[("IN982", "DS01")][0] == "UNRELATED"
    assert lineage.correlation_pairs(demo).count() == 15
    assert [r.path for r in lineage.lineage_paths(demo, "B17", "O982").collect()] == [["B17", "TR42", "V4", "D7", "I982", "O982"]]
    v4 = spark.createDataFrame([("demo", "V4")], "case_id string, node_id string")
    assert {r.found for r in lineage.downstream(demo, v4).collect()} == {"D7", "I982", "O982"}


def test_counterfactuals(spark, demo):
    t = spark.createDataFrame([("demo", n) for n in ("B17", "B03", "V4")], "case_id string, node_id string")
    r = {x.target: x for x in counterfactual.simulate(demo, t).results.collect()}
    b17 = r["B17"]
    assert (b17.original_risk, b17.structural_risk, b17.final_risk, b17.effect, b17.final_state, b17.final_source) == (87.5, 63.2, 27.0, "SUBSTANTIAL", "AMBER", "O982")
    assert b17.removed_nodes == ["B17", "S184", "S185"] and b17.cleared_evidence == ["E010", "E011"] and "88 -> 27" in b17.summary
    assert (r["B03"].risk_delta, r["B03"].effect, r["B03"].retained_evidence) == (0.0, "NONE", ["E010", "E011"])
    assert (r["V4"].final_risk, r["V4"].final_state) == (63.8, "RED")


def test_counterfactual_shared_sample_and_second_suspect(spark):
    shared = fixtures.demo(spark, extra_edges=[("B03", "S184", "CONTAINS")])
    t = spark.createDataFrame([("demo", "B17")], "case_id string, node_id string")
    x = counterfactual.simulate(shared, t).results.first()
    assert "S184" not in x.removed_nodes and "E003" not in x.removed_evidence
    second = fixtures.demo(spark, extra_evidence=[("E200", "B03", "LABEL_DISTRIBUTION_ANOMALY", 0.8, 0.9, "label_detector")])
    assert counterfactual.simulate(second, t).results.first().cleared_evidence == []


EVERYWHERE = fixtures.inspected_everywhere()
MATRIX = {
    "clean": ([], EVERYWHERE, "GREEN", "CLEAN", []), "minor": ([("B1", "CLASS_IMBALANCE", 0.5, 0.7, "label_detector")], EVERYWHERE, "GREEN", "CLEAN", []), "uninspected": ([], (), "AMBER", "INCONCLUSIVE", ["INCONCLUSIVE"]),
    "partial": ([], fixtures.inspected_everywhere(("DS", "B1", "TR")), "AMBER", "CLEAN", ["LOW_COVERAGE"]), "not decisive": ([("B1", "LABEL_DISTRIBUTION_ANOMALY", 0.6, 0.7, "label_detector")], EVERYWHERE, "AMBER", "CLEAN", ["CLEAN_NOT_DECISIVE"]),
    "benign": ([("S1", "OOD_ANOMALY", 0.7, 0.85, "ood_detector"), ("O", "ENVIRONMENT_METADATA_CHANGE", 0.9, 0.9, "metadata_monitor")], EVERYWHERE, "AMBER", "BENIGN_DISTRIBUTION_SHIFT", ["BENIGN_SHIFT"]),
    "trigger": ([("M", "TRIGGER_SENSITIVITY", 0.9, 0.9, "trigger_detector")], EVERYWHERE, "AMBER", "BACKDOOR", ["ATTACK_MODERATE"]),
    "substitution": ([("M", "MODEL_ARTIFACT_MISMATCH", 0.95, 0.95, "hash_verifier"), ("M", "STRUCTURAL_DEVIATION", 0.8, 0.9, "structural_detector")], EVERYWHERE, "RED", "MODEL_SUBSTITUTION", ["ATTACK_HIGH"]),
    "tampering": ([("O", "OUTPUT_HASH_MISMATCH", 0.95, 0.95, "passport_verifier"), ("I", "REPLAY_DETECTED", 0.9, 0.9, "passport_verifier")], EVERYWHERE, "RED", "INFERENCE_TAMPERING", ["ATTACK_HIGH"]),
}


def test_state_matrix(spark):
    graphs = [fixtures.chain(spark, e, i, name) for name, (e, i, *_) in MATRIX.items()]
    whole = graphs[0]
    for g in graphs[1:]:
        whole = lineage.Graph(*(getattr(whole, k).union(getattr(g, k)) for k in ("nodes", "edges", "evidence", "inspections")), 7)
    inv = assurance.investigate(whole)
    got = {r.case_id: r for r in inv.decisions.collect()}
    for name, (_, _, state, top, codes) in MATRIX.items():
        assert (got[name].state, got[name].top_hypothesis) == (state, top), name
        assert not codes or codes == [c for c in got[name].codes if c in codes], name
    assert got["clean"].risk == 0 and got["clean"].coverage == 100 and got["uninspected"].confidence == 0 and got["partial"].coverage == 50.0
    origins = {r.case_id: r.origin for r in inv.origins.collect()}
    assert origins["substitution"] == "M" and origins["trigger"] == "M" and origins["tampering"] == "I" and "benign" not in origins
    assert "1 minor anomaly" in assurance.report(inv, "minor")["human_readable_summary"]


def test_config(spark):
    with pytest.raises(ValueError):
        AssuranceConfig(red_support=2)
    with pytest.raises(ValueError):
        FusionConfig(saturation=0)
    c = FusionConfig().with_reliability(label_detector=0.1).with_mapping("NEW", {"CLEAN": -1.0})
    assert c.reliability["label_detector"] == 0.1 and "NEW" in c.coefficients
    g = fixtures.chain(spark, [("B1", "CLASS_IMBALANCE", 0.5, 0.7, "label_detector")], EVERYWHERE)
    f = fusion.fuse(g, FusionConfig(clean_prior=0.0))
    assert assurance.decide(f.scores, f.context).first().codes == ["ATTACK_LOW"]


def test_validation(spark):
    g = fixtures.graph(spark, [("a", "MODEL", "a"), ("b", "MODEL", "b"), ("o", "OUTPUT", "o"), ("x", "MODEL", "x")], [("a", "b", "DERIVED_FROM"), ("a", "a", "DERIVED_FROM"), ("o", "a", "MODIFIED"), ("a", "zz", "PRODUCED")], [("E1", "a", "T", 1.5, 0.5, "d"), ("E2", "q", "T", 0.5, float("nan"), "d")])
    got = {(r.problem, r.subject) for r in lineage.validate(g).collect()}
    assert got == {("self_loop", "a->a"), ("illegal_edge", "o->a"), ("unknown_node", "a->zz"), ("bad_number", "E1"), ("bad_number", "E2"), ("unknown_source", "E2")}
    assert {r.node_id for r in lineage.isolated(g).collect()} == {"x"}
    ring = fixtures.graph(spark, [(n, "MODEL", n) for n in "abc"], [("a", "b", "DERIVED_FROM"), ("b", "c", "DERIVED_FROM"), ("c", "a", "DERIVED_FROM")])
    with pytest.raises(ValueError):
        ring.closure  # noqa: B018


def test_documents_round_trip(spark, demo):
    doc = lineage.to_json(demo)
    back = lineage.from_json(doc)
    assert sorted(map(tuple, back.nodes.collect())) == sorted(map(tuple, demo.nodes.collect())) and sorted(map(tuple, back.evidence.collect())) == sorted(map(tuple, demo.evidence.collect()))
    old = spark.createDataFrame([("c", '{"nodes": [{"id": "n", "type": "MODEL"}], "evidence": [{"node_id": "n", "type": "T", "severity": 0.5, "confidence": 1.0}]}')], "case_id string, document string")
    e = lineage.from_json(old).evidence.first()
    assert (e.evidence_id, e.source_id, e.detector) == ("E-00001", "n", "unknown")
    x = lineage.export(demo, spark.createDataFrame([("demo", "B17")], "case_id string, node_id string")).filter(F.col("node_id") == "B17").first()
    assert (x.stage, x["rank"], x.evidence_count, x.max_severity, x.highlighted) == ("data", 0, 2, 0.81, True)


def test_statements_of_a_narrative():
    got = writer.statements("Risk is 87.5 percent of E-01. [F1] It stands at V4 [F2][F3]! see b2 too")
    assert [(sorted(s.cites), sorted(s.names), sorted(s.numbers)) for s in got] == [(["F1"], ["E-01"], ["87.5"]), (["F2", "F3"], ["V4", "b2"], [])]
    facts = [writer.Fact("F1", "Model V4 has 3 faults."), writer.Fact("F2", "All is said.")]
    assert writer.violations("Model V4 has 3 faults [F1]. All is said [F2].", facts) == []
    assert writer.violations("Model V5 has 4 faults [F1]. All is said. [F2]", facts) == ["identifiers not in cited facts: ['V5']", "numbers not in cited facts: ['4']"]
    assert writer.violations("Model V4 [F9]. Nothing cited here.", facts) == ["unknown citation(s): ['F9']", "uncited sentence: 'Nothing cited here.'", "required fact F1 not cited", "required fact F2 not cited"]


def test_loopback_model():
    import http.server
    import json
    import threading

    class Reply(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"choices": [{"message": {"content": f" {asked['model']} says {len(asked['messages'])} "}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Reply)
    threading.Thread(target=server.handle_request, daemon=True).start()
    model = writer.LoopbackModel(f"http://127.0.0.1:{server.server_port}/v1/chat/completions", "m", timeout=5)
    assert model([writer.Fact("F1", "x")]) == "m says 2"
    with pytest.raises(ValueError):
        writer.LoopbackModel("http://example.com/v1", "m")


def test_paths_are_limited_by_length_and_ids(spark):
    nodes = [("s", "DATASET", "s"), ("t", "DATASET", "t")] + [(f"{c}{k}", "DATASET", "") for c in "abc" for k in range(4)]
    edges = [("s", f"a{k}", "DERIVED_FROM") for k in range(4)] + [(f"{x}{i}", f"{y}{j}", "DERIVED_FROM") for x, y in ("ab", "bc") for i in range(4) for j in range(4)] + [(f"c{k}", "t", "DERIVED_FROM") for k in range(4)] + [("a3", "t", "DERIVED_FROM")]
    g = fixtures.graph(spark, nodes, edges, depth=5)
    got = [tuple(r.path) for r in lineage.lineage_paths(g, "s", "t", limit=5).collect()]
    every = sorted(("s", f"a{i}", f"b{j}", f"c{k}", "t") for i in range(4) for j in range(4) for k in range(4))
    assert sorted(got, key=lambda p: (len(p), p)) == [("s", "a3", "t"), *every[:4]]
    assert lineage.lineage_paths(g, "t", "s").count() == 0
