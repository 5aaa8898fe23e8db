"""Windows against a sequential model, known attacks, and the stream against the batch."""

import json
import os
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.scalars import hmac_sha256
from plumbline.operators import passports, scenarios
from plumbline.streaming import verifier


def sequential(rows):
    last_seq, last_hash, reanchor, seen, out = 0, "GENESIS", False, set(), {}
    for r in rows:
        if not r["sig_ok"]:
            out[r["arrival"]], reanchor = ["SIGNATURE_INVALID"], True
            continue
        if r["nonce"] in seen:
            out[r["arrival"]] = ["REPLAY_DETECTED"]
            continue
        seen.add(r["nonce"])
        found = []
        if r["sequence"] > last_seq + 1 + reanchor:
            found.append("SEQUENCE_GAP")
        if r["prev_hash"] != last_hash and not reanchor:
            found.append("CHAIN_BREAK")
        if r["sequence"] > last_seq:
            last_seq, last_hash = r["sequence"], r["own_hash"]
        reanchor = False
        out[r["arrival"]] = found
    return out


record = st.fixed_dictionaries({"sequence": st.integers(-1, 8), "nonce": st.sampled_from("abcdef"), "sig_ok": st.sampled_from([True, True, True, False]), "prev": st.integers(0, 5)})


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(record, min_size=1, max_size=14), min_size=20, max_size=40))
def test_windows_equal_a_sequential_verifier(spark, streams):
    rows, want = [], {}
    for k, stream in enumerate(streams):
        own = [r | {"deployment_id": f"d{k}", "arrival": 1000 * k + i, "own_hash": f"h{i}", "prev_hash": "GENESIS" if r["prev"] == 0 else f"h{r['prev'] - 1}"} for i, r in enumerate(stream)]
        want |= sequential(own)
        rows += own
    df = spark.createDataFrame([(r["deployment_id"], r["arrival"], r["nonce"], r["sequence"], r["prev_hash"], r["sig_ok"], r["own_hash"]) for r in rows], "deployment_id string, arrival long, nonce string, sequence long, prev_hash string, sig_ok boolean, own_hash string")
    got = {r.arrival: [f.kind for f in r.findings] for r in passports.verdicts(passports.replay_state(df)).collect()}
    assert got == want


def test_attacks_are_found_and_the_control_is_clean(spark):
    got = {r.attack: r for r in scenarios.evaluate(spark, seeds=range(2)).collect()}
    assert got["none"].detected == 0 and all(r.false_positives == 0 for r in got.values())
    kinds = {"output_tamper": "OUTPUT_HASH_MISMATCH", "input_tamper": "INPUT_HASH_MISMATCH", "replay": "REPLAY_DETECTED", "model_swap": "MODEL_ARTIFACT_MISMATCH", "config_tamper": "CONFIG_MISMATCH", "drop_records": "SEQUENCE_GAP", "forged_signature": "SIGNATURE_INVALID"}
    assert all(got[a].detected == 1 and k in got[a].kinds for a, k in kinds.items())


def test_issue_then_verify(spark):
    rows = [("D", f"I{k}", "i", "o", "m", "p", "c", 1.7e9 + k, f"n{k}", k) for k in range(5)]
    req = spark.createDataFrame(rows, "deployment_id string, inference_id string, input_hash string, output_hash string, model_hash string, preproc_hash string, config_hash string, timestamp double, nonce string, arrival long")
    expected = spark.createDataFrame([("D", "m", "p", "c")], "deployment_id string, expected_model string, expected_preproc string, expected_config string")
    v = passports.verify_batch(passports.issue(req, b"k"), expected, b"k", now=F.lit(1.7e9))
    assert passports.totals(v).first().clean and passports.evidence(v).count() == 0
    late = passports.verify_batch(passports.issue(req, b"k"), expected, b"k", now=F.lit(1.8e9))
    assert {f.kind for r in late.collect() for f in r.findings} == {"TIMESTAMP_SKEW"}


def test_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        assert spark.range(1).select(hmac_sha256(key, F.lit("message")).alias("h")).first().h == hmac.new(key, b"message", hashlib.sha256).hexdigest()


def _stream(spark, tmp_path, files: list[list[dict]]) -> list:
    """Rows of the stream over the files in the order given, one a micro-batch."""
    names = [c.split()[0] for c in passports.COLUMNS.split(", ")] + ["arrival"]
    schema = passports.COLUMNS + ", arrival long"
    for k, rows in enumerate(files):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({n: r[n] for n in names}) for r in rows))
        os.utime(tmp_path / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)  # the source goes by the files' times
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", verifier.PROVIDER)
    out = verifier.verify_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path)), scenarios.KEY)
    name = f"receipts_{tmp_path.name.replace('-', '_')}"
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def _attacked() -> list[dict]:
    return [r for a in ("replay", "drop_records", "forged_signature", "none") for r in scenarios.passport_stream(a, 20, 3, 8)]


def test_stream_equals_batch(spark, tmp_path):
    rows = _attacked()
    files = [[r for r in rows if r["arrival"] < 10], [r for r in rows if r["arrival"] >= 10]]
    for f in files:
        random.Random(1).shuffle(f)
    got = _stream(spark, tmp_path, files)
    assert not any(r.late for r in got)
    df = spark.createDataFrame([(*passports.to_rows([r])[0], r["arrival"]) for r in rows], passports.COLUMNS + ", arrival long")
    v = passports.verdicts(passports.replay_state(passports.with_digests(df, scenarios.KEY)))
    assert {(r.deployment_id, r.arrival, r.kind) for r in got if r.kind != "OK"} == {(r.deployment_id, r.arrival, f.kind) for r in v.collect() for f in r.findings}


def test_late_receipts_are_judged_as_they_come(spark, tmp_path):
    rows = _attacked()
    files = [[r for r in rows if r["arrival"] >= 10], [r for r in rows if r["arrival"] < 10]]
    got = _stream(spark, tmp_path, files)
    assert {r.arrival for r in got if r.late} == set(range(10)) and all(r.late == (r.arrival < 10) for r in got)
    want = set()
    for d in {r["deployment_id"] for r in rows}:
        own = [r | {"place": k, "sig_ok": passports.sign(scenarios.KEY, r) == r["signature"], "own_hash": passports.record_hash(r)} for k, r in enumerate(r for f in files for r in sorted(f, key=lambda r: r["arrival"]) if r["deployment_id"] == d)]
        found = sequential([r | {"arrival": r["place"]} for r in own])
        want |= {(d, r["arrival"], kind) for r in own for kind in found[r["place"]]}
    assert {(r.deployment_id, r.arrival, r.kind) for r in got if r.kind != "OK"} == want
