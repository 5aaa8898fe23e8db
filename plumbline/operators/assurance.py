"""GREEN / AMBER / RED decisions with reasons, attributed origins, and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import fusion, lineage
from plumbline.operators.lineage import Graph
from plumbline.plans import dims
from plumbline.plans.dims import FusionConfig
from plumbline.sources.storage import cut

ACTIONS = {"GREEN": "ACCEPT", "AMBER": "REVIEW", "RED": "QUARANTINE"}


@dataclass(frozen=True)
class AssuranceConfig:
    """Thresholds of the decision."""

    red_support: float = 0.6
    amber_attack_support: float = 0.3
    green_min_coverage: float = 0.75
    green_min_margin: float = 0.5
    margin_full: float = 0.5
    margin_weight: float = 0.5
    coverage_floor: float = 0.5
    origin_min_fraction: float = 0.25
    top_origins: int = 5

    def __post_init__(self) -> None:
        shares = (self.red_support, self.amber_attack_support, self.green_min_coverage, self.green_min_margin, self.margin_weight, self.coverage_floor, self.origin_min_fraction)
        if not all(0.0 <= s <= 1.0 for s in shares):
            raise ValueError("thresholds lie in [0, 1]")
        if self.margin_full <= 0 or self.amber_attack_support > self.red_support or self.top_origins < 0:
            raise ValueError("inconsistent thresholds")


def percent(x) -> F.Column:
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 100, 1)


def decide(scores: DataFrame, context: DataFrame, config: AssuranceConfig | None = None) -> DataFrame:
    """One row for each case: state, action, risk, confidence, top hypothesis, focus, reason codes."""
    c = config or AssuranceConfig()
    row = F.struct("support", "hypothesis", "raw", "is_attack")
    wide = scores.groupBy("case_id").agg(
        F.max_by(row, -F.col("rank")).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("support"))).alias("second"),
        F.max_by(F.when(F.col("is_attack"), row), F.when(F.col("is_attack"), -F.col("rank"))).alias("attack"),
        F.max(F.when(F.col("hypothesis").isin(dims.CLEAN, dims.SHIFT), F.col("support"))).alias("innocent"),
        F.max(F.when(F.col("hypothesis") == dims.CLEAN, F.size("contradicting"))).alias("n_minor"), F.max(F.when(F.col("hypothesis") == dims.CLEAN, F.struct("contradicting"))).alias("minor"),
    )
    d = wide.join(context.select("case_id", "coverage", "n_gaps"), "case_id")
    attack, top = F.col("attack"), F.col("top")
    none = top["raw"] <= 0
    red = attack["support"] >= c.red_support
    moderate = attack["support"] >= c.amber_attack_support
    low = ~moderate & ~none & top["is_attack"]
    margin = top["support"] - F.col("second")
    covered = F.col("coverage") >= c.green_min_coverage
    code = lambda cond, name: F.when(cond, name)
    review = F.array_compact(
        F.array(
            code(moderate, "ATTACK_MODERATE"), code(low, "ATTACK_LOW"), code(~none & (top["hypothesis"] == dims.SHIFT), "BENIGN_SHIFT"), code(none, "INCONCLUSIVE"), code(~none & ~covered, "LOW_COVERAGE"),
            code(F.col("n_gaps") > 0, "PROVENANCE_GAPS"), code(~none & (top["hypothesis"] == dims.CLEAN) & covered & (margin < c.green_min_margin), "CLEAN_NOT_DECISIVE"),
        )
    )
    d = d.withColumn("codes", F.when(red, F.array(F.lit("ATTACK_HIGH"))).when(F.size(review) > 0, review).otherwise(F.array(F.lit("CLEAN_CONFIRMED"))))
    state = F.when(red, "RED").when(F.array_contains("codes", "CLEAN_CONFIRMED"), "GREEN").otherwise("AMBER")
    leader = F.when(red, attack["support"]).when(none, 0.0).otherwise(top["support"])
    rival = F.when(red, F.col("innocent")).when(none, 0.0).otherwise(F.col("second"))
    lead = F.greatest(F.lit(0.0), leader - rival)
    strength = c.margin_weight * F.least(F.lit(1.0), lead / c.margin_full) + (1 - c.margin_weight) * leader
    confidence = strength * (c.coverage_floor + (1 - c.coverage_floor) * F.col("coverage"))
    focus = F.when(F.exists("codes", lambda x: x.startswith("ATTACK_")), attack["hypothesis"])
    action = F.when(state == "GREEN", ACTIONS["GREEN"]).when(state == "RED", ACTIONS["RED"]).otherwise(ACTIONS["AMBER"])
    name = F.when(red, attack["hypothesis"]).when(none, "INCONCLUSIVE").otherwise(top["hypothesis"])
    return d.select(
        "case_id", state.alias("state"), action.alias("action"), percent(attack["support"]).alias("risk"), percent(confidence).alias("confidence"), percent(F.col("coverage")).alias("coverage"),
        name.alias("top_hypothesis"), focus.alias("focus"), lead.alias("decision_margin"), "codes", attack["support"].alias("attack_support"), attack["hypothesis"].alias("attack"),
        top["support"].alias("top_support"), margin.alias("margin"), F.col("coverage").alias("coverage_share"), F.col("minor.contradicting").alias("minor"),
    )


def select_origins(g: Graph, decisions: DataFrame, config: AssuranceConfig | None = None, origins: DataFrame | None = None) -> DataFrame:
    """case_id, origin and what it explains: the best node of a type that the focus admits, if it explains enough, else the best of all."""
    c = config or AssuranceConfig()
    o = lineage.candidate_origins(g) if origins is None else origins
    fits = F.lit(False)
    for hypothesis, types in dims.ORIGIN_TYPES.items():
        if types:
            fits = F.when(F.col("focus") == hypothesis, F.col("node_type").isin(*types)).otherwise(fits)
    j = o.join(decisions.filter("focus is not null").select("case_id", "focus"), "case_id").withColumn("fits", fits)
    row = F.struct("node_id", "node_type", "label", "fraction", "n_evidence", "stages", "n_detectors")
    first = j.groupBy("case_id").agg(F.min_by(row, F.when(F.col("fits") & (F.col("fraction") >= c.origin_min_fraction), F.col("rank"))).alias("scoped"), F.min_by(row, "rank").alias("any"))
    return first.select("case_id", F.coalesce("scoped", "any").alias("o")).select("case_id", F.col("o.node_id").alias("origin"), "o.node_type", "o.label", "o.fraction", "o.n_evidence", "o.stages", "o.n_detectors")


@dataclass(frozen=True)
class Investigation:
    graph: Graph
    scores: DataFrame
    context: DataFrame
    decisions: DataFrame
    candidates: DataFrame
    origins: DataFrame
    fusion_config: FusionConfig
    config: AssuranceConfig


def investigate(g: Graph, fusion_config: FusionConfig | None = None, config: AssuranceConfig | None = None) -> Investigation:
    """All tables of an investigation of every case. Scores, context and candidates are kept as tables."""
    fcfg, cfg = fusion_config or FusionConfig(), config or AssuranceConfig()
    fused = fusion.fuse(g, fcfg)
    d = decide(fused.scores, fused.context, cfg)
    candidates = cut(lineage.candidate_origins(g))
    return Investigation(g, fused.scores, fused.context, d, candidates, select_origins(g, d, cfg, candidates), fcfg, cfg)


# --- reports: the few rows of one case, as text ---------------------------------------------------------------------------


def _and(items: list[str]) -> str:
    return items[0] if len(items) == 1 else ", ".join(items[:-1]) + " and " + items[-1] if items else ""


def _many(n: int, word: str) -> str:
    return f"{n} {word}" + ("" if n == 1 else "s")


def report(inv: Investigation, case_id: str) -> dict:
    """The report of one case. Collects that case's rows only."""
    of = lambda df: df.filter(F.col("case_id") == case_id)
    g, cfg = inv.graph, inv.config
    d = of(inv.decisions).first()
    if d is None:
        raise KeyError(case_id)
    scores = sorted(of(inv.scores).collect(), key=lambda r: r["rank"])
    ctx = of(inv.context).first()
    by = {s["hypothesis"]: s for s in scores}
    origin = of(inv.origins).first()
    target = of(g.nodes).filter(F.col("node_id") == (origin["origin"] if origin else "")).select("case_id", F.col("node_id").alias("origin"), "node_id")
    path = lineage.attack_paths(g, target.select("case_id", "origin")).first() if origin else None
    leading = of(inv.candidates).filter(F.col("rank") <= cfg.top_origins).orderBy("rank").collect()
    named = target.select("case_id", "node_id").union(of(inv.candidates).filter(F.col("rank") <= cfg.top_origins).select("case_id", "node_id"))
    ids = {r["node_id"]: list(r["evidence_ids"]) for r in lineage.converging(g, named).collect()}
    labels = {r["node_id"]: r["label"] for r in of(g.nodes).collect()}
    below = sorted(lineage.downstream(g, target).collect(), key=lambda r: (r["dist"], r["found"])) if origin else []
    reasons = _reasons(d, by, ctx, cfg)
    advice = _advice(d, origin, labels, below)
    top = by.get(d["top_hypothesis"])
    return {
        "assurance_state": d["state"], "risk_score": d["risk"], "confidence": d["confidence"], "coverage": d["coverage"], "top_hypothesis": d["top_hypothesis"],
        "implicated_source": origin["origin"] if origin else None, "implicated_source_label": origin["label"] if origin else None, "implicated_source_type": origin["node_type"] if origin else None,
        "origin_explained_fraction": origin["fraction"] if origin else 0.0, "attack_path": list(path["nodes"]) if path else [], "attack_path_edges": [e.split("->") for e in path["edges"]] if path else [],
        "attack_path_evidence_nodes": list(path["evidence_nodes"]) if path else [], "converging_evidence": ids.get(origin["origin"], []) if origin else [],
        "human_readable_summary": _summary(d, by, scores, ctx, origin, reasons, advice, cfg), "recommended_action": d["action"], "top_hypothesis_support": top["support"] if top else 0.0,
        "supporting_evidence": list(top["supporting"] or []) if top else [],
        "hypotheses": [{"hypothesis": s["hypothesis"], "support": round(s["support"], 4), "level": s["level"], "supporting_evidence": list(s["supporting"] or []), "contradicting_evidence": list(s["contradicting"] or [])} for s in scores],
        "origin_candidates": [r.asDict() | {"evidence_ids": ids.get(r["node_id"], [])} for r in leading],
        "integrity_checks": {name: next(k["status"] for k in ctx["checks"] if k["check"] == name) for name in dims.CHECKS}, "decision_margin": d["decision_margin"],
        "reason_codes": list(d["codes"]), "reasons": reasons, "warnings": warnings(inv, case_id),
    }


def _reasons(d, by, ctx, cfg: AssuranceConfig) -> list[str]:
    phrase, attack = dims.PHRASES, d["attack"]
    gaps = ctx["gaps"] or []
    minor = list(d["minor"] or [])
    tail = f"{_many(len(minor), 'minor anomaly')} recorded ({', '.join(minor[:5])}), none material" if minor else "no integrity evidence against it"
    said = {
        "ATTACK_HIGH": lambda: f"{phrase[attack]} has support {d['attack_support']:.2f}, at or above the RED threshold of {cfg.red_support:.2f}",
        "ATTACK_MODERATE": lambda: f"{phrase[attack]} has moderate support ({d['attack_support']:.2f}), above the review threshold {cfg.amber_attack_support:.2f} but below the RED threshold {cfg.red_support:.2f}",
        "ATTACK_LOW": lambda: f"{phrase[d['top_hypothesis']]} is the leading hypothesis but with low support ({d['top_support']:.2f})",
        "BENIGN_SHIFT": lambda: f"a benign distribution shift is the most supported explanation ({d['top_support']:.2f}); attack hypotheses are suppressed by passing integrity checks",
        "INCONCLUSIVE": lambda: "no hypothesis has positive support: the pipeline is effectively uninspected, so no conclusion can be drawn",
        "LOW_COVERAGE": lambda: f"only {d['coverage_share']:.0%} of key pipeline nodes were inspected ({cfg.green_min_coverage:.0%} needed to accept)",
        "PROVENANCE_GAPS": lambda: f"{_many(len(gaps), 'broken provenance link')} (e.g. {gaps[0]['node_id']}: {gaps[0]['issue']})",
        "CLEAN_NOT_DECISIVE": lambda: f"CLEAN leads by only {d['margin']:.2f} ({cfg.green_min_margin:.2f} needed to accept)",
        "CLEAN_CONFIRMED": lambda: f"a clean pipeline is the most supported explanation ({d['top_support']:.2f}, margin {d['margin']:.2f}) with {d['coverage_share']:.0%} inspection coverage and {tail}",
    }
    return [said[code]() for code in d["codes"]]


def _advice(d, origin, labels: dict, below: list) -> str:
    red, codes = d["state"] == "RED", set(d["codes"])
    if d["state"] == "GREEN":
        return "accept the pipeline and continue routine monitoring"
    if d["focus"] and origin:
        name = origin["label"]
        runs = [labels[r["found"]] for r in below if r["found_type"] == "TRAINING_RUN"]
        models = [name] if origin["node_type"] == "MODEL" else [labels[r["found"]] for r in below if r["found_type"] == "MODEL"]
        hold = "do not deploy" if red else "hold deployment of"
        if d["focus"] == dims.SUBSTITUTION:
            return f"{hold} {_and(models) or name} and verify its artifact hash against the authorized registry; re-provision from a trusted source"
        if d["focus"] == dims.TAMPERING:
            return f"{'isolate' if red else 'inspect'} {name}, then audit the prediction passports, signing keys and deployment configuration behind it"
        if dims.STAGE_OF[origin["node_type"]] != "data":
            return f"{hold} {_and(models) or name}; trace and audit the training data that produced it"
        steps = [f"quarantine {name}", *([f"review {_and(runs)}"] if runs else [])] if red else [f"review {_and([name, *runs])}"]
        return "; ".join([*steps, *([f"{hold} {_and(models)}"] if models else [])])
    if "BENIGN_SHIFT" in codes:
        return "confirm the environment change (sensor, lighting, season), then re-validate and if needed recalibrate or fine-tune the model; no quarantine is indicated"
    if codes & {"INCONCLUSIVE", "LOW_COVERAGE"}:
        return "run the missing detectors on the uninspected stages and re-run the investigation before deployment"
    if "PROVENANCE_GAPS" in codes:
        return "restore the missing provenance records before relying on this pipeline"
    return "gather more evidence before deciding; the clean verdict is not yet decisive"


def _summary(d, by, scores, ctx, origin, reasons: list[str], advice: str, cfg: AssuranceConfig) -> str:
    head, tail = f"{d['state']} ({d['action']}).", f"Recommended action: {advice}."
    cov, codes, phrase = d["coverage_share"], d["codes"], dims.PHRASES
    low = 0 < cov < cfg.green_min_coverage and d["state"] != "GREEN" and "LOW_COVERAGE" not in codes
    if low:
        tail += f" Note: only {cov:.0%} of key pipeline nodes were inspected."
    first_up = lambda s: s[:1].upper() + s[1:]
    if d["focus"]:
        focus = by[d["focus"]]
        if d["state"] == "RED":
            text = f"Most supported explanation: {phrase[d['focus']]} (support {focus['support']:.2f})"
            also = [s for s in scores if s["is_attack"] and s["hypothesis"] != d["focus"] and s["level"] == "HIGH"]
            if also:
                text += f"; {_and([f'{phrase[s["hypothesis"]]} ({s["support"]:.2f})' for s in also])} {'is' if len(also) == 1 else 'are'} also strongly supported"
                if origin and dims.STAGE_OF[origin["node_type"]] == "data" and {d["focus"], also[0]["hypothesis"]} == {dims.POISONING, dims.BACKDOOR}:
                    text += ", consistent with a dataset-originated compromise"
        else:
            text = f"{phrase[d['focus']].capitalize()} has {'moderate' if 'ATTACK_MODERATE' in codes else 'low'} support ({focus['support']:.2f}), not enough to quarantine but enough to review"
        if origin:
            n, stages = origin["n_evidence"], list(origin["stages"])
            text += f". {_many(n, 'evidence item')} from {_many(origin['n_detectors'], 'detector')} across the {_and(stages)} stage{'' if len(stages) == 1 else 's'} converge{'s' if n == 1 else ''} on {origin['label']} ({origin['fraction']:.0%} of observed anomaly weight)"
        return f"{head} {text}. {tail}"
    if "BENIGN_SHIFT" in codes:
        named = lambda status: [name.replace("_", " ") for name in dims.CHECKS if any(k["check"] == name and k["status"] == status for k in ctx["checks"])]
        text = f"Observed anomalies are best explained by a benign distribution shift (support {by[dims.SHIFT]['support']:.2f})"
        text += f"; {_and(named('PASS'))} checks passed" if named("PASS") else ""
        text += f", but {_and(named('UNKNOWN'))} could not be verified" if named("UNKNOWN") else ""
        return f"{head} {text}. {tail}"
    if "INCONCLUSIVE" in codes:
        return f"{head} Insufficient evidence to assess this pipeline: nothing has been inspected ({cov:.0%} coverage), so absence of anomalies proves nothing. Recommended action: {advice}."
    return f"{head} {first_up('; '.join(reasons) if d['state'] != 'GREEN' else reasons[0])}. {tail}"


def warning_rows(g: Graph, config: FusionConfig | None = None) -> DataFrame:
    """case_id, ord, subject, message of everything that weakens a case's report."""
    config = config or FusionConfig()
    gaps = lineage.provenance_gaps(g).select("case_id", F.lit(0).alias("ord"), F.col("node_id").alias("subject"), F.concat(F.lit("provenance gap at "), "node_id", F.lit(": "), "issue").alias("message"))
    checks = fusion.check_status(g, config).filter("status = 'UNKNOWN'")
    place = F.array_position(F.array(*map(F.lit, dims.CHECKS)), F.col("check")).cast("string")
    checks = checks.select("case_id", F.lit(1), place, F.concat(F.lit("integrity check '"), "check", F.lit("' is unverified (detectors not run: "), F.array_join("missing_detectors", ", "), F.lit(")")))
    seen = g.inspected.select("case_id", "node_id").distinct().withColumn("seen", F.lit(1))
    n = g.nodes.filter(F.col("node_type").isin(*dims.COVERED)).join(seen, ["case_id", "node_id"], "left")
    per = n.groupBy("case_id", "node_type").agg(F.count("*").alias("all"), F.array_sort(F.collect_list(F.when(F.col("seen").isNull(), F.col("node_id")))).alias("missing")).filter("size(missing) > 0")
    k = F.size("missing")
    shown = F.concat(F.array_join(F.slice("missing", 1, 5), ", "), F.when(k > 5, F.concat(F.lit(" (+"), (k - 5).cast("string"), F.lit(" more)"))).otherwise(""))
    place = F.array_position(F.array(*map(F.lit, dims.COVERED)), F.col("node_type")).cast("string")
    per = per.select("case_id", F.lit(2), place, F.concat(k.cast("string"), F.lit("/"), F.col("all").cast("string"), F.lit(" "), "node_type", F.lit(" nodes not inspected: "), shown))
    present = g.nodes.groupBy("case_id").agg(F.collect_set(lineage.stage_of(F.col("node_type"))).alias("st"))
    absent = present.select("case_id", F.posexplode(F.array(*map(F.lit, dims.STAGES))).alias("at", "stage"), "st").filter("not array_contains(st, stage)")
    absent = absent.select("case_id", F.lit(3), F.col("at").cast("string"), F.concat(F.lit("no "), "stage", F.lit("-stage nodes registered; that stage was not assessed")))
    odd = g.weighted.filter(~F.col("evidence_type").isin(*config.coefficients)).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("evidence_type")), ", ").alias("t"))
    odd = odd.select("case_id", F.lit(4), F.lit(""), F.concat(F.lit("evidence types ignored by fusion (no evidence-map row): "), "t"))
    return gaps.union(checks).union(per).union(absent).union(odd)


def warnings(inv: Investigation, case_id: str) -> list[str]:
    rows = warning_rows(inv.graph, inv.fusion_config).filter(F.col("case_id") == case_id).collect()
    return [r["message"] for r in sorted(rows, key=lambda r: (r["ord"], r["subject"]))]
