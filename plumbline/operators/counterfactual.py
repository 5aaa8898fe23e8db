"""What if a node had never existed: every scenario of every case in one plan.

A scenario is a (case, target node); its variants "original", "structural" (the node and what only existed through it are gone) and
"final" (models that would be retrained lose what they learned from it) become cases of one graph, whose ids carry scenario and
variant. Fusion and decision then run once over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import assurance, lineage
from plumbline.operators.assurance import AssuranceConfig
from plumbline.operators.lineage import Graph
from plumbline.plans.dims import STAGE_OF, FusionConfig
from plumbline.sources.storage import cut


@dataclass(frozen=True)
class CounterfactualConfig:
    simulate_retraining: bool = True
    sensitive_types: tuple[str, ...] = ("BEHAVIORAL_DEVIATION", "TRIGGER_SENSITIVITY")
    residual_weight: float = 0.15
    material: float = 1.0
    moderate: float = 10.0
    substantial: float = 30.0

    def __post_init__(self) -> None:
        if not 0 <= self.residual_weight <= 1 or not 0 <= self.material <= self.moderate <= self.substantial <= 100:
            raise ValueError("inconsistent thresholds")


SEP = "\u0001"
MANY = 1_000_000  # scenarios whose names are broadcast at most


def _spread(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each case's rows once for each of its scenarios."""
    return df.join(scenarios.select("case_id", "scenario"), "case_id").drop("case_id").withColumnRenamed("scenario", "case_id")


def removal_set(g: Graph, targets: DataFrame, nested_samples: bool | None = None) -> DataFrame:
    """targets(case_id, node_id), one for each case -> case_id, node_id of all that goes.

    A contributor takes what it contributed, a dataset what it contains, and samples go whose predecessors all went. One pass
    suffices unless samples derive from samples; then the rule is applied until nothing changes.
    """
    t = targets.join(g.nodes, ["case_id", "node_id"]).select("case_id", "node_id", "node_type")
    e = g.edges.select("case_id", F.col("src").alias("node_id"), "dst", "edge_type")
    takes = ((F.col("node_type") == "CONTRIBUTOR") & (F.col("edge_type") == "CONTRIBUTED")) | ((F.col("node_type") == "DATASET") & (F.col("edge_type") == "CONTAINS"))
    gone = t.select("case_id", "node_id").union(t.join(e, ["case_id", "node_id"]).filter(takes).select("case_id", "dst")).distinct()
    samples = g.nodes.filter("node_type = 'SAMPLE'").select("case_id", F.col("node_id").alias("dst"))
    into = e.join(samples, ["case_id", "dst"])
    if nested_samples is None:
        both = into.join(samples.withColumnRenamed("dst", "node_id"), ["case_id", "node_id"], "left_semi")
        nested_samples = both.limit(1).count() > 0
    while True:
        held = into.join(gone.withColumn("went", F.lit(1)), ["case_id", "node_id"], "left")
        more = held.groupBy("case_id", "dst").agg(F.count("*").alias("n"), F.count("went").alias("k"), F.max(F.col("went").isNotNull() & (F.col("edge_type") == "CONTAINS")).alias("by")).filter("n = k and by")
        grown = gone.union(more.select("case_id", F.col("dst").alias("node_id"))).distinct()
        if not nested_samples:
            return grown
        grown = cut(grown)
        if grown.count() == gone.count():
            return grown
        gone = grown


def _scenarios(g: Graph, targets: DataFrame | None) -> tuple[DataFrame, Graph]:
    """((case_id, node_id, scenario), the graph with each case once for each of its scenarios)."""
    targets = g.nodes.select("case_id", "node_id") if targets is None else targets.select("case_id", "node_id").distinct()
    s = targets.select("case_id", "node_id", F.concat_ws(SEP, "case_id", "node_id").alias("scenario"))
    return s, Graph(*(_spread(df, s).select(*df.columns) for df in (g.nodes, g.edges, g.evidence, g.inspections)), g.depth)


def _unnamed(df: DataFrame) -> DataFrame:
    part = F.split("case_id", SEP)
    return df.select(part[0].alias("case_id"), part[1].alias("target"), *[x for x in df.columns if x != "case_id"])


def removals(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    """case_id, target, node_id: what goes with each target (None: every node)."""
    s, whole = _scenarios(g, targets)
    return _unnamed(removal_set(whole, s.select(F.col("scenario").alias("case_id"), "node_id")))


@dataclass(frozen=True)
class Simulation:
    results: DataFrame
    removed: DataFrame
    cleared: DataFrame
    retained: DataFrame


def simulate(g: Graph, targets: DataFrame | None = None, config: CounterfactualConfig | None = None, fusion_config: FusionConfig | None = None, assurance_config: AssuranceConfig | None = None, nested_samples: bool | None = None) -> Simulation:
    """targets(case_id, node_id); None: every node. results has a row for each scenario."""
    c, acfg = config or CounterfactualConfig(), assurance_config or AssuranceConfig()
    s, whole = _scenarios(g, targets)
    aim = s.select(F.col("scenario").alias("case_id"), "node_id")
    gone = cut(removal_set(whole, aim, nested_samples))
    left = lineage.without_nodes(whole, gone)
    left = replace(left, nodes=cut(left.nodes), edges=cut(left.edges), evidence=cut(left.evidence), inspections=cut(left.inspections))

    # retraining: models below a data-stage target that survive, without remaining data evidence upstream
    data = [t for t, stage in STAGE_OF.items() if stage == "data"]
    in_data = aim.join(whole.nodes, ["case_id", "node_id"]).filter(F.col("node_type").isin(*data)).select("case_id", "node_id")
    models = lineage.downstream(whole, in_data).filter("found_type = 'MODEL'").select("case_id", F.col("found").alias("node_id"))
    models = models.join(left.nodes, ["case_id", "node_id"], "left_semi")
    ev = left.weighted
    upstream = left.closure.select("case_id", F.col("anc").alias("source_id"), F.col("dst").alias("node_id")).join(models, ["case_id", "node_id"])
    residual = upstream.join(ev.filter((F.col("stage") == "data") & (F.col("weight") >= c.residual_weight)), ["case_id", "source_id"])
    blocked = residual.select("case_id", "node_id").distinct()
    sensitive = ev.filter(F.col("evidence_type").isin(*c.sensitive_types)).select("case_id", F.col("source_id").alias("node_id"), "evidence_id").join(models, ["case_id", "node_id"])
    if not c.simulate_retraining:
        sensitive = sensitive.filter(F.lit(False))
    blocked, sensitive = cut(blocked), cut(sensitive)
    cleared = sensitive.join(blocked, ["case_id", "node_id"], "left_anti")
    retained = sensitive.join(blocked, ["case_id", "node_id"], "left_semi")
    # where nothing is cleared, the final variant is the structural one and is not decided again
    moved = F.broadcast(sized) if (sized := cut(cleared.select("case_id").distinct())).limit(MANY + 1).count() <= MANY else sized
    some = replace(left, **{t: getattr(left, t).join(moved, "case_id", "left_semi") for t in ("nodes", "edges", "evidence", "inspections")})
    final = lineage.without_evidence(some, cleared)

    # the variants side by side; the original is decided once for each case
    mark = lambda df, v: df.withColumn("case_id", F.concat_ws(SEP, "case_id", F.lit(v)))
    two = Graph(*(mark(a, "structural").unionByName(mark(b, "final")) for a, b in ((left.nodes, final.nodes), (left.edges, final.edges), (left.evidence, final.evidence), (left.inspections, final.inspections))), g.depth)
    after = _outcome(two, fusion_config, acfg).withColumn("variant", F.element_at(F.split("case_id", SEP), -1)).withColumn("case_id", F.regexp_replace("case_id", SEP + "[a-z]+$", ""))
    pick = lambda v: after.filter(F.col("variant") == v).select(F.col("case_id").alias("scenario"), *[F.col(k).alias(f"{v}_{k}") for k in ("risk", "state", "top_hypothesis", "source")])
    before = _outcome(g, fusion_config, acfg).select("case_id", *[F.col(k).alias(f"original_{k}") for k in ("risk", "state", "top_hypothesis", "source")])
    r = s.join(before, "case_id").join(pick("structural"), "scenario", "left").join(pick("final"), "scenario", "left")
    changed = F.col("final_state").isNotNull()
    r = r.withColumns({f"final_{k}": F.when(changed, F.col(f"final_{k}")).otherwise(F.col(f"structural_{k}")) for k in ("risk", "top_hypothesis", "source", "state")})
    # a scenario that leaves no node at all has nothing to decide
    r = r.na.fill({"structural_risk": 0.0, "final_risk": 0.0, "structural_state": "AMBER", "final_state": "AMBER", "structural_top_hypothesis": "INCONCLUSIVE", "final_top_hypothesis": "INCONCLUSIVE"})
    lists = lambda df, col, alias: df.groupBy(F.col("case_id").alias("scenario")).agg(F.array_sort(F.collect_set(col)).alias(alias))
    lost = _spread(g.evidence, s).join(gone.withColumnRenamed("node_id", "source_id"), ["case_id", "source_id"], "left_semi")
    for df, col, alias in ((gone, "node_id", "removed_nodes"), (lost, "evidence_id", "removed_evidence"), (cleared, "evidence_id", "cleared_evidence"), (retained, "evidence_id", "retained_evidence")):
        r = r.join(lists(df, col, alias), "scenario", "left").withColumn(alias, F.coalesce(alias, F.array().cast("array<string>")))
    delta = F.round(F.col("original_risk") - F.col("final_risk"), 1)
    effect = F.when(F.abs(delta) < c.material, "NONE").when(delta < 0, "INCREASED").when(delta >= c.substantial, "SUBSTANTIAL").when(delta >= c.moderate, "MODERATE").otherwise("SLIGHT")
    r = r.withColumns({"risk_delta": delta, "effect": effect}).withColumnRenamed("node_id", "target").drop("scenario")
    return Simulation(r.withColumn("summary", summary()), _unnamed(gone), _unnamed(cleared), _unnamed(retained))


def _outcome(g: Graph, fusion_config: FusionConfig | None, config: AssuranceConfig) -> DataFrame:
    inv = assurance.investigate(g, fusion_config, config)
    return inv.decisions.join(inv.origins.select("case_id", F.col("origin").alias("source")), "case_id", "left").select("case_id", "risk", "state", "top_hypothesis", "source")


def summary() -> F.Column:
    """The sentence of a result row."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    t, whole = F.col("target"), lambda c: F.format_string("%.0f", F.bround(c, 0))
    state = F.when(F.col("original_state") != F.col("final_state"), text("; state ", F.col("original_state"), " -> ", F.col("final_state"))).otherwise("")
    detail = text("(Risk: ", whole(F.col("original_risk")), " -> ", whole(F.col("final_risk")), state, ")")
    falls = lambda verb, tail: text("Removing ", t, " ", verb, " the observed integrity anomalies ", detail, ", ", tail, " the hypothesis that ", t, " is implicated.")
    out = (
        F.when(F.col("effect") == "NONE", text("Removing ", t, " had no material effect on the observed integrity anomalies ", detail, ", so this simulation gives no evidence that ", t, " is implicated."))
        .when(F.col("effect") == "INCREASED", text("Removing ", t, " increases the observed risk ", detail, ", which does not support the hypothesis that ", t, " is implicated."))
        .when(F.col("effect") == "SUBSTANTIAL", falls("substantially reduces", "strengthening")).when(F.col("effect") == "MODERATE", falls("reduces", "partly supporting"))
        .otherwise(text("Removing ", t, " slightly reduces the observed integrity anomalies ", detail, ", giving only weak support to the hypothesis that ", t, " is implicated."))
    )
    return F.concat(out, F.when(F.size("cleared_evidence") > 0, " This assumes the affected downstream models would be retrained without it (simulated, not measured).").otherwise(""))
