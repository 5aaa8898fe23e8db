"""Fusion of evidence into support scores for competing explanations, for all cases in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import lineage
from plumbline.operators.lineage import Graph
from plumbline.plans import dims
from plumbline.plans.dims import FusionConfig
from plumbline.sources.storage import cut


def strengths(g: Graph, config: FusionConfig) -> DataFrame:
    """Evidence with strength = reliability of its detector x severity x confidence."""
    rel = F.broadcast(dims.reliabilities(g.spark, config))  # a row for each known detector
    e = g.weighted.join(rel, "detector", "left")
    return e.withColumn("strength", F.coalesce("reliability", F.lit(config.default_reliability)) * F.col("weight"))


def signed(g: Graph, config: FusionConfig) -> DataFrame:
    """A row for each evidence and hypothesis that its type speaks for or against."""
    return strengths(g, config).join(F.broadcast(dims.coefficients(g.spark, config)), "evidence_type")  # some hundred rows


def base_scores(g: Graph, config: FusionConfig) -> DataFrame:
    s = signed(g, config)
    weigh = lambda sign: F.sum(F.when(F.col("coef") * sign > 0, F.col("strength") * F.abs("coef")).otherwise(0.0))
    ids = lambda sign: F.array_sort(F.collect_list(F.when(F.col("coef") * sign > 0, F.col("evidence_id"))))
    return s.groupBy("case_id", "hypothesis").agg(weigh(1).alias("base"), weigh(-1).alias("contra"), ids(1).alias("supporting"), ids(-1).alias("contradicting"))


def corroboration(g: Graph, config: FusionConfig) -> DataFrame:
    """Sum of pair bonuses by case and hypothesis.

    A bonus hangs on the two sources, stages and detectors and on sqrt(m_a * m_b), so evidence is summed to one row for each source and
    detector first, and a pair of such rows gives the product of their sums of sqrt(m): no evidence meets other evidence. Only related
    sources are paired. Detectors that are not known speak for themselves each, so a group of them has pairs of its own.
    """
    m = F.col("strength") * F.col("coef")
    s = signed(g, config).filter("coef > 0").groupBy("case_id", "hypothesis", "source_id", "stage", "detector").agg(F.sum(F.sqrt(m)).alias("root"), F.sum(m).alias("m"))
    s = cut(s)
    key = F.struct("source_id", "detector")
    a, b = (s.select("case_id", "hypothesis", *[F.col(c).alias(f"{c}_{k}") for c in ("source_id", "stage", "detector", "root")], key.alias(f"key_{k}")) for k in "ab")
    rel = lineage.related(g, s.select("case_id", "source_id").distinct()).withColumn("near", lineage.proximity(F.col("kind"), F.col("dist"), config))
    rel = rel.select("case_id", F.col("a").alias("source_id_a"), F.col("b").alias("source_id_b"), "near")
    p = a.join(rel, ["case_id", "source_id_a"]).join(b, ["case_id", "hypothesis", "source_id_b"])
    p = p.filter("key_a < key_b and (detector_a != detector_b or detector_a = 'unknown')")
    factor = F.when(F.col("stage_a") != F.col("stage_b"), 1.0).otherwise(config.same_stage)
    between = p.select("case_id", "hypothesis", (F.col("near") * factor * F.col("root_a") * F.col("root_b")).alias("bonus"))
    within = s.filter("detector = 'unknown'").select("case_id", "hypothesis", (F.lit(config.same_stage) * (F.col("root") * F.col("root") - F.col("m")) / 2).alias("bonus"))
    return between.union(within).groupBy("case_id", "hypothesis").agg((config.gain * F.sum("bonus")).alias("corr"))


def check_status(g: Graph, config: FusionConfig) -> DataFrame:
    """case_id, check, status, failing ids, detectors that did not run, of each integrity check."""
    cases = g.nodes.select("case_id").distinct()
    ran = g.inspected.groupBy("case_id").agg(F.collect_set("detector").alias("ran"))
    bad = g.weighted.filter(F.col("weight") >= config.fail_weight).select("case_id", "evidence_id", "evidence_type")
    k = F.broadcast(dims.checks(g.spark))  # four rows
    hits = bad.join(k, F.array_contains("failing", F.col("evidence_type"))).groupBy("case_id", "check").agg(F.array_sort(F.collect_list("evidence_id")).alias("failed_by"))
    c = cases.join(ran, "case_id", "left").crossJoin(k).join(hits, ["case_id", "check"], "left")
    missing = F.array_except("needed", F.coalesce("ran", F.array().cast("array<string>")))
    status = F.when(F.col("failed_by").isNotNull(), "FAIL").when(F.size(missing) > 0, "UNKNOWN").otherwise("PASS")
    return c.select("case_id", "check", status.alias("status"), "failed_by", F.when(status == "UNKNOWN", missing).alias("missing_detectors"))


def context(g: Graph, config: FusionConfig) -> DataFrame:
    """One row for each case: coverage, gaps, passed and failed checks, shift signal, unmapped evidence types."""
    gaps = lineage.provenance_gaps(g).groupBy("case_id").agg(F.count("*").alias("n_gaps"), F.array_sort(F.collect_list(F.struct("node_id", "issue"))).alias("gaps"))
    checks = check_status(g, config).groupBy("case_id").agg(F.count_if(F.col("status") == "PASS").alias("n_pass"), F.count_if(F.col("status") == "FAIL").alias("n_fail"), F.sort_array(F.collect_list(F.struct("check", "status", "missing_detectors"))).alias("checks"))
    s = strengths(g, config)
    shift = s.groupBy("case_id").agg(
        F.sum(F.when(F.col("evidence_type").isin(*dims.SHIFT_SIGNALS), F.col("strength")).otherwise(0.0)).alias("shift_signal"),
        F.array_sort(F.collect_set(F.when(~F.col("evidence_type").isin(*config.coefficients), F.col("evidence_type")))).alias("unmapped"),
    )
    out = lineage.coverage(g).join(gaps, "case_id", "left").join(checks, "case_id", "left").join(shift, "case_id", "left")
    return out.na.fill(0, ["n_gaps", "n_pass", "n_fail"]).na.fill(0.0, ["shift_signal"])


def scores(g: Graph, config: FusionConfig | None = None, ctx: DataFrame | None = None) -> DataFrame:
    """Six rows for each case: base, corr, contra, ctx, raw, support, share, level, rank, margin to the next."""
    config = config or FusionConfig()
    ctx = context(g, config) if ctx is None else ctx
    dense = ctx.crossJoin(F.broadcast(dims.hypotheses(g.spark)))  # six rows
    j = dense.join(base_scores(g, config), ["case_id", "hypothesis"], "left").join(corroboration(g, config), ["case_id", "hypothesis"], "left")
    j = j.na.fill(0.0, ["base", "contra", "corr"])
    clean = F.col("hypothesis") == dims.CLEAN
    base = F.when(clean, config.clean_prior * F.col("coverage")).otherwise(F.col("base"))
    contra = F.when(clean, config.clean_contradiction * F.col("contra") + config.gap_penalty * F.col("n_gaps")).otherwise(F.col("contra"))
    corr = F.when(clean, 0.0).otherwise(F.least("corr", config.corroboration_cap * F.col("base")))
    scale = F.when((F.col("shift_signal") > 0) & (F.col("n_fail") == 0), F.col("n_pass") / len(dims.CHECKS)).otherwise(0.0)
    push = F.when(F.col("hypothesis") == dims.SHIFT, 1.0).when(F.col("is_attack"), -1.0).otherwise(0.0) * F.col("shift_signal") * scale
    j = j.select("case_id", "hypothesis", "ord", "is_attack", base.alias("base"), corr.alias("corr"), contra.alias("contra"), push.alias("ctx"), "supporting", "contradicting")
    j = j.withColumn("raw", F.greatest(F.lit(0.0), F.col("base") + F.col("corr") - F.col("contra") + F.col("ctx")))
    j = j.withColumn("support", 1 - F.exp(-F.col("raw") / config.saturation))
    whole = W.partitionBy("case_id")
    order = whole.orderBy(F.desc("support"), F.desc("raw"), "ord")
    level = F.when(F.col("support") >= config.high, "HIGH").when(F.col("support") >= config.medium, "MEDIUM").otherwise("LOW")
    share = F.coalesce(F.col("raw") / F.nullif(F.sum("raw").over(whole), F.lit(0.0)), F.lit(0.0))
    return j.withColumns({"level": level, "share": share, "rank": F.row_number().over(order), "margin": F.col("support") - F.coalesce(F.lead("support").over(order), F.lit(0.0))})


@dataclass(frozen=True)
class Fused:
    scores: DataFrame
    context: DataFrame


def fuse(g: Graph, config: FusionConfig | None = None) -> Fused:
    config = config or FusionConfig()
    ctx = cut(context(g, config))
    return Fused(cut(scores(g, config, ctx)), ctx)
