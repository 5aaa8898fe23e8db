"""Lifecycle graphs of many cases as tables, and the queries on them.

A Graph holds nodes(case_id, node_id, node_type, label), edges(case_id, src, dst, edge_type), evidence(case_id, evidence_id,
source_id, evidence_type, severity, confidence, detector) and inspections(case_id, node_id, detector). Every operator works on all
cases at once; case_id is part of every key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.plans import dims
from plumbline.sources.storage import cut

NODES = "case_id string, node_id string, node_type string, label string"
EDGES = "case_id string, src string, dst string, edge_type string"
EVIDENCE = "case_id string, evidence_id string, source_id string, evidence_type string, severity double, confidence double, detector string"
INSPECTIONS = "case_id string, node_id string, detector string"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in pairs.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def stage_of(node_type: Column) -> Column:
    return _lookup(dims.STAGE_OF, node_type)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    inspections: DataFrame
    depth: int | None = None  # longest path, where known: the closure is then one declarative plan

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @cached_property
    def closure(self) -> DataFrame:
        """Kept as a table, for nearly every operator reads it."""
        return cut(closure(self.nodes, self.edges, self.depth))

    @cached_property
    def weighted(self) -> DataFrame:
        """Evidence with stage and weight; evidence of unknown nodes is dropped."""
        n = self.nodes.select("case_id", F.col("node_id").alias("source_id"), stage_of(F.col("node_type")).alias("stage"))
        return cut(self.evidence.join(n, ["case_id", "source_id"]).withColumn("weight", F.col("severity") * F.col("confidence")))

    @cached_property
    def inspected(self) -> DataFrame:
        """(case_id, node_id, detector): recorded inspections, and evidence, which implies one."""
        both = self.inspections.select("case_id", "node_id", "detector").union(self.evidence.select("case_id", F.col("source_id").alias("node_id"), "detector"))
        return cut(both.distinct().join(self.nodes.select("case_id", "node_id"), ["case_id", "node_id"], "left_semi"))


def closure(nodes: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """case_id, anc, dst, dist (fewest hops) of every node and all that it reaches, itself included at 0.

    With a known depth this is a union of chained joins. Otherwise the frontier grows hop by hop, each new level is kept in a
    table, and pairs already known do not come back; a node that reaches itself is an error.
    """
    base = nodes.select("case_id", F.col("node_id").alias("anc"), F.col("node_id").alias("dst"), F.lit(0).alias("dist"))
    e = edges.select("case_id", F.col("src").alias("mid"), F.col("dst").alias("to")).distinct()
    front = e.select("case_id", F.col("mid").alias("anc"), F.col("to").alias("dst"), F.lit(1).alias("dist"))
    hop = lambda f, d: f.join(e, (f["case_id"] == e["case_id"]) & (f["dst"] == e["mid"])).select(f["case_id"], "anc", F.col("to").alias("dst"), F.lit(d).alias("dist")).distinct()
    if depth is not None:
        out = base.union(front)
        for d in range(2, depth + 1):
            front = hop(front, d)
            out = out.union(front)
        return out.groupBy("case_id", "anc", "dst").agg(F.min("dist").alias("dist"))
    known, d = cut(front), 1
    front = known
    while front.limit(1).count():
        if known.filter("anc = dst").limit(1).count():
            raise ValueError("the graph has a cycle")
        d += 1
        front = cut(hop(front, d).join(known, ["case_id", "anc", "dst"], "left_anti"))
        known = known.union(front)
    return base.union(known)


def upstream(g: Graph, targets: DataFrame) -> DataFrame:
    """targets(case_id, node_id) -> case_id, node_id, found, dist, found_type: all ancestors, closest first by (dist, found)."""
    c = g.closure.filter("dist > 0").withColumnsRenamed({"dst": "node_id", "anc": "found"})
    return _typed(g, c.join(targets.select("case_id", "node_id").distinct(), ["case_id", "node_id"]))


def downstream(g: Graph, targets: DataFrame) -> DataFrame:
    """The blast radius of each target."""
    c = g.closure.filter("dist > 0").withColumnsRenamed({"anc": "node_id", "dst": "found"})
    return _typed(g, c.join(targets.select("case_id", "node_id").distinct(), ["case_id", "node_id"]))


def _typed(g: Graph, c: DataFrame) -> DataFrame:
    n = g.nodes.select("case_id", F.col("node_id").alias("found"), F.col("node_type").alias("found_type"))
    return c.join(n, ["case_id", "found"]).select("case_id", "node_id", "found", "dist", "found_type")


def relation(g: Graph, pairs: DataFrame) -> DataFrame:
    """pairs(case_id, a, b) -> also kind, dist, via: a above b (UPSTREAM), below it, or under a nearest common ancestor."""
    p = pairs.select("case_id", "a", "b").distinct()
    c = g.closure
    down = c.select("case_id", F.col("anc").alias("a"), F.col("dst").alias("b"), F.col("dist").alias("d_up"))
    up = c.select("case_id", F.col("anc").alias("b"), F.col("dst").alias("a"), F.col("dist").alias("d_down"))
    p = p.join(down, ["case_id", "a", "b"], "left").join(up, ["case_id", "a", "b"], "left")
    apart = p.filter("d_up is null and d_down is null").select("case_id", "a", "b")
    ca = c.select("case_id", F.col("anc").alias("via"), F.col("dst").alias("a"), F.col("dist").alias("da"))
    cb = c.select("case_id", F.col("anc").alias("via"), F.col("dst").alias("b"), F.col("dist").alias("db"))
    best = apart.join(ca, ["case_id", "a"]).join(cb, ["case_id", "b", "via"]).groupBy("case_id", "a", "b").agg(F.min(F.struct((F.col("da") + F.col("db")).alias("d"), "via")).alias("m"))
    p = p.join(best, ["case_id", "a", "b"], "left")
    kind = F.when(F.col("a") == F.col("b"), "SAME_NODE").when(F.col("d_up").isNotNull(), "UPSTREAM").when(F.col("d_down").isNotNull(), "DOWNSTREAM").when(F.col("m").isNotNull(), "COMMON_ORIGIN").otherwise("UNRELATED")
    return p.select("case_id", "a", "b", kind.alias("kind"), F.coalesce("d_up", "d_down", "m.d").alias("dist"), F.col("m.via").alias("via"))


def related(g: Graph, sources: DataFrame) -> DataFrame:
    """sources(case_id, source_id) -> case_id, a, b, kind, dist, via of every ordered pair of them that is related (a = b too).

    Pairs come from the closure (one above the other, or ancestors in common), so unrelated sources never meet.
    """
    s = sources.select("case_id", "source_id").distinct()
    up = g.closure.join(s.withColumnRenamed("source_id", "dst"), ["case_id", "dst"])
    up = cut(up.select("case_id", "anc", F.col("dst").alias("x"), "dist"))
    y = up.select("case_id", "anc", F.col("x").alias("b"), F.col("dist").alias("db"))
    both = up.withColumnsRenamed({"x": "a", "dist": "da"}).join(y, ["case_id", "anc"])
    direct = lambda c, d: F.min(F.when(F.col("anc") == F.col(c), F.col(d)))
    p = both.groupBy("case_id", "a", "b").agg(
        direct("a", "db").alias("down"), direct("b", "da").alias("up"), F.min(F.struct((F.col("da") + F.col("db")).alias("d"), F.col("anc").alias("via"))).alias("m")
    )
    kind = F.when(F.col("a") == F.col("b"), "SAME_NODE").when(F.col("down").isNotNull(), "UPSTREAM").when(F.col("up").isNotNull(), "DOWNSTREAM").otherwise("COMMON_ORIGIN")
    return p.select("case_id", "a", "b", kind.alias("kind"), F.coalesce("down", "up", "m.d").alias("dist"), F.when(kind == "COMMON_ORIGIN", F.col("m.via")).alias("via"))


def proximity(kind: Column, dist: Column, config: dims.FusionConfig = dims.FusionConfig()) -> Column:
    near = F.pow(F.lit(config.direct_decay), dist - 1)
    return F.when(kind == "SAME_NODE", 1.0).when(kind == "UNRELATED", 0.0).when(kind == "COMMON_ORIGIN", near * config.common_discount).otherwise(near)


def correlation_pairs(g: Graph, config: dims.FusionConfig = dims.FusionConfig(), least: float = 0.0) -> DataFrame:
    """Pairs of evidence (id_a < id_b) whose sources are related, with proximity, cross_stage and same_detector.

    The relation is computed once for each distinct pair of related sources, and evidence joins its two ends.
    """
    e = g.weighted.select("case_id", "evidence_id", "source_id", "stage", "detector")
    a, b = (e.select("case_id", *[F.col(c).alias(f"{c}_{k}") for c in ("evidence_id", "source_id", "stage", "detector")]) for k in "ab")
    rel = related(g, e.select("case_id", "source_id")).withColumn("proximity", proximity(F.col("kind"), F.col("dist"), config)).filter(F.col("proximity") >= least)
    rel = rel.withColumnsRenamed({"a": "source_id_a", "b": "source_id_b"})
    p = a.join(rel, ["case_id", "source_id_a"]).join(b, ["case_id", "source_id_b"]).filter("evidence_id_a < evidence_id_b")
    return p.select(
        "case_id", F.col("evidence_id_a").alias("id_a"), F.col("evidence_id_b").alias("id_b"), "kind", "dist", "via", "proximity",
        (F.col("stage_a") != F.col("stage_b")).alias("cross_stage"), (F.col("detector_a") == F.col("detector_b")).alias("same_detector"),
        ((F.col("detector_a") == F.col("detector_b")) & (F.col("detector_a") != "unknown")).alias("one_voice"),
    )


def candidate_origins(g: Graph, node_types: tuple[str, ...] | None = None, exclude_positive: bool = False) -> DataFrame:
    """Nodes by the share of all evidence weight at or below them; ties go to the smaller blast radius, then the id."""
    ev = _without_positive(g.weighted) if exclude_positive else g.weighted
    total = ev.groupBy("case_id").agg(F.sum("weight").alias("total")).filter("total > 0")
    size = g.closure.groupBy("case_id", F.col("anc").alias("node_id")).agg(F.count("*").alias("closure_size"))
    own = ev.groupBy("case_id", "source_id", "stage", "detector").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    below = g.closure.select("case_id", F.col("anc").alias("node_id"), F.col("dst").alias("source_id")).join(own, ["case_id", "source_id"])
    held = below.groupBy("case_id", "node_id").agg(F.sum("w").alias("w"), F.sum("n").alias("n_evidence"), F.collect_set("stage").alias("st"), F.count_distinct("detector").alias("n_detectors"))
    n = g.nodes if node_types is None else g.nodes.filter(F.col("node_type").isin(*node_types))
    o = held.join(total, "case_id").join(size, ["case_id", "node_id"]).join(n, ["case_id", "node_id"])
    o = o.withColumn("fraction", F.col("w") / F.col("total"))
    stages = F.filter(F.array(*map(F.lit, dims.STAGES)), lambda s: F.array_contains("st", s))
    order = W.partitionBy("case_id").orderBy(F.desc(F.round("fraction", 9)), "closure_size", "node_id")
    return o.select("case_id", "node_id", "node_type", "label", "fraction", "closure_size", "n_evidence", stages.alias("stages"), "n_detectors", F.row_number().over(order).alias("rank"))


def converging(g: Graph, origins: DataFrame, exclude_positive: bool = False) -> DataFrame:
    """origins(case_id, node_id) -> case_id, node_id, evidence_ids at or below each: for the few nodes of a report, not for a ranking."""
    ev = _without_positive(g.weighted) if exclude_positive else g.weighted
    o = origins.select("case_id", "node_id").distinct()
    below = g.closure.select("case_id", F.col("anc").alias("node_id"), F.col("dst").alias("source_id")).join(o, ["case_id", "node_id"])
    return below.join(ev.select("case_id", "source_id", "evidence_id"), ["case_id", "source_id"]).groupBy("case_id", "node_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))


def _without_positive(ev: DataFrame) -> DataFrame:
    return ev.filter(~F.col("evidence_type").isin([t for t, row in dims.COEFFICIENTS.items() if max(row.values()) < 0]))


def provenance_gaps(g: Graph) -> DataFrame:
    """case_id, node_id, issue: nodes without any ancestor of a type that theirs requires."""
    need = F.broadcast(dims.required_upstream(g.spark))  # one row for each of five types
    n = g.nodes.join(need, "node_type")
    types = g.nodes.select("case_id", F.col("node_id").alias("anc"), F.col("node_type").alias("anc_type"))
    have = g.closure.filter("dist > 0").join(types, ["case_id", "anc"]).select("case_id", F.col("dst").alias("node_id"), "anc_type")
    ok = n.join(have, ["case_id", "node_id"]).filter(F.array_contains("needed", F.col("anc_type"))).select("case_id", "node_id")
    return n.join(ok, ["case_id", "node_id"], "left_anti").select("case_id", "node_id", "issue")


def coverage(g: Graph, node_types: tuple[str, ...] = dims.COVERED) -> DataFrame:
    """case_id, n_nodes, n_inspected, coverage over nodes of the types; 0 where a case has none."""
    seen = g.inspected.select("case_id", "node_id").distinct().withColumn("seen", F.lit(1))
    n = g.nodes.filter(F.col("node_type").isin(*node_types)).join(seen, ["case_id", "node_id"], "left")
    per = n.groupBy("case_id").agg(F.count("*").alias("n_nodes"), F.count("seen").alias("n_inspected"))
    out = g.nodes.select("case_id").distinct().join(per, "case_id", "left").na.fill(0, ["n_nodes", "n_inspected"])
    return out.withColumn("coverage", F.when(F.col("n_nodes") > 0, F.col("n_inspected") / F.col("n_nodes")).otherwise(0.0))


def evidence_for(g: Graph, targets: DataFrame, include_upstream: bool = False, include_downstream: bool = False) -> DataFrame:
    own = targets.select("case_id", "node_id", F.col("node_id").alias("source_id"))
    if include_upstream:
        own = own.union(upstream(g, targets).select("case_id", "node_id", "found"))
    if include_downstream:
        own = own.union(downstream(g, targets).select("case_id", "node_id", "found"))
    return own.distinct().join(g.weighted, ["case_id", "source_id"])


def lineage_paths(g: Graph, src: str, dst: str, limit: int = 20) -> DataFrame:
    """Simple paths between two nodes of each case as arrays, shortest first."""
    ends = g.nodes.filter(F.col("node_id").isin(src, dst)).groupBy("case_id").agg(F.lit(src).alias("src"), F.lit(dst).alias("dst"))
    return paths_between(g, ends, limit).select("case_id", "path")


def paths_between(g: Graph, ends: DataFrame, limit: int = 20) -> DataFrame:
    """ends(case_id, src, dst) -> case_id, src, dst, path of the first `limit` simple paths of each, by length and then by the nodes' ids.

    Lineage has no cycles, so of the paths of one length that reach a node only the first `limit` can begin one of the answers: a
    hop never holds more for a pair of ends and a node, however many paths there are.
    """
    step = g.edges.select("case_id", F.col("src").alias("mid"), F.col("dst").alias("to")).distinct()
    reach = g.closure.select("case_id", F.col("anc").alias("to"), "dst")
    known = g.nodes.select("case_id", F.col("node_id").alias("src"))
    front = ends.select("case_id", "src", "dst").distinct().join(known, ["case_id", "src"]).withColumn("path", F.array("src"))
    done = front.filter("src = dst")
    while True:
        last = front.filter(F.element_at("path", -1) != F.col("dst")).withColumn("mid", F.element_at("path", -1))
        more = last.join(step, ["case_id", "mid"]).join(reach, ["case_id", "to", "dst"], "left_semi").filter(~F.array_contains("path", F.col("to")))
        more = more.select("case_id", "src", "dst", "to", F.concat("path", F.array("to")).alias("path"))
        first = W.partitionBy("case_id", "src", "dst", "to").orderBy("path")
        front = cut(more.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= limit).select("case_id", "src", "dst", "path"))
        if not front.limit(1).count():
            break
        done = done.union(front.filter(F.element_at("path", -1) == F.col("dst")))
    order = W.partitionBy("case_id", "src", "dst").orderBy(F.size("path"), "path")
    return done.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit).drop("k")


def attack_paths(g: Graph, origins: DataFrame) -> DataFrame:
    """origins(case_id, origin) -> nodes, edges and evidence carriers of one shortest path to each carrier, in topological order.

    Of several shortest paths the lexicographically least predecessor is taken. The order is that of Kahn's algorithm with a heap
    over the ancestors of the path's nodes, which gives the same relative order as on the whole graph; a group of
    applyInPandas is one case's ancestor-closed subgraph.
    """
    c = g.closure
    reach = origins.join(c.withColumnRenamed("anc", "origin"), ["case_id", "origin"])
    carriers = reach.join(g.weighted.select("case_id", F.col("source_id").alias("dst")).distinct(), ["case_id", "dst"]).select("case_id", "origin", "dst", "dist")
    e = g.edges.select("case_id", F.col("src").alias("pred"), "dst")
    preds = reach.filter("dist > 0").join(e, ["case_id", "dst"]).join(reach.select("case_id", "origin", F.col("dst").alias("pred"), (F.col("dist") + 1).alias("dist")), ["case_id", "origin", "pred", "dist"])
    preds = preds.groupBy("case_id", "origin", "dst").agg(F.min("pred").alias("pred"))
    above = reach.select("case_id", "origin", F.col("dst").alias("d")).join(c.select("case_id", "anc", F.col("dst").alias("d")), ["case_id", "d"]).select("case_id", "origin", F.col("anc").alias("dst")).distinct()
    inner = above.join(e, ["case_id", "dst"]).select("case_id", "origin", F.lit("edge").alias("kind"), F.col("pred").alias("x"), F.col("dst").alias("y"))
    rows = inner.union(preds.select("case_id", "origin", F.lit("pred"), "pred", "dst")).union(carriers.select("case_id", "origin", F.lit("carrier"), "dst", "dst"))
    rows = rows.union(origins.select("case_id", "origin", F.lit("origin"), "origin", "origin"))
    return rows.groupBy("case_id", "origin").applyInPandas(_walk, "case_id string, origin string, nodes array<string>, edges array<string>, evidence_nodes array<string>")


def _walk(key, pdf):
    import pandas as pd

    case, origin = key
    kinds = {k: list(zip(p["x"], p["y"], strict=True)) for k, p in pdf.groupby("kind")}
    back = {y: x for x, y in kinds.get("pred", [])}
    carriers = {x for x, _ in kinds.get("carrier", [])}
    nodes, edges = {origin}, set()
    for at in carriers:
        while at != origin:
            nodes.add(at)
            edges.add((back[at], at))
            at = back[at]
    inner = set(kinds.get("edge", []))
    waits, after = {}, {}
    everything = nodes | {n for e in inner for n in e}
    for x, y in inner:
        waits[y] = waits.get(y, 0) + 1
        after.setdefault(x, []).append(y)
    heap, order = [n for n in everything if not waits.get(n)], {}
    heapq.heapify(heap)
    while heap:
        n = heapq.heappop(heap)
        order[n] = len(order)
        for y in after.get(n, ()):
            waits[y] -= 1
            if not waits[y]:
                heapq.heappush(heap, y)
    by = order.__getitem__
    arcs = sorted(edges, key=lambda e: (by(e[0]), by(e[1])))
    return pd.DataFrame({"case_id": [case], "origin": [origin], "nodes": [sorted(nodes, key=by)], "edges": [[f"{a}->{b}" for a, b in arcs]], "evidence_nodes": [sorted(carriers, key=by)]})


def without_nodes(g: Graph, removed: DataFrame) -> Graph:
    """removed(case_id, node_id): nodes, incident edges and own evidence go; evidence further down stays."""
    r = removed.select("case_id", "node_id").distinct()
    gone = lambda c: r.withColumnRenamed("node_id", c)
    return replace(
        g, nodes=g.nodes.join(r, ["case_id", "node_id"], "left_anti"), edges=g.edges.join(gone("src"), ["case_id", "src"], "left_anti").join(gone("dst"), ["case_id", "dst"], "left_anti").select(*g.edges.columns),
        evidence=g.evidence.join(gone("source_id"), ["case_id", "source_id"], "left_anti").select(*g.evidence.columns), inspections=g.inspections.join(r, ["case_id", "node_id"], "left_anti").select(*g.inspections.columns),
    )


def without_evidence(g: Graph, removed: DataFrame) -> Graph:
    """removed(case_id, evidence_id). The nodes still count as inspected."""
    kept = g.evidence.join(removed.select("case_id", "evidence_id").distinct(), ["case_id", "evidence_id"], "left_anti")
    return replace(g, evidence=kept.select(*g.evidence.columns), inspections=g.inspected)


def validate(g: Graph, strict: bool = True) -> DataFrame:
    """case_id, problem, subject of every fault: unknown ends, self-loops, illegal or conflicting types, bad numbers, repeated ids, cycles."""
    n = g.nodes.select("case_id", "node_id", "node_type")
    arrow = F.concat_ws("->", "src", "dst")
    ends = g.edges.join(n.select("case_id", F.col("node_id").alias("src"), F.col("node_type").alias("src_type")), ["case_id", "src"], "left").join(n.select("case_id", F.col("node_id").alias("dst"), F.col("node_type").alias("dst_type")), ["case_id", "dst"], "left")
    out = ends.filter("src_type is null or dst_type is null").select("case_id", F.lit("unknown_node").alias("problem"), arrow.alias("subject"))
    out = out.union(g.edges.filter("src = dst").select("case_id", F.lit("self_loop"), arrow))
    if strict:
        bad = ends.filter("src != dst").join(F.broadcast(dims.legal_edges(g.spark)), ["edge_type", "src_type", "dst_type"], "left_anti")
        out = out.union(bad.filter("src_type is not null and dst_type is not null").select("case_id", F.lit("illegal_edge"), arrow))
    two = g.edges.groupBy("case_id", "src", "dst").agg(F.count_distinct("edge_type").alias("k")).filter("k > 1")
    out = out.union(two.select("case_id", F.lit("conflicting_edge"), arrow))
    kinds = g.nodes.groupBy("case_id", "node_id").agg(F.count_distinct("node_type").alias("k")).filter("k > 1")
    out = out.union(kinds.select("case_id", F.lit("conflicting_node"), "node_id"))
    unit = lambda c: F.col(c).between(0.0, 1.0)  # noqa: E731  not true of NaN
    out = out.union(g.evidence.filter(~F.coalesce(unit("severity") & unit("confidence"), F.lit(False))).select("case_id", F.lit("bad_number"), "evidence_id"))
    out = out.union(g.evidence.groupBy("case_id", "evidence_id").count().filter("count > 1").select("case_id", F.lit("repeated_evidence"), "evidence_id"))
    lost = g.evidence.join(n.withColumnRenamed("node_id", "source_id"), ["case_id", "source_id"], "left_anti")
    return out.union(lost.select("case_id", F.lit("unknown_source"), "evidence_id"))


def merged(additions: DataFrame) -> DataFrame:
    """additions(case_id, node_id, node_type, label, at) of nodes, some added again -> one row for each node.

    The last label that is given holds (the id where none is). A node keeps its first type; validate() names the nodes whose types conflict.
    """
    label = F.when(F.col("label") != "", F.col("label"))
    m = additions.groupBy("case_id", "node_id").agg(F.min_by("node_type", "at").alias("node_type"), F.max_by(label, F.when(label.isNotNull(), F.col("at"))).alias("label"))
    return m.select("case_id", "node_id", "node_type", F.coalesce("label", "node_id").alias("label"))


def layout(g: Graph) -> DataFrame:
    """case_id, node_id, node_type, rank (of the stage; 0 where a type has none), position (from 1, among the case's nodes of the type by id)."""
    stage = stage_of(F.col("node_type"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, dims.STAGES)), stage) - 1, F.lit(0)).cast("int")
    place = F.row_number().over(W.partitionBy("case_id", "node_type").orderBy("node_id"))
    return g.nodes.select("case_id", "node_id", "node_type", rank.alias("rank"), place.alias("position"))


def in_display_order(rows: DataFrame) -> DataFrame:
    """Rows of layout() or export() by case, rank and id."""
    return rows.orderBy("case_id", F.coalesce("rank", F.lit(0)), F.lower("node_id"), "node_id")


def evidence_where(g: Graph, predicate: Column) -> DataFrame:
    """Evidence with stage and weight for which a condition on its columns holds."""
    return g.weighted.filter(predicate)


def by_stage(g: Graph) -> DataFrame:
    """case_id, stage, n, weight, max_severity of the evidence."""
    return g.weighted.groupBy("case_id", "stage").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.max("severity").alias("max_severity"))


def isolated(g: Graph) -> DataFrame:
    ends = g.edges.select("case_id", F.col("src").alias("node_id")).union(g.edges.select("case_id", "dst"))
    return g.nodes.join(ends, ["case_id", "node_id"], "left_anti").select("case_id", "node_id")


def export(g: Graph, highlighted: DataFrame | None = None) -> DataFrame:
    """Nodes for display: stage, rank, evidence_count, max_severity, highlighted."""
    per = g.evidence.groupBy("case_id", F.col("source_id").alias("node_id")).agg(F.count("*").alias("evidence_count"), F.max("severity").alias("max_severity"))
    n = g.nodes.join(per, ["case_id", "node_id"], "left").na.fill({"evidence_count": 0, "max_severity": 0.0})
    mark = F.lit(False)
    if highlighted is not None:
        n = n.join(highlighted.select("case_id", "node_id").distinct().withColumn("_lit", F.lit(True)), ["case_id", "node_id"], "left")
        mark = F.coalesce("_lit", F.lit(False))
    stage = stage_of(F.col("node_type"))
    rank = F.array_position(F.array(*map(F.lit, dims.STAGES)), stage) - 1
    return n.select("case_id", "node_id", "node_type", "label", stage.alias("stage"), rank.cast("int").alias("rank"), "evidence_count", "max_severity", mark.alias("highlighted"))


def to_json(g: Graph) -> DataFrame:
    """case_id, document: nodes by id, edges by (src, dst), evidence by id. Rows without a case_id are a case, too."""
    one = lambda df, name, cols: df.select("case_id", F.struct(*cols).alias(name))
    rows = one(g.nodes, "nodes", ["node_id", "node_type", "label"]).unionByName(one(g.edges, "edges", ["src", "dst", "edge_type"]), allowMissingColumns=True)
    rows = rows.unionByName(one(g.evidence, "evidence", ["evidence_id", "source_id", "evidence_type", "severity", "confidence", "detector"]), allowMissingColumns=True)
    lists = [F.array_sort(F.collect_list(name)).alias(name) for name in ("nodes", "edges", "evidence")]
    return rows.groupBy("case_id").agg(*lists).select("case_id", F.to_json(F.struct("nodes", "edges", "evidence")).alias("document"))


def from_json(documents: DataFrame, numbered: bool = True) -> Graph:
    """documents(case_id, document) with {nodes, edges, evidence} -> Graph. Evidence fields may have their older names.

    Evidence without an id gets its place in the document as one; without `numbered` it stays as it was written.
    """
    schema = (
        "nodes array<struct<node_id:string,id:string,node_type:string,type:string,label:string>>, edges array<struct<src:string,dst:string,source:string,target:string,edge_type:string,type:string>>, "
        "evidence array<struct<evidence_id:string,id:string,source_id:string,source_node_id:string,source:string,node_id:string,evidence_type:string,type:string,severity:double,confidence:double,detector:string>>"
    )
    d = documents.select("case_id", F.from_json("document", schema).alias("d"))
    rows = lambda name: d.select("case_id", F.explode(F.col("d")[name]).alias("r")).select("case_id", "r.*")
    nodes = rows("nodes").select("case_id", F.coalesce("node_id", "id").alias("node_id"), F.coalesce("node_type", "type").alias("node_type"), F.coalesce("label", "node_id", "id").alias("label"))
    edges = rows("edges").select("case_id", F.coalesce("src", "source").alias("src"), F.coalesce("dst", "target").alias("dst"), F.coalesce("edge_type", "type").alias("edge_type"))
    ev = d.select("case_id", F.posexplode(F.col("d")["evidence"]).alias("at", "r")).select("case_id", "at", "r.*")
    given = F.coalesce("evidence_id", "id")
    named = F.coalesce(F.nullif(given, F.lit("")), F.format_string("E-%05d", F.col("at") + 1)) if numbered else given
    ev = ev.select(
        "case_id", named.alias("evidence_id"), F.coalesce("source_id", "source_node_id", "source", "node_id").alias("source_id"),
        F.coalesce("evidence_type", "type").alias("evidence_type"), "severity", "confidence", F.coalesce("detector", F.lit("unknown")).alias("detector"),
    )
    none = documents.sparkSession.createDataFrame([], INSPECTIONS)
    return Graph(nodes, edges, ev, none)
