"""Mixing sources to target weights by the cube method.

Every source gets a target number of words: its weight's share of all words, no more than MAX_COPIES times what it has,
the excess shared anew by weight. A document of a source is taken floor(r) times for certain, r = target / source size,
and once more with probability pi = r - floor(r). The cube method turns these probabilities into decisions: the flight
moves the vector of pi through the null space of the balancing constraints (number of documents, number of words), so
that both totals stay exactly as they are while one probability after another becomes 0 or 1.

Spark-wise the flight runs in a tree. A source's documents are dealt at random to groups of GROUP units; each group ends
with two undecided units or so; those are grouped again, until a source has one group, whose last units are landed.
So no group depends on the size of a source, and balance holds exactly but for the last units of each source, which are
among its smallest as units are settled in descending size.

Defined cases: a null text has size 0; sources rank by code point, null last; rows that agree in doc_id, source and size
are one unit and share one decision; sources without words have target 0; an empty table gives no rows. The same rows
always give the same result: the random numbers come from hashes of source, group and level. Very long texts are counted whole; other
columns, of whatever name, are kept by apply_mix() and ignored by mix().
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import begin, sized_broadcast, table, trim, written

WORD = r"[^\x20\x09-\x0D]+"
GROUP = 4096
MAX_COPIES = 3
EPS = 1e-9


def fly(pi: np.ndarray, count: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase under sum(count * s) and sum(size * s): few entries of the result, mostly the smallest, lie between 0 and 1.

    Units are settled from the largest down. A step moves one unit's probability and spreads the compensation over all
    that are still open, in proportion to pi * (1 - pi), by the projection that keeps both sums; it ends at the first wall.
    """
    pi = pi.astype(float).copy()
    scale = max(float(np.abs(size).max(initial=0)), 1.0)
    order = np.argsort(-size, kind="stable")
    open_ = order[(pi[order] > EPS) & (pi[order] < 1 - EPS)]
    p, c, z = pi[open_], count[open_].astype(float), size[open_] / scale
    while len(p) > 2:
        w = p[1:] * (1 - p[1:])
        wc, wz = w * c[1:], w * z[1:]
        gram = np.array([[wc @ c[1:], wc @ z[1:]], [0.0, wz @ z[1:]]])
        gram[1, 0] = gram[0, 1]
        lead = np.array([c[0], z[0]])
        mult = np.linalg.lstsq(gram, lead, rcond=1e-12)[0]
        if np.abs(gram @ mult - lead).max() > 1e-7:  # the others cannot make up for this one: it stays open, they fly on
            pi[open_[0]] = p[0]
            open_, p, c, z = open_[1:], p[1:], c[1:], z[1:]
            continue
        u = np.concatenate(([1.0], -(mult[0] * wc + mult[1] * wz)))
        with np.errstate(divide="ignore", invalid="ignore"):
            to_one, to_zero = (1 - p) / u, -p / u
        ahead, behind = np.where(u > 0, to_one, to_zero), np.where(u > 0, to_zero, to_one)
        moving = np.abs(u) > 1e-15
        up, down = float(ahead[moving].min()), float(-behind[moving].max())
        forward = rng.random() * (up + down) < down
        wall = np.flatnonzero(moving)[int(np.argmin(ahead[moving]) if forward else np.argmax(behind[moving]))]
        p = p + (up if forward else -down) * u
        p[wall] = round(p[wall])
        shut = (p <= EPS) | (p >= 1 - EPS)
        pi[open_[shut]] = np.round(p[shut])
        keep = ~shut
        open_, p, c, z = open_[keep], p[keep], c[keep], z[keep]
    pi[open_] = p
    return pi


def land(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Landing phase: the undecided units, largest first; one is exchanged for another as long as two remain."""
    pi = pi.copy()
    left = [int(k) for k in np.argsort(-size, kind="stable") if EPS < pi[k] < 1 - EPS]
    while len(left) > 1:
        a, b = left[:2]
        up, down = min(1 - pi[a], pi[b]), min(pi[a], 1 - pi[b])
        step = up if rng.random() * (up + down) < down else -down
        pi[a], pi[b] = pi[a] + step, pi[b] - step
        left = [k for k in left if EPS < pi[k] < 1 - EPS]
    for k in left:
        pi[k] = float(rng.random() < pi[k])
    return np.round(pi)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> also weight and target. One row for each source."""
    whole = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy()
    t = sizes.withColumn("rank", F.row_number().over(whole))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    t = t.withColumn("most", F.lit(float(MAX_COPIES)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    t = t.withColumn("words", F.sum(F.col("source_size").cast("double")).over(every)).withColumn("all_weight", F.sum("weight").over(every))
    # in ascending order of most / weight, those before the first source that stays below its stop are stopped
    t = t.withColumn("before_most", F.sum("most").over(by_ratio) - F.col("most")).withColumn("before_weight", F.sum("weight").over(by_ratio) - F.col("weight"))
    t = t.withColumn("level", (F.col("words") - F.col("before_most")) / (F.col("all_weight") - F.col("before_weight")))
    t = t.withColumn("rate", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(every)["level"])
    return t.select("source", "source_size", "weight", F.least("most", F.coalesce(F.col("rate") * F.col("weight"), F.col("most"))).alias("target"))


def _flown(units: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    """One level of the tree over the undecided units; at the last level each source is a single group."""

    def run(pdf):
        begin("mix")
        pdf = pdf.sort_values(["doc_id", "size"], na_position="first", kind="stable").reset_index(drop=True)
        source, group = pdf["source"].iloc[0], int(pdf["group"].iloc[0])
        name = b"" if source is None or source != source else b"s" + source.encode()
        rng = np.random.default_rng([seed, level, group & 0xFFFFFFFF, zlib.crc32(name)])
        pi, count, size = pdf["pi"].to_numpy(float), pdf["n"].to_numpy(float), (pdf["n"] * pdf["size"]).to_numpy(float)
        pi = fly(pi, count, size, rng)
        out = pdf.assign(pi=land(pi, size, rng) if last else pi)
        trim()
        return out

    return units.groupBy("source", "group").applyInPandas(run, units.schema)


def sample_copies(sized: DataFrame, goal: DataFrame, seed: int = 42) -> DataFrame:
    """sized: doc_id, source, size. Returns each distinct row of it with source_size, target and copies."""
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    g = goal.select(F.col("source").alias("of"), "source_size", "target", F.floor(ratio).cast("int").alias("sure"), (ratio - F.floor(ratio)).alias("pi"))
    units = units.join(sized_broadcast(g), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    decided, level, before = None, 0, None
    open_ = (F.col("pi") > EPS) & (F.col("pi") < 1 - EPS)
    while True:
        count = units.filter(open_).groupBy("source").agg(F.count("*").alias("m"))
        groups = written(count.select(F.col("source").alias("of"), F.ceil(F.col("m") / GROUP).alias("groups")), f"groups-{level}")
        most, left = groups.agg(F.max("groups"), F.sum("groups")).first()
        # groups that no longer settle their units are landed as they are, so the tree always ends
        last, before = (most or 1) <= 1 or (before is not None and left > before / 2), left or 0
        flying = units.filter(open_).join(sized_broadcast(groups), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        flying = flying.withColumn("group", F.pmod(F.xxhash64(F.lit(level), h), F.col("groups"))).drop("groups")
        flown = _flown(flying, level, last, seed).drop("group")
        stay = units.filter(~open_)
        both = written(flown.unionByName(stay) if decided is None else flown, f"cube-{level}")
        done = both if last else both.filter(~open_)
        decided = done if decided is None else decided.unionByName(done)
        if last:
            return decided.withColumn("copies", (F.col("sure") + F.round("pi")).cast("int")).drop("pi", "sure", "n")
        units, level = both.filter(open_), level + 1


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row of docs (columns doc_id, source, text)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select(F.col("doc_id"), F.col("source"), size.alias("size")), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    chosen = sample_copies(sized, targets(sums, weights), seed).withColumnsRenamed({"doc_id": "id_", "source": "of", "size": "size_"})
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("size_"))
    return sized.join(chosen, same).drop("id_", "of", "size_")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 42) -> DataFrame:
    """The documents as the mix takes them: each as often as it has copies, under its own columns."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    whole = docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), F.struct(*docs.columns).alias("row"))  # one name for all other columns
    narrow = written(whole.select("doc_id", "source", "size"), "sizes")
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    chosen = sample_copies(narrow, targets(sums, weights), seed).filter("copies > 0")
    chosen = chosen.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("n"), "copies")
    chosen = sized_broadcast(written(chosen, "chosen"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("n"))
    return whole.join(chosen, same).select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
