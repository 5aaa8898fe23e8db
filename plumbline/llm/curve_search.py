"""Approximate nearest neighbours by shifted space-filling curves.

Each of ORDERS orderings projects the vectors to DIMS dimensions by its own random rotation, turns the coordinates into
quantiles, shifts them by its own offset and takes the Hilbert key of BITS bits a dimension. A key range (block) of an
ordering is a task's unit: blocks have about BLOCK vectors, and a block of more than twice that, as in tables beyond what the
sample can cut, is dealt to several tasks by a hash, each of which sees all of the block's queries. A query goes to its own block and the neighbouring ones that make
up REACH of the ordering, is multiplied with their vectors, and the best of every block are merged over blocks and
orderings and ranked by the exact cosine in double precision of the original vectors.

REACH is a share of the ordering, not a number of rows: vectors without cluster structure have no small neighbourhoods on any
curve, and a window of fixed size would lose recall as tables grow. Where vectors do cluster, REACH can be lowered.

Quantiles and block limits are fitted on SAMPLE vectors at most; every vector is indexed. Equal vectors are one
index entry that carries its K + 1 smallest ids, so a very common vector costs what any vector costs, and ties go
to the smaller ids as demanded. The smallest ids of a vector are found by a window limit that Spark applies before
the shuffle too.

Defined cases: vectors null, empty, zero, or with null or non-finite components take no part, nor do rows without vec_id;
vectors of different lengths are searched apart; rows that repeat id and vector count once; ties go to the smaller vec_id; a
query with fewer than K candidates returns them all; other columns, of whatever name, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import begin, table, written

ORDERS, DIMS, BITS = 16, 8, 6
BLOCK, MOST_BLOCKS = 2048, 2048
REACH = 0.075
SAMPLE = 20_000
K = 5


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n x dims, each below 2^bits): the curve's Gray code is undone bit by bit, all points at once."""
    axes = [points[:, d].astype(np.uint64) for d in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for d in range(len(axes)):
            on = (axes[d] & bit) != 0
            swap = np.where(on, np.uint64(0), (axes[0] ^ axes[d]) & low)
            axes[0] = np.where(on, axes[0] ^ low, axes[0] ^ swap)
            if d:
                axes[d] = axes[d] ^ swap
    for d in range(1, len(axes)):
        axes[d] = axes[d] ^ axes[d - 1]
    flip = np.zeros(len(points), dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        flip = np.where((axes[-1] & np.uint64(1 << level)) != 0, flip ^ np.uint64((1 << level) - 1), flip)
    key = np.zeros(len(points), dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << np.uint64(1)) | (((a ^ flip) >> np.uint64(level)) & np.uint64(1))
    return key.astype(np.int64)


class Orderings:
    """Rotations, shifts, quantiles and block limits for vectors of one length."""

    def __init__(self, sample: np.ndarray, n: int, orders: int = ORDERS, seed: int = 20):
        dim = sample.shape[1]
        rng = np.random.default_rng([seed, dim])
        unit = _unit(sample)
        self.blocks = max(1, min(-(-n // BLOCK), MOST_BLOCKS, max(1, len(sample) // 4)))
        self.salts = max(1, -(-n // (2 * BLOCK * self.blocks)))  # of a block that is larger than a task should hold
        self.turns = [np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :DIMS] for _ in range(orders)]
        self.shifts = rng.random((orders, min(dim, DIMS)))
        at = np.linspace(0, 1, 258)[1:-1]
        self.marks = [np.quantile(unit @ t, at, axis=0) for t in self.turns]
        self.limits = []
        for o in range(orders):
            keys = np.sort(self.keys(unit, o))
            self.limits.append(keys[(np.arange(1, self.blocks) * len(keys)) // self.blocks])

    def keys(self, unit: np.ndarray, o: int) -> np.ndarray:
        """Key of each unit vector; the last bits are a hash, so that vectors of one cell can lie in several blocks."""
        z = unit @ self.turns[o]
        where = np.stack([np.searchsorted(self.marks[o][:, d], z[:, d]) / 257 for d in range(z.shape[1])], axis=1)
        cell = np.minimum((where + self.shifts[o]) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
        tie = (np.abs(unit @ np.cos(np.arange(unit.shape[1]) * 12.9898)) * 1e6).astype(np.int64) & 0x7FFF
        return (hilbert_keys(cell, BITS) << 15) | tie

    def block(self, unit: np.ndarray, o: int) -> np.ndarray:
        return np.searchsorted(self.limits[o], self.keys(unit, o), side="right")

    def window(self, block: int, reach: float) -> range:
        """The blocks that a query of this block visits; at an end of the ordering the window moves inwards."""
        wide = min(self.blocks, 2 * int(np.ceil(reach / 2 * self.blocks)) + 1)
        first = min(max(0, block - wide // 2), self.blocks - wide)
        return range(first, first + wide)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of pairs of rows in double precision; components are added in their order, so equal pairs get equal results.

    Rows are scaled by powers of two first, which changes no digit but keeps squares of huge and tiny components in range."""
    x, y = (a * np.exp2(-np.frexp(np.abs(a).max(axis=1, initial=0))[1].astype(float))[:, None] for a in (x, y))
    dot, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for d in range(x.shape[1]):
        dot, xx, yy = dot + x[:, d] * y[:, d], xx + x[:, d] * x[:, d], yy + y[:, d] * y[:, d]
    return dot / (np.sqrt(xx) * np.sqrt(yy))


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """vectors(vec_id, embedding) -> v, embedding, ids (the smallest `keep`), one row for each distinct vector that takes part."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    fine = fine.filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda x: x != 0))
    fine = fine.withColumn("embedding", F.transform(e, lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0
    fine = fine.withColumn("v", F.xxhash64("embedding"))
    least = W.partitionBy("v").orderBy("vec_id")
    once = fine.withColumn("k", F.dense_rank().over(least)).filter(F.col("k") <= keep)
    return once.groupBy("v").agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_set("vec_id")).alias("ids"))


def search(vectors: DataFrame, query_ids: DataFrame, k: int = K, reach: float = REACH, orders: int = ORDERS) -> DataFrame:
    """vectors(vec_id, embedding), query_ids(vec_id) -> query_id, rank, vec_id, score of the k nearest found of each query."""
    spark = vectors.sparkSession
    index = written(distinct_vectors(vectors, k + 1), "vectors")
    e = F.col("embedding").cast("array<double>")
    asked = vectors.join(query_ids.distinct(), "vec_id").select(F.col("vec_id").alias("query_id"), F.xxhash64(F.transform(e, lambda x: x + F.lit(0.0))).alias("v")).distinct()
    asked = written(asked.join(index.select("v"), "v", "left_semi"), "queries")
    found = None
    lengths = sorted((r[0], r[1]) for r in index.groupBy(F.size("embedding")).count().collect())  # as many rows as lengths
    for dim, n in lengths:
        own = index.filter(F.size("embedding") == dim)
        sample = own.select("embedding").orderBy(F.xxhash64("v")).limit(SAMPLE).toPandas()["embedding"] if n > BLOCK else own.select("embedding").limit(1).toPandas()["embedding"]
        plan = Orderings(np.stack(sample.to_list()), n, orders)
        part = _search_one(own, asked.select("v").distinct(), plan, orders, k, reach)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = written(found, "candidates")
    best = W.partitionBy("q").orderBy(F.desc("score"), "least")
    near = found.distinct().withColumn("k", F.row_number().over(best)).filter(F.col("k") <= k + 1)
    near = near.join(index.select("v", "ids"), "v").select("q", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.join(near, F.col("v") == F.col("q")).filter("query_id != vec_id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_one(own: DataFrame, asked: DataFrame, plan: Orderings, orders: int, k: int, reach: float) -> DataFrame:
    def deal(batches):
        """Every vector to its block of every ordering; a query also to the other blocks of its window."""
        import pandas as pd

        begin("curve search")
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["embedding"].to_list()).astype(float)
            unit, raw = _unit(x), [r.tobytes() for r in x]
            for o in range(orders):
                block = plan.block(unit, o)
                yield pd.DataFrame({"o": o, "block": block, "salt": pdf["v"].to_numpy() % plan.salts, "kind": 0, "v": pdf["v"], "least": pdf["least"], "data": raw})
                at = [(i, b, salt) for i in np.flatnonzero(pdf["asked"].to_numpy()) for b in plan.window(int(block[i]), reach) for salt in range(plan.salts)]
                if at:
                    rows, blocks, salts = zip(*at, strict=True)
                    some = pdf.iloc[list(rows)]
                    yield pd.DataFrame({"o": o, "block": blocks, "salt": salts, "kind": 1, "v": some["v"].to_numpy(), "least": some["least"].to_numpy(), "data": [raw[i] for i in rows]})

    def multiply(pdf):
        import pandas as pd

        begin("curve search")
        there, here = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        empty = pd.DataFrame({"q": [], "v": [], "least": [], "score": []})
        if not len(there) or not len(here):
            return empty
        y, x = (np.frombuffer(b"".join(p["data"]), dtype=float).reshape(len(p), -1) for p in (there, here))
        names, least, uy = there["v"].to_numpy(), there["least"].to_numpy(), _unit(y)
        out = []
        for a in range(0, len(x), 256):
            near = _unit(x[a : a + 256]) @ uy.T
            cut = np.partition(near, -min(k + 1, near.shape[1]), axis=1)[:, -min(k + 1, near.shape[1])]
            row, col = np.nonzero(near >= cut[:, None] - 1e-12)
            score = cosine(x[a + row], y[col])
            order = np.lexsort((least[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            fine = rank < k + 1
            out.append(pd.DataFrame({"q": here["v"].to_numpy()[a + row[fine]], "v": names[col[fine]], "least": least[col[fine]], "score": score[fine]}))
        return pd.concat(out) if out else empty

    vectors = own.select("v", "embedding", F.col("ids")[0].alias("least")).join(asked.withColumn("asked", F.lit(True)), "v", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    dealt = vectors.mapInPandas(deal, "o int, block int, salt long, kind int, v long, least long, data binary")
    return dealt.groupBy("o", "block", "salt").applyInPandas(multiply, "q long, v long, least long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 50 = 0").select("vec_id"))
