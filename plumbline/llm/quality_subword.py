"""Document quality by supervised subword embeddings.

Words, pairs of words and character n-grams are hashed to rows of an embedding matrix; a document is the average of its
rows, and a softmax over two classes gives the score of class 1. Matrix and softmax are trained together by numpy
stochastic gradient descent on a bounded sample of labelled documents (SAMPLE_ROWS, SAMPLE_BYTES; whole texts, taken by
a hash of doc_id, so any part of the corpus is equally likely). Everything else covers every whole text.

Besides plain hashes there are relation n-grams that no vocabulary can hold: "this word is the one k before it" for
small k, and "these three words stood in this document before". They get rows of the matrix like any other n-gram.

Scoring is linear until the softmax, so the trained matrix is folded to one number for each row before it is sent to the
executors: the broadcast is BUCKETS * 4 bytes whatever the corpus.

Defined cases: a null or empty text has the score of the bias alone; rows with null labels do not train; a label given
several times counts once (its smallest value); when labels hold one class only, or none, the score is that class's rate
(0.5 without labels); repeated rows are each scored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import begin, chunks, mix64, table, text_buffers, trim, word_hashes

BUCKETS = 1 << 18
RELATIONS = 16  # the last rows are kept for relation n-grams
NGRAMS = (3, 5)
DIM = 12
EPOCHS = 4
LEAST_STEPS = 8000
RATE = 0.3
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 32 << 20
THRESHOLD = 0.7
NEAR = 6  # a word is compared with so many before it


@dataclass
class Model:
    weights: np.ndarray  # one logit for each bucket
    bias: float

    def scores(self, column) -> np.ndarray:
        raw, offsets = text_buffers(column)
        out = np.full(len(column), self.bias)
        for i, j in chunks(offsets):
            total, n = np.zeros(j - i), np.zeros(j - i)
            for ids, counts in features(raw, offsets[i : j + 1]):
                at = np.concatenate(([0], np.cumsum(counts)))
                run = np.concatenate(([0.0], np.cumsum(self.weights[ids], dtype=np.float64)))
                total += run[at[1:]] - run[at[:-1]]
                n += counts
            out[i:j] += total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(BUCKETS - RELATIONS)).astype(np.int32)


def features(raw: np.ndarray, offsets: np.ndarray):
    """Yield (bucket ids in the order of the texts, number of ids of each text) for each kind of n-gram."""
    words, counts = word_hashes(raw, offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    yield _bucket(words), counts
    if len(words) > 1:
        same = doc[1:] == doc[:-1]
        yield _bucket(mix64(words[:-1] * np.uint64(3) + words[1:]))[same], np.bincount(doc[1:][same], minlength=len(counts))
    for k in range(1, NEAR + 1):
        if len(words) > k:
            hit = (words[k:] == words[:-k]) & (doc[k:] == doc[:-k])
            d = doc[k:][hit]
            yield np.full(3 * len(d), BUCKETS - RELATIONS + min(k, 2), np.int32), 3 * np.bincount(d, minlength=len(counts))
    if len(words) > 2:
        three = mix64(words[:-2] + mix64(words[1:-1] * np.uint64(5) + words[2:]) + doc[:-2].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        inside = doc[2:] == doc[:-2]
        three, d = three[inside], doc[:-2][inside]
        order = np.argsort(three, kind="stable")
        again = np.zeros(len(three), dtype=bool)
        again[order[1:]] = three[order[1:]] == three[order[:-1]]
        d = d[again]
        yield np.full(3 * len(d), BUCKETS - RELATIONS + 3, np.int32), 3 * np.bincount(d, minlength=len(counts))
    a, b = int(offsets[0]), int(offsets[-1])
    body = raw[a:b]
    lead = (body & 0xC0) != 0x80  # first bytes of characters
    ends = np.concatenate(([0], np.cumsum(lead)))[offsets - a]
    chars = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    if len(chars) != ends[-1]:
        return
    spread = (chars + np.uint32(1)) * np.uint32(2654435761)
    spread ^= spread >> np.uint32(15)
    for n in NGRAMS:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h = spread[:m].copy()
        for k in range(1, n):
            h *= np.uint32(0x85EBCA6B)
            h += spread[k : k + m]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0xC2B2AE35 + 2 * n)
        ids = ((h >> np.uint32(12)) % np.uint32(BUCKETS - RELATIONS)).astype(np.int32)
        lengths = np.maximum(np.diff(ends) - n + 1, 0)
        if len(lengths) > 1:  # n-grams do not reach over the end of a text
            mask = np.zeros(m + 1, dtype=np.int32)
            some = lengths > 0
            np.add.at(mask, ends[:-1][some], 1)
            np.add.at(mask, ends[:-1][some] + lengths[some], -1)
            ids = ids[np.cumsum(mask[:m]) > 0]
        yield ids, lengths


def train(texts: list[str], labels: list[int], seed: int = 42) -> Model:
    """Stochastic gradient descent over single documents, on embeddings (BUCKETS x DIM) and the softmax layer."""
    import pyarrow as pa

    y_all = np.array(labels, dtype=int)
    if len(set(labels)) < 2:
        rate = float(y_all.mean()) if len(y_all) else 0.5
        rate = min(max(rate, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate))))
    docs = []
    for t in texts:
        raw, offsets = text_buffers(pa.array([t or ""], pa.string()))
        found = [ids for ids, _ in features(raw, offsets)]
        ids, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0))
        docs.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    top, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(docs)))
    steps, at = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, part = docs[k]
            rate, at = RATE * (1 - at / steps), at + 1
            x = part @ emb[ids]
            z = x @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y_all[k]] -= 1
            back = top @ p
            top -= rate * np.outer(x, p)
            bias -= rate * p
            # the gradient of an average is spread over all its rows; 1 / sum(part^2) keeps the document's step at rate
            emb[ids] -= np.outer(part * (rate / max(float(part @ part), 1e-3)), back)
    fold = top[:, 1] - top[:, 0]
    return Model((emb @ fold).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most so many rows and bytes, in the order of a hash of doc_id; a doc_id whose texts don't fit is passed over."""
    import pyarrow as pa

    once = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_y"))
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("_n"))  # texts stay out of the join
    order = F.xxhash64(F.lit(7), F.col("doc_id"))
    first = sized.join(once, "doc_id").select("doc_id", "_n", "_y", order.alias("_h")).orderBy("_h", "doc_id", "_n").limit(rows).collect()
    chosen, total = {}, 0
    for i, same in itertools.groupby(first, lambda r: r["doc_id"]):
        same = list(same)
        n = sum(r["_n"] for r in same)
        if total + n > size:
            continue
        total += n
        chosen[i] = int(same[0]["_y"] > 0)
    if not chosen:
        return [], []
    ids = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(chosen, pa.int64())}))  # rows of them at most; a list of rows would go through Python workers of their own
    got = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).collect()
    got = sorted((r["doc_id"], r["_t"]) for r in got)
    return [t for _, t in got], [chosen[i] for i, _ in got]


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def scorer(spark: SparkSession, model: Model):
    """A function of text columns: the score of each text."""
    from collections.abc import Iterator

    import pyarrow as pa

    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    def run(columns):
        begin("quality")
        m = Model(*shared.value)
        for texts in columns:
            yield pa.array(m.scores(texts))
        trim()

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Labels of held-out documents are never read."""
    keep = ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = train(*sample(docs, labels.filter(keep)))
    trim()  # of the driver's Python: the sample and the embeddings are done with
    return model


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more."""
    return docs.filter(scorer(docs.sparkSession, fit(docs, labels))(F.col("text")) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = docs.withColumn("score", scorer(spark, fit(docs, table(spark, sf_dir, "labels")))(F.col("text")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
