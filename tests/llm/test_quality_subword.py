import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm import quality_subword as qs
from plumbline.llm.common import text_buffers


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    syllables = "an the er ion ou re sch ti st in".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts, labels = [], []
    for k in range(n):
        w = [word() for _ in range(rng.integers(20, 120))]
        kind = k % 6
        text = {0: " | ".join(w), 1: " ".join(x + "###" for x in w), 2: " ".join([w[0]] * len(w))}.get(kind, " ".join(w))
        texts.append(text)
        labels.append(int(kind > 2))
    return texts, labels


def test_held_out_accuracy():
    m = qs.train(*corpus(900, 1))
    texts, labels = corpus(300, 2)
    p = m.scores(pa.array(texts)) >= qs.THRESHOLD
    assert (p == np.array(labels, bool)).mean() > 0.97


def test_features_of_many_equal_those_of_one():
    texts = ["Ab cd ab cd ab cd", "", "é" * 40, "x", "one two three one two three", " lead and trail "]
    raw, offsets = text_buffers(pa.array(texts))
    whole = {}
    for kind, (ids, counts) in enumerate(qs.features(raw, offsets)):
        for k, part in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
            whole.setdefault(k, {})[kind] = sorted(part.tolist())
    m = qs.train(*corpus(120, 3))
    one = [float(m.scores(pa.array([t]))[0]) for t in texts]
    assert np.allclose(m.scores(pa.array(texts)), one) and len(whole[0][0]) == 6


def test_query_rules(spark):
    texts, labels = corpus(240, 4)
    docs = spark.createDataFrame([(k, t, "clash", 0.5) for k, t in enumerate(texts)] + [(None, "a b", "c", 0.1), (7000, None, "c", 0.1), (7001, "", "c", 0.1)], "doc_id long, text string, _t string, score double")
    lab = spark.createDataFrame([(k, y) for k, y in enumerate(labels)] + [(0, labels[0]), (None, 1), (9, None)], "doc_id long, quality int")
    held = {r.doc_id for r in docs.filter(qs.held_out(F.col("doc_id"))).collect()}
    import zlib

    assert held == {k for k in [*range(240), 7000, 7001] if zlib.crc32(str(k).encode()) % 4 == 2}
    flipped = lab.withColumn("quality", F.when(F.col("doc_id").isin(*held), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = qs.fit(docs, lab), qs.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias  # held-out labels are never read
    kept = qs.accepted(docs, lab)
    assert kept.columns == docs.columns
    assert qs.fit(docs.limit(0), lab).bias == 0.0 and qs.fit(docs, lab.filter("quality = 1")).bias > 5


def test_sample_passes_over_a_long_text(spark):
    ids = [r.id for r in spark.range(20).orderBy(F.xxhash64(F.lit(7), F.col("id"))).collect()]
    docs = spark.createDataFrame([(i, "x" * (1000 if k in (0, 7) else 10)) for k, i in enumerate(ids)] + [(ids[9], "y" * 1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    assert qs.sample(docs, labels, size=500) == (["x" * 10] * 17, [1] * 17)  # ids[9] has a long text too


def test_scores_equal_plain_loops():
    """Features one by one with plain loops over words and characters, the average, the logistic function."""
    import pyarrow as pa

    texts = ["one two  Three one two three", "é a", "", "x" * 5, "the the the cat sat on the mat, the cat sat on it", "tab\tand\nline"]
    rng = np.random.default_rng(0)
    m = qs.Model(rng.normal(size=qs.BUCKETS).astype(np.float32), 0.3)
    mask = (1 << 64) - 1

    def mix(h):
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD & mask
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 & mask
        return h ^ (h >> 33)

    def word_hash(w):
        total = 0
        for k, b in enumerate(w.encode()):
            total += (b + 32 * (65 <= b <= 90) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64)
        return mix(total & mask)

    top = qs.BUCKETS - qs.RELATIONS

    def ids(text):
        w = [word_hash(x) for x in text.split()]
        out = [(h >> 20) % top for h in w] + [(mix((a * 3 + b) & mask) >> 20) % top for a, b in zip(w, w[1:], strict=False)]
        for k in range(1, qs.NEAR + 1):
            out += [top + min(k, 2)] * (3 * sum(w[i] == w[i - k] for i in range(k, len(w))))
        three, seen = list(zip(w, w[1:], w[2:], strict=False)), set()
        out += [top + 3] * (3 * sum(t in seen or seen.add(t) is not None for t in three))
        spread = []
        for c in text:
            x = (ord(c) + 1) * 2654435761 & 0xFFFFFFFF
            spread.append(x ^ (x >> 15))
        for n in qs.NGRAMS:
            for at in range(len(text) - n + 1):
                h = spread[at]
                for k in range(1, n):
                    h = (h * 0x85EBCA6B + spread[at + k]) & 0xFFFFFFFF
                h ^= h >> 16
                h = h * (0xC2B2AE35 + 2 * n) & 0xFFFFFFFF
                out.append((h >> 12) % top)
        return out

    want = []
    for t in texts:
        found = ids(t)
        want.append(1 / (1 + np.exp(-(0.3 + (sum(float(m.weights[i]) for i in found) / len(found) if found else 0)))))
    assert np.allclose(m.scores(pa.array(texts)), want, atol=1e-6)
