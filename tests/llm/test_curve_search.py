import itertools

import numpy as np
import pytest

from plumbline.llm import curve_search as cs


def brute(rows, ids, k):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine.setdefault((i, tuple(v)), np.array(v, float))
    out = {}
    for q in ids:
        for (i, _), v in fine.items():
            if i != q:
                continue
            best = {}
            for (j, _), w in fine.items():
                if j != q and len(w) == len(v):
                    s = float(cs.cosine(v[None], w[None])[0])
                    best[j] = max(best.get(j, -9), s)
            out[q] = [j for j, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = np.argsort(cs.hilbert_keys(grid, bits))
        assert len(set(cs.hilbert_keys(grid, bits).tolist())) == len(grid)
        assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(120)]
    rows += [(200 + k, rows[0][1]) for k in range(12)] + [(50, rows[50][1]), (None, rows[3][1]), (300, None), (301, []), (302, [0.0] * 6), (303, [float("nan"), *[1.0] * 5]), (304, [None, *[1.0] * 5]), (305, [float("inf"), *[1.0] * 5]), (306, [1.0, 2.0]), (350, [2.0, 4.0]), (400, [3.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], "vec_id long, embedding array<double>, v string, score double")
    ids = [0, 50, 100, 200, 300, 302, 350, 400]
    got = {}
    for r in cs.search(df, df.filter(df.vec_id.isin(ids)).select("vec_id")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    want = brute(rows, ids, 5)
    assert {q: v for q, v in want.items() if v} == got
    assert cs.search(df.limit(0), df.select("vec_id")).count() == 0


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_over_several_blocks(spark, monkeypatch, clusters):
    monkeypatch.setattr(cs, "BLOCK", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    if clusters:
        x = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 3000)] + 0.2 * x
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {}
    for r in cs.search(df, df.filter("vec_id % 50 = 0").select("vec_id")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = [len(got[q] & set(np.argsort(-np.where(np.arange(3000) == q, -2, u @ u[q]), kind="stable")[:5].tolist())) / 5 for q in range(0, 3000, 50)]
    assert np.mean(hits) >= 0.9


def test_cosines_of_huge_and_tiny_vectors():
    x = np.array([[1e200, 1e200], [1e-200, 0.0], [3.0, 4.0]])
    y = np.array([[1e-200, 1e-200], [1e300, 1e300], [4.0, 3.0]])
    assert np.allclose(cs.cosine(x, y), [1.0, np.sqrt(0.5), 0.96])


def test_blocks_beyond_the_sample_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(cs, "BLOCK", 16)
    monkeypatch.setattr(cs, "MOST_BLOCKS", 3)
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids = [k for k in range(0, 400, 50)]
    got = cs.search(df, df.filter("vec_id % 50 = 0").select("vec_id"), reach=1.0, orders=2).collect()
    want = brute(rows, ids, 5)
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in ids} == want
