import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import mix_cube as mc


def test_targets_by_hand(spark):
    def fill(sizes):  # reshare the excess until none is above its stop
        names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
        stopped, whole = set(), sum(sizes.values())
        while True:
            rest = whole - sum(3 * sizes[s] for s in stopped)
            free = sum(weight[s] for s in names if s not in stopped)
            t = {s: 3 * sizes[s] if s in stopped else rest * weight[s] / free for s in names}
            over = {s for s in names if t[s] > 3 * sizes[s] * (1 + 1e-12)}
            if not over:
                return t
            stopped |= over

    rng = np.random.default_rng(5)
    for _ in range(4):
        sizes = {None if k == 7 else f"s{k:02d}": int(x) for k, x in enumerate(rng.integers(0, 1000, 9) * rng.integers(0, 9, 9))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mc.targets(df).collect()}
        want = fill(sizes)
        assert all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9) for s in want)


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(0)
    size = np.round(np.exp(rng.normal(5, 1.3, 300)))
    pi = np.full(300, 0.37)
    f = mc.fly(pi, np.ones(300), size, np.random.default_rng(1))
    assert ((f > mc.EPS) & (f < 1 - mc.EPS)).sum() <= 6 and f.sum() == pytest.approx(pi.sum()) and f @ size == pytest.approx(pi @ size)
    p, z = np.array([0.2, 0.5, 0.7, 0.6]), np.array([10.0, 3.0, 3.0, 1.0])
    runs = [mc.land(mc.fly(p, np.ones(4), z, np.random.default_rng(k)), z, np.random.default_rng(9000 + k)) for k in range(4000)]
    assert np.abs(np.mean(runs, axis=0) - p).max() < 0.03 and set(np.unique(runs)) <= {0.0, 1.0}


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mc, "GROUP", 64)  # several levels of the tree
    rng = np.random.default_rng(2)
    rows = [(k, "ab"[k % 2] if k % 5 else None, "w " * int(rng.integers(1, 200))) for k in range(900)]
    rows += [(900, "hot", "x y")] * 3 + [(901, "hot", None), (902, "hot", ""), (None, "hot", "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"size": F.lit("clash"), "copies": F.lit(1), "row": F.lit(2)})
    m = mc.mix(df)
    got = m.collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mc.mix(df).collect()), key=repr)
    assert all(0 <= r.copies <= 3 for r in got)
    by = {}
    for r in got:
        t = by.setdefault(r.source, [0, r.target, r.source_size])
        t[0] += r.size * r.copies
    for taken, target, size in by.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 0.02 * target + 8
    applied = mc.apply_mix(df)
    assert applied.columns == df.columns and applied.count() == sum(r.copies for r in got)
    assert mc.mix(df.limit(0)).count() == 0


def test_a_unit_that_the_others_cannot_balance_is_set_aside():
    size, pi = np.array([1000.0] + [10.0] * 99), np.full(100, 0.5)
    f = mc.fly(pi, np.ones(100), size, np.random.default_rng(3))
    still = (f > mc.EPS) & (f < 1 - mc.EPS)
    assert still.sum() <= 3 and f[0] == 0.5 and f[1:].sum() == pytest.approx(49.5)


def test_groups_that_settle_nothing_end(spark, monkeypatch):
    monkeypatch.setattr(mc, "GROUP", 2)  # no flight moves two units
    df = spark.createDataFrame([(k, "a" if k % 2 else "b", "w " * (1 + k % 7)) for k in range(60)], "doc_id long, source string, text string")
    rows = mc.mix(df).collect()
    assert len(rows) == 60 and all(0 <= r.copies <= 3 for r in rows)
