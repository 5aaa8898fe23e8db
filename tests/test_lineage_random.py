"""Closure and paths against brute force on random graphs."""

import random

from plumbline.operators import lineage
from plumbline.plans import fixtures


def test_closure_of_random_dags(spark):
    rng = random.Random(4)
    for depth in (None, 9):
        nodes = [(f"n{k}", "MODEL", "") for k in range(10)]
        edges = [(f"n{a}", f"n{b}", "DERIVED_FROM") for a in range(10) for b in range(a + 1, 10) if rng.random() < 0.25]
        g = fixtures.graph(spark, nodes, edges, depth=depth)
        want = {(n, n): 0 for n, _, _ in nodes}
        for n, _, _ in nodes:
            front, d = {n}, 0
            while front:
                d += 1
                front = {b for a, b, _ in edges if a in front} - {y for x, y in want if x == n}
                want |= {(n, b): d for b in front}
        assert {(r.anc, r.dst): r.dist for r in g.closure.collect()} == want


def test_removal_of_derived_samples(spark):
    from plumbline.operators.counterfactual import removal_set

    nodes = [("B", "BATCH", ""), ("S1", "SAMPLE", ""), ("S2", "SAMPLE", ""), ("S3", "SAMPLE", "")]
    edges = [("B", "S1", "CONTAINS"), ("B", "S2", "CONTAINS"), ("S1", "S2", "DERIVED_FROM"), ("S2", "S3", "DERIVED_FROM")]
    t = spark.createDataFrame([("demo", "B")], "case_id string, node_id string")
    assert {r.node_id for r in removal_set(fixtures.graph(spark, nodes, edges), t).collect()} == {"B", "S1", "S2"}  # S3 is contained in nothing
