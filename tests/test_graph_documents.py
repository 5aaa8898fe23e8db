"""graph_documents against its SQL, to the last digit, on events whose weights lie next to a half and on events without keys."""

from collections import Counter

import pytest

from plumbline.operators import lineage
from plumbline.plans import catalogue, fixtures

duckdb = pytest.importorskip("duckdb")


def compare(spark, tmp_path, events):
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = catalogue.queries()["graph_documents"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    r = con.execute(catalogue.oracle_sql()["graph_documents"])
    assert df.columns == [c[0] for c in r.description]
    got, want = Counter(map(tuple, df.collect())), Counter(r.fetchall())
    assert got == want
    return got


def test_weights_next_to_a_half(spark, tmp_path):
    # severities are multiples of 0.000025 and confidences of 0.01, so many weights end in 5e-7
    values = [(k, 100 + c / 100) for k in range(50) for c in range(1, 40000, 101)]
    events = [(50 * at + k, at % 7, "click", value) for at, (k, value) in enumerate(values)]
    events += [(1032, 88, "error", 205.57), (-1032, 88, "error", 205.57)]
    got = compare(spark, tmp_path, events)
    assert sum(n for r, n in got.items() if r[1] == "evidence") == len(events)


def test_events_without_keys(spark, tmp_path):
    events = [(1, 1, "click", 200.0), (2, None, "click", 250.0), (3, None, "error", 333.33), (None, 1, "view", 200.0), (4, 1, None, 300.0), (5, 1, "view", None), (6, 1, "view", float("nan")), (7, 2, "view", float("inf")), (7, 2, "view", float("inf"))]
    got = compare(spark, tmp_path, events)
    assert sum(n for r, n in got.items() if r[0] is None and r[1] == "evidence") == 2


def test_document_of_evidence_alone(spark):
    g = fixtures.graph(spark, [], [], [("E1", "a", "T", 0.5, 0.25, "d"), (None, "a", "T", 0.5, 0.25, "d")])
    doc = lineage.to_json(g)
    assert sorted(r.evidence_id for r in lineage.from_json(doc).evidence.collect()) == ["E-00001", "E1"]
    assert {r.evidence_id for r in lineage.from_json(doc, numbered=False).evidence.collect()} == {"E1", None}
