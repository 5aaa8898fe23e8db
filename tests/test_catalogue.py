"""Every query against its SQL on the smallest tables."""

import glob
import os

import pytest

from plumbline.plans import catalogue

duckdb = pytest.importorskip("duckdb")


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    one = lambda v: None if v is None else round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, sf_dir, oracle, name):
    df = catalogue.queries()[name](spark, sf_dir)
    rows = df.collect()
    if sql := catalogue.oracle_sql().get(name):
        r = oracle.execute(sql)
        assert sorted(df.columns) == sorted(c[0] for c in r.description)
        assert plain(rows, df.columns) == plain(r.fetchall(), [c[0] for c in r.description])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(catalogue.queries()) <= set(e.queries())
