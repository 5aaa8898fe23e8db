import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import cosine, hamming_hex, py_round
from plumbline.operators import detect, scenarios
from plumbline.sources import relational


def test_label_skew(spark):
    rows = [(i, "a", "x") for i in range(10)] + [(100 + i, "b", "xy"[i % 2]) for i in range(20)] + [(200, "a", None), (201, "a", "")]
    s = spark.createDataFrame(rows, "sample_id long, batch_id string, label_class string")
    b = spark.createDataFrame([("a", "d"), ("b", "d")], "batch_id string, dataset_id string")
    got = {r.batch_id: r for r in detect.label_skew(s, b).collect()}
    m = (1 + 0.5) / 2
    assert got["a"].js == pytest.approx(math.sqrt(0.5 * math.log2(1 / m) + 0.5 * (0.5 * math.log2(0.5 / m) + 0.5 * math.log2(0.5 / 0.25)))) and got["a"].n_batch == 10
    found = {r.source_id: r for r in detect.labels(s, b).collect()}
    assert found["a"].severity == round(min(1, got["a"].js / 0.6), 3)
    flipped = scenarios.label_flip(s.filter("label_class != ''"), "z")
    assert flipped.filter("label_class = 'z'").groupBy("batch_id").count().count() == 2


def test_leader_clusters_and_flood(spark):
    rows = [(1, "b", "0000000000000000"), (2, "b", "000000000000001f"), (3, "b", "00000000000003ff"), (4, "b", "ffffffffffffffff"), (5, "b", "fffffffffffffffe"), (6, "b", None)]
    s = spark.createDataFrame(rows, "sample_id long, batch_id string, phash string")
    assert {r.sample_id: r.leader for r in detect.leader_clusters(s).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert {(r.a, r.b, r.distance) for r in detect.near_pairs(s).collect()} == {(1, 2, 5), (2, 3, 5), (4, 5, 1)}
    f = {r.severity for r in detect.duplicates(s).collect()}
    assert f == {0.6}
    assert spark.range(1).select(hamming_hex(F.lit("ff"), F.lit("0")).alias("d")).first().d == 8


def test_ood(spark):
    rows = [(f"s{i}", "ab"[i % 2], [float(i % 5), float(i % 3)]) for i in range(40)]
    s = spark.createDataFrame(rows, "sample_id string, batch_id string, embedding array<double>")
    b = spark.createDataFrame([("a", "d"), ("b", "d")], "batch_id string, dataset_id string")
    assert detect.ood(s, b).count() == 0
    wild = scenarios.ood_injection(s.withColumn("label_class", F.lit("x"))).select("sample_id", "batch_id", "embedding")
    both = s.unionByName(wild)
    batches = both.select("batch_id", F.lit("d").alias("dataset_id")).distinct()
    assert {r.source_id for r in detect.ood(both, batches, reference=s.withColumn("dataset_id", F.lit("d")).select("dataset_id", "embedding")).collect()} == {"a-injected", "b-injected"}


def test_models(spark):
    p = spark.createDataFrame([("m", [1.0, 0.0], [0.0, 1.0]), ("n", [1.0, 0.0], [1.0, 0.0])], "model_id string, reference array<double>, candidate array<double>")
    r = detect.behaviour(p).collect()
    assert [(x.source_id, x.severity, x.confidence) for x in r] == [("m", 1.0, 0.99)]
    zero = spark.range(1).select(cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0))).alias("a"), cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("b")).first()
    assert (zero.a, zero.b) == (1.0, 0.0)
    d = detect.structure(spark.createDataFrame([("m", "onnx", "onnx", 1, 2)], "model_id string, format_ref string, format_new string, layer_count_ref int, layer_count_new int"), ("format", "layer_count"))
    assert d.first().severity == 0.25
    a = detect.artifacts(spark.createDataFrame([("m", "x"), ("n", None)], "model_id string, sha256 string"), spark.createDataFrame([("m", "y"), ("n", "y")], "model_id string, sha256 string"))
    assert [r.source_id for r in a.collect()] == ["m"]
    t = spark.createDataFrame([("m", "a", 0.9), ("m", "b", 0.1)], "model_id string, trigger string, delta double")
    x = detect.triggers(t).first()
    assert (x.severity, x.confidence) == (round(0.7 * 0.9 + 0.3 * 0.5, 3), 0.8)
    one = "struct<count:double,confidence:double,classes:map<string,int>,boxes:array<double>,numbers:array<double>>"
    resp = spark.createDataFrame([("m", "t", (1.0, 0.5, {"a": 1}, [0.0, 0.0], []), (1.0, 0.99, {"a": 1}, [0.0, 0.0], []))], f"model_id string, trigger string, clean {one}, triggered {one}")
    assert detect.trigger_deltas(resp).first().delta == pytest.approx(0.6 * 0.98)


def test_rounding_is_that_of_binary_values(spark):
    assert [r[0] for r in spark.createDataFrame([(0.2855,), (2.675,)], "x double").select(py_round(F.col("x"), 2)).collect()] == [round(0.2855, 2), 2.67]


def test_sources(spark, tmp_path):
    for name in ("pics/cat/a.png", "pics/cat/deep/b.JPG", "pics/dog/c.txt", "pics/d.bmp"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    got = {(r.path.rsplit("/", 1)[1], r.label) for r in relational.images(spark, str(tmp_path / "pics")).collect()}
    assert got == {("a.png", "cat"), ("b.JPG", "cat"), ("d.bmp", None)}
    (tmp_path / "m.pt").write_bytes(b"x")
    assert relational.model_files(spark, str(tmp_path / "m.pt")).first().format == "pytorch"
    have = spark.createDataFrame([("c_1", "Ann")], "id string, name string")
    every, new = relational.get_or_create(have, spark.createDataFrame([("Ann",), ("Bob",), ("Bob",)], "name string"), "c")
    assert every.count() == 2 and [r.name for r in new.collect()] == ["Bob"]
    relational.append_findings(have, have, str(tmp_path / "out"))
    relational.append_findings(have, have, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/evidence")).count() == 2
