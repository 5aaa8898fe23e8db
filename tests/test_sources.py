"""Ingestion, uploads, substitution, patches, bundles, stores."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import media
from plumbline.functions.scalars import sha256_of_base64
from plumbline.operators import assurance, detect, scenarios
from plumbline.plans import fixtures
from plumbline.sources import relational

RNG = np.random.default_rng(0)


def image() -> np.ndarray:
    return RNG.integers(0, 256, (40, 50, 3)).astype(np.uint8)


def bmp(x: np.ndarray) -> bytes:
    h, w = x.shape[:2]
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" * (-3 * w % 4) for r in x[::-1])
    head = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    return head + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + rows


def test_ingestion(spark, tmp_path):
    files = {"pics/cat/a.bmp": bmp(image()), "pics/cat/deep/b.BMP": bmp(image()), "pics/dog/c.bmp": b"broken", "pics/dog/d.txt": b"x", "pics/top.bmp": bmp(image()), "pics/dog/e.bmp": bmp(image())}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    known = {"contributors": spark.createDataFrame([("c_1", "Ann")], "id string, name string")}
    rows, summary = relational.ingest_images(spark, str(tmp_path / "pics"), "animals", "Ann", "first", known=known)
    got = {r.label_class: r for r in summary.collect()}
    assert (got["cat"].n_samples, got["cat"].n_skipped, got["dog"].n_samples, got["dog"].n_skipped) == (2, 0, 1, 1)
    assert rows["contributors"].count() == 0 and rows["datasets"].count() == 1
    b = rows["batches"].first()
    assert (b.contributor_id, b.label, b.sample_count) == ("c_1", "first", 3)
    s = rows["samples"].collect()
    assert len({r.id for r in s}) == 3 and {r.batch_id for r in s} == {b.id} and all(len(r.phash) == 16 for r in s)
    again, _ = relational.ingest_images(spark, str(tmp_path / "pics"), "animals", "Ann", "first", known=known)
    assert again["batches"].first().id == b.id
    nobody, _ = relational.ingest_images(spark, str(tmp_path / "pics"), "animals")
    assert nobody["batches"].first().contributor_id is None and nobody["samples"].count() == 3


def test_upload(spark):
    data = bmp(image())
    a, b = (relational.upload(spark, "B1", "C:\\pics\\x.BMP", c, "cat").first() for c in (data, base64.b64encode(data).decode()))
    assert a == b and a.file_path == "x.BMP" and a.phash == media.fingerprint(media.decode(data))
    for name, content in (("x.txt", data), ("bmp", data), ("x.bmp", b"no image"), ("x.bmp", "no base64!")):
        with pytest.raises(ValueError):
            relational.upload(spark, "B1", name, content)


def test_base64_hash(spark):
    import hashlib

    df = spark.createDataFrame([(base64.b64encode(b"input").decode(),), ("?",), (None,)], "x string")
    assert [r[0] for r in df.select(sha256_of_base64(F.col("x"))).collect()] == [hashlib.sha256(b"input").hexdigest(), None, None]


def test_substitution(spark):
    models = spark.createDataFrame([("V4", "TR42", "aa"), ("V5", "TR43", None)], "model_id string, training_run_id string, sha256 string")
    new = spark.createDataFrame([("V4", "/x/other.onnx", "bb", None, None), ("V4", "/x/same", "aa", "copy", "v9"), ("V5", "/x/y.pt", "cc", None, None), ("V9", "/x/z.pt", "dd", None, None)], "model_id string, path string, sha256 string, name string, version string")
    rows, compared = scenarios.substitution(models, new)
    assert sorted((r.training_run_id, r.name, r.version, r.format, r.sha256) for r in rows.collect()) == [("TR42", "copy", "v9", "unknown", "aa"), ("TR42", "other", "candidate", "onnx", "bb"), ("TR43", "y", "candidate", "pt", "cc")]
    assert sorted((r.authorized_model_id, r.candidate_sha256, r.artifact_mismatch) for r in compared.collect()) == [("V4", "aa", False), ("V4", "bb", True), ("V5", "cc", False)]


def test_patched_images_carry_the_trigger(spark):
    rows = [(f"s{k}", "B", "cat", bytearray(bmp(image()))) for k in range(10)] + [("s10", "B", "cat", None)]
    df = spark.createDataFrame(rows, "sample_id string, batch_id string, label_class string, content binary")
    got = scenarios.patched(df, share=0.3, target="dog").collect()
    assert sum(r.has_trigger for r in got) == 3 and all((r.label_class == "dog") == r.has_trigger for r in got)
    for r in got:
        if r.content is not None:
            assert (media.decode(bytes(r.content))[:4, :4] == (255, 0, 0)).all() == r.has_trigger


def test_bundle_store_and_fingerprint_rows(spark, tmp_path):
    inv = assurance.investigate(fixtures.demo(spark))
    bundle = relational.export_bundle(inv, "demo", str(tmp_path / "bundle"), counterfactual={"target": "B17"}, exported_at="now")
    (text,) = [r.value for r in spark.read.text(str(tmp_path / "bundle")).collect()]
    read = json.loads(text)
    assert read["exported_at"] == "now" and len(read["graph"]["nodes"]) == 14 and read["investigation"]["assurance_state"] == "RED" and read["counterfactual"] == {"target": "B17"}
    assert bundle["investigation"]["origin_candidates"][0]["evidence_ids"] == ["E001", "E002", "E003", "E010", "E011", "E021"]
    relational.append_fingerprints(spark.createDataFrame([("V4", [1.0, 2.0], 0.9)], "model_id string, fingerprint array<double>, stability double"), str(tmp_path / "store"))
    spark.createDataFrame([("V5", 3)], "model_id string, later int").write.mode("append").parquet(str(tmp_path / "store/model_fingerprints"))
    got = {r.model_id: r for r in relational.read_store(spark, str(tmp_path / "store"), "model_fingerprints").collect()}
    assert got["V4"].later is None and got["V5"].later == 3 and got["V4"].probe_name == "default_suite"


def test_clusters_by_connected_group_equal_the_sequential_rule(spark):
    rng = np.random.default_rng(4)
    rows = []
    for b in range(6):
        centre = int(rng.integers(0, 1 << 62))
        for k in range(40):
            centre = centre if rng.random() < 0.7 else int(rng.integers(0, 1 << 62))
            x = centre
            for _ in range(int(rng.integers(0, 6))):
                x ^= 1 << int(rng.integers(0, 62))
            centre = x if rng.random() < 0.5 else centre  # chains, so that neighbours of neighbours are apart
            rows.append((f"s{rng.integers(0, 10**6):06d}{k}", f"b{b}", f"{x:016x}" if rng.random() < 0.95 else None))
    want = {}
    for b in {r[1] for r in rows}:
        leaders = []
        for name, _, h in sorted(r for r in rows if r[1] == b and r[2]):
            x = int(h, 16)
            near = next((n for n, y in leaders if (x ^ y).bit_count() <= 5), None)
            if near is None:
                leaders.append((name, x))
            want[b, name] = near or name
    got = detect.leader_clusters(spark.createDataFrame(rows, "sample_id string, batch_id string, phash string"))
    assert {(r.batch_id, r.sample_id): r.leader for r in got.collect()} == want


def test_data_benchmark(spark):
    rng = np.random.default_rng(7)
    rows = [(f"s{b}{k:03d}", f"b{b}", ("cat", "dog", "cow")[k % 3], f"{int(rng.integers(0, 1 << 62)):016x}", [float(x) for x in rng.normal(size=12)]) for b in range(2) for k in range(90)]
    df = spark.createDataFrame(rows, "sample_id string, batch_id string, label_class string, phash string, embedding array<double>")
    got = {r.scenario: (r.kinds, r.passed) for r in scenarios.data_benchmark(df, "b1", "cat").collect()}
    assert all(p for _, p in got.values()) and set(got) == set(scenarios.DATA_SCENARIOS) and got["clean"][0] == []
