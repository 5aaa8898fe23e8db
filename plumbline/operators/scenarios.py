"""Controlled attacks on data and receipt streams, as generators of tables whose ground truth is known."""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import canonical_json
from plumbline.operators import detect, passports

ATTACKS = ("none", "output_tamper", "input_tamper", "replay", "model_swap", "config_tamper", "drop_records", "forged_signature")
KEY = b"scenario-key"
GOOD = {"model_hash": hashlib.sha256(b"model").hexdigest(), "preproc_hash": hashlib.sha256(b"preprocessing").hexdigest(), "config_hash": hashlib.sha256(b"configuration").hexdigest()}
START = 1_700_000_000.0


def _ranked(samples: DataFrame, seed: int) -> DataFrame:
    """Samples with their place in a seeded random order of their batch (by md5, so that any engine can repeat it), and the batch's size."""
    order = W.partitionBy("batch_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample_id").cast("string"))), F.col("sample_id").cast("string"))
    return samples.withColumns({"place": F.row_number().over(order), "size": F.count("*").over(W.partitionBy("batch_id"))})


def label_flip(samples: DataFrame, target: str, share: float = 0.6, seed: int = 42, suffix: str = "-flipped") -> DataFrame:
    """A copy of each batch in which a share of the samples has the target class."""
    r = _ranked(samples, seed)
    label = F.when(F.col("place") <= F.floor(F.col("size") * share), target).otherwise(F.col("label_class"))
    return r.withColumns({"label_class": label, "batch_id": F.concat("batch_id", F.lit(suffix))}).drop("place", "size")


def duplicate_flood(samples: DataFrame, share: float = 0.4, copies: int = 6, flips: int = 1, seed: int = 42, suffix: str = "-flooded") -> DataFrame:
    """A copy of each batch in which some samples give way to jittered copies of themselves (up to `flips` fingerprint bits differ)."""
    r = _ranked(samples, seed)
    n = F.greatest(F.lit(1), F.floor(F.col("size") * share / copies))
    hit = F.col("place") <= n
    r = r.withColumn("copy", F.explode(F.when(hit, F.sequence(F.lit(1), F.lit(copies))).otherwise(F.array(F.lit(0)))))
    last = F.conv(F.substring("phash", -1, 1), 16, 10).cast("int")
    draw = F.substring(F.md5(F.concat_ws("-", F.col("sample_id").cast("string"), F.col("copy").cast("string"))), 1, 1)
    jitter = F.when(F.lit(flips) > 0, F.conv(draw, 16, 10).cast("int") % 4).otherwise(0)
    bit = F.when(F.col("copy") > 0, F.element_at(F.array(*map(F.lit, (0, 1, 2, 4))), jitter + 1)).otherwise(0)
    phash = F.concat(F.expr("substring(phash, 1, length(phash) - 1)"), F.lower(F.hex(last.bitwiseXOR(bit).cast("long"))))
    name = F.when(F.col("copy") > 0, F.concat(F.col("sample_id").cast("string"), F.lit("-"), F.col("copy").cast("string"))).otherwise(F.col("sample_id").cast("string"))
    return r.withColumns({"phash": F.when(F.col("copy") > 0, phash).otherwise(F.col("phash")), "sample_id": name, "batch_id": F.concat("batch_id", F.lit(suffix))}).drop("place", "size", "copy")


def ood_injection(samples: DataFrame, share: float = 0.15, scale: float = 8.0, seed: int = 42, suffix: str = "-injected") -> DataFrame:
    """A copy of each batch with further samples far from all others, labelled __injected_ood__."""
    r = _ranked(samples, seed).withColumn("batch_id", F.concat("batch_id", F.lit(suffix)))
    extra = r.filter(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("size") * share)))
    far = F.transform("embedding", lambda x, i: x + scale * F.when(i % 2 == 0, 1.0).otherwise(-1.0))
    extra = extra.withColumns({"sample_id": F.concat(F.lit("ood-"), F.col("sample_id").cast("string")), "label_class": F.lit("__injected_ood__"), "embedding": far})
    return r.withColumn("sample_id", F.col("sample_id").cast("string")).unionByName(extra).drop("place", "size")


def triggered(samples: DataFrame, share: float = 0.3, target: str | None = None, seed: int = 42, suffix: str = "-triggered") -> DataFrame:
    """A copy of each batch in which a share carries a trigger (column has_trigger), and the target class if given."""
    r = _ranked(samples, seed)
    hit = F.col("place") <= F.floor(F.col("size") * share)
    label = F.when(hit, target).otherwise(F.col("label_class")) if target else F.col("label_class")
    return r.withColumns({"has_trigger": hit, "label_class": label, "batch_id": F.concat("batch_id", F.lit(suffix))}).drop("place", "size")


def substitution(authorized: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate models put in the place of authorized ones.

    authorized(model_id, training_run_id, sha256), candidates(model_id: the authorized one, path, sha256, name, version; the last two may be
    null) -> (rows for models: id, training_run_id, name, version, format, sha256; comparison: authorized_model_id, candidate_model_id, both hashes,
    artifact_mismatch). A candidate of a model that is not known is no row of either. A hash that is missing proves no mismatch.
    """
    known = authorized.select("model_id", "training_run_id", F.col("sha256").alias("authorized_sha256"))
    base = F.element_at(F.split("path", "/"), -1)
    c = candidates.join(known, "model_id").select(
        F.concat(F.lit("model_"), F.substring(F.sha2(F.concat_ws("|", "model_id", "path", "sha256"), 256), 1, 12)).alias("id"), "training_run_id", F.coalesce("name", F.regexp_replace(base, r"\.[^.]*$", "")).alias("name"),
        F.coalesce("version", F.lit("candidate")).alias("version"), F.coalesce(F.nullif(F.regexp_extract(base, r"\.([^.]+)$", 1), F.lit("")), F.lit("unknown")).alias("format"), "sha256", F.col("model_id").alias("of"), "authorized_sha256",
    )
    compared = c.select(F.col("of").alias("authorized_model_id"), F.col("id").alias("candidate_model_id"), "authorized_sha256", F.col("sha256").alias("candidate_sha256"), F.coalesce(F.col("authorized_sha256") != F.col("sha256"), F.lit(False)).alias("artifact_mismatch"))
    return c.select("id", "training_run_id", "name", "version", "format", "sha256"), compared


def patched(images: DataFrame, share: float = 0.3, target: str | None = None, seed: int = 42, suffix: str = "-triggered") -> DataFrame:
    """triggered() on images: samples with a column content of BMP or PPM bytes, of which those that carry the trigger get a red corner patch (as PPM)."""
    from collections.abc import Iterator

    import pandas as pd

    from plumbline.functions import media

    def run(parts):
        for content, hit in parts:
            yield pd.Series([media.to_ppm(media.corner_patch(media.decode(bytes(c)))) if h and c is not None else c for c, h in zip(content, hit, strict=True)])

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    t = triggered(samples=images, share=share, target=target, seed=seed, suffix=suffix)
    return t.withColumn("content", F.pandas_udf(run, "binary")("content", "has_trigger"))


# what each data scenario must make the detectors say of the attacked batch
DATA_SCENARIOS = {"clean": None, "duplicate_flood": "NEAR_DUPLICATE_CLUSTER", "label_flip": "LABEL_DISTRIBUTION_ANOMALY", "ood_injection": "OOD_ANOMALY"}


def data_benchmark(samples: DataFrame, batch: str, target: str, seed: int = 7) -> DataFrame:
    """samples(sample_id, batch_id, label_class, phash, embedding) -> scenario, expected, kinds, passed.

    A scenario is a dataset of its own that holds every batch and an attacked copy of `batch`: 40 % flooded with 20 copies a source, 70 % of labels
    flipped to `target`, 15 % more samples out of distribution, or no attack. All run in one plan. An attack passes if its kind is among the
    findings on the attacked batch, the clean one if no batch of its dataset has any.
    """
    s = samples.select(F.col("sample_id").cast("string").alias("sample_id"), "batch_id", "label_class", "phash", F.col("embedding").cast("array<double>").alias("embedding"))
    own = s.filter(F.col("batch_id") == batch)
    attacked = {
        "clean": own.withColumn("batch_id", F.concat("batch_id", F.lit("-attacked"))), "duplicate_flood": duplicate_flood(own, 0.4, 20, seed=seed, suffix="-attacked"),
        "label_flip": label_flip(own, target, 0.7, seed, "-attacked"), "ood_injection": ood_injection(own, 0.15, seed=seed, suffix="-attacked"),
    }
    every = None
    for name, copy in attacked.items():
        rows = s.unionByName(copy.select(*s.columns)).withColumn("dataset_id", F.lit(name)).withColumn("batch_id", F.concat_ws("/", F.lit(name), "batch_id"))
        every = rows if every is None else every.unionByName(rows)
    found, _ = detect.all_batches(every.drop("dataset_id"), every.select("batch_id", "dataset_id").distinct())
    at = F.split("source_id", "/", 2)
    seen = found.select(at[0].alias("scenario"), (at[1] == f"{batch}-attacked").alias("hit"), "evidence_type")
    seen = seen.filter((F.col("scenario") == "clean") | F.col("hit")).groupBy("scenario").agg(F.array_sort(F.collect_set("evidence_type")).alias("kinds"))
    want = samples.sparkSession.createDataFrame(list(DATA_SCENARIOS.items()), "scenario string, expected string").join(seen, "scenario", "left")
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    return want.select("scenario", "expected", kinds.alias("kinds"), F.when(F.col("expected").isNull(), F.size(kinds) == 0).otherwise(F.array_contains(kinds, F.col("expected"))).alias("passed"))


def passport_stream(attack: str, n: int = 50, seed: int = 0, at: int = 25) -> list[dict]:
    """Records of one deployment in arrival order, each with what the verifier sees beside it."""
    rng = random.Random(seed)
    digest = lambda data: hashlib.sha256(data).hexdigest()
    rows, last, swap = [], passports.GENESIS, {"model_swap": {"model_hash": digest(b"other model")}, "config_tamper": {"config_hash": digest(b"other configuration")}}.get(attack, {})
    for k in range(n):
        image, output = rng.randbytes(64), {"label": rng.choice(["vehicle", "person", "building"]), "conf": round(rng.uniform(0.5, 0.99), 2)}
        r = {"deployment_id": f"{attack}-{seed}", "inference_id": f"I{k:04d}", "input_hash": digest(image), "output_hash": digest(canonical_json(output).encode()), **GOOD, **(swap if k >= at else {}), "timestamp": START + k, "sequence": k + 1, "nonce": rng.randbytes(12).hex(), "prev_hash": last}
        r["signature"] = passports.sign(KEY, r)
        last = passports.record_hash(r)
        rows.append(r | {"seen_output_hash": r["output_hash"], "seen_input_hash": r["input_hash"], "seen_at": r["timestamp"]})
    if attack == "output_tamper":
        rows[at]["seen_output_hash"] = digest(b"tampered")
    elif attack == "input_tamper":
        rows[at]["seen_input_hash"] = digest(b"tampered")
    elif attack == "replay":
        rows.insert(at + 5, dict(rows[at - 10]))
    elif attack == "drop_records":
        del rows[at : at + 4]
    elif attack == "forged_signature":
        rows[at]["output_hash"] = rows[at]["seen_output_hash"] = digest(b"forged")
    elif attack not in ATTACKS:
        raise ValueError(attack)
    return [r | {"arrival": k} for k, r in enumerate(rows)]


def evaluate(spark: SparkSession, n: int = 50, seeds=range(5), at: int = 25) -> DataFrame:
    """Detection rate, false positives and kinds of findings of each attack over the seeds."""
    rows = [r | {"attack": a, "seed": s} for a in ATTACKS for s in seeds for r in passport_stream(a, n, s, at)]
    schema = passports.COLUMNS + ", seen_output_hash string, seen_input_hash string, seen_at double, arrival long, attack string, seed int"
    df = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 8))
    expected = df.select("deployment_id").distinct().select("deployment_id", F.lit(GOOD["model_hash"]).alias("expected_model"), F.lit(GOOD["preproc_hash"]).alias("expected_preproc"), F.lit(GOOD["config_hash"]).alias("expected_config"))
    return passports.detection_rates(passports.verify_batch(df, expected, KEY), at)
