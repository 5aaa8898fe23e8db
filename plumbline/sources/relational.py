"""Graphs from the relational store's tables, sources for images and model files, and append-only sinks."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.lineage import Graph
from plumbline.sources.storage import cut

IMAGES = ("jpg", "jpeg", "png", "bmp", "webp")
MODEL_FORMATS = {"pt": "pytorch", "pth": "pytorch", "jit": "torchscript", "onnx": "onnx", "safetensors": "safetensors"}
EVIDENCE_NODES = ("contributor", "dataset", "batch", "sample", "training_run", "model", "deployment", "inference")


def build_graph(tables: dict[str, DataFrame], case_id: str = "store") -> Graph:
    """tables: contributors, datasets, batches, samples, training_runs, models, deployments, inferences, evidence, inspections (any may be absent).

    Rows become typed nodes, foreign keys that resolve become edges, configurations, inputs and outputs become nodes of their own. A run's batch
    wins over its dataset. Evidence and inspections of unknown nodes are dropped.
    """
    spark = next(iter(tables.values())).sparkSession
    has = tables.get
    name = lambda *c: F.coalesce(*c)
    labels = {
        "contributors": ("CONTRIBUTOR", F.col("name")), "datasets": ("DATASET", F.col("name")), "batches": ("BATCH", F.concat(F.lit("Batch "), name("label", "id"))), "samples": ("SAMPLE", F.concat(F.lit("Sample "), "id")),
        "training_runs": ("TRAINING_RUN", F.concat(F.lit("Training Run "), "id")), "models": ("MODEL", F.trim(F.concat_ws(" ", "name", F.coalesce("version", F.lit(""))))), "deployments": ("DEPLOYMENT", F.concat(F.lit("Deployment "), "id")),
        "inferences": ("INFERENCE", F.concat(F.lit("Inference "), "id")),
    }
    parts = [has(t).select(F.col("id").alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label")) for t, (kind, label) in labels.items() if has(t) is not None]
    links = []

    def link(t, src, dst, kind):
        links.append(t.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type")))

    if (d := has("deployments")) is not None:
        conf = d.filter("config_sha256 is not null").select(F.concat(F.lit("config_"), "id").alias("node_id"), F.col("id").alias("of"))
        parts.append(conf.select("node_id", F.lit("CONFIGURATION"), F.concat(F.lit("Configuration "), "of")))
        link(conf, F.col("node_id"), F.col("of"), "CONFIGURES")
        link(d, F.col("model_id"), F.col("id"), "DEPLOYED_AS")
    if (i := has("inferences")) is not None:
        for kind in ("input", "output"):
            parts.append(i.select(F.concat(F.lit(f"{kind}_"), "id"), F.lit(kind.upper()), F.concat(F.lit(f"{kind.capitalize()} "), "id")))
        link(i, F.col("deployment_id"), F.col("id"), "INFERRED_ON")
        link(i, F.concat(F.lit("input_"), "id"), F.col("id"), "INFERRED_ON")
        link(i, F.col("id"), F.concat(F.lit("output_"), "id"), "GENERATED")
    if (b := has("batches")) is not None:
        link(b, F.col("dataset_id"), F.col("id"), "CONTAINS")
        link(b, F.col("contributor_id"), F.col("id"), "CONTRIBUTED")
    if (s := has("samples")) is not None:
        link(s, F.col("batch_id"), F.col("id"), "CONTAINS")
    if (r := has("training_runs")) is not None:
        known = has("batches")
        known = spark.createDataFrame([], "known string") if known is None else known.select(F.col("id").alias("known"))
        r = r.join(known, F.col("batch_id") == F.col("known"), "left")
        link(r, F.coalesce("known", "dataset_id"), F.col("id"), "TRAINED_ON")
    if (m := has("models")) is not None:
        link(m, F.col("training_run_id"), F.col("id"), "PRODUCED")
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.union(p)
    case = F.lit(case_id).alias("case_id")
    nodes = nodes.select(case, "node_id", "node_type", "label")
    empty = spark.createDataFrame([], "src string, dst string, edge_type string")
    edges = empty
    for e in links:
        edges = edges.union(e)
    ids = nodes.select("node_id")
    edges = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(case, "src", "dst", "edge_type")
    ev = has("evidence")
    if ev is not None:
        ev = ev.select(case, F.col("id").alias("evidence_id"), F.col("source_node_id").alias("source_id"), F.col("type").alias("evidence_type"), "severity", "confidence", F.coalesce("detector", F.lit("unknown")).alias("detector"))
        ev = ev.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").select("case_id", "evidence_id", "source_id", "evidence_type", "severity", "confidence", "detector")
    else:
        ev = spark.createDataFrame([], "case_id string, evidence_id string, source_id string, evidence_type string, severity double, confidence double, detector string")
    seen = has("inspections")
    seen = spark.createDataFrame([], "case_id string, node_id string, detector string") if seen is None else seen.select(case, "node_id", "detector").join(ids, "node_id", "left_semi").select("case_id", "node_id", "detector")
    return Graph(nodes, edges, ev, seen, depth=7)


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, label (the folder below path), sha256, length of every image file, in any depth."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    inside = F.element_at(F.split("path", "/" + path.rstrip("/").rsplit("/", 1)[-1] + "/", 2), -1)
    f = f.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGES)).withColumn("inside", inside)
    return f.select("path", F.when(F.col("inside").contains("/"), F.split("inside", "/")[0]).alias("label"), F.sha2("content", 256).alias("sha256"), "length")


def ingest_images(spark: SparkSession, path: str, dataset: str, contributor: str | None = None, batch_label: str | None = None, form: str = "folder-per-class", known: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """One ingestion of a folder whose immediate subfolders are classes -> (rows to append to datasets, contributors, batches and samples; summary).

    A dataset or contributor that known has by name is not made again. Every ingestion is a batch of its own; its id is a hash of what it
    holds and of the names, so an ingestion that is repeated is told from a new one by its content. Files that can't be decoded are skipped
    and counted. summary: dataset_id, contributor_id, batch_id, label_class, n_samples, n_skipped, one row for each class.
    """
    from plumbline.functions.media import describe_images

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    inside = F.element_at(F.split("path", "/" + path.rstrip("/").rsplit("/", 1)[-1] + "/", 2), -1)
    files = files.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGES)).withColumn("inside", inside).filter(F.col("inside").contains("/"))
    rows = files.select(F.col("path").alias("file_path"), F.split("inside", "/")[0].alias("label_class"), F.sha2("content", 256).alias("sha256"), "content")
    rows = cut(describe_images(rows).drop("embedding"))
    none = lambda schema: spark.createDataFrame([], schema)
    held = known or {}
    wanted = lambda name: spark.createDataFrame([(name,)] if name else [], "name string")
    ds, new_ds = get_or_create(held.get("datasets", none("id string, name string")), wanted(dataset), "ds")
    who, new_who = get_or_create(held.get("contributors", none("id string, name string")), wanted(contributor), "contributor")
    digest = rows.filter("phash is not null").agg(F.coalesce(F.bit_xor(F.xxhash64("file_path", "sha256")), F.lit(0)).alias("x"), F.count("*").alias("sample_count"))
    batch_id = F.concat(F.lit("batch_"), F.substring(F.sha2(F.concat_ws("|", F.lit(dataset), F.lit(contributor or ""), F.lit(batch_label or ""), F.col("x").cast("string")), 256), 1, 12))
    one = digest.crossJoin(F.broadcast(ds.select(F.col("id").alias("dataset_id")))).join(F.broadcast(who.select(F.col("id").alias("contributor_id"))), how="left")  # one row each
    batch = cut(one.select(batch_id.alias("id"), "dataset_id", "contributor_id", F.lit(batch_label).cast("string").alias("label"), "sample_count"))
    every = rows.crossJoin(F.broadcast(batch.select(F.col("id").alias("batch_id"), "dataset_id", "contributor_id")))  # one row
    sample_id = F.concat(F.lit("sample_"), F.substring(F.sha2(F.concat_ws("|", "batch_id", "file_path"), 256), 1, 12))
    samples = every.filter("phash is not null").select(sample_id.alias("id"), "batch_id", "file_path", "sha256", "label_class", "phash")
    per = every.groupBy("dataset_id", "contributor_id", "batch_id", "label_class").agg(F.count("phash").alias("n_samples"), F.count_if(F.col("phash").isNull()).alias("n_skipped"))
    return {"datasets": new_ds.withColumn("format", F.lit(form)), "contributors": new_who, "batches": batch, "samples": samples}, per


def upload(spark: SparkSession, batch_id: str, name: str, content: bytes | str, label_class: str | None = None) -> DataFrame:
    """The sample row of one uploaded image (bytes, or base64 text). A name without a known suffix, or content that is no image, is an error."""
    from plumbline.functions.media import decode, fingerprint

    base = name.replace("\\", "/").rsplit("/", 1)[-1]
    if base.rsplit(".", 1)[-1].lower() not in IMAGES or "." not in base:
        raise ValueError("not a supported image file")
    data = base64.b64decode(content, validate=True) if isinstance(content, str) else bytes(content)
    try:
        mark = fingerprint(decode(data))
    except Exception as e:  # whatever a decoder raises, the upload is refused
        raise ValueError(f"invalid image: {type(e).__name__}") from e
    sha = hashlib.sha256(data).hexdigest()
    row = (f"sample_{hashlib.sha256(f'{batch_id}|{base}|{sha}'.encode()).hexdigest()[:12]}", batch_id, base, sha, label_class, mark)
    return spark.createDataFrame([row], "id string, batch_id string, file_path string, sha256 string, label_class string, phash string")


def model_files(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(base.contains("."), F.lower(F.element_at(F.split(base, r"\."), -1))).otherwise("unknown")
    kind = suffix
    for s, k in MODEL_FORMATS.items():
        kind = F.when(suffix == s, k).otherwise(kind)
    return f.select("path", kind.alias("format"), F.sha2("content", 256).alias("sha256"), "length")


def get_or_create(existing: DataFrame, names: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """existing(id, name), names(name) -> (id of every name, the rows to insert). A new id is a hash of the name, so reruns agree."""
    have = existing.groupBy("name").agg(F.min("id").alias("id"))
    new = names.select("name").distinct().join(have, "name", "left_anti").select(F.concat(F.lit(prefix + "_"), F.substring(F.sha2("name", 256), 1, 12)).alias("id"), "name")
    return have.join(names.select("name").distinct(), "name").select("id", "name").unionByName(new), new


def accept_evidence(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(source_node_type, source_node_id, ...), nodes(node_type, node_id) -> (accepted, refused with reason)."""
    kind = F.col("source_node_type").isin(*EVIDENCE_NODES)
    n = nodes.select(F.lower("node_type").alias("source_node_type"), F.col("node_id").alias("source_node_id")).distinct()
    keys = ["source_node_type", "source_node_id"]
    bad = rows.filter(~F.coalesce(kind, F.lit(False))).withColumn("reason", F.lit("unsupported source type"))
    good = rows.filter(kind)
    return good.join(n, keys, "left_semi"), bad.unionByName(good.join(n, keys, "left_anti").withColumn("reason", F.lit("unknown node")))


def append_findings(findings: DataFrame, inspections: DataFrame, path: str) -> None:
    """Append evidence and inspection rows below path; an inspection row is kept even where nothing was found."""
    findings.write.mode("append").parquet(f"{path}/evidence")
    inspections.write.mode("append").parquet(f"{path}/inspections")


def append_fingerprints(rows: DataFrame, path: str) -> None:
    """Append model fingerprints (model_id, fingerprint, stability) of a comparison below path, under the suite's name."""
    kept = rows.select("model_id", F.lit("default_suite").alias("probe_name"), F.col("fingerprint").alias("response_vector"), F.col("stability").alias("stability_score"))
    kept.write.mode("append").parquet(f"{path}/model_fingerprints")


def read_store(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the store. Columns that later versions added are null in older files."""
    return spark.read.option("mergeSchema", True).parquet(f"{path}/{table}")


def export_bundle(investigation, case_id: str, path: str, counterfactual: dict | None = None, exported_at: str | None = None) -> dict:
    """Write a case's bundle below path as one JSON row, and return it: exported_at, graph, investigation, counterfactual."""
    from plumbline.operators import assurance, lineage

    g, spark = investigation.graph, investigation.graph.spark
    own = replace(g, **{t: getattr(g, t).filter(F.col("case_id") == case_id) for t in ("nodes", "edges", "evidence", "inspections")})
    document = lineage.to_json(own).first()["document"]
    bundle = {"exported_at": exported_at or datetime.now(UTC).isoformat(), "graph": json.loads(document), "investigation": assurance.report(investigation, case_id), "counterfactual": counterfactual}
    spark.createDataFrame([(json.dumps(bundle, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return bundle


def search_rows(rows: DataFrame, text: str, columns: tuple[str, ...], **equal) -> DataFrame:
    """Rows by exact values of columns and by a text that occurs in the given ones, whatever the case."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    every = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns if c in rows.columns]))
    return rows.filter(every.contains(text.strip().lower())) if text.strip() else rows


def search_evidence(evidence: DataFrame, text: str = "", node: str | None = None, kind: str | None = None, detector: str | None = None) -> DataFrame:
    """Evidence by source, type and detector and by a text in any of its fields."""
    return search_rows(evidence, text, ("evidence_id", "source_id", "evidence_type", "detector", "stage", "details"), source_id=node, evidence_type=kind, detector=detector)


def facets(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """facet, value, n of the values of each column (given by the facet's name), in one aggregation."""
    named = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value")) for name, c in columns.items()])
    return rows.select(F.explode(named).alias("x")).select("x.facet", "x.value").groupBy("facet", "value").agg(F.count("*").alias("n"))


def ingest_counts(samples: DataFrame) -> DataFrame:
    """label_class, n, batches of what was ingested."""
    return samples.groupBy("label_class").agg(F.count("*").alias("n"), F.count_distinct("batch_id").alias("batches"))


def newest_first(models: DataFrame, n: int | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """models(model_id, created_at, ...) with place by created_at, newest first, then by id; the first n of each group."""
    w = W.partitionBy(*within).orderBy(F.desc("created_at"), "model_id")
    placed = models.withColumn("place", F.row_number().over(w))
    return placed if n is None else placed.filter(F.col("place") <= n)
