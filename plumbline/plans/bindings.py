"""The driver's tables as inputs of the operators. CASES is SQL that Spark and the oracle share word for word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import hmac_sha256
from plumbline.operators.lineage import Graph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# a lifecycle case for each user; some lack contributor or deployment; large event values are findings
CASES = {
    "users": "SELECT DISTINCT user_id AS u FROM events",
    "nodes": """
SELECT 'u' || CAST(u AS STRING) AS case_id, code || '_' || CAST(u AS STRING) AS node_id, node_type, node_type || ' ' || CAST(u AS STRING) AS label
FROM users CROSS JOIN (VALUES ('C', 'CONTRIBUTOR'), ('DS', 'DATASET'), ('B', 'BATCH'), ('S', 'SAMPLE'), ('TR', 'TRAINING_RUN'), ('M', 'MODEL'), ('D', 'DEPLOYMENT'), ('IN', 'INPUT'), ('I', 'INFERENCE'), ('O', 'OUTPUT')) AS k(code, node_type)
WHERE NOT (code = 'C' AND u % 5 = 0) AND NOT (code = 'D' AND u % 11 = 0)""",
    "edges": """
SELECT 'u' || CAST(u AS STRING) AS case_id, a || '_' || CAST(u AS STRING) AS src, b || '_' || CAST(u AS STRING) AS dst, edge_type
FROM users CROSS JOIN (VALUES ('C', 'B', 'CONTRIBUTED'), ('DS', 'B', 'CONTAINS'), ('B', 'S', 'CONTAINS'), ('B', 'TR', 'TRAINED_ON'), ('TR', 'M', 'PRODUCED'), ('M', 'D', 'DEPLOYED_AS'), ('D', 'I', 'INFERRED_ON'), ('IN', 'I', 'INFERRED_ON'), ('I', 'O', 'GENERATED')) AS k(a, b, edge_type)
WHERE NOT (a = 'C' AND u % 5 = 0) AND NOT ((a = 'D' OR b = 'D') AND u % 11 = 0)""",
    "evidence": """
SELECT 'u' || CAST(user_id AS STRING) AS case_id, 'E' || CAST(1000000000 + event_id AS STRING) AS evidence_id, code || '_' || CAST(user_id AS STRING) AS source_id, evidence_type,
  LEAST(1.0, (value - 100.0) / 400.0) AS severity, 0.5 + CAST(event_id % 50 AS DOUBLE) / 100.0 AS confidence, detector
FROM events JOIN (VALUES ('click', 'B', 'NEAR_DUPLICATE_CLUSTER', 'duplicate_detector'), ('view', 'S', 'OOD_ANOMALY', 'ood_detector'), ('purchase', 'M', 'TRIGGER_SENSITIVITY', 'trigger_detector'), ('signup', 'I', 'ENVIRONMENT_METADATA_CHANGE', 'metadata_monitor'), ('error', 'O', 'PROVENANCE_MISMATCH', 'passport_verifier')) AS k(kind, code, evidence_type, detector)
ON event_type = kind WHERE value >= 100.0""",
    "inspections": """
SELECT 'u' || CAST(u AS STRING) AS case_id, code || '_' || CAST(u AS STRING) AS node_id, detector
FROM users CROSS JOIN (VALUES ('B', 'duplicate_detector', 2), ('B', 'label_detector', 2), ('M', 'hash_verifier', 3), ('M', 'trigger_detector', 3), ('D', 'passport_verifier', 4), ('DS', 'label_detector', 2), ('TR', 'label_detector', 6)) AS k(code, detector, every)
WHERE u % every = 0 AND NOT (code = 'D' AND u % 11 = 0)""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_cases(spark: SparkSession, sf_dir: str) -> Graph:
    made = {"events": load(spark, sf_dir, "events")}
    for name, sql in CASES.items():
        made[name] = spark.sql(sql.replace(" users ", " {users} ").replace("FROM events", "FROM {events}"), **{k: v for k, v in made.items() if f"{{{k}}}" in sql.replace(" users ", " {users} ").replace("FROM events", "FROM {events}")})
    cast = lambda df: df.select("case_id", "evidence_id", "source_id", "evidence_type", F.col("severity").cast("double").alias("severity"), F.col("confidence").cast("double").alias("confidence"), "detector")
    return Graph(made["nodes"], made["edges"], cast(made["evidence"]), made["inspections"], depth=6)


# faults of some of the cases, as rows beside theirs
FAULTS = {
    "nodes": "SELECT 'u' || CAST(u AS STRING), 'M_' || CAST(u AS STRING), 'BATCH' FROM users WHERE u % 7 = 0",
    "edges": """SELECT 'u' || CAST(u AS STRING), a || '_' || CAST(u AS STRING), b || '_' || CAST(u AS STRING), edge_type FROM users
JOIN (VALUES ('B', 'X', 'CONTAINS', 3, 0), ('TR', 'TR', 'DERIVED_FROM', 4, 0), ('O', 'B', 'CONTAINS', 5, 1), ('B', 'TR', 'CONTAINS', 6, 0)) AS k(a, b, edge_type, every, rest) ON u % every = rest""",
    "evidence": """SELECT 'u' || CAST(u AS STRING), code || '_' || CAST(u AS STRING), source || '_' || CAST(u AS STRING), severity, 0.5 FROM users
JOIN (VALUES ('F', 'M', 1.5, 2, 0), ('N', 'M', CAST(NULL AS DOUBLE), 8, 1), ('R', 'B', 0.5, 3, 1), ('R', 'S', 0.5, 3, 1), ('U', 'nowhere', 0.5, 5, 2)) AS k(code, source, severity, every, rest) ON u % every = rest""",
}


def faulty_cases(spark: SparkSession, sf_dir: str) -> Graph:
    """user_cases() with FAULTS."""
    g = user_cases(spark, sf_dir)
    users = load(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    rows = {t: spark.sql(sql.replace(" users", " {users}", 1), users=users) for t, sql in FAULTS.items()}
    nodes = g.nodes.union(rows["nodes"].toDF("case_id", "node_id", "node_type").withColumn("label", F.lit("again")))
    ev = rows["evidence"].toDF("case_id", "evidence_id", "source_id", "severity", "confidence")
    ev = ev.select("case_id", "evidence_id", "source_id", F.lit("TRIGGER_SENSITIVITY"), F.col("severity").cast("double"), F.col("confidence").cast("double"), F.lit("trigger_detector"))
    return Graph(nodes, g.edges.union(rows["edges"]), g.evidence.union(ev), g.inspections, depth=6)


# region -> nation -> {supplier, customer}; customer -> orders; a case for each region
def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = {n: load(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "orders")}
    n = t["nation"].select("n_nationkey", F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("case_id"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    cust = t["customer"].join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    supp = t["supplier"].join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    ords = t["orders"].join(cust.select("case_id", "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    node = lambda df, i, kind: df.select("case_id", i.alias("node_id"), F.lit(kind).alias("node_type"), i.alias("label"))
    edge = lambda df, a, b, kind: df.select("case_id", a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type"))
    reg = t["region"].select(key("R", "r_regionkey").alias("case_id"), "r_regionkey")
    nodes = node(reg, key("R", "r_regionkey"), "DATASET").union(node(n, key("N", "n_nationkey"), "BATCH")).union(node(cust, key("C", "c_custkey"), "SAMPLE")).union(node(supp, key("S", "s_suppkey"), "SAMPLE")).union(node(ords, key("O", "o_orderkey"), "SAMPLE"))
    edges = edge(n, F.col("case_id"), key("N", "n_nationkey"), "CONTAINS").union(edge(cust, key("N", "c_nationkey"), key("C", "c_custkey"), "CONTAINS")).union(edge(supp, key("N", "s_nationkey"), key("S", "s_suppkey"), "CONTAINS")).union(edge(ords, key("C", "o_custkey"), key("O", "o_orderkey"), "DERIVED_FROM"))
    ev = ords.filter("o_orderstatus = 'F'").select("case_id", key("E", "o_orderkey").alias("evidence_id"), key("O", "o_orderkey").alias("source_id"), F.lit("CLASS_IMBALANCE").alias("evidence_type"), (F.col("o_orderkey") % 100 / 100.0).alias("severity"), F.lit(0.5).alias("confidence"), F.lit("label_detector").alias("detector"))
    none = spark.createDataFrame([], "case_id string, node_id string, detector string")
    return Graph(nodes, edges, ev, none, depth=3)


def label_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A sample for each document; its batch is its source; its class its labels."""
    d, lab = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    s = d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("batch_id"), F.concat(F.col("quality").cast("string"), F.lit("_"), F.col("toxic").cast("string")).alias("label_class"), F.substring(F.md5("text"), 1, 16).alias("phash"))
    return s, d.select(F.col("source").alias("batch_id"), F.lit("corpus").alias("dataset_id")).distinct()


def embedding_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("batch_id"), "embedding")
    return e, e.select("batch_id", F.lit("all").alias("dataset_id")).distinct()


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as receipts: a deployment for each user; every 17th is lost, every 13th repeats a nonce, every 29th has a bad signature, every
    19th another model, every 23rd another configuration, every 31st another output, every 37th another input; a receipt bears the time of the event before it."""
    e = load(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("sequence", F.row_number().over(w).cast("long")).withColumn("prev", F.coalesce(F.concat(F.lit("h"), F.lag("event_id").over(w).cast("string")), F.lit("GENESIS")))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = e.withColumn("timestamp", F.coalesce(F.lag(seconds).over(w), seconds)).withColumn("seen_at", seconds)
    e = e.filter("event_id % 17 != 0")
    other = lambda every, name: F.when(F.col("event_id") % every == 0, "other").otherwise(name)
    good = {"output_hash": (31, "o"), "input_hash": (37, "i"), "model_hash": (19, "m"), "config_hash": (23, "c"), "preproc_hash": (0, "p")}
    beside = {"output_hash": "seen_output_hash", "input_hash": "seen_input_hash", "model_hash": "expected_model", "config_hash": "expected_config", "preproc_hash": "expected_preproc"}
    return e.select(
        F.col("user_id").cast("string").alias("deployment_id"), F.col("event_id").cast("string").alias("inference_id"), F.col("event_id").alias("arrival"), "sequence",
        F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("r"), (F.col("event_id") % 7).cast("string"))).otherwise(F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("nonce"),
        (F.col("event_id") % 29 != 0).alias("sig_ok"), F.col("prev").alias("prev_hash"), F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("own_hash"), "timestamp", "seen_at",
        *[(other(every, name) if every else F.lit(name)).alias(c) for c, (every, name) in good.items()], *[F.lit(good[c][1]).alias(s) for c, s in beside.items()],
    )


def signed_receipts(spark: SparkSession, sf_dir: str, key: bytes) -> DataFrame:
    """receipts() as records with a signature (every 29th over something else) whose times are whole seconds; signed by column functions."""
    r = receipts(spark, sf_dir).withColumn("timestamp", F.floor("timestamp").cast("double"))
    text = lambda c: F.concat(F.lit(f'"{c}":"'), F.col(c), F.lit('"'))
    head = [text(c) for c in ("config_hash", "deployment_id", "inference_id", "input_hash", "model_hash", "nonce", "output_hash", "preproc_hash", "prev_hash")]
    number = [F.concat(F.lit('"sequence":'), F.col("sequence").cast("string")), F.concat(F.lit('"timestamp":'), F.col("timestamp").cast("long").cast("string"), F.lit(".0"))]
    body = F.concat(F.lit("{"), F.concat_ws(",", *head, *number), F.lit("}"))
    signature = hmac_sha256(key, F.when(F.col("sig_ok"), body).otherwise("forged"))
    return r.withColumn("signature", signature).drop("sig_ok", "own_hash")
