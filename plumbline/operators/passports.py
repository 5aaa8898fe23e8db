"""Receipts of inferences: issuing, and verification as windows over each deployment's arrivals.

Whether a record is accepted hangs on its signature and on its nonce's first valid arrival only, never on sequence state; so the state that a
sequential verifier would hold before a record is a set of aggregates over the rows before it.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import canonical_json
from plumbline.sources.storage import cut

# fixed values: the signed fields
FIELDS = ("deployment_id", "inference_id", "input_hash", "output_hash", "model_hash", "preproc_hash", "config_hash", "timestamp", "sequence", "nonce", "prev_hash")
GENESIS = "GENESIS"
MAX_SKEW = 300.0
COLUMNS = "deployment_id string, inference_id string, input_hash string, output_hash string, model_hash string, preproc_hash string, config_hash string, timestamp double, sequence long, nonce string, prev_hash string, signature string"


def sign(key: bytes, record: dict) -> str:
    return hmac.new(key, canonical_json({f: record[f] for f in FIELDS}).encode(), hashlib.sha256).hexdigest()


def record_hash(record: dict) -> str:
    """Chain hash: over the whole record, the signature included."""
    return hashlib.sha256(canonical_json({f: record[f] for f in (*FIELDS, "signature")}).encode()).hexdigest()


def issue(requests: DataFrame, key: bytes) -> DataFrame:
    """requests(deployment_id, inference_id, input_hash, output_hash, model_hash, preproc_hash, config_hash, timestamp, nonce, arrival)
    -> signed and chained records. A deployment's chain is sequential, so each is one group."""

    def run(pdf):
        last, rows = GENESIS, []
        for k, r in enumerate(pdf.sort_values("arrival").to_dict("records"), 1):
            r = {f: r[f] for f in FIELDS if f in r} | {"timestamp": float(r["timestamp"]), "sequence": k, "prev_hash": last, "arrival": int(r["arrival"])}
            r["signature"] = sign(key, r)
            last = record_hash(r)
            rows.append(r)
        import pandas as pd

        return pd.DataFrame(rows)[[c.split()[0] for c in COLUMNS.split(", ")] + ["arrival"]]

    return requests.groupBy("deployment_id").applyInPandas(run, COLUMNS + ", arrival long")


def with_digests(records: DataFrame, key: bytes) -> DataFrame:
    """Adds sig_ok and own_hash; canonical JSON needs Python, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
            for r in rows:
                r["timestamp"] = None if r["timestamp"] is None else float(r["timestamp"])
                r["sequence"] = None if r["sequence"] is None else int(r["sequence"])
            yield pdf.assign(sig_ok=[hmac.compare_digest(sign(key, r), r["signature"] or "") for r in rows], own_hash=[record_hash(r) for r in rows])

    schema = ", ".join(f"{c} {t}" for c, t in records.dtypes)
    return records.mapInPandas(run, schema + ", sig_ok boolean, own_hash string")


def replay_state(records: DataFrame) -> DataFrame:
    """records(deployment_id, arrival, nonce, sequence, prev_hash, sig_ok, own_hash) -> also replayed, last_seq, last_hash, reanchor before each row.

    The state before a row is made of maxima over the rows before it, and maxima compose: rows are range-partitioned by (deployment,
    arrival), so that a deployment with a third of all rows spreads over many partitions; a window within each partition gives the
    partition's own part, and deployments that reach over a partition's end get the maxima of their earlier partitions from a table of a
    row for each partition. A nonce's first arrival is an aggregate, so a flood of one nonce is no group either.
    """
    keys = ["deployment_id", "nonce", "sig_ok"]
    first = records.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("arrival").alias("_first"))
    same = F.col("deployment_id").eqNullSafe(F.col("_deployment_id")) & F.col("nonce").eqNullSafe(F.col("_nonce")) & F.col("sig_ok").eqNullSafe(F.col("_sig_ok"))
    r = records.join(first, same).withColumn("replayed", F.col("sig_ok") & (F.col("arrival") > F.col("_first"))).drop("_first", *[f"_{k}" for k in keys])
    r = r.withColumn("accepted", F.col("sig_ok") & ~F.col("replayed"))
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = cut(r.repartitionByRange(n, "deployment_id", "arrival").withColumn("_part", F.spark_partition_id()))
    best = F.when(F.col("accepted") & (F.col("sequence") > 0), F.struct("sequence", (-F.col("arrival")).alias("earliest"), "own_hash"))
    tops = {"_best": best, "_bad": F.when(~F.col("sig_ok"), F.col("arrival")), "_good": F.when(F.col("accepted"), F.col("arrival"))}
    before = W.partitionBy("deployment_id", "_part").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    own = r.withColumns({k: F.max(c).over(before) for k, c in tops.items()})
    parts = r.groupBy("deployment_id", "_part").agg(*[F.max(c).alias(k) for k, c in tops.items()])
    earlier = W.partitionBy("deployment_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    several = parts.withColumn("_n", F.count("*").over(W.partitionBy("deployment_id"))).filter("_n > 1")  # fewer than two rows for each partition
    carried = several.select("deployment_id", "_part", *[F.max(k).over(earlier).alias(f"{k}_before") for k in tops])
    r = own.join(F.broadcast(carried), ["deployment_id", "_part"], "left")
    top = lambda k: F.greatest(k, f"{k}_before")
    last = lambda k: F.coalesce(top(k), F.lit(-1))
    r = r.withColumns({"best": top("_best"), "reanchor": last("_bad") > last("_good")})
    r = r.withColumns({"last_seq": F.coalesce("best.sequence", F.lit(0)), "last_hash": F.coalesce("best.own_hash", F.lit(GENESIS))})
    return r.drop("best", "_part", *tops, *[f"{k}_before" for k in tops])


def verdicts(state: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """Adds findings: array of (kind, severity, confidence) in order of the checks. A bad signature or a replay ends the list.

    checks: further mismatch conditions by kind, for what a table holds beside the record (expected hashes, output, input, time).
    """
    one = lambda cond, kind, severity, confidence: F.when(cond, F.struct(F.lit(kind).alias("kind"), severity.cast("double").alias("severity"), F.lit(confidence).alias("confidence")))
    given = checks or {}
    levels = {"OUTPUT_HASH_MISMATCH": (1.0, 1.0), "INPUT_HASH_MISMATCH": (1.0, 1.0), "MODEL_ARTIFACT_MISMATCH": (1.0, 1.0), "CONFIG_MISMATCH": (0.9, 1.0), "TIMESTAMP_SKEW": (0.5, 0.8)}
    own = [one(given[k], k, F.lit(s), c) for k, (s, c) in levels.items() if k in given]
    jump = F.col("sequence") - F.col("last_seq") - 1
    gap = one(F.col("sequence") > F.col("last_seq") + 1 + F.col("reanchor").cast("int"), "SEQUENCE_GAP", F.least(F.lit(1.0), 0.4 + 0.2 * jump), 0.9)
    broken = one((F.col("prev_hash") != F.col("last_hash")) & ~F.col("reanchor"), "CHAIN_BREAK", F.lit(0.9), 0.9)
    bad, again = one(F.lit(True), "SIGNATURE_INVALID", F.lit(1.0), 1.0), one(F.lit(True), "REPLAY_DETECTED", F.lit(1.0), 1.0)
    found = F.when(~F.col("sig_ok"), F.array(bad)).when(F.col("replayed"), F.array_compact(F.array(*own, again))).otherwise(F.array_compact(F.array(*own, gap, broken)))
    return state.withColumn("findings", found)


def verify_batch(records: DataFrame, expected: DataFrame, key: bytes, now: Column | None = None, max_skew: float = MAX_SKEW) -> DataFrame:
    """records (COLUMNS, arrival; optionally seen_output_hash, seen_input_hash, seen_at), expected(deployment_id, expected_model, expected_preproc, expected_config)."""
    r = with_digests(records, key).join(expected, "deployment_id", "left")
    return verdicts(replay_state(r), mismatches(r.columns, now, max_skew))


def mismatches(columns: list[str], now: Column | None = None, max_skew: float = MAX_SKEW) -> dict[str, Column]:
    """Conditions by kind, for verdicts(), of a table with some of the columns that verify_batch() knows."""
    out = {}
    if "seen_output_hash" in columns:
        out["OUTPUT_HASH_MISMATCH"] = F.col("seen_output_hash") != F.col("output_hash")
    if "seen_input_hash" in columns:
        out["INPUT_HASH_MISMATCH"] = F.col("seen_input_hash") != F.col("input_hash")
    if "expected_model" not in columns:
        return out
    out["MODEL_ARTIFACT_MISMATCH"] = F.col("expected_model") != F.col("model_hash")
    out["CONFIG_MISMATCH"] = (F.col("expected_config") != F.col("config_hash")) | (F.col("expected_preproc") != F.col("preproc_hash"))
    at = now if now is not None else (F.col("seen_at") if "seen_at" in columns else None)
    if at is not None:
        out["TIMESTAMP_SKEW"] = F.abs(at - F.col("timestamp")) > max_skew
    return out


def evidence(verified: DataFrame) -> DataFrame:
    """Findings as evidence; ids carry the deployment, so that they stay unique."""
    order = W.partitionBy("deployment_id").orderBy("arrival", "at")
    v = verified.select("deployment_id", "inference_id", "arrival", F.posexplode("findings").alias("at", "f"))
    return v.select(
        F.format_string("%s/E-INF-%04d", F.col("deployment_id"), F.row_number().over(order)).alias("evidence_id"), F.col("inference_id").alias("source_id"), F.col("f.kind").alias("evidence_type"),
        F.col("f.severity").alias("severity"), F.col("f.confidence").alias("confidence"), F.lit("passport_verifier").alias("detector"),
    )


def totals(verified: DataFrame) -> DataFrame:
    """deployment_id, n_total, n_ok, clean, confidence of PASSPORT_VERIFIED where every record is clean."""
    ok = F.size("findings") == 0
    t = verified.groupBy("deployment_id").agg(F.count("*").alias("n_total"), F.count_if(ok).alias("n_ok"), F.bool_and(ok).alias("clean"))
    return t.withColumn("confidence", F.when(F.col("clean"), F.least(F.lit(1.0), F.col("n_total") / 20)))


def detection_rates(runs: DataFrame, attack_at: int) -> DataFrame:
    """runs(attack, seed, arrival, findings) -> attack, detected (share of seeds with a finding from attack_at on), false_positives, kinds."""
    late = (F.col("arrival") >= attack_at) & (F.size("findings") > 0)
    early = (F.col("arrival") < attack_at) & (F.size("findings") > 0)
    per = runs.groupBy("attack", "seed").agg(F.max(late.cast("int")).alias("hit"), F.count_if(early).alias("fp"), F.array_distinct(F.flatten(F.collect_list(F.col("findings.kind")))).alias("kinds"))
    return per.groupBy("attack").agg(F.avg("hit").alias("detected"), F.sum("fp").alias("false_positives"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))


def to_rows(records: list[dict]) -> list[tuple]:
    return [tuple(r[c.split()[0]] for c in COLUMNS.split(", ")) for r in records]


