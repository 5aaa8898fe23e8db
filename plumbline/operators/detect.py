"""Detectors over all batches, models or responses at once. Each returns findings in the evidence schema with details.

samples(sample_id, batch_id, label_class, phash, embedding) and batches(batch_id, dataset_id) are the data detectors' inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import clip01, cosine, hamming_hex, l2, norm, py_round
from plumbline.sources.storage import cut

JS_LIMIT, LEAST_LABELS = 0.25, 10
Z_LIMIT, LEAST_REFERENCE = 3.0, 8
NEAR_BITS, LEAST_HASHED, FLOOD_SHARE = 5, 5, 0.15
SHOWN = 50  # names that a finding's details list


def finding(rows: DataFrame, kind: str, source: str, severity: Column, confidence: Column, detector: str, *details: str) -> DataFrame:
    return rows.select(
        F.col(source).alias("source_id"), F.lit(kind).alias("evidence_type"), py_round(severity, 3).alias("severity"), confidence.alias("confidence"), F.lit(detector).alias("detector"),
        F.to_json(F.struct(*details)).alias("details"),
    )


def first_names(rows: DataFrame, keys: list[str], name: str, alias: str, n: int = SHOWN) -> DataFrame:
    """keys and the first n names of each group; a window limit, which Spark applies before its shuffle too, keeps the rest from being gathered."""
    first = rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(name))).filter(F.col("_k") <= n)
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(name)).alias(alias))


# --- labels ---------------------------------------------------------------------------------------------------------


def class_frequencies(samples: DataFrame) -> DataFrame:
    """batch_id, label_class, n, share of the batch."""
    c = samples.filter("label_class is not null and label_class != ''").groupBy("batch_id", "label_class").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("batch_id")))


def label_skew(samples: DataFrame, batches: DataFrame) -> DataFrame:
    """batch_id, n_batch, n_rest, js: Jensen-Shannon distance (base 2) of a batch's classes from all other batches of its dataset.

    One aggregation by (batch, class); the rest of a dataset is its total minus the batch, so no batch is joined with its siblings.
    """
    c = samples.filter("label_class is not null and label_class != ''").join(batches.select("batch_id", "dataset_id"), "batch_id").groupBy("dataset_id", "batch_id", "label_class").agg(F.count("*").alias("n"))
    per_class = c.groupBy("dataset_id", "label_class").agg(F.sum("n").alias("n_class"))
    per_batch = c.groupBy("dataset_id", "batch_id").agg(F.sum("n").alias("n_batch"))
    total = per_class.groupBy("dataset_id").agg(F.sum("n_class").alias("n_all"))
    dense = per_batch.join(per_class, "dataset_id").join(total, "dataset_id").join(c, ["dataset_id", "batch_id", "label_class"], "left").na.fill(0, ["n"])
    p, q = F.col("n") / F.col("n_batch"), (F.col("n_class") - F.col("n")) / (F.col("n_all") - F.col("n_batch"))
    d = dense.filter("n_all > n_batch").withColumns({"p": p, "q": q}).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.sum(F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(0.0))
    g = d.groupBy("dataset_id", "batch_id", "n_batch", (F.col("n_all") - F.col("n_batch")).alias("n_rest")).agg((0.5 * part("p") + 0.5 * part("q")).alias("jsd"))
    return g.select("dataset_id", "batch_id", "n_batch", "n_rest", F.sqrt(F.greatest("jsd", F.lit(0.0))).alias("js"))


def labels(samples: DataFrame, batches: DataFrame) -> DataFrame:
    s = label_skew(samples, batches).filter((F.col("n_batch") >= LEAST_LABELS) & (F.col("n_rest") >= LEAST_LABELS) & (F.col("js") >= JS_LIMIT))
    return finding(s, "LABEL_DISTRIBUTION_ANOMALY", "batch_id", F.least(F.lit(1.0), F.col("js") / 0.6), F.lit(0.85), "label_detector", "n_batch", "n_rest", "js")


# --- out of distribution ----------------------------------------------------------------------------------------------


def ood_scores(samples: DataFrame, batches: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """sample_id, batch_id, n_ref, z: root mean square of an embedding's deviations from its reference, dimension by dimension.

    The reference is all other batches of the dataset, as total minus batch of counts, sums and squares; or the samples in `reference`
    (dataset_id, embedding).
    """
    s = samples.filter("embedding is not null").join(batches.select("batch_id", "dataset_id"), "batch_id").select("sample_id", "batch_id", "dataset_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    sums = [F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss")]
    if reference is None:
        b = s.groupBy("dataset_id", "batch_id", "d").agg(*sums)
        whole = W.partitionBy("dataset_id", "d")
        rest = {c: F.sum(c).over(whole) - F.col(c) for c in ("n", "s", "ss")}
        b = b.select("dataset_id", "batch_id", "d", *[v.alias(k) for k, v in rest.items()])
    else:
        r = reference.select("dataset_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x")).groupBy("dataset_id", "d").agg(*sums)
        b = s.select("dataset_id", "batch_id", "d").distinct().join(r, ["dataset_id", "d"])
    b = b.filter(F.col("n") > 0).withColumn("mean", F.col("s") / F.col("n"))
    b = b.withColumn("std", F.greatest(F.sqrt(F.greatest(F.col("ss") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0))), F.lit(1e-6)))
    z = s.join(b.select("dataset_id", "batch_id", "d", F.col("n").alias("n_ref"), "mean", "std"), ["dataset_id", "batch_id", "d"])
    return z.groupBy("dataset_id", "batch_id", "sample_id").agg(F.min("n_ref").alias("n_ref"), F.sqrt(F.avg(F.pow((F.col("x") - F.col("mean")) / F.col("std"), 2))).alias("z"))


def ood(samples: DataFrame, batches: DataFrame, reference: DataFrame | None = None, limit: float = Z_LIMIT) -> DataFrame:
    z = ood_scores(samples, batches, reference).filter(F.col("n_ref") >= LEAST_REFERENCE)
    hit = F.col("z") >= limit
    z = z.withColumn("name", F.col("sample_id").cast("string"))
    b = z.groupBy("batch_id").agg(F.max("z").alias("max_z"), F.count_if(hit).alias("n_flagged"), F.avg(hit.cast("double")).alias("fraction"))
    b = b.join(first_names(z.filter(hit), ["batch_id"], "name", "flagged"), "batch_id")
    return finding(b.filter("n_flagged > 0"), "OOD_ANOMALY", "batch_id", F.least(F.lit(1.0), F.col("max_z") / 6.0), F.lit(0.7), "ood_detector", "max_z", "n_flagged", "fraction", "flagged")


# --- near duplicates of fingerprints ----------------------------------------------------------------------------------


def near_pairs(samples: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """batch_id, a, b (a < b), distance of fingerprints within `bits`: of bits + 1 bands at least one agrees, so bands are the join key."""
    bands = min(bits + 1, 64)
    cuts = [64 * k // bands for k in range(bands + 1)]
    hexes = F.lpad("phash", 16, "0")
    binary = F.concat(*[F.lpad(F.conv(F.substring(hexes, 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(2)])
    s = samples.filter("phash is not null").select("batch_id", "sample_id", F.lower(hexes).alias("phash"), binary.alias("bin"))
    keys = F.array(*[F.substring("bin", a + 1, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    band = s.select("batch_id", "sample_id", "phash", F.posexplode(keys).alias("k", "key"))
    a, b = band.withColumnsRenamed({"sample_id": "a", "phash": "x"}), band.withColumnsRenamed({"sample_id": "b", "phash": "y"})
    d = hamming_hex(F.col("x"), F.col("y"))
    return a.join(b, ["batch_id", "k", "key"]).filter("a < b").select("batch_id", "a", "b", d.alias("distance")).filter(F.col("distance") <= bits).distinct()


def leader_clusters(samples: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """batch_id, sample_id, leader: in order of sample_id a sample joins the first leader within `bits`, or leads.

    The rule is sequential, but only samples that chains of near fingerprints connect can touch one another: equal fingerprints are one
    entry, near_pairs() finds the entries within `bits`, labels spread along them until nothing changes, and the rule runs in
    each connected group. A sample without any near one leads itself and reaches no group.
    """
    s = samples.filter("phash is not null").select("batch_id", "sample_id", F.lower(F.lpad("phash", 16, "0")).alias("phash"))
    kinds = dict(s.dtypes)
    once = cut(s.groupBy("batch_id", "phash").agg(F.min("sample_id").alias("sample_id")))
    pairs = cut(near_pairs(once, bits).select("batch_id", "a", "b"))
    ends = pairs.union(pairs.select("batch_id", "b", "a"))
    label = cut(ends.groupBy("batch_id", F.col("a").alias("x")).agg(F.least(F.min("a"), F.min("b")).alias("l")))
    while True:  # the least id spreads along chains and through the labels themselves, so rounds grow with the logarithm of a chain
        by = label.select("batch_id", F.col("x").alias("b"), F.col("l").alias("m"))
        near = ends.join(by, ["batch_id", "b"]).groupBy("batch_id", F.col("a").alias("x")).agg(F.min("m").alias("m"))
        jump = label.join(label.select("batch_id", F.col("x").alias("l"), F.col("l").alias("j")), ["batch_id", "l"], "left").select("batch_id", "x", "l", "j")
        new = cut(jump.join(near, ["batch_id", "x"]).select("batch_id", "x", F.least("l", "j", "m").alias("l"), (F.least("j", "m") < F.col("l")).alias("moved")))
        label = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            break

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("sample_id")
        leaders, names, out = np.zeros(0, np.uint64), [], []
        for i, c in zip(pdf["sample_id"].to_numpy(), [np.uint64(int(h, 16)) for h in pdf["phash"]], strict=True):
            near = np.flatnonzero(np.bitwise_count(leaders ^ c) <= bits)
            if len(near):
                out.append(names[near[0]])
            else:
                leaders = np.append(leaders, c)
                names.append(i)
                out.append(i)
        return pdf.assign(leader=out)[["batch_id", "phash", "leader"]]

    grouped = once.join(label.withColumnRenamed("x", "sample_id"), ["batch_id", "sample_id"])
    led = grouped.groupBy("batch_id", "l").applyInPandas(run, f"batch_id {kinds['batch_id']}, phash string, leader {kinds['sample_id']}")
    alone = once.join(label.withColumnRenamed("x", "sample_id"), ["batch_id", "sample_id"], "left_anti").select("batch_id", "phash", F.col("sample_id").alias("leader"))
    return s.join(led.unionByName(alone), ["batch_id", "phash"]).select("batch_id", "sample_id", "leader")


def duplicates(samples: DataFrame, bits: int = NEAR_BITS, share: float = FLOOD_SHARE) -> DataFrame:
    c = leader_clusters(samples, bits).withColumn("name", F.col("sample_id").cast("string"))
    members = first_names(c, ["batch_id", "leader"], "name", "members")
    c = c.groupBy("batch_id", "leader").agg(F.count("*").alias("size")).join(members, ["batch_id", "leader"])
    c = c.withColumn("hashed", F.sum("size").over(W.partitionBy("batch_id"))).withColumn("fraction", F.col("size") / F.col("hashed"))
    c = c.filter((F.col("hashed") >= LEAST_HASHED) & (F.col("size") >= 2) & (F.col("fraction") >= share))
    return finding(c, "NEAR_DUPLICATE_CLUSTER", "batch_id", F.least(F.lit(1.0), 1.5 * F.col("fraction")), F.lit(0.9), "duplicate_detector", "size", "fraction", "members")


def all_batches(samples: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings of the three data detectors over every batch, one inspection (node_id, detector) of each batch by each, found or not)."""
    found = duplicates(samples).unionByName(labels(samples, batches)).unionByName(ood(samples, batches))
    ran = F.explode(F.array(*map(F.lit, ("duplicate_detector", "label_detector", "ood_detector"))))
    return found, batches.select(F.col("batch_id").alias("node_id")).distinct().select("node_id", ran.alias("detector"))


def exact_duplicates(samples: DataFrame) -> DataFrame:
    """samples(sample_id, batch_id, digest) -> batch_id, digest, n, first (sample), fraction of the batch, of digests that recur in a batch."""
    per = samples.groupBy("batch_id").agg(F.count("*").alias("every"))
    g = samples.groupBy("batch_id", "digest").agg(F.count("*").alias("n"), F.min("sample_id").alias("first")).filter("n > 1").join(per, "batch_id")
    return g.select("batch_id", "digest", "n", "first", (F.col("n") / F.col("every")).alias("fraction"))


# --- models -----------------------------------------------------------------------------------------------------------


def fingerprint_distances(fingerprints: DataFrame) -> DataFrame:
    """fingerprints(model_id, fingerprint) of a suite's few models -> reference, candidate (each pair once), l2, cosine."""
    a, b = (fingerprints.select(F.col("model_id").alias(n), F.col("fingerprint").alias(x)) for n, x in (("reference", "x"), ("candidate", "y")))
    p = a.join(b, F.col("reference") < F.col("candidate"))
    return p.select("reference", "candidate", l2(F.col("x"), F.col("y")).alias("l2"), cosine(F.col("x"), F.col("y")).alias("cosine"))


def behaviour(pairs: DataFrame) -> DataFrame:
    """pairs(model_id, reference, candidate) of fingerprints -> BEHAVIORAL_DEVIATION where they deviate."""
    p = pairs.withColumns({"distance": l2(F.col("reference"), F.col("candidate")), "similarity": cosine(F.col("reference"), F.col("candidate"))})
    p = p.withColumn("bad", F.assert_true(F.size("reference") == F.size("candidate"), F.lit("fingerprints differ in shape"))).filter("bad is null")
    off = 1 - F.col("similarity")
    p = p.withColumn("severity", F.greatest(F.least(F.lit(1.0), F.col("distance") / 2), clip01(off / 0.5)))
    p = p.withColumn("confidence", F.least(F.lit(0.99), 0.65 + 0.2 * F.least(F.lit(1.0), F.col("distance")) + 0.15 * clip01(off))).filter("severity >= 0.25")
    return finding(p, "BEHAVIORAL_DEVIATION", "model_id", F.col("severity"), py_round(F.col("confidence"), 3), "behavior_detector", "distance", "similarity")


MODEL_FIELDS = ("format", "architecture", "param_count", "layer_count", "input_shape")


def differences(pairs: DataFrame, fields: tuple[str, ...] = MODEL_FIELDS) -> DataFrame:
    """pairs with <field>_ref and <field>_new -> also differences: field -> {reference, candidate} where unequal."""
    text = lambda f, k: F.col(f"{f}_{k}").cast("string")
    each = [F.when(~F.col(f"{f}_ref").eqNullSafe(F.col(f"{f}_new")), F.struct(F.lit(f).alias("key"), F.struct(text(f, "ref").alias("reference"), text(f, "new").alias("candidate")).alias("value"))) for f in fields]
    return pairs.withColumn("differences", F.map_from_entries(F.array_compact(F.array(*each))))


def structure(pairs: DataFrame, fields: tuple[str, ...] = MODEL_FIELDS) -> DataFrame:
    d = differences(pairs, fields).withColumn("n", F.size("differences")).filter("n > 0")
    return finding(d, "STRUCTURAL_DEVIATION", "model_id", F.least(F.lit(1.0), 0.25 * F.col("n")), F.lit(0.95), "structural_detector", "differences")


def artifacts(models: DataFrame, authorized: DataFrame) -> DataFrame:
    """models(model_id, sha256), authorized(model_id, sha256): hashes that differ; a missing hash proves nothing."""
    j = models.select("model_id", F.col("sha256").alias("candidate")).join(authorized.select("model_id", F.col("sha256").alias("authorized")), "model_id").filter("candidate != authorized")
    return finding(j, "MODEL_ARTIFACT_MISMATCH", "model_id", F.lit(1.0), F.lit(0.99), "model_artifact_hash_checker", "authorized", "candidate")


def trigger_deltas(responses: DataFrame) -> DataFrame:
    """responses(model_id, trigger, clean, triggered) of summaries (count, confidence, classes map, boxes array, numbers array) -> delta.

    A response with detections compares counts, confidences, classes and boxes; any other its flat numbers.
    """
    a, b = F.col("clean"), F.col("triggered")
    count = clip01(F.abs(b["count"] - a["count"]) / F.greatest(F.lit(1.0), a["count"]))
    conf = clip01(F.abs(b["confidence"] - a["confidence"]) / F.greatest(F.lit(0.05), F.abs(a["confidence"])))
    entries = lambda m: F.array_sort(F.map_entries(m))
    kinds = F.when(entries(a["classes"]) == entries(b["classes"]), 0.0).otherwise(1.0)
    box = F.when(F.size(a["boxes"]) != F.size(b["boxes"]), 1.0).otherwise(clip01(l2(a["boxes"], b["boxes"]) / F.greatest(F.lit(1.0), norm(a["boxes"]))))
    detections = F.least(F.lit(1.0), 0.2 * count + 0.6 * conf + 0.1 * kinds + 0.1 * box)
    plain = l2(b["numbers"], a["numbers"]) / (norm(a["numbers"]) + 1e-8)
    return responses.select("model_id", "trigger", F.when((a["count"] > 0) | (b["count"] > 0), detections).otherwise(plain).alias("delta"))


def triggers(deltas: DataFrame, limit: float = 0.5) -> DataFrame:
    g = deltas.groupBy("model_id").agg(F.count_if(F.col("delta") >= limit).alias("suspicious"), F.count("*").alias("total"), F.max("delta").alias("max_delta")).filter("suspicious > 0")
    g = g.withColumn("consistency", F.col("suspicious") / F.col("total"))
    severity = F.least(F.lit(1.0), 0.7 * F.least(F.lit(1.0), F.col("max_delta")) + 0.3 * F.col("consistency"))
    return finding(g, "TRIGGER_SENSITIVITY", "model_id", severity, py_round(F.least(F.lit(0.99), 0.65 + 0.3 * F.col("consistency")), 3), "trigger_detector", "suspicious", "total", "max_delta")


def stability(runs: DataFrame) -> DataFrame:
    """runs(model_id, probe, reference, response) -> mean over probes of max(0, 1 - relative change)."""
    change = l2(F.col("response"), F.col("reference")) / (norm(F.col("reference")) + 1e-8)
    return runs.groupBy("model_id").agg(F.coalesce(F.avg(F.greatest(F.lit(0.0), 1 - change)), F.lit(1.0)).alias("stability"))
