"""All queries over the driver's tables with their SQL equivalents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import assurance, counterfactual, detect, fusion, lineage, passports, scenarios
from plumbline.plans import bindings, dims
from plumbline.plans.bindings import CASES, load, user_cases
from plumbline.sources import relational

CONFIG = dims.FusionConfig()


def r6(c) -> F.Column:
    return F.round(c, 6)


# --- SQL pieces -----------------------------------------------------------------------------------------------------

WITH_CASES = "WITH RECURSIVE " + ", ".join(f"{name} AS ({sql})" for name, sql in CASES.items())
CLOSURE = """, reach(case_id, anc, dst, dist) AS (SELECT case_id, node_id, node_id, 0 FROM nodes UNION SELECT r.case_id, r.anc, e.dst, r.dist + 1 FROM reach r JOIN edges e ON r.case_id = e.case_id AND r.dst = e.src),
closure AS (SELECT case_id, anc, dst, min(dist) AS dist FROM reach GROUP BY ALL)"""
STAGE_SQL = "CASE " + " ".join(f"WHEN node_type = '{t}' THEN '{s}'" for t, s in dims.STAGE_OF.items()) + " END"
WEIGHTED = f", weighted AS (SELECT v.*, n.node_type, {STAGE_SQL} AS stage, severity * confidence AS weight FROM evidence v JOIN nodes n ON v.case_id = n.case_id AND v.source_id = n.node_id)"
INSPECTED = ", inspected AS (SELECT DISTINCT i.* FROM (SELECT case_id, node_id, detector FROM inspections UNION SELECT case_id, source_id, detector FROM evidence) i JOIN nodes n USING (case_id, node_id))"
_values = lambda rows: ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
COVERAGE = f""", coverage AS (SELECT case_id, count(*) FILTER (node_type IN {dims.COVERED}) AS n_nodes, count(*) FILTER (node_type IN {dims.COVERED} AND EXISTS (SELECT 1 FROM inspected i WHERE i.case_id = n.case_id AND i.node_id = n.node_id)) AS n_inspected FROM nodes n GROUP BY case_id)"""
GAPS = """, need AS (SELECT * FROM (VALUES {0}) t(node_type, anc_type, issue)),
gaps AS (SELECT DISTINCT n.case_id, n.node_id, d.issue FROM nodes n JOIN need d USING (node_type) WHERE NOT EXISTS (
  SELECT 1 FROM closure c JOIN nodes a ON a.case_id = c.case_id AND a.node_id = c.anc JOIN need d2 ON d2.node_type = n.node_type AND d2.anc_type = a.node_type WHERE c.case_id = n.case_id AND c.dst = n.node_id AND c.dist > 0))""".format(_values([(t, a, f"{t}_WITHOUT_{'_OR_'.join(need)}") for t, need in dims.REQUIRED_UPSTREAM.items() for a in need]))
RELATION = """, direct AS (SELECT p.case_id, p.a, p.b, u.dist AS up, d.dist AS down FROM pairs p LEFT JOIN closure u ON u.case_id = p.case_id AND u.anc = p.a AND u.dst = p.b LEFT JOIN closure d ON d.case_id = p.case_id AND d.anc = p.b AND d.dst = p.a),
common AS (SELECT p.case_id, p.a, p.b, x.anc AS via, x.dist + y.dist AS dist, row_number() OVER (PARTITION BY p.case_id, p.a, p.b ORDER BY x.dist + y.dist, x.anc) AS k FROM direct p JOIN closure x ON x.case_id = p.case_id AND x.dst = p.a JOIN closure y ON y.case_id = p.case_id AND y.dst = p.b AND y.anc = x.anc WHERE p.up IS NULL AND p.down IS NULL),
relation AS (SELECT p.case_id, p.a, p.b, CASE WHEN p.a = p.b THEN 'SAME_NODE' WHEN up IS NOT NULL THEN 'UPSTREAM' WHEN down IS NOT NULL THEN 'DOWNSTREAM' WHEN c.via IS NOT NULL THEN 'COMMON_ORIGIN' ELSE 'UNRELATED' END AS kind, coalesce(up, down, c.dist) AS dist, c.via
  FROM direct p LEFT JOIN common c ON c.case_id = p.case_id AND c.a = p.a AND c.b = p.b AND c.k = 1),
near AS (SELECT *, CASE WHEN kind = 'SAME_NODE' THEN 1.0 WHEN kind = 'UNRELATED' THEN 0.0 WHEN kind = 'COMMON_ORIGIN' THEN 0.5 * pow(0.85, dist - 1) ELSE pow(0.85, dist - 1) END AS proximity FROM relation)"""
SOURCES = ", src AS (SELECT DISTINCT case_id, source_id FROM weighted), pairs AS (SELECT x.case_id, x.source_id AS a, y.source_id AS b FROM src x JOIN src y USING (case_id))"
CHECKS = f""", chk AS (SELECT * FROM (VALUES {_values([(c,) for c in dims.CHECKS])}) t(name)), chk_type AS (SELECT * FROM (VALUES {_values([(c, t) for c, (ts, _) in dims.CHECKS.items() for t in ts])}) t(name, evidence_type)), chk_need AS (SELECT * FROM (VALUES {_values([(c, d) for c, (_, ds) in dims.CHECKS.items() for d in ds])}) t(name, detector)),
status AS (SELECT case_id, name, CASE WHEN EXISTS (SELECT 1 FROM weighted w JOIN chk_type t ON t.evidence_type = w.evidence_type WHERE w.case_id = c.case_id AND t.name = k.name AND w.weight >= 0.15) THEN 'FAIL'
  WHEN EXISTS (SELECT 1 FROM chk_need d WHERE d.name = k.name AND NOT EXISTS (SELECT 1 FROM inspected i WHERE i.case_id = c.case_id AND i.detector = d.detector)) THEN 'UNKNOWN' ELSE 'PASS' END AS status FROM (SELECT DISTINCT case_id FROM nodes) c CROSS JOIN chk k)"""
SCORES = f""", coef AS (SELECT * FROM (VALUES {_values([(t, h, c) for t, row in dims.COEFFICIENTS.items() for h, c in row.items()])}) t(evidence_type, hypothesis, coef)), rel AS (SELECT * FROM (VALUES {_values(list(dims.RELIABILITY.items()))}) t(detector, r)), hyp AS (SELECT * FROM (VALUES {_values([(h, k, int(h in dims.ATTACKS)) for k, h in enumerate(dims.HYPOTHESES)])}) t(hypothesis, ord, is_attack)),
strong AS (SELECT w.*, coalesce(r, 0.5) * weight AS strength FROM weighted w LEFT JOIN rel USING (detector)),
signed AS (SELECT s.*, hypothesis, CAST(coef AS DOUBLE) AS coef FROM strong s JOIN coef USING (evidence_type)),
base AS (SELECT case_id, hypothesis, sum(CASE WHEN coef > 0 THEN strength * coef ELSE 0 END) AS base, sum(CASE WHEN coef < 0 THEN -strength * coef ELSE 0 END) AS contra FROM signed GROUP BY ALL),
corr AS (SELECT x.case_id, x.hypothesis, sum(0.5 * proximity * CASE WHEN x.stage <> y.stage THEN 1.0 ELSE 0.6 END * sqrt(x.strength * x.coef * y.strength * y.coef)) AS corr FROM signed x JOIN signed y ON x.case_id = y.case_id AND x.hypothesis = y.hypothesis AND x.evidence_id < y.evidence_id AND x.coef > 0 AND y.coef > 0 AND x.detector <> y.detector JOIN near n ON n.case_id = x.case_id AND n.a = x.source_id AND n.b = y.source_id GROUP BY ALL),
ctx AS (SELECT c.case_id, CASE WHEN n_nodes > 0 THEN n_inspected / n_nodes ELSE 0 END AS coverage, (SELECT count(*) FROM gaps g WHERE g.case_id = c.case_id) AS n_gaps, (SELECT count(*) FROM status s WHERE s.case_id = c.case_id AND status = 'PASS') AS n_pass, (SELECT count(*) FROM status s WHERE s.case_id = c.case_id AND status = 'FAIL') AS n_fail,
  coalesce((SELECT sum(strength) FROM strong s WHERE s.case_id = c.case_id AND evidence_type IN {dims.SHIFT_SIGNALS}), 0) AS shift_signal FROM coverage c),
part AS (SELECT c.case_id, h.hypothesis, ord, is_attack, coverage, n_gaps, CASE WHEN h.hypothesis = 'CLEAN' THEN 2.0 * coverage ELSE coalesce(base, 0) END AS base, CASE WHEN h.hypothesis = 'CLEAN' THEN 0 ELSE least(coalesce(corr, 0), coalesce(base, 0)) END AS corr,
  CASE WHEN h.hypothesis = 'CLEAN' THEN 2.0 * coalesce(contra, 0) + 0.25 * n_gaps ELSE coalesce(contra, 0) END AS contra, CASE WHEN shift_signal > 0 AND n_fail = 0 THEN n_pass / 4.0 * shift_signal ELSE 0 END * CASE WHEN h.hypothesis = '{dims.SHIFT}' THEN 1 WHEN is_attack = 1 THEN -1 ELSE 0 END AS ctx
  FROM ctx c CROSS JOIN hyp h LEFT JOIN base b ON b.case_id = c.case_id AND b.hypothesis = h.hypothesis LEFT JOIN corr r ON r.case_id = c.case_id AND r.hypothesis = h.hypothesis),
raw AS (SELECT *, greatest(0.0, base + corr - contra + ctx) AS raw, 1 - exp(-greatest(0.0, base + corr - contra + ctx) / 1.5) AS support FROM part),
scores AS (SELECT *, row_number() OVER w AS rank, support - coalesce(lead(support) OVER w, 0) AS margin, coalesce(raw / nullif(sum(raw) OVER (PARTITION BY case_id), 0), 0) AS share FROM raw WINDOW w AS (PARTITION BY case_id ORDER BY support DESC, raw DESC, ord))"""
ALL_CASES = WITH_CASES + CLOSURE + WEIGHTED + INSPECTED + COVERAGE + GAPS + SOURCES + RELATION + CHECKS + SCORES
TRADE = """WITH nodes AS (SELECT 'R' || r_regionkey AS case_id, 'R' || r_regionkey AS node_id, 0 AS level FROM region),
n AS (SELECT 'R' || n_regionkey AS case_id, 'N' || n_nationkey AS id, n_nationkey FROM nation), c AS (SELECT case_id, 'C' || c_custkey AS id, c_custkey, n.id AS up FROM customer JOIN n ON c_nationkey = n_nationkey),
s AS (SELECT case_id, 'S' || s_suppkey AS id, s_suppkey, n.id AS up FROM supplier JOIN n ON s_nationkey = n_nationkey), o AS (SELECT case_id, 'O' || o_orderkey AS id, o_orderkey, o_orderstatus, c.id AS up, c.up AS up2 FROM orders JOIN c ON o_custkey = c_custkey),
closure AS (SELECT case_id, node_id AS anc, node_id AS dst, 0 AS dist FROM nodes UNION ALL SELECT case_id, id, id, 0 FROM n UNION ALL SELECT case_id, id, id, 0 FROM c UNION ALL SELECT case_id, id, id, 0 FROM s UNION ALL SELECT case_id, id, id, 0 FROM o
 UNION ALL SELECT case_id, case_id, id, 1 FROM n UNION ALL SELECT case_id, up, id, 1 FROM c UNION ALL SELECT case_id, case_id, id, 2 FROM c UNION ALL SELECT case_id, up, id, 1 FROM s UNION ALL SELECT case_id, case_id, id, 2 FROM s
 UNION ALL SELECT case_id, up, id, 1 FROM o UNION ALL SELECT case_id, up2, id, 2 FROM o UNION ALL SELECT case_id, case_id, id, 3 FROM o)"""

_found: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _found[name] = (f, sql)
        return f

    return keep


# --- detectors --------------------------------------------------------------------------------------------------------

LABELS = "WITH s AS (SELECT source AS b, quality || '_' || toxic AS k FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


@query("class_frequencies", LABELS + " SELECT b AS batch_id, k AS label_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY b), 6) AS share FROM s GROUP BY b, k")
def class_frequencies(spark, d):
    return detect.class_frequencies(bindings.label_samples(spark, d)[0]).withColumn("share", r6("share"))


SKEW = LABELS + """, c AS (SELECT b, k, count(*) AS n FROM s GROUP BY ALL), pb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), pk AS (SELECT k, sum(n) AS nk FROM c GROUP BY k), t AS (SELECT sum(n) AS nt FROM c),
d AS (SELECT pb.b, nb, nt - nb AS nr, coalesce(n, 0) / nb AS p, (nk - coalesce(n, 0)) / (nt - nb) AS q FROM pb CROSS JOIN pk CROSS JOIN t LEFT JOIN c ON c.b = pb.b AND c.k = pk.k),
skew AS (SELECT b AS batch_id, CAST(nb AS BIGINT) AS n_batch, CAST(nr AS BIGINT) AS n_rest,
 sqrt(greatest(0.0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END))) AS js FROM d GROUP BY b, nb, nr)"""


@query("label_skew", SKEW + " SELECT batch_id, n_batch, n_rest, round(js, 6) AS js FROM skew")
def label_skew(spark, d):
    s, b = bindings.label_samples(spark, d)
    return detect.label_skew(s, b).select("batch_id", "n_batch", "n_rest", r6("js").alias("js"))


LABEL_FOUND = "n_batch >= 10 AND n_rest >= 10 AND js >= 0.25"


@query("label_findings", SKEW + f" SELECT batch_id AS source_id, 'LABEL_DISTRIBUTION_ANOMALY' AS evidence_type, round(least(1.0, js / 0.6), 3) AS severity, CAST(0.85 AS DOUBLE) AS confidence, 'label_detector' AS detector, n_batch, n_rest, round(js, 6) AS js FROM skew WHERE {LABEL_FOUND}")
def label_findings(spark, d):
    x = F.from_json("details", "n_batch long, n_rest long, js double")
    f = detect.labels(*bindings.label_samples(spark, d)).withColumn("x", x)
    return f.select("source_id", "evidence_type", "severity", "confidence", "detector", "x.n_batch", "x.n_rest", r6("x.js").alias("js"))


@query("ood_scores", """WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS b, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), g AS (SELECT b, d, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM e GROUP BY ALL),
t AS (SELECT b, d, sum(n) OVER w - n AS n, sum(s) OVER w - s AS s, sum(ss) OVER w - ss AS ss FROM g WINDOW w AS (PARTITION BY d)), m AS (SELECT b, d, n, s / n AS mu, greatest(sqrt(greatest(ss / n - (s / n) * (s / n), 0.0)), 1e-6) AS sd FROM t WHERE n > 0)
SELECT vec_id AS sample_id, b AS batch_id, CAST(min(n) AS BIGINT) AS n_ref, round(sqrt(avg(pow((x - mu) / sd, 2))), 6) AS z FROM e JOIN m USING (b, d) GROUP BY ALL""")  # fmt: skip
def ood_scores(spark, d):
    return detect.ood_scores(*bindings.embedding_samples(spark, d)).select("sample_id", "batch_id", "n_ref", r6("z").alias("z"))


@query("ood_injected", """WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS b, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY md5('42:' || id), id) AS place, count(*) OVER (PARTITION BY b) AS size FROM e),
every AS (SELECT id, b, v FROM e UNION ALL SELECT id, b || '-injected', v FROM r UNION ALL SELECT 'ood-' || id, b || '-injected', [v[i] + 8.0 * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END FOR i IN range(1, len(v) + 1)] FROM r WHERE place <= greatest(1, floor(size * 0.15))),
x AS (SELECT id, b, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM every), g AS (SELECT b, d, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM x GROUP BY ALL),
t AS (SELECT b, d, sum(n) OVER w - n AS n, sum(s) OVER w - s AS s, sum(ss) OVER w - ss AS ss FROM g WINDOW w AS (PARTITION BY d)), m AS (SELECT b, d, n, s / n AS mu, greatest(sqrt(greatest(ss / n - (s / n) * (s / n), 0.0)), 1e-6) AS sd FROM t WHERE n > 0),
z AS (SELECT id, b, min(n) AS n, sqrt(avg(pow((x - mu) / sd, 2))) AS z FROM x JOIN m USING (b, d) GROUP BY ALL)
SELECT b AS source_id, round(least(1.0, max(z) / 6), 3) AS severity, round(max(z), 6) AS max_z, count(*) FILTER (z >= 3) AS n_flagged, round(count(*) FILTER (z >= 3) / count(*), 6) AS fraction, array_to_string((list(id ORDER BY id) FILTER (z >= 3))[1:50], ',') AS flagged
FROM z WHERE n >= 8 GROUP BY b HAVING count(*) FILTER (z >= 3) > 0""")  # fmt: skip
def ood_injected(spark, d):
    s, b = bindings.embedding_samples(spark, d)
    wild = scenarios.ood_injection(s.withColumn("label_class", F.col("batch_id")))
    both = s.select(F.col("sample_id").cast("string").alias("sample_id"), "batch_id", F.col("embedding").cast("array<double>")).unionByName(wild.select("sample_id", "batch_id", F.col("embedding").cast("array<double>")))
    f = detect.ood(both, both.select("batch_id", F.lit("all").alias("dataset_id")).distinct())
    f = f.withColumn("x", F.from_json("details", "max_z double, n_flagged long, fraction double, flagged array<string>"))
    return f.select("source_id", "severity", r6("x.max_z").alias("max_z"), "x.n_flagged", r6("x.fraction").alias("fraction"), F.array_join("x.flagged", ",").alias("flagged"))


@query("near_duplicate_pairs", """WITH s AS (SELECT doc_id, source, left(md5(text), 16) AS h FROM documents), p AS (SELECT x.source, x.doc_id AS a, y.doc_id AS b, list_sum([bit_count(xor(strpos('0123456789abcdef', substr(x.h, i, 1)) - 1, strpos('0123456789abcdef', substr(y.h, i, 1)) - 1)) FOR i IN range(1, 17)]) AS d FROM s x JOIN s y ON x.source = y.source AND x.doc_id < y.doc_id)
SELECT source AS batch_id, a, b, CAST(d AS BIGINT) AS distance FROM p WHERE d <= 5""")  # fmt: skip
def near_duplicate_pairs(spark, d):
    return detect.near_pairs(bindings.label_samples(spark, d)[0]).withColumn("distance", F.col("distance").cast("long"))


# fingerprints are digests, so near ones are only the jittered copies, which differ in their last digit
@query("duplicate_flood", """WITH s AS (SELECT doc_id, source, left(md5(text), 15) AS h, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), CAST(doc_id AS VARCHAR)) AS place, count(*) OVER (PARTITION BY source) AS size FROM documents),
c AS (SELECT source || '-flooded' AS b, h, CASE WHEN k = 0 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '-' || k END AS name FROM s, unnest(CASE WHEN place <= greatest(1, floor(size * 0.4 / 20)) THEN range(1, 21) ELSE [0] END) AS u(k) WHERE h IS NOT NULL),
g AS (SELECT b, count(*) AS size, array_to_string((list(name ORDER BY name))[1:50], ',') AS members FROM c GROUP BY b, h), f AS (SELECT *, sum(size) OVER (PARTITION BY b) AS hashed FROM g)
SELECT b AS source_id, round(least(1.0, 1.5 * size / hashed), 3) AS severity, size, round(size / hashed, 6) AS fraction, members FROM f WHERE hashed >= 5 AND size >= 2 AND size / hashed >= 0.15""")  # fmt: skip
def duplicate_flood(spark, d):
    s, _ = bindings.label_samples(spark, d)
    f = detect.duplicates(scenarios.duplicate_flood(s, copies=20)).withColumn("x", F.from_json("details", "size long, fraction double, members array<string>"))
    return f.select("source_id", "severity", "x.size", r6("x.fraction").alias("fraction"), F.array_join("x.members", ",").alias("members"))


@query("detect_all", SKEW + f""", b AS (SELECT DISTINCT source FROM documents), h AS (SELECT source, count(*) AS size FROM documents WHERE text IS NOT NULL GROUP BY source, md5(text)), f AS (SELECT *, sum(size) OVER (PARTITION BY source) AS hashed FROM h)
SELECT batch_id AS source_id, 'LABEL_DISTRIBUTION_ANOMALY' AS kind, round(least(1.0, js / 0.6), 3) AS severity FROM skew WHERE {LABEL_FOUND} UNION ALL SELECT source, 'NEAR_DUPLICATE_CLUSTER', round(least(1.0, 1.5 * size / hashed), 3) FROM f WHERE hashed >= 5 AND size >= 2 AND size / hashed >= 0.15
UNION ALL SELECT source, 'inspected by ' || x, NULL FROM b CROSS JOIN (VALUES ('duplicate_detector'), ('label_detector'), ('ood_detector')) t(x)""")  # fmt: skip
def detect_all(spark, d):
    s, b = bindings.label_samples(spark, d)
    found, ran = detect.all_batches(s.withColumn("embedding", F.lit(None).cast("array<double>")), b)
    ran = ran.select(F.col("node_id").alias("source_id"), F.concat(F.lit("inspected by "), "detector").alias("kind"), F.lit(None).cast("double").alias("severity"))
    return found.select("source_id", F.col("evidence_type").alias("kind"), "severity").unionByName(ran)


@query("exact_duplicates", "SELECT source AS batch_id, md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id, round(count(*) / any_value(t.n), 6) AS fraction FROM documents JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) t USING (source) GROUP BY ALL HAVING count(*) > 1")
def exact_duplicates(spark, d):
    s = load(spark, d, "documents").select(F.col("source").alias("batch_id"), F.md5("text").alias("digest"), F.col("doc_id").alias("sample_id"))
    return detect.exact_duplicates(s).withColumnRenamed("first", "first_id").withColumn("fraction", r6("fraction"))


@query("fingerprint_distances", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS x FROM e GROUP BY ALL)
SELECT a.label AS reference, b.label AS candidate, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS l2, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) AS cosine FROM m a JOIN m b ON a.d = b.d AND a.label < b.label GROUP BY ALL""")  # fmt: skip
def fingerprint_distances(spark, d):
    e = load(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    m = e.groupBy("label", "d").agg(F.avg("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select(F.col("label").alias("model_id"), F.col("v.x").alias("fingerprint"))
    p = detect.fingerprint_distances(m)
    return p.select("reference", "candidate", r6("l2").alias("l2"), r6("cosine").alias("cosine"))


@query("behaviour_findings", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT y.vec_id, sqrt(list_sum([(x.v[i] - y.v[i]) * (x.v[i] - y.v[i]) FOR i IN range(1, len(x.v) + 1)])) AS l2,
 list_sum([x.v[i] * y.v[i] FOR i IN range(1, len(x.v) + 1)]) / (sqrt(list_sum([a * a FOR a IN x.v])) * sqrt(list_sum([a * a FOR a IN y.v]))) AS sim FROM e x JOIN e y ON y.vec_id = x.vec_id + 1),
s AS (SELECT *, greatest(least(1.0, l2 / 2), least(1.0, greatest(0.0, (1 - sim) / 0.5))) AS severity, least(0.99, 0.65 + 0.2 * least(1.0, l2) + 0.15 * least(1.0, greatest(0.0, 1 - sim))) AS confidence FROM p)
SELECT CAST(vec_id AS VARCHAR) AS source_id, round(severity, 3) AS severity, round(confidence, 3) AS confidence, round(l2, 6) AS distance, round(sim, 6) AS similarity FROM s WHERE severity >= 0.25""")  # fmt: skip
def behaviour_findings(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    p = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("reference")).join(e.withColumnRenamed("v", "candidate"), "vec_id")
    f = detect.behaviour(p.select(F.col("vec_id").cast("string").alias("model_id"), "reference", "candidate")).withColumn("x", F.from_json("details", "distance double, similarity double"))
    return f.select("source_id", "severity", "confidence", r6("x.distance").alias("distance"), r6("x.similarity").alias("similarity"))


PART_FIELDS = ("p_brand", "p_type", "p_size")


@query("structural_differences", "SELECT CAST(b.p_partkey AS VARCHAR) AS model_id, CAST((a.p_brand IS DISTINCT FROM b.p_brand)::INT + (a.p_type IS DISTINCT FROM b.p_type)::INT + (a.p_size IS DISTINCT FROM b.p_size)::INT AS INT) AS n_differences, CASE WHEN a.p_size IS DISTINCT FROM b.p_size THEN a.p_size || '>' || b.p_size END AS size_change FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def structural_differences(spark, d):
    p = load(spark, d, "part")
    a = p.select((F.col("p_partkey") + 1).alias("k"), *[F.col(f).alias(f"{f}_ref") for f in PART_FIELDS])
    b = p.select(F.col("p_partkey").alias("k"), *[F.col(f).alias(f"{f}_new") for f in PART_FIELDS])
    x = detect.differences(a.join(b, "k"), PART_FIELDS)
    s = F.col("differences")["p_size"]
    return x.select(F.col("k").cast("string").alias("model_id"), F.size("differences").alias("n_differences"), F.concat(s["reference"], F.lit(">"), s["candidate"]).alias("size_change"))


@query("trigger_consistency", "WITH d AS (SELECT user_id, event_type, avg(value) / 60 AS delta FROM events GROUP BY ALL) SELECT CAST(user_id AS VARCHAR) AS model_id, count(*) FILTER (delta >= 0.5) AS suspicious, count(*) AS total, round(max(delta), 6) AS max_delta, round(count(*) FILTER (delta >= 0.5) / count(*), 6) AS consistency FROM d GROUP BY user_id HAVING count(*) FILTER (delta >= 0.5) > 0")
def trigger_consistency(spark, d):
    e = load(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("model_id"), F.col("event_type").alias("trigger")).agg((F.avg("value") / 60).alias("delta"))
    x = F.from_json("details", "suspicious long, total long, max_delta double")
    t = detect.triggers(e).select(F.col("source_id").alias("model_id"), x.alias("x")).select("model_id", "x.*")
    return t.select("model_id", "suspicious", "total", r6("max_delta").alias("max_delta"), r6(F.col("suspicious") / F.col("total")).alias("consistency"))


# --- lineage ----------------------------------------------------------------------------------------------------------


@query("closure", TRADE + " SELECT case_id, anc, dst, CAST(dist AS INT) AS dist FROM closure")
def closure(spark, d):
    return bindings.trade_graph(spark, d).closure


@query("blast_radius", TRADE + " SELECT case_id, anc AS node_id, count(*) AS n_below, CAST(max(dist) AS INT) AS depth FROM closure WHERE dist > 0 GROUP BY ALL")
def blast_radius(spark, d):
    g = bindings.trade_graph(spark, d)
    return lineage.downstream(g, g.nodes).groupBy("case_id", "node_id").agg(F.count("*").alias("n_below"), F.max("dist").alias("depth"))


@query("trace_back", TRADE + " SELECT case_id, dst AS node_id, anc AS found, CAST(dist AS INT) AS dist FROM closure WHERE dist > 0 AND dst LIKE 'O%'")
def trace_back(spark, d):
    g = bindings.trade_graph(spark, d)
    return lineage.upstream(g, g.nodes.filter(F.col("node_id").startswith("O"))).select("case_id", "node_id", "found", "dist")


@query("common_origins", TRADE + """, p AS (SELECT c.case_id, c.id AS a, s.id AS b FROM c JOIN s ON c.case_id = s.case_id AND c_custkey = s_suppkey), k AS (SELECT p.*, x.anc AS via, x.dist + y.dist AS dist, row_number() OVER (PARTITION BY p.case_id, a, b ORDER BY x.dist + y.dist, x.anc) AS rn FROM p JOIN closure x ON x.case_id = p.case_id AND x.dst = a JOIN closure y ON y.case_id = p.case_id AND y.dst = b AND x.anc = y.anc)
SELECT case_id, a, b, 'COMMON_ORIGIN' AS kind, CAST(dist AS INT) AS dist, via FROM k WHERE rn = 1""")  # fmt: skip
def common_origins(spark, d):
    g = bindings.trade_graph(spark, d)
    side = lambda p, c: g.nodes.filter(F.col("node_id").rlike(f"^{p}[0-9]")).select("case_id", F.col("node_id").alias(c), F.expr("substring(node_id, 2)").alias("k"))
    return lineage.relation(g, side("C", "a").join(side("S", "b"), ["case_id", "k"]))


@query("origins_by_region", TRADE + """, v AS (SELECT case_id, id, (o_orderkey % 100 / 100.0) * 0.5 AS w FROM o WHERE o_orderstatus = 'F'), t AS (SELECT case_id, sum(w) AS t FROM v GROUP BY ALL), z AS (SELECT case_id, anc, count(*) AS size FROM closure GROUP BY ALL), x AS (SELECT c.case_id, anc, sum(w) AS w FROM closure c JOIN v ON v.case_id = c.case_id AND v.id = c.dst GROUP BY ALL)
SELECT case_id, anc AS node_id, round(w / t, 6) AS fraction, size AS closure_size, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(w / t, 9) DESC, size, anc) AS INT) AS rank FROM x JOIN t USING (case_id) JOIN z USING (case_id, anc)""")  # fmt: skip
def origins_by_region(spark, d):
    return lineage.candidate_origins(bindings.trade_graph(spark, d)).select("case_id", "node_id", r6("fraction").alias("fraction"), "closure_size", "rank")


@query("provenance_gaps", ALL_CASES + " SELECT case_id, node_id, issue FROM gaps")
def provenance_gaps(spark, d):
    return lineage.provenance_gaps(user_cases(spark, d))


@query("coverage", ALL_CASES + " SELECT case_id, n_nodes, n_inspected, round(CASE WHEN n_nodes > 0 THEN n_inspected / n_nodes ELSE 0 END, 6) AS coverage FROM coverage")
def coverage(spark, d):
    return lineage.coverage(user_cases(spark, d)).select("case_id", "n_nodes", "n_inspected", r6("coverage").alias("coverage"))


@query("correlation_pairs", ALL_CASES + " SELECT x.case_id, x.evidence_id AS id_a, y.evidence_id AS id_b, kind, CAST(dist AS INT) AS dist, via, round(proximity, 6) AS proximity, x.stage <> y.stage AS cross_stage, x.detector = y.detector AS same_detector FROM weighted x JOIN weighted y ON x.case_id = y.case_id AND x.evidence_id < y.evidence_id JOIN near n ON n.case_id = x.case_id AND n.a = x.source_id AND n.b = y.source_id WHERE kind <> 'UNRELATED'")
def correlation_pairs(spark, d):
    p = lineage.correlation_pairs(user_cases(spark, d))
    return p.select("case_id", "id_a", "id_b", "kind", "dist", "via", r6("proximity").alias("proximity"), "cross_stage", "same_detector")


@query("candidate_origins", ALL_CASES + """, tot AS (SELECT case_id, sum(weight) AS t FROM weighted GROUP BY ALL HAVING sum(weight) > 0), z AS (SELECT case_id, anc, count(*) AS size FROM closure GROUP BY ALL), held AS (SELECT c.case_id, c.anc, sum(weight) AS w, count(*) AS n, string_agg(DISTINCT stage, ',' ORDER BY stage) AS st FROM closure c JOIN weighted v ON v.case_id = c.case_id AND v.source_id = c.dst GROUP BY ALL)
SELECT case_id, anc AS node_id, round(w / t, 6) AS fraction, size AS closure_size, n AS n_evidence, st AS stages, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(w / t, 9) DESC, size, anc) AS INT) AS rank FROM held JOIN tot USING (case_id) JOIN z USING (case_id, anc)""")  # fmt: skip
def candidate_origins(spark, d):
    o = lineage.candidate_origins(user_cases(spark, d))
    return o.select("case_id", "node_id", r6("fraction").alias("fraction"), "closure_size", F.col("n_evidence").cast("long").alias("n_evidence"), F.array_join(F.array_sort("stages"), ",").alias("stages"), "rank")


# in these cases a node has one predecessor below any origin, and topological order is that of the codes
PLACE = "list_position(['C', 'DS', 'B', 'IN', 'S', 'TR', 'M', 'D', 'I', 'O'], split_part({0}, '_', 1))"
RANKED = """, tot AS (SELECT case_id, sum(weight) AS t FROM weighted GROUP BY ALL HAVING sum(weight) > 0), z AS (SELECT case_id, anc, count(*) AS size FROM closure GROUP BY ALL), held AS (SELECT c.case_id, c.anc, sum(weight) AS w, count(*) AS n, count(DISTINCT detector) AS nd, string_agg(DISTINCT stage, ',' ORDER BY stage) AS st FROM closure c JOIN weighted v ON v.case_id = c.case_id AND v.source_id = c.dst GROUP BY ALL),
ranked AS (SELECT case_id, anc AS node_id, w / t AS fraction, size AS closure_size, n AS n_evidence, nd AS n_detectors, st AS stages, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(w / t, 9) DESC, size, anc) AS INT) AS rank FROM held JOIN tot USING (case_id) JOIN z USING (case_id, anc))"""


@query("attack_paths", ALL_CASES + RANKED + f""", origin AS (SELECT case_id, node_id AS origin FROM ranked WHERE rank = 1), hit AS (SELECT DISTINCT o.case_id, o.origin, dst AS n FROM origin o JOIN closure c ON c.case_id = o.case_id AND c.anc = origin JOIN src ON src.case_id = c.case_id AND src.source_id = c.dst),
way AS (SELECT DISTINCT o.case_id, o.origin, c.dst AS n FROM origin o JOIN closure c ON c.case_id = o.case_id AND c.anc = origin JOIN closure k ON k.case_id = c.case_id AND k.anc = c.dst JOIN hit h ON h.case_id = k.case_id AND h.n = k.dst)
SELECT case_id, origin, (SELECT string_agg(n, ',' ORDER BY {PLACE.format('n')}) FROM way w WHERE w.case_id = o.case_id) AS nodes, coalesce((SELECT string_agg(src || '->' || dst, ',' ORDER BY {PLACE.format('src')}, {PLACE.format('dst')}) FROM edges e JOIN way a ON a.case_id = e.case_id AND a.n = src JOIN way b ON b.case_id = e.case_id AND b.n = dst WHERE e.case_id = o.case_id), '') AS edges,
 (SELECT string_agg(n, ',' ORDER BY {PLACE.format('n')}) FROM hit h WHERE h.case_id = o.case_id) AS evidence_nodes FROM origin o""")  # fmt: skip
def attack_paths(spark, d):
    g = user_cases(spark, d)
    best = lineage.candidate_origins(g).filter("rank = 1").select("case_id", F.col("node_id").alias("origin"))
    return lineage.attack_paths(g, best).select("case_id", "origin", *[F.array_join(c, ",").alias(c) for c in ("nodes", "edges", "evidence_nodes")])


# shortcuts DS -> TR and B -> M make several paths, of which the first three count
@query("lineage_paths", ALL_CASES + """, more AS (SELECT case_id, src, dst FROM edges UNION ALL SELECT case_id, node_id, 'TR' || substr(node_id, 3) FROM nodes WHERE node_type = 'DATASET' UNION ALL SELECT case_id, node_id, 'M' || substr(node_id, 2) FROM nodes WHERE node_type = 'BATCH'),
walk(case_id, path) AS (SELECT case_id, [node_id] FROM nodes WHERE node_type IN ('CONTRIBUTOR', 'DATASET', 'INPUT') UNION ALL SELECT w.case_id, list_append(path, dst) FROM walk w JOIN more m ON m.case_id = w.case_id AND m.src = path[-1]),
ends AS (SELECT *, row_number() OVER (PARTITION BY case_id, path[1] ORDER BY len(path), path) AS k FROM walk WHERE path[-1] LIKE 'O\\_%' ESCAPE '\\') SELECT case_id, array_to_string(path, '->') AS path FROM ends WHERE k <= 3""")  # fmt: skip
def lineage_paths(spark, d):
    g = user_cases(spark, d)
    extra = lambda kind, code, cut: g.nodes.filter(F.col("node_type") == kind).select("case_id", F.col("node_id").alias("src"), F.concat(F.lit(code), F.expr(f"substring(node_id, {cut})")).alias("dst"), F.lit("TRAINED_ON").alias("edge_type"))
    g = replace(g, edges=g.edges.union(extra("DATASET", "TR", 3)).union(extra("BATCH", "M", 2)))
    ends = g.nodes.filter("node_type in ('CONTRIBUTOR', 'DATASET', 'INPUT')").select("case_id", F.col("node_id").alias("src"), F.regexp_replace("node_id", "^[A-Z]+", "O").alias("dst"))
    return lineage.paths_between(g, ends, limit=3).select("case_id", F.array_join("path", "->").alias("path"))


LEGAL = _values([(e, a, b) for e, pairs in dims.LEGAL.items() for a, b in pairs])


# every kind of fault, in some of the cases
@query("validation", ALL_CASES + f""", n AS (SELECT case_id, node_id, node_type FROM nodes UNION ALL {bindings.FAULTS['nodes']}), e AS (SELECT case_id, src, dst, edge_type FROM edges UNION ALL {bindings.FAULTS['edges']}), v AS (SELECT case_id, evidence_id, source_id, severity, confidence FROM evidence UNION ALL {bindings.FAULTS['evidence']}),
t AS (SELECT e.*, a.node_type AS st, b.node_type AS dt FROM e LEFT JOIN n a ON a.case_id = e.case_id AND a.node_id = e.src LEFT JOIN n b ON b.case_id = e.case_id AND b.node_id = e.dst)
SELECT case_id, 'unknown_node' AS problem, src || '->' || dst AS subject FROM t WHERE st IS NULL OR dt IS NULL UNION ALL SELECT case_id, 'self_loop', src || '->' || dst FROM e WHERE src = dst
UNION ALL SELECT case_id, 'illegal_edge', src || '->' || dst FROM t WHERE src <> dst AND st IS NOT NULL AND dt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (VALUES {LEGAL}) l(x, y, z) WHERE x = edge_type AND y = st AND z = dt)
UNION ALL SELECT case_id, 'conflicting_edge', src || '->' || dst FROM e GROUP BY case_id, src, dst HAVING count(DISTINCT edge_type) > 1 UNION ALL SELECT case_id, 'conflicting_node', node_id FROM n GROUP BY case_id, node_id HAVING count(DISTINCT node_type) > 1
UNION ALL SELECT case_id, 'bad_number', evidence_id FROM v WHERE NOT coalesce(severity BETWEEN 0 AND 1 AND confidence BETWEEN 0 AND 1, false) UNION ALL SELECT case_id, 'repeated_evidence', evidence_id FROM v GROUP BY case_id, evidence_id HAVING count(*) > 1
UNION ALL SELECT case_id, 'unknown_source', evidence_id FROM v WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.case_id = v.case_id AND n.node_id = v.source_id)""")  # fmt: skip
def validation(spark, d):
    return lineage.validate(bindings.faulty_cases(spark, d))


# the samples of every fourth case have lost their edge
LOST = "dst LIKE 'S\\_%' ESCAPE '\\' AND CAST(substr(case_id, 2) AS INT) % 4 = 0"


@query("isolated_nodes", ALL_CASES + f" SELECT case_id, node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE NOT ({LOST}) AND e.case_id = n.case_id AND (e.src = n.node_id OR e.dst = n.node_id))")
def isolated_nodes(spark, d):
    g = user_cases(spark, d)
    lost = F.col("dst").startswith("S_") & (F.expr("cast(substring(case_id, 2) as int)") % 4 == 0)
    return lineage.isolated(replace(g, edges=g.edges.filter(~lost)))


@query("node_export", ALL_CASES + f" SELECT n.case_id, n.node_id, n.node_type, {STAGE_SQL.replace('node_type', 'n.node_type')} AS stage, count(v.evidence_id) AS evidence_count, round(coalesce(max(severity), 0), 6) AS max_severity FROM nodes n LEFT JOIN evidence v ON v.case_id = n.case_id AND v.source_id = n.node_id GROUP BY ALL")
def node_export(spark, d):
    return lineage.export(user_cases(spark, d)).select("case_id", "node_id", "node_type", "stage", "evidence_count", r6("max_severity").alias("max_severity"))


# each case written as a document and read again
@query("graph_documents", ALL_CASES + " SELECT case_id, 'node' AS part, node_id AS id, node_type AS kind, label AS text, CAST(NULL AS DOUBLE) AS weight FROM nodes UNION ALL SELECT case_id, 'edge', src, edge_type, dst, NULL FROM edges UNION ALL SELECT case_id, 'evidence', evidence_id, evidence_type, source_id || ' ' || detector, round(severity * confidence, 6) FROM evidence")
def graph_documents(spark, d):
    g = lineage.from_json(lineage.to_json(user_cases(spark, d)), numbered=False)
    row = lambda df, part, i, kind, text, weight: df.select("case_id", F.lit(part).alias("part"), F.col(i).alias("id"), F.col(kind).alias("kind"), text.alias("text"), weight.cast("double").alias("weight"))
    none = F.lit(None)
    out = row(g.nodes, "node", "node_id", "node_type", F.col("label"), none).union(row(g.edges, "edge", "src", "edge_type", F.col("dst"), none))
    return out.union(row(g.evidence, "evidence", "evidence_id", "evidence_type", F.concat("source_id", F.lit(" "), "detector"), scalars.scaled_round(F.col("severity") * F.col("confidence"), 6)))


@query("layout_positions", ALL_CASES + f" SELECT case_id, node_id, node_type, CAST(list_position({list(dims.STAGES)}, {STAGE_SQL}) - 1 AS INT) AS rank, CAST(row_number() OVER (PARTITION BY case_id, node_type ORDER BY node_id) AS INT) AS position FROM nodes")
def layout_positions(spark, d):
    return lineage.layout(user_cases(spark, d))


# every node added three times: with an empty label, with its own, with a later one
@query("merged_nodes", ALL_CASES + " SELECT case_id, node_id, node_type, 'again ' || node_id AS label FROM nodes")
def merged_nodes(spark, d):
    n = user_cases(spark, d).nodes
    again = lambda label, at: n.select("case_id", "node_id", "node_type", label.alias("label"), F.lit(at).alias("at"))
    return lineage.merged(again(F.concat(F.lit("again "), "node_id"), 3).union(again(F.col("label"), 1)).union(again(F.lit(""), 4)))


@query("store_graph", """WITH c AS (SELECT DISTINCT lang FROM documents), b AS (SELECT DISTINCT source FROM documents)
SELECT node_id, node_type, label, n_in FROM (SELECT lang AS node_id, 'CONTRIBUTOR' AS node_type, lang AS label, 0 AS n_in FROM c UNION ALL SELECT 'corpus', 'DATASET', 'corpus', 0 UNION ALL SELECT source, 'BATCH', 'Batch ' || source, 1 FROM b UNION ALL SELECT 'd' || doc_id, 'SAMPLE', 'Sample d' || doc_id, 1 FROM documents
 UNION ALL SELECT 'run_' || source, 'TRAINING_RUN', 'Training Run run_' || source, 1 FROM b UNION ALL SELECT 'model_' || source, 'MODEL', source || ' v1', 1 FROM b) t""")  # fmt: skip
def store_graph(spark, d):
    doc = load(spark, d, "documents")
    b = doc.select("source").distinct()
    tables = {
        "contributors": doc.select(F.col("lang").alias("id"), F.col("lang").alias("name")).distinct(), "datasets": spark.createDataFrame([("corpus", "corpus")], "id string, name string"),
        "batches": b.select(F.col("source").alias("id"), F.lit("corpus").alias("dataset_id"), F.lit(None).cast("string").alias("contributor_id"), F.lit(None).cast("string").alias("label")), "samples": doc.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("batch_id")),
        "training_runs": b.select(F.concat(F.lit("run_"), "source").alias("id"), F.lit("corpus").alias("dataset_id"), F.col("source").alias("batch_id")), "models": b.select(F.concat(F.lit("model_"), "source").alias("id"), F.concat(F.lit("run_"), "source").alias("training_run_id"), F.col("source").alias("name"), F.lit("v1").alias("version")),
    }
    g = relational.build_graph(tables)
    into = g.edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").cast("int").alias("n_in"))
    return g.nodes.join(into, "node_id", "left").na.fill(0, ["n_in"]).select("node_id", "node_type", "label", "n_in")


# --- fusion and decisions ------------------------------------------------------------------------------------------------


@query("fusion_scores", ALL_CASES + " SELECT case_id, hypothesis, round(base, 6) AS base, round(corr, 6) AS corr, round(contra, 6) AS contra, round(ctx, 6) AS ctx, round(raw, 6) AS raw, round(support, 6) AS support, round(share, 6) AS share, CASE WHEN support >= 0.6 THEN 'HIGH' WHEN support >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM scores")
def fusion_scores(spark, d):
    s = fusion.fuse(user_cases(spark, d), CONFIG).scores
    return s.select("case_id", "hypothesis", *[r6(c).alias(c) for c in ("base", "corr", "contra", "ctx", "raw", "support", "share")], "level")


flagship = fusion_scores


@query("strengths", ALL_CASES + " SELECT case_id, evidence_id, stage, round(strength, 6) AS strength FROM strong")
def strengths(spark, d):
    return fusion.strengths(user_cases(spark, d), CONFIG).select("case_id", "evidence_id", "stage", r6("strength").alias("strength"))


@query("integrity_checks", ALL_CASES + ' SELECT case_id, name AS "check", status FROM status')
def integrity_checks(spark, d):
    return fusion.check_status(user_cases(spark, d), CONFIG).select("case_id", "check", "status")


@query("fusion_context", ALL_CASES + " SELECT case_id, round(coverage, 6) AS coverage, n_gaps, n_pass, n_fail, round(shift_signal, 6) AS shift_signal FROM ctx")
def fusion_context(spark, d):
    return fusion.context(user_cases(spark, d), CONFIG).select("case_id", r6("coverage").alias("coverage"), "n_gaps", "n_pass", "n_fail", r6("shift_signal").alias("shift_signal"))


DECIDE = """, lead AS (SELECT case_id, any_value(coverage) AS coverage, any_value(n_gaps) AS n_gaps, max(support) FILTER (rank = 1) AS top_support, max(raw) FILTER (rank = 1) AS top_raw, max(hypothesis) FILTER (rank = 1) AS top, max(is_attack) FILTER (rank = 1) AS top_attack, max(support) FILTER (rank = 2) AS second, max(support) FILTER (is_attack = 1) AS attack_support,
 arg_min(hypothesis, rank) FILTER (is_attack = 1) AS attack, max(support) FILTER (hypothesis IN ('CLEAN', 'BENIGN_DISTRIBUTION_SHIFT')) AS innocent FROM scores GROUP BY case_id),
coded AS (SELECT *, CASE WHEN attack_support >= 0.6 THEN 'ATTACK_HIGH' ELSE concat_ws(',', CASE WHEN attack_support >= 0.3 THEN 'ATTACK_MODERATE' WHEN top_raw > 0 AND top_attack = 1 THEN 'ATTACK_LOW' END, CASE WHEN top_raw > 0 AND top = 'BENIGN_DISTRIBUTION_SHIFT' THEN 'BENIGN_SHIFT' END, CASE WHEN top_raw <= 0 THEN 'INCONCLUSIVE' WHEN coverage < 0.75 THEN 'LOW_COVERAGE' END,
 CASE WHEN n_gaps > 0 THEN 'PROVENANCE_GAPS' END, CASE WHEN top_raw > 0 AND top = 'CLEAN' AND coverage >= 0.75 AND top_support - second < 0.5 THEN 'CLEAN_NOT_DECISIVE' END) END AS codes FROM lead),
stated AS (SELECT *, CASE WHEN attack_support >= 0.6 THEN 'RED' WHEN codes = '' THEN 'GREEN' ELSE 'AMBER' END AS state, CASE WHEN attack_support >= 0.6 THEN attack_support WHEN top_raw <= 0 THEN 0 ELSE top_support END AS leader, CASE WHEN attack_support >= 0.6 THEN innocent WHEN top_raw <= 0 THEN 0 ELSE second END AS rival FROM coded),
decided AS (SELECT case_id, state, attack_support, round(100 * least(greatest(attack_support, 0), 1), 1) AS risk, round(100 * (0.5 * least(1, greatest(0, leader - rival) / 0.5) + 0.5 * leader) * (0.5 + 0.5 * coverage), 1) AS confidence, round(100 * coverage, 1) AS coverage, CASE WHEN state = 'RED' THEN attack WHEN top_raw <= 0 THEN 'INCONCLUSIVE' ELSE top END AS top_hypothesis,
 CASE WHEN codes LIKE 'ATTACK_%' THEN attack END AS focus, greatest(0, leader - rival) AS decision_margin, CASE WHEN codes = '' THEN 'CLEAN_CONFIRMED' ELSE codes END AS codes FROM stated)"""  # fmt: skip


@query("decisions", ALL_CASES + DECIDE + " SELECT * REPLACE (round(attack_support, 6) AS attack_support, round(decision_margin, 6) AS decision_margin) FROM decided")
def decisions(spark, d):
    f = fusion.fuse(user_cases(spark, d), CONFIG)
    x = assurance.decide(f.scores, f.context)
    return x.select("case_id", "state", r6("attack_support").alias("attack_support"), "risk", "confidence", "coverage", "top_hypothesis", "focus", r6("decision_margin").alias("decision_margin"), F.array_join("codes", ",").alias("codes"))


FITS = _values([(h, t) for h, types in dims.ORIGIN_TYPES.items() for t in types or ()])


@query("attributed_origins", ALL_CASES + DECIDE + RANKED + f""", o AS (SELECT r.*, n.node_type, focus, fraction >= 0.25 AND EXISTS (SELECT 1 FROM (VALUES {FITS}) f(h, t) WHERE h = focus AND t = n.node_type) AS fits FROM ranked r JOIN nodes n USING (case_id, node_id) JOIN decided d USING (case_id) WHERE focus IS NOT NULL)
SELECT case_id, node_id AS origin, node_type, round(fraction, 6) AS fraction, n_evidence, n_detectors, stages FROM o QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY fits DESC, rank) = 1""")  # fmt: skip
def attributed_origins(spark, d):
    inv = assurance.investigate(user_cases(spark, d))
    return inv.origins.select("case_id", "origin", "node_type", r6("fraction").alias("fraction"), F.col("n_evidence").cast("long").alias("n_evidence"), "n_detectors", F.array_join(F.array_sort("stages"), ",").alias("stages"))


NEEDED = _values([(c, k, d, j) for k, (c, (_, ds)) in enumerate(dims.CHECKS.items(), 1) for j, d in enumerate(ds)])


@query("warnings", ALL_CASES + f""", blind AS (SELECT n.case_id, n.node_type, count(*) AS n, count(*) FILTER (NOT seen) AS k, array_to_string((list(node_id ORDER BY node_id) FILTER (NOT seen))[1:5], ', ') AS missing FROM (SELECT *, EXISTS (SELECT 1 FROM inspected i WHERE i.case_id = x.case_id AND i.node_id = x.node_id) AS seen FROM nodes x WHERE node_type IN {dims.COVERED}) n GROUP BY ALL)
SELECT case_id, 0 AS ord, node_id AS subject, 'provenance gap at ' || node_id || ': ' || issue AS message FROM gaps
UNION ALL SELECT s.case_id, 1, CAST(k AS VARCHAR), 'integrity check ' || chr(39) || name || chr(39) || ' is unverified (detectors not run: ' || string_agg(detector, ', ' ORDER BY j) || ')' FROM status s JOIN (VALUES {NEEDED}) t(name, k, detector, j) USING (name) WHERE status = 'UNKNOWN' AND NOT EXISTS (SELECT 1 FROM inspected i WHERE i.case_id = s.case_id AND i.detector = t.detector) GROUP BY s.case_id, name, k
UNION ALL SELECT case_id, 2, CAST(list_position({list(dims.COVERED)}, node_type) AS VARCHAR), k || '/' || n || ' ' || node_type || ' nodes not inspected: ' || missing || CASE WHEN k > 5 THEN ' (+' || (k - 5) || ' more)' ELSE '' END FROM blind WHERE k > 0
UNION ALL SELECT c.case_id, 3, CAST(idx - 1 AS VARCHAR), 'no ' || stage || '-stage nodes registered; that stage was not assessed' FROM (SELECT DISTINCT case_id FROM nodes) c CROSS JOIN (SELECT unnest({list(dims.STAGES)}) AS stage, generate_subscripts({list(dims.STAGES)}, 1) AS idx) t WHERE NOT EXISTS (SELECT 1 FROM (SELECT case_id, {STAGE_SQL} AS st FROM nodes) n WHERE n.case_id = c.case_id AND n.st = t.stage)
UNION ALL SELECT case_id, 4, '', 'evidence types ignored by fusion (no evidence-map row): ' || string_agg(DISTINCT evidence_type, ', ' ORDER BY evidence_type) FROM weighted WHERE evidence_type NOT IN (SELECT evidence_type FROM coef) GROUP BY case_id""")  # fmt: skip
def warning_rows(spark, d):
    return assurance.warning_rows(user_cases(spark, d))


# every scenario's variants as further cases of the same SQL
SCENARIO_CASES = "WITH RECURSIVE " + ", ".join(f"{name + '0' if name in ('nodes', 'edges', 'evidence', 'inspections') else name} AS ({sql})" for name, sql in CASES.items())
TAKEN = """, scen AS (SELECT case_id, node_id AS target, node_type FROM nodes0), first AS (SELECT case_id, target, target AS node_id FROM scen UNION SELECT s.case_id, target, dst FROM scen s JOIN edges0 e ON e.case_id = s.case_id AND e.src = target WHERE (node_type = 'CONTRIBUTOR' AND edge_type = 'CONTRIBUTED') OR (node_type = 'DATASET' AND edge_type = 'CONTAINS')),
gone AS (SELECT * FROM first UNION SELECT s.case_id, s.target, n.node_id FROM scen s JOIN nodes0 n ON n.case_id = s.case_id AND n.node_type = 'SAMPLE' WHERE EXISTS (SELECT 1 FROM edges0 e JOIN first f ON f.case_id = e.case_id AND f.node_id = e.src WHERE e.case_id = s.case_id AND f.target = s.target AND e.dst = n.node_id AND e.edge_type = 'CONTAINS')
 AND NOT EXISTS (SELECT 1 FROM edges0 e WHERE e.case_id = s.case_id AND e.dst = n.node_id AND NOT EXISTS (SELECT 1 FROM first f WHERE f.case_id = e.case_id AND f.target = s.target AND f.node_id = e.src)))"""
_left = lambda alias, *cols: " AND ".join(f"NOT EXISTS (SELECT 1 FROM gone g WHERE g.case_id = s.case_id AND g.target = s.target AND g.node_id = {alias}.{c})" for c in cols)
VARIANTS = SCENARIO_CASES + TAKEN + f""", var AS (SELECT case_id, target, node_type, v, case_id || '#' || target || '#' || v AS name FROM scen CROSS JOIN (VALUES ('structural'), ('final')) t(v)),
nodes AS (SELECT * FROM nodes0 UNION ALL SELECT s.name, n.node_id, n.node_type, n.label FROM var s JOIN nodes0 n ON n.case_id = s.case_id WHERE {_left('n', 'node_id')}), edges AS (SELECT * FROM edges0 UNION ALL SELECT s.name, e.src, e.dst, e.edge_type FROM var s JOIN edges0 e ON e.case_id = s.case_id WHERE {_left('e', 'src', 'dst')})""" + CLOSURE + f""",
kept AS (SELECT s.case_id AS of, s.target, s.v, s.name, e.* EXCLUDE (case_id) FROM var s JOIN evidence0 e ON e.case_id = s.case_id WHERE {_left('e', 'source_id')}),
retrained AS (SELECT s.case_id, s.target, s.name, m.node_id FROM var s JOIN closure c ON c.case_id = s.case_id AND c.anc = s.target AND c.dist > 0 JOIN nodes m ON m.case_id = s.name AND m.node_id = c.dst AND m.node_type = 'MODEL' WHERE s.v = 'final' AND s.node_type IN ('CONTRIBUTOR', 'DATASET', 'BATCH', 'SAMPLE')),
sensitive AS (SELECT r.*, k.evidence_id, EXISTS (SELECT 1 FROM closure c JOIN kept d ON d.name = c.case_id AND d.source_id = c.anc JOIN nodes n ON n.case_id = c.case_id AND n.node_id = c.anc WHERE c.case_id = r.name AND c.dst = r.node_id AND n.node_type IN ('CONTRIBUTOR', 'DATASET', 'BATCH', 'SAMPLE') AND d.severity * d.confidence >= 0.15) AS blocked
 FROM retrained r JOIN kept k ON k.name = r.name AND k.source_id = r.node_id AND k.evidence_type IN ('BEHAVIORAL_DEVIATION', 'TRIGGER_SENSITIVITY')),
evidence AS (SELECT case_id, evidence_id, source_id, evidence_type, severity, confidence, detector FROM evidence0 UNION ALL SELECT name, evidence_id, source_id, evidence_type, severity, confidence, detector FROM kept k WHERE NOT EXISTS (SELECT 1 FROM sensitive c WHERE c.name = k.name AND c.evidence_id = k.evidence_id AND NOT blocked)),
inspections AS (SELECT case_id, node_id, detector FROM inspections0 UNION SELECT s.name, i.node_id, i.detector FROM var s JOIN inspections0 i ON i.case_id = s.case_id WHERE {_left('i', 'node_id')} UNION SELECT name, source_id, detector FROM kept)"""
VARIANT_CASES = VARIANTS + WEIGHTED + INSPECTED + COVERAGE + GAPS + SOURCES + RELATION + CHECKS + SCORES + DECIDE


@query("counterfactuals", VARIANT_CASES + """, ids AS (SELECT g.case_id, g.target, string_agg(DISTINCT g.node_id, ',' ORDER BY g.node_id) AS removed_nodes, coalesce(string_agg(DISTINCT e.evidence_id, ',' ORDER BY e.evidence_id), '') AS removed_evidence FROM gone g LEFT JOIN evidence0 e ON e.case_id = g.case_id AND e.source_id = g.node_id GROUP BY ALL),
moved AS (SELECT case_id, target, string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (NOT blocked) AS cleared, string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (blocked) AS retained FROM sensitive GROUP BY ALL),
r AS (SELECT s.case_id, s.target, o.risk AS original_risk, a.risk AS structural_risk, b.risk AS final_risk, round(o.risk - b.risk, 1) AS risk_delta, o.state AS original_state, b.state AS final_state FROM scen s JOIN decided o ON o.case_id = s.case_id JOIN decided a ON a.case_id = s.case_id || '#' || s.target || '#structural' JOIN decided b ON b.case_id = s.case_id || '#' || s.target || '#final')
SELECT r.*, CASE WHEN abs(risk_delta) < 1 THEN 'NONE' WHEN risk_delta < 0 THEN 'INCREASED' WHEN risk_delta >= 30 THEN 'SUBSTANTIAL' WHEN risk_delta >= 10 THEN 'MODERATE' ELSE 'SLIGHT' END AS effect, removed_nodes, removed_evidence, coalesce(cleared, '') AS cleared_evidence, coalesce(retained, '') AS retained_evidence FROM r JOIN ids USING (case_id, target) LEFT JOIN moved USING (case_id, target)""")  # fmt: skip
def counterfactuals(spark, d):
    r = counterfactual.simulate(user_cases(spark, d)).results
    lists = [F.array_join(c, ",").alias(c) for c in ("removed_nodes", "removed_evidence", "cleared_evidence", "retained_evidence")]
    return r.select("case_id", "target", "original_risk", "structural_risk", "final_risk", "risk_delta", "effect", "original_state", "final_state", *lists)


@query("removal_sets", SCENARIO_CASES + TAKEN + " SELECT case_id, target, node_id FROM gone")
def removal_sets(spark, d):
    return counterfactual.removals(user_cases(spark, d))


@query("evidence_by_stage", ALL_CASES + " SELECT case_id, stage, count(*) AS n, round(sum(weight), 9) AS weight, round(max(severity), 9) AS max_severity FROM weighted GROUP BY ALL")
def evidence_by_stage(spark, d):
    return lineage.by_stage(user_cases(spark, d)).select("case_id", "stage", "n", F.round("weight", 9).alias("weight"), F.round("max_severity", 9).alias("max_severity"))


@query("evidence_facets", ALL_CASES + " SELECT 'detector' AS facet, detector AS value, count(*) AS n FROM evidence GROUP BY ALL UNION ALL SELECT 'type', evidence_type, count(*) FROM evidence GROUP BY ALL")
def evidence_facets(spark, d):
    return relational.facets(user_cases(spark, d).evidence, {"detector": "detector", "type": "evidence_type"})


@query("evidence_search", ALL_CASES + " SELECT case_id, evidence_id, source_id FROM weighted WHERE detector = 'trigger_detector' AND lower(concat_ws(' ', evidence_id, source_id, evidence_type, detector, stage)) LIKE '%m\\_1%' ESCAPE '\\'")
def evidence_search(spark, d):
    e = relational.search_evidence(user_cases(spark, d).weighted, " M_1", detector="trigger_detector")
    return e.select("case_id", "evidence_id", "source_id")


@query("conversation_search", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND lower(text) LIKE '%the and%'")
def conversation_search(spark, d):
    return relational.search_rows(load(spark, d, "conversations"), " THE and", ("text",), role="user").select("conv_id", "turn", "role")


@query("ingest_counts", "SELECT lang AS label, count(*) AS n, count(DISTINCT source) AS batches FROM documents GROUP BY ALL")
def ingest_counts(spark, d):
    s = load(spark, d, "documents").select(F.col("lang").alias("label_class"), F.col("source").alias("batch_id"))
    return relational.ingest_counts(s).withColumnRenamed("label_class", "label")


@query("accepted_evidence", """SELECT 'u' || user_id AS source_node_id, event_id, CASE WHEN user_id % 3 = 0 THEN 'unsupported source type' WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND CASE WHEN user_id % 3 = 1 THEN c_acctbal > 0 ELSE c_acctbal <= 0 END) THEN 'unknown node' END AS reason FROM events""")
def accepted_evidence(spark, d):
    kind = F.when(F.col("user_id") % 3 == 0, "gadget").when(F.col("user_id") % 3 == 1, "model").otherwise("deployment")
    e = load(spark, d, "events").select(kind.alias("source_node_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_node_id"), "event_id")
    n = load(spark, d, "customer").select(F.when(F.col("c_acctbal") > 0, "MODEL").otherwise("DEPLOYMENT").alias("node_type"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("node_id"))
    good, bad = relational.accept_evidence(e, n)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select("source_node_id", "event_id", "reason")


# --- receipts ---------------------------------------------------------------------------------------------------------

RECEIPTS = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, coalesce('h' || lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'GENESIS') AS prev_hash, coalesce(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), epoch(ts)) AS stamp FROM events),
r AS (SELECT CAST(user_id AS VARCHAR) AS dep, event_id AS arrival, sequence, CASE WHEN event_id % 13 = 0 THEN 'r' || event_id % 7 ELSE 'n' || event_id END AS nonce, event_id % 29 <> 0 AS sig_ok, prev_hash, 'h' || event_id AS own_hash, stamp, abs(epoch(ts) - stamp) > 300 AS skewed FROM e WHERE event_id % 17 <> 0),
p AS (SELECT *, sig_ok AND row_number() OVER (PARTITION BY dep, nonce, sig_ok ORDER BY arrival) > 1 AS replayed FROM r),
s AS (SELECT *, coalesce(max(CASE WHEN sig_ok AND NOT replayed THEN sequence END) OVER w, 0) AS last_seq, coalesce(max(CASE WHEN NOT sig_ok THEN arrival END) OVER w, -1) > coalesce(max(CASE WHEN sig_ok AND NOT replayed THEN arrival END) OVER w, -1) AS reanchor,
  max(CASE WHEN sig_ok AND NOT replayed THEN struct_pack(a := sequence, b := -arrival, c := own_hash) END) OVER w AS best FROM p WINDOW w AS (PARTITION BY dep ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, sig_ok AND NOT replayed AND sequence > last_seq + 1 + reanchor::INT AS gap, sig_ok AND NOT replayed AND prev_hash <> coalesce(best.c, 'GENESIS') AND NOT reanchor AS broken FROM s),
f AS (SELECT dep, arrival, kind, severity, confidence FROM v JOIN (VALUES ('SIGNATURE_INVALID', 1.0, 1.0), ('OUTPUT_HASH_MISMATCH', 1.0, 1.0), ('INPUT_HASH_MISMATCH', 1.0, 1.0), ('MODEL_ARTIFACT_MISMATCH', 1.0, 1.0), ('CONFIG_MISMATCH', 0.9, 1.0), ('TIMESTAMP_SKEW', 0.5, 0.8), ('REPLAY_DETECTED', 1.0, 1.0), ('CHAIN_BREAK', 0.9, 0.9)) t(kind, severity, confidence)
 ON CASE kind WHEN 'SIGNATURE_INVALID' THEN NOT sig_ok WHEN 'OUTPUT_HASH_MISMATCH' THEN sig_ok AND arrival % 31 = 0 WHEN 'INPUT_HASH_MISMATCH' THEN sig_ok AND arrival % 37 = 0 WHEN 'MODEL_ARTIFACT_MISMATCH' THEN sig_ok AND arrival % 19 = 0 WHEN 'CONFIG_MISMATCH' THEN sig_ok AND arrival % 23 = 0 WHEN 'TIMESTAMP_SKEW' THEN sig_ok AND skewed WHEN 'REPLAY_DETECTED' THEN replayed ELSE broken END
 UNION ALL SELECT dep, arrival, 'SEQUENCE_GAP', least(1.0, 0.4 + 0.2 * (sequence - last_seq - 1)), 0.9 FROM v WHERE gap)"""  # fmt: skip


def _verdicts(spark, d):
    r = bindings.receipts(spark, d)
    return passports.verdicts(passports.replay_state(r), passports.mismatches(r.columns))


@query("receipt_state", RECEIPTS + " SELECT dep AS deployment_id, arrival, replayed, last_seq, coalesce(best.c, 'GENESIS') AS last_hash, reanchor FROM v")
def receipt_state(spark, d):
    return passports.replay_state(bindings.receipts(spark, d)).select("deployment_id", "arrival", "replayed", "last_seq", "last_hash", "reanchor")


@query("receipt_verdicts", RECEIPTS + " SELECT dep AS deployment_id, arrival, kind, CAST(round(severity, 6) AS DOUBLE) AS severity, CAST(confidence AS DOUBLE) AS confidence FROM f")
def receipt_verdicts(spark, d):
    v = _verdicts(spark, d)
    return v.select("deployment_id", "arrival", F.explode("findings").alias("f")).select("deployment_id", "arrival", "f.kind", r6("f.severity").alias("severity"), "f.confidence")


@query("receipt_evidence", RECEIPTS + """ SELECT dep || '/E-INF-' || lpad(CAST(row_number() OVER (PARTITION BY dep ORDER BY arrival, list_position(['SIGNATURE_INVALID', 'OUTPUT_HASH_MISMATCH', 'INPUT_HASH_MISMATCH', 'MODEL_ARTIFACT_MISMATCH', 'CONFIG_MISMATCH', 'TIMESTAMP_SKEW', 'REPLAY_DETECTED', 'SEQUENCE_GAP', 'CHAIN_BREAK'], kind)) AS VARCHAR), 4, '0') AS evidence_id,
 CAST(arrival AS VARCHAR) AS source_id, kind AS evidence_type, CAST(round(severity, 6) AS DOUBLE) AS severity FROM f""")  # fmt: skip
def receipt_evidence(spark, d):
    return passports.evidence(_verdicts(spark, d)).select("evidence_id", "source_id", "evidence_type", r6("severity").alias("severity"))


@query("receipt_totals", RECEIPTS + ", ok AS (SELECT dep, NOT EXISTS (SELECT 1 FROM f WHERE f.dep = v.dep AND f.arrival = v.arrival) AS ok FROM v) SELECT dep AS deployment_id, count(*) AS n_total, count(*) FILTER (ok) AS n_ok, bool_and(ok) AS clean FROM ok GROUP BY dep")
def receipt_totals(spark, d):
    return passports.totals(_verdicts(spark, d)).select("deployment_id", "n_total", "n_ok", "clean")


@query("timestamp_skew", RECEIPTS + " SELECT v.dep AS deployment_id, count(*) FILTER (sig_ok AND skewed) AS n_skewed, count(*) AS n FROM v GROUP BY v.dep")
def timestamp_skew(spark, d):
    skewed = F.exists("findings", lambda f: f["kind"] == "TIMESTAMP_SKEW")
    return _verdicts(spark, d).groupBy("deployment_id").agg(F.count_if(skewed).alias("n_skewed"), F.count("*").alias("n"))


def _blob(byte: int) -> str:
    """HMAC's key block for an inner (0x36) or outer (0x5c) pad as a blob of DuckDB."""
    return "'" + "".join(f"\\x{b ^ byte:02X}" for b in scenarios.KEY.ljust(64, b"\0")) + "'::BLOB"


_HMAC = "sha256({outer} || unhex(sha256({inner} || encode({0}))))".format("{0}", outer=_blob(0x5C), inner=_blob(0x36))
_BODY = """'"config_hash":"' || CASE WHEN arrival % 23 = 0 THEN 'other' ELSE 'c' END || '","deployment_id":"' || dep || '","inference_id":"' || arrival || '","input_hash":"' || CASE WHEN arrival % 37 = 0 THEN 'other' ELSE 'i' END || '","model_hash":"' || CASE WHEN arrival % 19 = 0 THEN 'other' ELSE 'm' END
 || '","nonce":"' || nonce || '","output_hash":"' || CASE WHEN arrival % 31 = 0 THEN 'other' ELSE 'o' END || '","preproc_hash":"p","prev_hash":"' || prev_hash || '","sequence":' || sequence"""


@query("receipt_signatures", RECEIPTS + f""", b AS (SELECT dep, arrival, sig_ok, {_BODY} AS head, ',"timestamp":' || CAST(floor(stamp) AS BIGINT) || '.0' AS tail FROM r), g AS (SELECT *, {_HMAC.format("CASE WHEN sig_ok THEN '{' || head || tail || '}' ELSE 'forged' END")} AS signature FROM b)
SELECT dep AS deployment_id, arrival, signature = {_HMAC.format("'{' || head || tail || '}'")} AS sig_ok, sha256('{{' || head || ',"signature":"' || signature || '"' || tail || '}}') AS own_hash FROM g""")  # fmt: skip
def receipt_signatures(spark, d):
    v = passports.with_digests(bindings.signed_receipts(spark, d, scenarios.KEY), scenarios.KEY)
    return v.select("deployment_id", "arrival", "sig_ok", "own_hash")


KINDS = {"config_tamper": "CONFIG_MISMATCH", "drop_records": "CHAIN_BREAK,SEQUENCE_GAP", "forged_signature": "SIGNATURE_INVALID", "input_tamper": "INPUT_HASH_MISMATCH", "model_swap": "MODEL_ARTIFACT_MISMATCH", "none": "", "output_tamper": "OUTPUT_HASH_MISMATCH", "replay": "REPLAY_DETECTED"}


@query("attack_detection", f"SELECT attack, CAST(attack <> 'none' AS DOUBLE) AS detected, 0 AS false_positives, kinds FROM (VALUES {_values(list(KINDS.items()))}) t(attack, kinds)")
def attack_detection(spark, d):
    return scenarios.evaluate(spark).select("attack", F.col("detected").cast("double").alias("detected"), "false_positives", F.array_join("kinds", ",").alias("kinds"))


# orders as models: their statuses as formats
@query("models_by_date", "SELECT o_orderkey AS model_id, o_orderdate AS created_at, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS place, o_orderstatus AS format FROM orders QUALIFY place <= 5")
def models_by_date(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("model_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("format"))
    return relational.newest_first(o, 5, ("format",)).select("model_id", "created_at", "place", "format")


def queries() -> dict:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}
