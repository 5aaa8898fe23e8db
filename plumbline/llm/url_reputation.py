"""Host reputation by empirical Bayes, with allow and block rules before it.

Labelled page outcomes (1: bad) are counted by host and shrunk level by level: a suffix's rate towards the rate of all
pages, a registered domain's towards its suffix, a host's towards its domain. Each step is a beta-binomial update,
posterior mean = (bad + strength * parent mean) / (n + strength), whose strength is fitted by the method of moments to
how much the children's rates vary beyond what their sample sizes explain. A page is blocked if the lower bound of its
host's posterior bad rate exceeds `limit`: a few bad pages never block a host. The bound is the normal approximation of the beta
posterior, mean - z standard deviations; a host without outcomes is as uncertain as the prior is.

All counts are hash aggregations with partial sums, so a host with a third of all pages is a single row after the map
side; each level is counted once and kept as a table. The page table is only joined to the table of hosts.

Rules are (host, path) pairs; a rule fits its host and all subdomains if the url's path starts with the rule's path, and the
longest fitting rule decides.

Defined cases: a url that is null or has no :// has an empty host and path, fits no rule and has the overall rate; a host
without labelled pages takes the mean of its domain (else suffix, else all) and the prior's strength; labels without outcome are ignored; without any labels nothing is
blocked by the method; a host whose bound equals the limit is allowed, and of rules that fit equally the later one holds; very long
urls are read whole; repeated rows are each returned, and each counts; other columns, of whatever name, are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import sized_broadcast, table, written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z, LIMIT = 1.645, 0.5
LEAST, MOST = 2.0, 1000.0  # bounds of a fitted prior strength
# fixed values: public suffixes of two labels (the common ones; any other host's suffix is its last label)
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.ng",
    "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "edu.hk", "edu.tw", "gob.mx", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "go.jp",
    "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.hk", "org.nz", "org.tw", "org.uk", "org.za", "plc.uk", "sch.uk",
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The public suffix: the last two labels if they are in SUFFIXES, else the last one."""
    two = F.regexp_extract(host, r"[^.]+\.[^.]+$", 0)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.regexp_extract(host, r"[^.]*$", 0))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    three = F.regexp_extract(host, r"([^.]*\.)?[^.]+\.[^.]+$", 0)
    two = F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)
    return F.when(F.regexp_extract(host, r"[^.]+\.[^.]+$", 0).isin(*SUFFIXES), three).otherwise(two)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first, being outermost
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def strength(n_groups: Column, n: Column, mean: Column, sum_sq: Column, sum_n2: Column) -> Column:
    """Prior strength by moments: sum_sq is the weighted sum of squared deviations of the groups' rates from the mean."""
    var = sum_sq / n  # between groups, with sampling noise
    noise = mean * (1 - mean) * n_groups / n
    tau2 = F.greatest((var - noise) / F.greatest(F.lit(1e-12), 1 - sum_n2 / (n * n)), F.lit(0.0))
    fitted = F.when(tau2 > 0, mean * (1 - mean) / tau2 - 1).otherwise(F.lit(MOST))
    return F.least(F.greatest(F.coalesce(fitted, F.lit(MOST)), F.lit(LEAST)), F.lit(MOST))


def _level(groups: DataFrame, key: str, parent: str, parents: DataFrame) -> tuple[DataFrame, float]:
    """groups(key, parent, n, bad), parents(parent, mean) -> (key, mean, weight of each group; prior strength of any other)."""
    j = groups.join(sized_broadcast(parents.select(F.col(parent), F.col("mean").alias("prior"))), parent)
    rate = F.col("bad") / F.col("n")
    fit = j.agg(
        F.count("*").alias("g"), F.sum("n").alias("all_n"), F.sum(F.col("n") * (rate - F.col("prior")) * (rate - F.col("prior"))).alias("ss"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), (F.sum(F.col("n") * F.col("prior")) / F.sum("n")).alias("m"),
    )
    k = fit.select(strength(F.col("g"), F.col("all_n"), F.col("m"), F.col("ss"), F.col("n2"))).first()[0]  # one number
    mean = (F.col("bad") + k * F.col("prior")) / (F.col("n") + k)
    return written(j.select(key, mean.alias("mean"), (F.col("n") + k).alias("weight")), f"level-{key}"), float(k)


def reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """outcomes(host, bad 0/1), hosts(host) -> host, mean, weight of the posterior bad rate, for every row of hosts.

    A host without outcomes is a draw from the prior at the mean of what it belongs to: its weight is the prior's strength, never the
    evidence that its relatives have. Below a domain without outcomes that is the least of the strengths passed on the way.
    """
    keyed = lambda df: df.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    counted = outcomes.filter("bad is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    counted = written(keyed(counted), "host-counts")
    up = lambda df, *k: df.groupBy(*k).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    mean = (total[1] + 1) / (total[0] + 2) if total[0] else 0.0
    root = hosts.sparkSession.createDataFrame([(0, mean)], "root int, mean double")
    s, ks = _level(up(counted, "suffix").withColumn("root", F.lit(0)), "suffix", "root", root)
    d, kd = _level(up(counted, "domain", "suffix"), "domain", "suffix", s)
    h, kh = _level(counted.select("host", "domain", "n", "bad"), "host", "domain", d)
    out = keyed(hosts)
    for t, key in ((h, "host"), (d, "domain"), (s, "suffix")):
        out = out.join(sized_broadcast(t.select(key, F.col("mean").alias(f"{key}_mean"), F.col("weight").alias(f"{key}_weight"))), key, "left")
    unseen = F.when(F.col("domain_mean").isNotNull(), kh).when(F.col("suffix_mean").isNotNull(), min(kh, kd)).otherwise(min(kh, kd, ks))
    return out.select("host", F.coalesce("host_mean", "domain_mean", "suffix_mean", F.lit(mean)).alias("mean"), F.coalesce("host_weight", unseen).alias("weight"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """pages(page_id, url), outcomes(page_id, bad) -> page_id, host, path, rule, verdict, bad_rate, bad_bound."""
    p = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).drop("url")
    once = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = p.select("page_id", "host").join(once, "page_id")
    rep = reputation(seen.select("host", "bad"), p.select("host").distinct())
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    rep = written(rep.select("host", F.col("mean").alias("bad_rate"), F.greatest(F.col("mean") - z * sd, F.lit(0.0)).alias("bad_bound")), "reputation")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    out = p.join(sized_broadcast(rep), "host", "left").withColumn("rule", rule).withColumn("by_rule", said)  # past a broadcast, Spark splits a hot host
    verdict = F.coalesce(F.col("by_rule"), F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad_rate", "bad_bound")


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled pages of the tables: a url's last number is the doc_id whose text the page shows."""
    doc = F.regexp_extract(path_of(F.col("url")), r"([0-9]{1,18})[^0-9]*$", 1)
    p = pages.select("page_id", F.when(doc != "", doc.cast("long")).alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)
    return p.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, outcomes_of(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def _level_sql(key: str, parent: str) -> str:
    """CTEs fit_<key> and post_<key> from cnt_<key>(key, parent, n, bad) and post_<parent>(parent, mean)."""
    return f"""j_{key} AS (SELECT c.*, p.mean AS prior FROM cnt_{key} c JOIN post_{parent} p USING ({parent})),
m_{key} AS (SELECT count(*) AS g, sum(n) AS n, sum(n * (bad / n - prior) * (bad / n - prior)) AS ss, sum(n * n) AS n2, sum(n * prior) / sum(n) AS m FROM j_{key}),
t_{key} AS (SELECT m, greatest((ss / n - m * (1 - m) * g / n) / greatest(1e-12, 1 - n2 / (n * n)), 0.0) AS tau2 FROM m_{key}),
k_{key} AS (SELECT least(greatest(coalesce(CASE WHEN tau2 > 0 THEN m * (1 - m) / tau2 - 1 ELSE {MOST} END, {MOST}), {LEAST}), {MOST}) AS k FROM t_{key}),
post_{key} AS (SELECT {key}, {parent}, (bad + k * prior) / (n + k) AS mean, n + k AS weight FROM j_{key} CROSS JOIN k_{key})"""


def oracle_sql(rules=RULES) -> str:
    """The query in DuckDB's SQL."""
    fits, said = "", ""
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        when = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN "
        fits, said = fits + when + f"'{text}' ", said + when + f"'{kind}' "
    return rf"""WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END AS bad FROM p JOIN labels ON doc_id = CAST(nullif(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1), '') AS BIGINT)),
once AS (SELECT page_id, max(bad) AS bad FROM o GROUP BY page_id),
two AS (SELECT DISTINCT host, regexp_extract(host, '[^.]+\.[^.]+$', 0) IN {SUFFIXES} AS long FROM p),
keyed AS (SELECT host, CASE WHEN long THEN regexp_extract(host, '([^.]*\.)?[^.]+\.[^.]+$', 0) ELSE regexp_extract(host, '([^.]*\.)?[^.]*$', 0) END AS domain, CASE WHEN long THEN regexp_extract(host, '[^.]+\.[^.]+$', 0) ELSE regexp_extract(host, '[^.]*$', 0) END AS suffix FROM two),
cnt_host AS (SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM p JOIN once USING (page_id) JOIN keyed USING (host) WHERE bad IS NOT NULL GROUP BY ALL),
cnt_domain AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM cnt_host GROUP BY ALL), cnt_suffix AS (SELECT suffix, 0 AS root, sum(n) AS n, sum(bad) AS bad FROM cnt_domain GROUP BY ALL),
post_root AS (SELECT 0 AS root, (sum(bad) + 1) / (sum(n) + 2) AS mean FROM cnt_suffix),
{_level_sql('suffix', 'root')},
{_level_sql('domain', 'suffix')},
{_level_sql('host', 'domain')},
rep AS (SELECT k.host, coalesce(h.mean, d.mean, s.mean, (SELECT mean FROM post_root), 0.0) AS mean, coalesce(h.weight, CASE WHEN d.mean IS NOT NULL THEN kh.k WHEN s.mean IS NOT NULL THEN least(kh.k, kd.k) ELSE least(kh.k, kd.k, ks.k) END) AS weight
 FROM keyed k CROSS JOIN k_host kh CROSS JOIN k_domain kd CROSS JOIN k_suffix ks LEFT JOIN post_host h USING (host) LEFT JOIN post_domain d ON d.domain = k.domain LEFT JOIN post_suffix s ON s.suffix = k.suffix)
SELECT page_id, host, path, CASE {fits}END AS rule, CASE {said}WHEN greatest(mean - {Z} * sqrt(mean * (1 - mean) / (weight + 1)), 0.0) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM p JOIN rep USING (host)"""
