from plumbline.llm import url_reputation as ur


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate(str.maketrans(ur.UPPER, ur.LOWER))
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = (0, None, None)
    for kind, rule in ur.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and len(rule) > best[0]:
            best = (len(rule), rule, kind)
    return host, path, best[1], best[2]


URLS = [
    None, "", "nohost", "http://", "http://A.Example.NET/en/x?q=1#y", "https://example.net/EN/", "x://b.net", "x://b.net/", "x://net/", "x://example.com/de/a", "x://notexample.com/de/a", "x://www.example.com/de", "http://a.org/fr/1", "http://org/fr/",
    "http://a.org/f", "http://b.org?x=/fr/", "http://c.net#/en/", "a://b://c.net/x", "http://ÄB.net/é", "http://h:80/p", "http://x.example.net/en/\nnew",
]


def test_rules_equal_brute_force(spark):
    p = spark.createDataFrame([(k, u, "clash", 1.0) for k, u in enumerate(URLS)] + [(0, None, "clash", 1.0)], "page_id long, url string, host string, mean double")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = ur.judge(p, none).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), URLS[r.page_id]


def test_reputation_shrinks_and_blocks(spark):
    pages = [(k, f"http://{h}/p{k}") for k, h in enumerate(["bad.x.io"] * 60 + ["few.x.io"] * 2 + ["good.y.io"] * 200 + ["new.x.io", "new.q.de"])]
    bad = [(k, int(k < 62)) for k in range(262)] + [(0, 1), (300, 1)]
    p, o = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")
    got = {r.host: r for r in ur.judge(p, o).collect()}
    assert got["bad.x.io"].verdict == "block" and got["good.y.io"].verdict == "allow" and got["new.q.de"].verdict == "allow"
    assert got["good.y.io"].bad_rate < got["new.q.de"].bad_rate < got["few.x.io"].bad_rate <= got["bad.x.io"].bad_rate
    assert ur.judge(p.limit(0), o).count() == 0


def test_outcomes(spark):
    p = spark.createDataFrame([(1, "http://a/en/77.html?x=5"), (2, "http://a/none"), (3, None)], "page_id long, url string")
    lab = spark.createDataFrame([(77, 1, 1), (78, 0, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in ur.outcomes_of(p, lab).collect()] == [(1, 1)]


def test_query_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for limit in (ur.LIMIT, 0.05):  # the second makes the method block
        sql = ur.oracle_sql().replace(f"> {ur.LIMIT} THEN", f"> {limit} THEN")
        pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
        got = ur.judge(pages, ur.outcomes_of(pages, labels), limit=limit).select("page_id", "host", "path", "rule", "verdict")
        rows = con.execute(sql).fetchall()
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.collect())
    assert any(r[3] is None and r[4] == "block" for r in rows)


def test_a_host_never_seen_is_less_certain_than_a_labelled_one(spark):
    hosts = [f"h{k}.farm.com" for k in range(40)]
    rows = [(h, int(k > 0)) for h in hosts for k in range(11)]
    outcomes = spark.createDataFrame(rows + [("good.fine.org", 0)] * 50, "host string, bad int")
    asked = spark.createDataFrame([(h,) for h in (hosts[0], "new.farm.com", "a.other.com", "x.y.zz")], "host string")
    got = {r.host: r for r in ur.reputation(outcomes, asked).collect()}
    assert got["new.farm.com"].weight < got[hosts[0]].weight and abs(got["new.farm.com"].mean - 10 / 11) < 0.05
    assert got["a.other.com"].weight <= got["new.farm.com"].weight and got["x.y.zz"].weight <= got["a.other.com"].weight


def test_registered_domains(spark):
    df = spark.createDataFrame([(h,) for h in ("a.co.uk", "x.b.co.uk", "co.uk", "www.a.com", "com", "", "localhost", "1.2.3.4")], "host string")
    got = {r.host: (r.d, r.s) for r in df.select("host", ur.domain_of(df.host).alias("d"), ur.suffix_of(df.host).alias("s")).collect()}
    assert got == {"a.co.uk": ("a.co.uk", "co.uk"), "x.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "www.a.com": ("a.com", "com"), "com": ("com", "com"), "": ("", ""), "localhost": ("localhost", "localhost"), "1.2.3.4": ("3.4", "4")}
