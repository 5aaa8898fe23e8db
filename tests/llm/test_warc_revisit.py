import gzip
import random

from plumbline.llm import warc_revisit as wr

SCHEMA = wr.SCHEMA + ", full string, own string"


def brute(rows):
    canon = lambda u: u.split("#")[0].split("://")[1].lower().removeprefix("www.")  # noqa: E731  enough for the urls of this test
    out = {}
    for r in rows:
        if r[3] != "revisit":
            continue
        past = [] if r[1] is None or r[2] is None else [x for x in rows if x[3] == "response" and x[1] and x[2] is not None and canon(x[1]) == canon(r[1]) and x[2] < r[2]]
        if not past:
            out[r[0]] = (None, "no_response", None)
            continue
        f = max(past, key=lambda x: (x[2], x[0]))
        weak = lambda e: e.strip().removeprefix("W/")
        same = weak(r[4]) == weak(f[4]) if r[4] and f[4] else r[5] == f[5] if r[5] and f[5] else r[6] == f[6] if r[6] and f[6] else None
        outcome = "unverified" if same is None else "resolved" if same else "mismatch"
        headers = None
        if outcome != "mismatch":
            low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
            headers = low(f[7]) | {k: v for k, v in low(r[7]).items() if k not in wr.KEPT_HEADERS}
        out[r[0]] = (f[0] if outcome != "mismatch" else None, outcome, headers)
    return out


def test_as_of_join_equals_brute_force(spark):
    rng, rows = random.Random(6), []
    for k in range(600):
        url = rng.choice(["http://www.a.org/x", "https://A.org/x#f", "http://a.org/y", "http://hot.org/p", "http://hot.org/p", "http://hot.org/p", None])
        rows.append((f"r{k:04d}", url, rng.choice([None, *range(40)]), rng.choice(["response", "revisit"]), rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, "m1", "m2"]), rng.choice([None, "d1", "d2"]), rng.choice([None, {}, {"ETag": str(k), "Content-Length": "7", "X-A": str(k)}, {"content-type": "t", "x-b": "1"}])))
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], SCHEMA)
    got = {r.record_id: (r.refers_to, r.outcome, r.headers) for r in wr.resolve(df).collect()}
    assert got == brute(rows)
    again = wr.resolve(df.union(df.limit(0)).union(df.filter("record_id = 'r0001'")))
    assert again.count() == len(got) + sum(r[0] == "r0001" and r[3] == "revisit" for r in rows)
    assert wr.resolve(df.limit(0)).count() == 0


def test_canonical_urls(spark):
    same = ["http://www.A.org:80/b/?utm_source=x&q=1#f", "https://a.org/b?q=1", "a.org/b/?ref=z&q=1"]
    df = spark.createDataFrame([(u,) for u in same], "u string")
    assert {r[0] for r in df.select(wr.canonical_url(df.u)).collect()} == {"a.org/b?q=1"}


def test_files(spark, tmp_path):
    rows = [
        {"record_id": "<urn:1>", "url": "http://a.org/", "ts": 1_700_000_000, "kind": "response", "digest": "sha1:X", "headers": {"ETag": '"e"', "Content-Type": "text/html"}, "body": b"WARC/ not a record\r\n\r\nbody"},
        {"record_id": "<urn:2>", "url": "http://a.org/", "ts": 1_700_000_100, "kind": "revisit", "digest": None, "headers": {"ETag": 'W/"e"', "X-New": "1"}, "body": None},
    ]
    (tmp_path / "a.warc").write_bytes(wr.warc_bytes(rows))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(wr.warc_bytes([r])) for r in rows))
    for name in ("a.warc", "b.warc.gz"):
        df = wr.read_warc(spark, str(tmp_path / name))
        assert {r.record_id: bytes(r.body) for r in df.collect()} == {"<urn:1>": rows[0]["body"], "<urn:2>": b""}
        r = wr.resolve(df).first()
        assert (r.refers_to, r.outcome, r.digest, r.headers["x-new"], r.headers["content-type"]) == ("<urn:1>", "resolved", "sha1:X", "1", "text/html")


def test_query_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    rows = con.execute(wr.oracle_sql()).fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in wr.query(spark, sf_dir).collect()) and len({r[4] for r in rows}) == 3


def test_damaged_files_give_what_can_be_read():
    row = lambda k, body: {"record_id": f"<urn:{k}>", "url": "http://a.org/", "ts": 1_700_000_000, "kind": "response", "digest": None, "headers": {}, "body": body}
    parts = [wr.warc_bytes([row(k, bytes([65 + k]) * 300_000)]) for k in range(3)]
    read = lambda data: [(h["warc-record-id"], len(b), p) for h, _, b, p in wr.parse_warc(data)]
    whole = [(f"<urn:{k}>", 300_000, None) for k in range(3)]
    assert read(b"".join(parts)) == whole and read(b"".join(map(gzip.compress, parts))) == whole
    cut = read(b"".join(parts)[:-100_000])
    assert cut[:2] == whole[:2] and cut[2][0] == "<urn:2>" and cut[2][1] < 300_000 and cut[2][2] == "cut"
    zipped = [gzip.compress(p) for p in parts]
    assert read(b"".join(zipped)[: -len(zipped[2]) // 2])[:2] == whole[:2]
    odd = read(parts[0].replace(b"Content-Length", b"Content-Size") + parts[1])
    assert odd[0][0] == "<urn:0>" and odd[0][2] == "no length" and odd[0][1] >= 300_000 and odd[1] == whole[1]
    assert read(b"") == [] and read(b"no archive at all") == []
