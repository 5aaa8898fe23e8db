"""WARC: resolution of not-modified revisits.

A revisit record says that a page had not changed; its content is that of the latest earlier full response under the same
canonical url. resolve() finds that response by an as-of join, checks the validators of the two (ETag by weak comparison, else
Last-Modified, else payload digest) and merges the headers that a 304 response may update into the stored ones.

As-of join: records are range-partitioned by (url, time, ...), so that a url with a third of all records spreads over many
partitions. Within a partition a window carries the last response forward. Only a url that spans partitions needs
more: the last responses of its partitions are carried over in a table of at most two rows for each partition, which is broadcast.

read_warc() reads WARC files (plain, or gzipped by record), write_warc() writes them.

Defined cases: a revisit without url, time or earlier response has outcome no_response; equal times do not count as earlier;
of several responses of the same time the one with the greatest record id holds; with no validator in common the outcome
is unverified and the reference stands; repeated records are each resolved; very long headers and pages are read whole; columns beyond
SCHEMA, of whatever name, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import table, written

# fixed values: header fields that a 304 response must not update in a stored response
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization",
    "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"
SCHEMA = "record_id string, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """host without www. and default port, path without a last slash, query without tracking parameters; no scheme, no fragment."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_replace(F.regexp_extract(u, r"\?(.*)$", 1), r"(^|&)(" + TRACKING + r")=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def _lower_keys(headers: Column) -> Column:
    """Names in lower case; of names that differ in case only the least value stays."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    last = F.filter(entries, lambda e, i: (i == 0) | (F.get(entries, i - 1)["key"] != e["key"]))
    return F.coalesce(F.map_from_entries(last), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def merge_headers(stored: Column, fresh: Column) -> Column:
    fresh = F.map_filter(fresh, lambda k, _: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)


def resolve(records: DataFrame) -> DataFrame:
    """records (SCHEMA and more) -> record_id, url, ts, refers_to, outcome, headers of every revisit record."""
    spark = records.sparkSession
    r = records.select("record_id", canonical_url(F.col("url")).alias("url"), "ts", "kind", "etag", "last_modified", "digest", _lower_keys(F.col("headers")).alias("headers"))
    r = written(r, "records")  # range partitioning reads its input twice, and what makes the records may be dear
    placed = r.filter("url is not null and ts is not null").withColumn("rank", (F.col("kind") == "response").cast("int"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(n, "url", "ts", "rank", "record_id").withColumn("part", F.spark_partition_id())
    placed = written(placed, "captures")
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    before = W.partitionBy("part", "url").orderBy("ts", "rank", "record_id").rowsBetween(W.unboundedPreceding, -1)
    own = placed.withColumn("own", F.last(full, ignorenulls=True).over(before))
    # urls that reach over a partition's end: fewer than partitions
    spans = placed.groupBy("url").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select("url")
    tails = placed.join(F.broadcast(spans), "url").groupBy("url", "part").agg(F.max_by(full, F.when(F.col("kind") == "response", F.struct("ts", "record_id"))).alias("tail"))
    over = W.partitionBy("url").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select("url", "part", F.last("tail", ignorenulls=True).over(over).alias("carried")).filter("carried is not null")
    own = own.filter("kind = 'revisit'").join(F.broadcast(carried), ["url", "part"], "left")
    nowhere = r.filter("kind = 'revisit' and (url is null or ts is null)")
    none = F.lit(None).cast(own.schema["own"].dataType)
    found = own.withColumn("full", F.coalesce("own", "carried")).drop("own", "carried", "part", "rank")
    found = found.unionByName(nowhere.withColumn("full", none))
    f = F.col("full")
    by_etag = _weak(F.col("etag")) == _weak(f["etag"])
    same = F.coalesce(by_etag, F.col("last_modified") == f["last_modified"], F.col("digest") == f["digest"])
    outcome = F.when(f.isNull(), "no_response").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    good = outcome.isin("resolved", "unverified")
    return found.select(
        "record_id", "url", "ts", F.when(good, f["record_id"]).alias("refers_to"), outcome.alias("outcome"),
        F.when(good, f["digest"]).alias("digest"), F.when(good, merge_headers(f["headers"], F.col("headers"))).alias("headers"),
    )


def header_text(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


# --- files ----------------------------------------------------------------------------------------------------------


def inflated(data: bytes, step: int = 1 << 20):
    """Yield pieces of a file's content: of every gzip member in turn, or of a plain file as it is. A cut or damaged member ends it."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            piece = data[at : at + step]
            try:
                out = member.decompress(piece)
            except zlib.error:
                return
            at += len(piece) - len(member.unused_data)
            yield out


def parse_warc(data: bytes):
    """Yield (WARC headers, HTTP headers, body, problem) of the records of a file. Header names are lower-cased.

    problem: None; "no length" where a record's Content-Length is missing or no number (its block is taken to reach to the next
    record); "cut" where the file ends before the record does. One record is held at a time besides the file's own bytes.
    """
    source, held, more = inflated(data), b"", True

    def read(n: int) -> None:
        nonlocal held, more
        parts, size = [held], len(held)
        while more and size < n:
            piece = next(source, None)
            more = piece is not None
            parts.append(piece or b"")
            size += len(parts[-1])
        held = b"".join(parts)

    while True:
        read(1 << 16)
        at = held.find(b"WARC/")
        if at < 0:
            if not more:
                return
            held = held[-4:]
            read(len(held) + 1)
            continue
        held = held[at:]
        while (end := held.find(b"\r\n\r\n")) < 0 and more:
            read(len(held) + (1 << 16))
        if end < 0:
            return
        head, problem = _fields(held[:end]), None
        if head.get("content-length", "").isdecimal():
            size = int(head["content-length"])
            read(end + 4 + size)
            if len(held) < end + 4 + size:
                problem = "cut"
        else:
            problem = "no length"
            while (stop := held.find(b"\r\n\r\nWARC/", end)) < 0 and more:
                read(len(held) + (1 << 20))
            size = max(0, (stop if stop >= 0 else len(held)) - end - 4)
        block, held = held[end + 4 : end + 4 + size], held[end + 4 + size :]
        http, body = {}, block
        if block[:5] == b"HTTP/":
            cut = block.find(b"\r\n\r\n")
            cut = len(block) if cut < 0 else cut
            http, body = _fields(block[:cut]), block[cut + 4 :]
        yield head, http, body, problem


def _fields(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in raw.split(b"\r\n")[1:])
    return {k.decode("latin-1").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs if k.strip()}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of WARC files as SCHEMA plus body and problem (see parse_warc; null where a record is sound).

    A file is one task's work, so archives are cut at about 1 GB, as crawlers do; its members are unpacked one after another.
    """

    def run(batches):
        import pandas as pd

        columns = ["record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers", "body", "problem"]
        for pdf in batches:
            for content in pdf["content"]:
                rows, size = [], 0
                for head, http, body, problem in parse_warc(content):
                    if head.get("warc-type") not in ("response", "revisit"):
                        continue
                    ts = pd.to_datetime(head.get("warc-date"), utc=True, errors="coerce")
                    rows.append((head.get("warc-record-id"), head.get("warc-target-uri"), None if ts is pd.NaT else int(ts.timestamp()), head["warc-type"], http.get("etag"), http.get("last-modified"), head.get("warc-payload-digest"), http, body, problem))
                    size += len(body)
                    if size > 16 << 20:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInPandas(run, SCHEMA + ", body binary, problem string")


def warc_bytes(rows) -> bytes:
    """A WARC file of rows with the fields of SCHEMA and body."""
    from datetime import UTC, datetime

    out = []
    for r in rows:
        status = "200 OK" if r["kind"] == "response" else "304 Not Modified"
        http = [f"HTTP/1.1 {status}", *(f"{k}: {v}" for k, v in sorted((r["headers"] or {}).items()))]
        block = "\r\n".join(http).encode() + b"\r\n\r\n" + (r["body"] or b"")
        when = datetime.fromtimestamp(r["ts"], UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        head = [f"WARC/1.1\r\nWARC-Type: {r['kind']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Target-URI: {r['url']}", f"WARC-Date: {when}", *([f"WARC-Payload-Digest: {r['digest']}"] if r["digest"] else []), f"Content-Length: {len(block)}"]
        out.append("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    return b"".join(out)


# --- the driver's pages as captures -----------------------------------------------------------------------------------


def captures_of(pages: DataFrame) -> DataFrame:
    """Each page as a full response and two later revisits, some with foreign or missing validators."""
    p = pages.select(F.col("page_id").cast("string").alias("p"), F.coalesce(F.col("page_id"), F.lit(0)).alias("k"), "url", F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("m"))
    part = p.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v")).withColumn("c", F.pmod(F.col("k") * 7 + F.col("v") * 3, F.lit(5)))
    first = F.col("v") == 0
    etag = F.when(first | (F.col("c") == 4), F.concat(F.lit('"'), F.substring("m", 1, 16), F.lit('"'))).when(F.col("c") == 3, F.concat(F.lit('W/"'), F.substring("m", 1, 16), F.lit('"'))).when(F.col("c") == 2, F.lit('"other"'))
    modified = F.when(first | (F.col("c") == 1), F.concat(F.lit("day "), F.col("k") % 28))
    ts = F.lit(1_700_000_000) + (F.col("k") % 1000) * 3600 + F.col("v") * 86_400
    base = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("X-Version"), F.col("v").cast("string"), F.lit("Content-Length"), F.col("c").cast("string"))
    return part.select(
        F.concat(F.coalesce("p", F.lit("")), F.lit("-"), F.col("v").cast("string")).alias("record_id"),
        F.when(first, F.col("url")).otherwise(F.concat("url", F.lit("#again"))).alias("url"), ts.cast("long").alias("ts"), F.when(first, "response").otherwise("revisit").alias("kind"),
        etag.alias("etag"), modified.alias("last_modified"), F.when(first, F.col("m")).alias("digest"), base.alias("headers"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(captures_of(table(spark, sf_dir, "pages")))
    return out.select("record_id", "url", "ts", "refers_to", "outcome", "digest", header_text(F.col("headers")).alias("headers"))


def oracle_sql() -> str:
    """The query in DuckDB's SQL."""
    clean = r"regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    return rf"""WITH p AS (SELECT CAST(page_id AS VARCHAR) AS p, coalesce(page_id, 0) AS k, url, md5(coalesce(html, '')) AS m FROM pages),
part AS (SELECT *, (k * 7 + v * 3) % 5 AS c FROM p CROSS JOIN (VALUES (0), (1), (2)) t(v)),
cap AS (SELECT coalesce(p, '') || '-' || v AS record_id, CASE WHEN v = 0 THEN url ELSE url || '#again' END AS url, 1700000000 + (k % 1000) * 3600 + v * 86400 AS ts, v, c, m,
  CASE WHEN v = 0 OR c = 4 THEN '"' || left(m, 16) || '"' WHEN c = 3 THEN 'W/"' || left(m, 16) || '"' WHEN c = 2 THEN '"other"' END AS etag, CASE WHEN v = 0 OR c = 1 THEN 'day ' || (k % 28) END AS modified FROM part),
u AS (SELECT *, {clean} AS u FROM cap),
parts AS (SELECT * EXCLUDE (url, u), regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host, regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  regexp_replace(regexp_replace(regexp_extract(u, '\?(.*)$', 1), '(^|&)({TRACKING})=[^&]*', '', 'g'), '^&+', '') AS q FROM u),
r AS (SELECT *, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM parts),
j AS (SELECT x.record_id, x.url, x.ts, x.v, x.etag, x.modified, f.record_id AS f_id, f.etag AS f_etag, f.modified AS f_modified, f.m AS f_digest, f.c AS f_c, row_number() OVER (PARTITION BY x.record_id ORDER BY f.ts DESC, f.record_id DESC) AS k
  FROM r x LEFT JOIN r f ON f.v = 0 AND f.url = x.url AND f.ts < x.ts WHERE x.v > 0),
s AS (SELECT *, coalesce(regexp_replace(trim(etag), '^W/', '') = regexp_replace(trim(f_etag), '^W/', ''), modified = f_modified) AS same FROM j WHERE k = 1),
o AS (SELECT *, CASE WHEN f_id IS NULL THEN 'no_response' WHEN same IS NULL THEN 'unverified' WHEN same THEN 'resolved' ELSE 'mismatch' END AS outcome FROM s)
SELECT record_id, url, ts, CASE WHEN good THEN f_id END AS refers_to, outcome, CASE WHEN good THEN f_digest END AS digest, CASE WHEN good THEN 'content-length: ' || f_c || chr(10) || 'content-type: text/html' || chr(10) || 'x-version: ' || v END AS headers
FROM (SELECT *, outcome IN ('resolved', 'unverified') AS good FROM o)"""
