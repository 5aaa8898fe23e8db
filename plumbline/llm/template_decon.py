"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts and benchmark items become templates word by word: a number or number word becomes #n, a unit after a number #u, a capitalised
word within a sentence #p, punctuation after a word goes, the rest is lower-cased. Words with such placeholders are slots; numbers
or names in a row are one slot. Windows of WINDOW template words are hashed and joined. Documents and items take all of theirs,
so any WINDOW words in a row that a document shares with an item are a hit, wherever they stand and whatever other items there are.

A hit proposes an alignment (item at an offset of the document), which is then checked word by word: how many template words
agree, and whether the slots are consistent, that is, whether each value of the item always has the same value in the
document ("Ann has 3 pens, Ann ..." may become "Eva has 7 pens, Eva ...", not "Eva ... Tom ..."). The value of a slot of several words is
its first word. Consistent alignments with COVERAGE of the item's words make a leak.

Items of fewer than WINDOW words are looked for whole, by windows of their own length; those of fewer than SHORTEST words, which stand
in any text, only as a whole document.

The windows of the benchmark are broadcast if they are a million rows and 64 MB at most, otherwise both sides are shuffled;
so are the ids of documents with hits. Hits are pre-aggregated before their shuffle, and an item found in a third of all
documents is a row for each document, spread by doc_id. Only the aligned slices of a document go to the check.

Defined cases: null and empty texts and items never match; item rows with a null id are ignored; leaks() passes over documents
without doc_id, clean() judges them by their text; repeated rows give one result row; items that tie in a document are each a row; very
long texts take part whole; other columns, of whatever name, are ignored by leaks() and kept by clean(); empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import sized_broadcast, table, text_key, written

WINDOW = 8
SHORTEST = 3
COVERAGE = 0.5
# fixed values: units and number words
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|mile|miles|meter|meters|metre|metres|inch|inches|foot|feet|yard|yards|kilometers|kilograms|grams|pound|pounds|ton|tons|liter|liters|litre|litres|ml|gallon|gallons|second|seconds|minute|minutes|hour|hours|day|days|week|weeks|month|months|year|years|dollar|dollars|cent|cents|euro|euros|percent|degrees|mph|hz|watts|volts"
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion dozen"
).split()
SPACES = r"[\x20\x09-\x0D]+"


def template(text: Column) -> Column:
    """Template words of a text, one for each of its words: struct t (templates), w (words), without the words that a slot before them takes in."""
    # each pattern begins with a character of its own, so that the matcher passes over all others in one step
    t = F.regexp_replace(text, r"[0-9][0-9.,:/]*+", "#n")
    t = F.regexp_replace(t, r"#n([\x20\x09-\x0D]*)(?i:" + UNITS + r")(?!\p{L})", "#n$1#u")
    t = F.regexp_replace(t, r" (?<=[^.!?:\x20\x09-\x0D] )\p{Lu}\p{Ll}++(?!\p{L})", " #p")
    t = F.regexp_replace(t, r"[.,;:!?](?<=[\p{L}#][.,;:!?])[.,;:!?]*+(?=[\x20\x09-\x0D]|$)", "")
    return F.split(F.lower(t), SPACES)


def words(text: Column) -> Column:
    return F.split(text, SPACES)


def slotted(tokens: Column) -> Column:
    """Templates with number words as #n."""
    return F.transform(tokens, lambda w: F.when(w.isin(*NUMBERS), F.lit("#n")).otherwise(w))


def first_of_slot(tokens: Column, rows: Column) -> Column:
    """rows without those whose template repeats the slot before it (of numbers or names)."""
    return F.filter(rows, lambda _, i: ~(F.get(tokens, i).isin("#n", "#p") & F.coalesce(F.get(tokens, i) == F.get(tokens, i - 1), F.lit(False))))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def canonical(text: Column) -> Column:
    """The template of a text."""
    return let(slotted(template(text)), lambda t: first_of_slot(t, t))


def with_words(text: Column) -> Column:
    """(t: the template, w: the words it stands for)."""
    return let(slotted(template(text)), lambda t: F.struct(first_of_slot(t, t).alias("t"), first_of_slot(t, words(text)).alias("w")))


def windows(tokens: Column, size: int = WINDOW) -> Column:
    """Hashes of every window. The words' hashes are bound to a lambda variable, so that they are made once for each text."""

    def of(t: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(t) - size)
        return F.when(F.size(t) >= size, F.transform(at, lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(size)])))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def _placed(n: int):
    return lambda h, i: F.struct(F.lit(n).alias("n"), i.alias("i"), h.alias("h"))


def _places(tokens: Column, lengths: list[int]) -> Column:
    """(length, place, hash) of all windows that the items' lengths ask for; length 0 names windows of WINDOW words."""
    none, found = F.array().cast("array<struct<n:int,i:int,h:bigint>>"), []
    for n in lengths:
        size = n or WINDOW
        own = F.coalesce(F.transform(windows(tokens, size), _placed(n)), none)
        found.append(F.when(F.size(tokens) == size, own).otherwise(none) if 0 < n < SHORTEST else own)
    return F.concat(*found) if found else none


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> a row for each leak: doc_id, item_id, item_words, matched, slots, changed."""
    b = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    b = b.select("item_id", with_words(F.col("text")).alias("x")).select("item_id", F.col("x.t").alias("bt"), F.col("x.w").alias("bw")).filter("bt != array('')")
    b = written(b.withColumn("item_words", F.size("bt")), "items")
    kind = F.when(F.col("item_words") >= WINDOW, 0).otherwise(F.col("item_words"))
    lengths = sorted(r[0] for r in b.select(kind).distinct().collect())  # WINDOW rows at most
    keys = None
    for n in lengths:
        own = b.filter(kind == n).select("item_id", F.lit(n).alias("n"), F.posexplode(windows(F.col("bt"), n or WINDOW)).alias("at", "h"))
        keys = own if keys is None else keys.unionByName(own)
    if keys is None:
        keys = b.select("item_id", F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("h")).limit(0)
    keys = written(keys.groupBy("n", "h", "item_id").agg(F.collect_set("at").alias("places")), "item-windows")
    d = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    w = d.select("doc_id", let(canonical(F.col("text")), lambda t: _places(t, lengths)).alias("w"))
    w = w.select("doc_id", F.explode("w").alias("w")).select("doc_id", "w.n", "w.i", "w.h")
    hits = w.join(sized_broadcast(keys), ["n", "h"]).select("doc_id", "item_id", F.explode("places").alias("place"), "i")
    hits = written(hits.select("doc_id", "item_id", (F.col("i") - F.col("place")).alias("shift")).distinct(), "hits")

    found = hits.select("doc_id").distinct()
    texts = d.join(sized_broadcast(written(found, "hit-docs")), "doc_id", "left_semi").distinct()
    texts = written(texts.select("doc_id", with_words(F.col("text")).alias("x")).select("doc_id", F.col("x.t").alias("dt"), F.col("x.w").alias("dw")), "hit-texts")
    # the words that an alignment covers; places before the document's start are empty
    ahead = F.greatest(-F.col("shift"), F.lit(0))
    cut = lambda c: F.slice(c, F.greatest(F.col("shift"), F.lit(0)) + 1, F.greatest(F.col("item_words") - ahead, F.lit(0)))
    sized = hits.join(sized_broadcast(b.select("item_id", "item_words").distinct()), "item_id")
    pair = sized.join(texts, "doc_id").select("doc_id", "item_id", "item_words", ahead.alias("ahead"), cut("dt").alias("dt"), cut("dw").alias("dw"))
    pair = pair.join(sized_broadcast(b), ["item_id", "item_words"])
    spot = F.transform(
        F.sequence(F.lit(0), F.col("item_words") - 1),
        lambda j: F.struct(j.alias("j"), F.get("bt", j).alias("b"), F.get("dt", j - F.col("ahead")).alias("d"), F.get("bw", j).alias("x"), F.get("dw", j - F.col("ahead")).alias("y")),
    )
    pair = pair.select("doc_id", "item_id", "item_words", F.filter(spot, lambda s: s["b"] == s["d"]).alias("same"))
    plain = lambda c: F.regexp_replace(c, r"[.,;:!?]+$", "")
    slot = F.transform(F.filter("same", lambda s: s["b"].contains("#")), lambda s: F.struct(s["b"].alias("b"), plain(s["x"]).alias("x"), plain(s["y"]).alias("y")))
    pair = pair.withColumn("slot", F.array_distinct(slot)).withColumn("values", F.size(F.array_distinct(F.transform("slot", lambda s: F.struct(s["b"], s["x"])))))
    ok = pair.filter(F.size("slot") == F.col("values"))
    ok = ok.select("doc_id", "item_id", "item_words", F.size("slot").alias("slots"), F.size(F.filter("slot", lambda s: s["x"] != s["y"])).alias("changed"), F.explode("same.j").alias("j"))
    per = ok.groupBy("doc_id", "item_id", "item_words", "j").agg(F.max("slots").alias("slots"), F.max("changed").alias("changed"))
    out = per.groupBy("doc_id", "item_id", "item_words").agg(F.count("*").alias("matched"), F.max("slots").alias("slots"), F.max("changed").alias("changed"))
    whole = F.when(F.col("item_words") < WINDOW, F.col("item_words")).otherwise(coverage * F.col("item_words"))
    return out.filter(F.col("matched") >= whole)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item. A row without doc_id goes by a hash of its text, beyond the range of ids."""
    key = F.coalesce(F.col("doc_id").cast("long"), text_key(F.col("text")))
    whole = docs.select(key.alias("key"), F.col("text").alias("body"), F.struct(*docs.columns).alias("row"))
    keyed = whole.select(F.col("key").alias("doc_id"), F.col("body").alias("text"))
    bad = written(leaks(keyed, benchmark).select(F.col("doc_id").alias("key")).distinct(), "leaky")
    return whole.join(sized_broadcast(bad), "key", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _template_sql(text: str) -> tuple[str, str]:
    """(pieces p, template words made of them) of a text in DuckDB's SQL, whose patterns know no lookaround: names are found piece by piece between spaces."""
    ws = r"[\x20\x09-\x0D]"
    t = f"regexp_replace({text}, '[0-9][0-9.,:/]*', '#n', 'g')"
    t = rf"string_split(regexp_replace({t}, '#n({ws}*)(?i:{UNITS})(\P{{L}}|$)', '#n\1#u\2', 'g'), ' ')"
    named = rf"CASE WHEN i > 1 AND regexp_matches(p[i - 1], '[^.!?:\x20\x09-\x0D]$') THEN regexp_replace(p[i], '^\p{{Lu}}\p{{Ll}}+(\P{{L}}|$)', '#p\1') ELSE p[i] END"
    plain = rf"regexp_replace(array_to_string([{named} FOR i IN range(1, len(p) + 1)], ' '), '([\p{{L}}#])[.,;:!?]+({ws}|$)', '\1\2', 'g')"
    numbers = ", ".join(f"'{n}'" for n in NUMBERS)
    return t, f"[CASE WHEN w IN ({numbers}) THEN '#n' ELSE w END FOR w IN regexp_split_to_array(lower({plain}), '{ws}+')]"


def oracle_sql(coverage: float = COVERAGE) -> str:
    """The query in DuckDB's SQL."""
    pieces, words_of = _template_sql("text")
    canon = lambda key, table: f"""(SELECT {key}, [t[i] FOR i IN range(1, len(t) + 1) IF NOT (t[i] IN ('#n', '#p') AND i > 1 AND t[i] = t[i - 1])] AS t, [w[i] FOR i IN range(1, len(t) + 1) IF NOT (t[i] IN ('#n', '#p') AND i > 1 AND t[i] = t[i - 1])] AS w
 FROM (SELECT {key}, {words_of} AS t, regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+') AS w FROM (SELECT DISTINCT {key}, text, {pieces} AS p FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL)))"""  # noqa: E731
    return rf"""WITH b AS (SELECT item_id, t AS bt, w AS bw, len(t) AS n, CASE WHEN len(t) >= {WINDOW} THEN {WINDOW} ELSE len(t) END AS size FROM {canon('item_id', 'benchmark')} WHERE t <> ['']),
d AS (SELECT doc_id, t AS dt, w AS dw FROM {canon('doc_id', 'documents')}), kinds AS (SELECT DISTINCT size FROM b),
k AS (SELECT DISTINCT item_id, size, pos, array_to_string(bt[pos : pos + size - 1], ' ') AS x FROM b, unnest(range(1, n - size + 2)) u(pos)),
w AS (SELECT doc_id, size, pos, array_to_string(dt[pos : pos + size - 1], ' ') AS x FROM d, kinds, unnest(range(1, len(dt) - size + 2)) u(pos) WHERE size >= {SHORTEST} OR len(dt) = size),
hits AS (SELECT DISTINCT doc_id, item_id, w.pos - k.pos AS shift FROM w JOIN k USING (size, x)),
spot AS (SELECT h.doc_id, item_id, n, size, shift, j, bt[j] AS t, regexp_replace(bw[j], '[.,;:!?]+$', '') AS x, regexp_replace(dw[shift + j], '[.,;:!?]+$', '') AS y FROM hits h JOIN b USING (item_id) JOIN d USING (doc_id), unnest(range(1, n + 1)) u(j) WHERE shift + j >= 1 AND bt[j] = dt[shift + j]),
fit AS (SELECT doc_id, item_id, n, shift, count(DISTINCT (t, x, y)) FILTER (contains(t, '#')) AS slots, count(DISTINCT (t, x, y)) FILTER (contains(t, '#') AND x <> y) AS changed, list(DISTINCT j) AS js FROM spot GROUP BY doc_id, item_id, n, shift HAVING count(DISTINCT (t, x, y)) FILTER (contains(t, '#')) = count(DISTINCT (t, x)) FILTER (contains(t, '#')))
SELECT doc_id, item_id, CAST(n AS INT) AS item_words, count(DISTINCT j) AS matched, CAST(max(slots) AS INT) AS slots, CAST(max(changed) AS INT) AS changed FROM fit, unnest(js) u(j) GROUP BY doc_id, item_id, n HAVING count(DISTINCT j) >= CASE WHEN n < {WINDOW} THEN n ELSE {coverage} * n END"""
