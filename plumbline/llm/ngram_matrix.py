"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns are 5-word shingles (64-bit hashes of words with A-Z lower-cased), and
an entry of its product with its transpose is the overlap of two documents. Two documents link if
100 * overlap >= 75 * union, that is, overlap >= 3/7 * (|x| + |y|).

1. Column blocks. Row batches are cut by ranges of a 32-bit prefix of the hash into cells, sorted, delta-coded and
   compressed (about 4 bytes an entry); a batch sends each column once. A column block finds the columns of one document
   only. A document with more than a quarter of such columns can't reach the bound with any other and leaves.
2. The remaining rows, one for each distinct set, are cut into cells again to get exact column counts. By the size bound, two
   rows that link share one of the |x| - ceil(3/4 |x|) + 1 rarest columns of each; these entries are the postings.
   Columns that many documents hold sort last, so a passage of thousands of documents is never a posting of
   documents that are mostly their own.
3. The product is accumulated block by block for the pairs that the postings name. First each row is multiplied by one
   leader of its postings, so that a group of copies costs one pair a row; the links that pass the
   bound are contracted to components. Then, in columns that still hold several components, every pair of rows from
   different components is multiplied that the sizes allow. So no link between components is lost, and pairs within a
   component are not expanded.

No step gathers the rows of a column or of a group in one task: minima and counts are partially aggregated, joins on a
column are ordinary joins (that Spark splits when skewed), and a leader's rows are salted by count.

Defined cases: null and empty texts have no shingles, link with nothing and are their own component; texts below five words have
one shingle; rows that repeat a doc_id are each returned, as one vertex that has the links of all of them; a row without
doc_id has component_id null in classes() and is judged by its text in one_of_each(); of links that tie for a class the least doc_id names
it; very long texts take part whole, each a row batch of its own; other columns, of whatever name, are ignored by classes() and kept by
one_of_each(); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import begin, mix64, shingle_sets, sized_broadcast, table, text_buffers, text_key, trim, written
from plumbline.llm.components import components

SHINGLE = 5
NUM, DEN = 3, 4  # the least Jaccard similarity
BATCH_BYTES = 4 << 20  # of text in a row batch
BATCH_ROWS = 1 << 15
BLOCK_ENTRIES = 1 << 20  # of a column block
SALT = 256  # rows of a leader in one group
MANY = 0xFFFF


# --- row batches ----------------------------------------------------------------------------------------------------


def _row_batches(batches):
    """Gather and cut Arrow batches (doc_id, text) to BATCH_BYTES of text and BATCH_ROWS rows; yields (doc ids, list of sets)."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH_BYTES:
            yield from _cut(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield from _cut(pa.Table.from_batches(held))


def _cut(rows):
    ids, raw, offsets = rows.column(0), *text_buffers(rows.column(1).combine_chunks())
    i, n = 0, len(ids)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + 2 * BATCH_BYTES, side="right")) - 1
        j = min(n, i + BATCH_ROWS, max(j, i + 1))
        yield ids.slice(i, j - i).combine_chunks(), [s for _, s in shingle_sets(raw, offsets[i : j + 1], SHINGLE)]
        i = j


def _pack(*arrays: np.ndarray) -> bytes:
    """Byte planes of integer arrays of one length, compressed."""
    import zstandard

    planes = [a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += size * n
    return out


def _cells(blocks: int):
    """Row batch -> a row for each column block: columns of the batch and, where a single row has one, which.

    A batch is known by its partition and its place there: equal batches stay apart, and a task that runs again over the
    same rows gives the same names."""

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        begin("n-gram matrix")
        for name, (ids, sets) in enumerate(_row_batches(batches), TaskContext.get().partitionId() << 32):
            sizes = np.array([len(s) for s in sets], dtype=np.int32)
            keys = np.concatenate(sets)
            keys >>= np.uint64(32)
            keys <<= np.uint64(16)
            keys |= np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)
            keys.sort()
            column = (keys >> np.uint64(16)).astype(np.uint32)
            first = np.concatenate(([True], column[1:] != column[:-1]))[: len(column)]
            single = first & np.concatenate((first[1:], [True]))[: len(column)]
            row = np.where(single, keys & np.uint64(0xFFFF), MANY).astype(np.uint16)[first]
            column = column[first]
            cuts = np.searchsorted(column, (((np.arange(blocks + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(blocks)).clip(max=0xFFFFFFFF)).astype(np.uint32))
            cuts[-1] = len(column)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            docs = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            names = _pack(known.astype(np.uint8), np.diff(docs, prepend=0), sizes)
            data = [_pack(np.diff(column[i:j], prepend=np.uint32(0)), row[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pd.DataFrame({"batch": name, "block": np.arange(blocks), "n": np.diff(cuts), "rows": len(sets), "names": [names if b == 0 else b"" for b in range(blocks)], "data": data})
        trim()

    return run


def _own_columns(pdf):
    """Column block -> for each batch, how many columns of each row no other row of any batch has."""
    import pandas as pd

    cells = [_unpack(d, n, "u4", "u2") for d, n in zip(pdf["data"], pdf["n"], strict=True)]
    column = np.concatenate([np.cumsum(c, dtype=np.uint32) for c, _ in cells]).astype(np.uint64)
    order = np.sort((column << np.uint64(32)) | np.arange(len(column), dtype=np.uint64))
    column, entry = order >> np.uint64(32), order & np.uint64(0xFFFFFFFF)
    first = np.concatenate(([True], column[1:] != column[:-1]))[: len(column)]
    alone = entry[first & np.concatenate((first[1:], [True]))[: len(column)]]
    flag = np.zeros(len(column), dtype=bool)
    flag[alone] = True
    out, at = [], 0
    for (_, row), n_rows in zip(cells, pdf["rows"], strict=True):
        mine = row[flag[at : at + len(row)]]
        at += len(row)
        out.append(_pack(np.bincount(mine[mine != MANY], minlength=n_rows).astype(np.int32)))
    found = pd.DataFrame({"batch": pdf["batch"], "rows": pdf["rows"], "names": pdf["names"], "own": out})
    del cells, column, order, entry, first, alone, flag
    trim()
    return found


def _sizes_of_batch(pdf):
    """Batch -> doc_id, n, own of its rows."""
    import pandas as pd

    n = int(pdf["rows"].iloc[0])
    own = sum(_unpack(d, n, "i4")[0] for d in pdf["own"])
    known, step, size = _unpack(next(x for x in pdf["names"] if len(x)), n, "u1", "i8", "i4")
    docs = pd.array(np.cumsum(step), dtype="Int64")
    docs[known == 0] = pd.NA
    return pd.DataFrame({"doc_id": docs, "n": size, "own": own})


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), own (columns that it shares with no other row) of every row of docs."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(8, int(total / 5.5 / BLOCK_ENTRIES) + 1)  # words have about 5.5 bytes; only the size of blocks hangs on it
    cells = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_arrow(_cells(blocks), "batch long, block int, n int, rows int, names binary, data binary"), "batch long, block int, n int, rows int, names binary, data binary")
    own = cells.groupBy("block").applyInPandas(_own_columns, "batch long, rows int, names binary, own binary")
    return written(own.groupBy("batch").applyInPandas(_sizes_of_batch, "doc_id long, n int, own int"), "set-sizes")


def _arrow(run, schema: str):
    """A function that yields pandas frames, as one for mapInArrow."""
    kinds = [c.split() for c in schema.split(", ")]

    def wrapped(batches):
        import pyarrow as pa

        of = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
        target = pa.schema([(n, of[k]) for n, k in kinds])
        for pdf in run(batches):
            yield from pa.Table.from_pandas(pdf, schema=target, preserve_index=False).to_batches()

    return wrapped


# --- rows that can link ---------------------------------------------------------------------------------------------


def _set_rows(batches):
    """(doc_id, text) -> doc_id, rid, n, data: the set's hashes and its 128-bit name."""
    import pandas as pd

    begin("n-gram matrix")
    for ids, sets in _row_batches(batches):
        names = []
        for s in sets:
            a, b = mix64(s + np.uint64(0x632BE59BD9B4E019)), mix64(s ^ np.uint64(0xA0761D6478BD642F))
            names.append(f"{int(a.sum(dtype=np.uint64)):016x}{int(b.sum(dtype=np.uint64)):016x}")
        for k in range(0, len(sets), 500):
            few = sets[k : k + 500]
            yield pd.DataFrame({"doc_id": ids.slice(k, 500).to_pandas().astype("Int64"), "rid": names[k : k + 500], "n": [len(s) for s in few], "data": [s.tobytes() for s in few]})
    trim()


def _gather(batches):
    """(rid, n, data) -> numbered batches of rows, of BATCH_BYTES / 2 unless a single row is larger."""
    import pandas as pd
    from pyspark import TaskContext

    held, size, at = [], 0, TaskContext.get().partitionId() << 40

    def flush():
        nonlocal at
        first, at = at, at + len(held)
        return pd.DataFrame({"batch": [first], "rows": [list(range(first, at))], "rids": [[r for r, _, _ in held]], "sizes": [[int(n) for _, n, _ in held]], "data": [b"".join(d for _, _, d in held)]})

    for pdf in batches:
        for row in zip(pdf["rid"], pdf["n"], pdf["data"], strict=True):
            if held and size + len(row[2]) > BATCH_BYTES // 2:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[2])
    if held:
        yield flush()
    held = []
    trim()


def _count_cells(blocks: int):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            for batch, data in zip(pdf["batch"], pdf["data"], strict=True):
                column, count = np.unique(np.frombuffer(data, np.uint64), return_counts=True)
                cuts = np.searchsorted(column >> np.uint64(32), (np.arange(blocks + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(blocks))
                yield pd.DataFrame({"batch": batch, "block": np.arange(blocks), "columns": [column[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], "counts": [count[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})
        trim()

    return run


def _add_counts(pdf):
    import pandas as pd

    cells = [np.frombuffer(d, np.uint64) for d in pdf["columns"]]
    column, at = np.unique(np.concatenate(cells), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([np.frombuffer(c, np.uint32) for c in pdf["counts"]]), minlength=len(column)).astype(np.uint32)[at]
    cut = np.cumsum([0, *map(len, cells)])
    out = pd.DataFrame({"batch": pdf["batch"], "block": pdf["block"], "counts": [total[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]})
    del cells, column, at, total
    trim()
    return out


def _postings(key, rows, counts):
    """Batch of rows and the counts of its columns -> the shared columns among the rarest of each row.

    u is how many columns are the row's own; near marks the columns that are rare enough to be shared with a row at least as large.
    """
    import pandas as pd

    data = np.frombuffer(rows["data"].iloc[0], np.uint64)
    column, at = np.unique(data, return_inverse=True)
    total = np.concatenate([np.frombuffer(c, np.uint32) for c in counts.sort_values("block")["counts"]])[at]
    cut = np.cumsum([0, *rows["sizes"].iloc[0]])
    names, sizes, own, hashes, near = [], [], [], [], []
    for row, a, b in zip(rows["rows"].iloc[0], cut[:-1], cut[1:], strict=True):
        n = int(b - a)
        order = np.lexsort((data[a:b], total[a:b]))[: n - -(-NUM * n // DEN) + 1]
        shared = total[a:b][order] > 1
        near.append(np.arange(len(order))[shared] <= n - -(-2 * NUM * n // (NUM + DEN)))
        order = order[shared]
        hashes.append(data[a:b][order])
        names += [row] * len(order)
        sizes += [n] * len(order)
        own += [int(np.count_nonzero(total[a:b] == 1))] * len(order)
    return pd.DataFrame({"h": np.concatenate(hashes).view(np.int64), "row": np.array(names, dtype=np.int64), "n": np.array(sizes, dtype=np.int32), "u": np.array(own, dtype=np.int32), "near": np.concatenate(near)})


def _unbatched(batches):
    import pandas as pd

    for pdf in batches:
        for names, sizes_, data in zip(pdf["rows"], pdf["sizes"], pdf["data"], strict=True):
            cut = np.cumsum([0, *sizes_]) * 8
            yield pd.DataFrame({"row": list(names), "data": [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]})
    trim()


# --- blocks of the product ------------------------------------------------------------------------------------------


def _multiply(batches):
    """Rows sorted by leader, salt and kind (0: the leader, 1: a row to multiply it with) -> links (u, v)."""
    import pandas as pd

    lead, of = None, None
    for pdf in batches:
        u, v = [], []
        for b, salt, kind, a, data in zip(pdf["b"], pdf["salt"], pdf["kind"], pdf["a"], pdf["data"], strict=True):
            x = np.frombuffer(data, np.uint64)
            if kind == 0:
                lead, of = x, (b, salt)
                continue
            assert of == (b, salt)
            at = np.searchsorted(lead, x)
            both = int(np.count_nonzero(lead[np.minimum(at, len(lead) - 1)] == x))
            if DEN * both >= NUM * (len(x) + len(lead) - both):
                u.append(a)
                v.append(b)
        yield pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64)})
    trim()


def multiply(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs(a, b), rows(row, data) -> links (u, v) of those that pass the bound."""
    counts = pairs.groupBy("b").agg(F.count("*").alias("c"))
    salts = F.ceil(F.col("c") / SALT).cast("int")
    dealt = pairs.join(counts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), salts).cast("int"))
    mine = dealt.join(rows.select(F.col("row").alias("a"), "data"), "a").select("b", "salt", F.lit(1).alias("kind"), "a", "data")
    lead = counts.select("b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).join(rows.select(F.col("row").alias("b"), "data"), "b")
    lead = lead.select("b", "salt", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("a"), "data")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = mine.union(lead).repartition(n, "b", "salt").sortWithinPartitions("b", "salt", "kind")
    return written(together.mapInPandas(_multiply, "u long, v long"), "links")


def _may_link(x: str, y: str) -> F.Column:
    """Of two structs (n, u, near) of one column: can the rows reach the bound, overlap >= 3/7 (n + n'), by their sizes, and
    would this column be among the rarest of the smaller one? A row's own columns are no part of an overlap."""
    least = F.least(F.col(x)["n"] - F.col(x)["u"], F.col(y)["n"] - F.col(y)["u"])
    near = F.when(F.col(x)["n"] < F.col(y)["n"], F.col(x)["near"]).when(F.col(x)["n"] > F.col(y)["n"], F.col(y)["near"]).otherwise(F.col(x)["near"] & F.col(y)["near"])
    return near & (least * (NUM + DEN) >= (F.col(x)["n"] + F.col(y)["n"]) * NUM)


def _size() -> F.Column:
    return F.struct("n", "u", "near")


def _to_leaders(postings: DataFrame) -> DataFrame:
    """Each row with the leader that most of its postings name: (a, b). A column's leader is the row with fewest columns of its
    own, which among edited copies is the one nearest to all others."""
    lead = postings.groupBy("h").agg(F.min(F.struct("u", F.xxhash64("row").alias("r"), "row", _size().alias("y"))).alias("l"), F.count("*").alias("c")).filter("c > 1")
    lead = lead.select("h", F.col("l.row").alias("b"), F.col("l.y").alias("y"))
    named = postings.select("h", "row", _size().alias("x")).join(lead, "h").filter((F.col("row") != F.col("b")) & _may_link("x", "y"))
    named = named.groupBy(F.col("row").alias("a"), "b").agg(F.count("*").alias("c"))
    return named.groupBy("a").agg(F.max(F.struct("c", "b")).alias("x")).select("a", F.col("x.b").alias("b"))


def _between_components(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Every pair (a, b) of rows that share a posting, lie in different components and may link by size."""
    p = postings.join(labels.withColumnRenamed("u", "of"), F.col("row") == F.col("of"), "left").withColumn("label", F.coalesce("label", "row"))
    p = written(p.select("h", "row", _size().alias("x"), "label"), "postings-labelled")
    by = p.groupBy("h", "label").agg(F.count("*").alias("c"))
    mixed = by.groupBy("h").agg(F.count("*").alias("k"), F.max(F.struct("c", "label")).alias("m")).filter("k > 1").select("h", F.col("m.label").alias("major"))
    p = p.join(mixed, "h")
    # one of two components is not the column's largest, so its rows may drive the join
    minor = p.filter("label != major").select("h", F.col("row").alias("a"), "x", F.col("label").alias("la"))
    rest = p.select("h", F.col("row").alias("b"), F.col("x").alias("y"), F.col("label").alias("lb"), (F.col("label") == F.col("major")).alias("is_major"))
    pairs = minor.join(rest, "h").filter((F.col("la") != F.col("lb")) & (F.col("is_major") | (F.col("a") < F.col("b"))) & _may_link("x", "y"))
    return pairs.select("a", "b").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    s = sizes(docs)
    may = s.filter(f"n > 0 and doc_id is not null and {DEN} * (n - own) >= {NUM} * n").select("doc_id").distinct()
    schema = "doc_id long, rid string, n int, data binary"
    sets = written(docs.join(sized_broadcast(written(may, "may-link")), "doc_id").mapInArrow(_arrow(_set_rows, schema), schema), "sets")
    distinct = sets.groupBy("rid").agg(F.first("n").alias("n"), F.first("data").alias("data"))
    batches = written(distinct.mapInPandas(_gather, "batch long, rows array<long>, rids array<string>, sizes array<int>, data binary"), "row-batches")
    named = batches.select(F.explode(F.arrays_zip("rids", "rows")).alias("x")).select("x.rids", "x.rows").toDF("rid", "row")
    members = written(sets.select("doc_id", "rid").join(named, "rid").select("doc_id", "row").distinct(), "members")
    total = batches.agg(F.sum(F.length("data")) / 8).first()[0] or 0
    blocks = max(8, int(total / BLOCK_ENTRIES) + 1)
    cells = batches.select("batch", "data").mapInPandas(_count_cells(blocks), "batch long, block int, columns binary, counts binary")
    counts = cells.groupBy("block").applyInPandas(_add_counts, "batch long, block int, counts binary")
    postings = batches.select("batch", "rows", "sizes", "data").groupBy("batch").cogroup(counts.groupBy("batch")).applyInPandas(_postings, "h long, row long, n int, u int, near boolean")
    postings = written(postings, "postings")
    rows = batches.select("rows", "sizes", "data").mapInPandas(_unbatched, "row long, data binary")

    links = multiply(written(_to_leaders(postings), "to-leaders"), rows)
    twice = members.groupBy("doc_id").agg(F.min("row").alias("u"), F.max("row").alias("v")).filter("u != v").select("doc_id", "u")
    links = links.union(members.join(twice, "doc_id").select("u", F.col("row").alias("v")).filter("u != v"))
    more = multiply(written(_between_components(postings, components(links)), "between"), rows)
    labels = components(links.union(more)) if more.limit(1).count() else components(links)

    of = members.join(labels.withColumnRenamed("u", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    least = of.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = of.join(least, "label").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    of = written(of.filter("component_id != doc_id"), "classes")
    out = s.join(of, "doc_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each class the document whose doc_id names it; rows that repeat its doc_id leave one, the least by text. A row without doc_id goes
    by a hash of its text, beyond the range of ids, and so gives way to a copy that has one."""
    key = F.coalesce(F.col("doc_id").cast("long"), text_key(F.col("text")))
    whole = docs.select(key.alias("key"), F.col("text").alias("body"), F.struct(*docs.columns).alias("row"))
    c = written(classes(whole.select(F.col("key").alias("doc_id"), F.col("body").alias("text"))), "class-rows").withColumnRenamed("doc_id", "key")
    lost = sized_broadcast(written(c.filter("component_id != key").select("key").distinct(), "lost"))
    again = sized_broadcast(written(c.filter("component_id = key").groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "again"))
    single = whole.join(lost, "key", "left_anti").join(again, "key", "left_anti").select("row")
    twice = whole.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.struct("body", F.xxhash64(F.to_json("row")))).alias("row")).select("row")
    return single.unionByName(twice).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
