"""Token ids in plane-shuffled binary shards.

write_shards() deals whole texts out in ascending doc_id order, tokenises them and writes the shard files of each range of
ids in one task; read_shards() reads documents back from those files.

Shard file (little endian): magic, blocks, document table, index as JSON, length of the index (8 bytes), magic.
A block holds BLOCK_IDS ids (the last one fewer) as unsigned words of `width` bytes. The words of a block are
transposed into planes, one plane for each bit ("bit") or byte ("byte") of a word, and every plane is compressed by
zstandard on its own. The index stores offset and length of each plane of each block, so a reader seeks to what it needs.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first; rows that repeat a doc_id are each
written, in the order of a hash of their text; very long texts are encoded one at a time; an empty table gives no shard and no
rows; other columns, of whatever name, are ignored.
Lost executors: a shard's file has a name of its own attempt, and the manifest, which Spark commits, names the files of the
attempts that count; what a lost attempt leaves is never read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import begin, fresh_path, held_by_worker, trim, written

MAGIC = b"PLPLANE1"
BLOCK_IDS = 1 << 16
MEMO_UNITS = 100_000  # both only trade memory of a Python worker against its time; the ids are the same
ENCODE_BYTES = 2 << 20  # of text that are encoded at once, or one text
SHARD_BYTES = 32 << 20


# --- planes ---------------------------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, width: int, plane: str) -> list[bytes]:
    """Transpose the words of a block: plane k holds bit k (or byte k) of every word."""
    raw = np.ascontiguousarray(ids.astype(f"<u{width}")).view(np.uint8).reshape(len(ids), width)
    if plane == "byte":
        return [raw[:, k].tobytes() for k in range(width)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def from_planes(planes: list[bytes], n: int, width: int, plane: str) -> np.ndarray:
    if plane == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(f"<u{width}").reshape(-1)


def pack_shard(doc_ids: list, lengths: list[int], payload: bytes, width: int, plane: str = "byte", level: int = 3) -> bytes:
    """The bytes of one shard file."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    ids = np.frombuffer(payload, dtype=f"<u{width}")
    parts, index, at = [MAGIC], [], len(MAGIC)
    for start in range(0, len(ids), BLOCK_IDS):
        block, places = ids[start : start + BLOCK_IDS], []
        for p in to_planes(block, width, plane):
            packed = press.compress(p)
            parts.append(packed)
            places.append([at, len(packed)])
            at += len(packed)
        index.append({"start": start, "n": len(block), "planes": places})
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    docs = np.array([d or 0 for d in doc_ids], dtype="<i8")
    table = press.compress(known.tobytes() + docs.tobytes() + np.array(lengths, dtype="<i8").tobytes())
    parts.append(table)
    foot = json.dumps({"width": width, "plane": plane, "n_docs": len(doc_ids), "n_ids": len(ids), "docs": [at, len(table)], "blocks": index}).encode()
    return b"".join([*parts, foot, len(foot).to_bytes(8, "little"), MAGIC])


class Shard:
    """Random access to a shard through any seekable file object."""

    def __init__(self, source):
        import zstandard

        self.source, self.press = source, zstandard.ZstdDecompressor()
        end = source.seek(0, os.SEEK_END)
        tail = self._at(end - 16, 16)
        if tail[8:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a plane-shuffled shard")
        n = int.from_bytes(tail[:8], "little")
        self.index = json.loads(self._at(end - 16 - n, n))
        self.width, self.plane, n_docs = self.index["width"], self.index["plane"], self.index["n_docs"]
        table = self.press.decompress(self._at(*self.index["docs"]))
        known = np.frombuffer(table, np.uint8, n_docs)
        docs = np.frombuffer(table, "<i8", n_docs, n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(docs, known, strict=True)]
        self.lengths = np.frombuffer(table, "<i8", n_docs, 9 * n_docs)

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        b = self.index["blocks"][k]
        return from_planes([self.press.decompress(self._at(*p)) for p in b["planes"]], b["n"], self.width, self.plane)

    def documents(self):
        """Yield (doc_id, start in the shard, ids); one block is held besides the document at hand."""
        held, k, start = np.zeros(0, f"<u{self.width}"), 0, 0
        for doc, n in zip(self.doc_ids, self.lengths, strict=True):
            while len(held) < n:
                more = [held]
                while sum(map(len, more)) < n:
                    more.append(self.block(k))
                    k += 1
                held = np.concatenate(more)
            yield doc, start, held[:n]
            held, start = held[n:], start + int(n)


# --- tokenising -----------------------------------------------------------------------------------------------------

LEARN = 200  # units in one text for the library
CALL = 20  # such texts in one call
LONGEST = 64  # bytes of a unit that is kept


class MemoEncoder:
    """The ids that tokenizers gives for whole texts, with repeated units looked up.

    The byte-level pre-tokeniser ends a piece before a space that a visible character follows, so the units between such
    spaces can be encoded by themselves. A batch's units are numbered by a hash table in Arrow that begins with the kept ones, the library encodes
    each distinct one that is not kept, and the texts' ids are taken by those numbers. Texts with runs of spaces, or with a space before other
    white space or at their end, are encoded whole.

    The memo is two Arrow arrays, units and their ids, of at most `units` rows and a batch's (about 40 bytes each, LONGEST bounds them). When there
    are more, the half that was met most often stays, and what was counted counts half from then on.
    """

    def __init__(self, path: str, end_id: int, units: int = MEMO_UNITS):
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.units = units
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # a special token's string within a text is ordinary text
        self.width = 2 if max(self.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.end, self.known, self.ids, self.met = end_id, pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        pre = self.tok.pre_tokenizer
        self.split = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.tok.normalizer is None
        vocab = self.tok.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # a byte-level token has one character for each byte
        self.n_bytes[list(vocab.values())] = [len(t) for t in vocab]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units):
        """Ids of units that follow a space, an Arrow array. Many are encoded as one text, whose ids are cut before the spaces."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(units):
            return pa.array([], pa.large_binary())
        at = np.append(np.arange(0, len(units), LEARN), len(units))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), units), pa.scalar(" ", pa.large_string()))
        raw = []
        for k in range(0, len(texts), CALL):
            raw += self._ids([" " + t for t in texts.slice(k, CALL).to_pylist()])
        flat = b"".join(raw)
        past = np.cumsum(self.n_bytes[np.frombuffer(flat, self.kind)])
        ends = np.cumsum(pc.binary_length(units).to_numpy().astype(np.int64) + 1)
        return _binary(flat, (np.searchsorted(past, ends) + 1) * self.width)

    def _keep(self, units, ids, met: np.ndarray) -> None:
        """The memo of the next batch: units, their ids, how often they were met."""
        import pyarrow as pa
        import pyarrow.compute as pc

        kept = np.flatnonzero(pc.less_equal(pc.binary_length(units), LONGEST).to_numpy(zero_copy_only=False))
        half = self.units // 2
        if len(kept) > self.units:
            kept = np.sort(kept[np.argpartition(met[kept], -half)[-half:]]) if half else kept[:0]
            met = met >> 1
        if len(kept) < len(units):
            units, ids, met = units.take(pa.array(kept)), ids.take(pa.array(kept)), met[kept]
        self.known, self.ids, self.met = units, ids, met

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Arrow strings (null: empty) -> (ids of all texts, each with the end id after it, end of each text's ids)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "").cast(pa.large_string())
        parts = pc.split_pattern(texts, " ")
        n_known = len(self.known)
        codes = pa.concat_arrays([self.known, parts.flatten()]).dictionary_encode()
        units, code = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)[n_known:]
        count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(count) - count
        # a text without units that are empty or begin with white space (but for its first) is taken apart
        inner = np.ones(len(code), dtype=bool)
        inner[first] = False
        lead = pc.utf8_slice_codeunits(units.slice(n_known), 0, 1)
        odd = pc.or_(pc.equal(lead, ""), pc.utf8_is_space(lead)).to_numpy(zero_copy_only=False)
        whole = np.full(len(count), not self.split)
        hits = np.flatnonzero(inner & np.concatenate((np.zeros(n_known, bool), odd))[code]) if odd.any() else np.zeros(0, np.int64)
        whole[np.searchsorted(first, hits, side="right") - 1] = True
        inner &= ~np.repeat(whole, count)
        met = np.bincount(code[inner], minlength=len(units))
        new = n_known + np.flatnonzero(met[n_known:])
        n_inner = n_known + len(new)
        place = np.full(len(units), -1, dtype=np.int64)
        place[:n_known] = np.arange(n_known)
        place[new] = np.arange(n_known, n_inner)
        learnt = units.take(pa.array(new))
        ids = pa.concat_arrays([self.ids, self._learn(learnt)])
        heads, rest = np.flatnonzero(~whole), np.flatnonzero(whole)
        head, where = np.unique(code[first[heads]], return_inverse=True)
        more = [np.array([self.end], self.kind).tobytes(), *self._ids(units.take(pa.array(head)).to_pylist()), *self._ids(texts.take(pa.array(rest)).to_pylist())]
        # every text as rows of ids: its head, its units, the end; or whole, the end
        row = np.where(inner, place[code], -1)
        row[first[heads]] = n_inner + 1 + where
        row[first[rest]] = n_inner + 1 + len(head) + np.arange(len(rest))
        row = np.insert(row, first + count, n_inner)
        last = np.cumsum(count + 1) - 1
        kept = row >= 0
        last, row = np.cumsum(kept)[last], row[kept]
        out = pa.concat_arrays([ids, pa.array(more, pa.large_binary())]).take(pa.array(row))
        self._keep(pa.concat_arrays([self.known, learnt]), ids, np.concatenate((self.met + met[:n_known], met[new])))
        _, ends, data = out.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(row) + 1] // self.width
        return np.frombuffer(data, self.kind, ends[-1]), ends[last]


def _binary(data: bytes, ends: np.ndarray):
    """An Arrow array of the pieces of data that end there."""
    import pyarrow as pa

    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(data)])


_encoders: dict[tuple[str, int, int], MemoEncoder] = {}
held_by_worker(_encoders.clear)


def _encoder(tokenizer: str, end_id: int, units: int = MEMO_UNITS) -> MemoEncoder:
    """One encoder for each Python worker, so that its memo serves the worker's later tasks of this operator; other operators' tasks drop it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (tokenizer, end_id, units) not in _encoders:
        _encoders.clear()
        _encoders[tokenizer, end_id, units] = MemoEncoder(tokenizer, end_id, units)
    return _encoders[tokenizer, end_id, units]


# --- shards ---------------------------------------------------------------------------------------------------------


def _store(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, tokenizer: str, uri: str, end_id: int = 2, plane: str = "byte", shards: int | None = None, memo: int = MEMO_UNITS) -> DataFrame:
    """Write the ids of docs(doc_id, text) in ascending doc_id order under uri. Returns the manifest: shard, path, n_docs, n_ids, start.

    The range partitioning samples the keys, so the ranges are even without any count; rows that agree in doc_id and text may lie in
    several ranges. A partition with more than SHARD_BYTES of ids becomes several files. The manifest is kept under uri too and names the files
    that count: a task that runs again writes files of its own, so no store needs an atomic rename.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        begin("token planes")
        part, seq, enc = TaskContext.get().partitionId(), 0, _encoder(tokenizer, end_id, memo)
        store, root = _store(uri)
        store.create_dir(root, recursive=True)
        held, docs_, lengths, size = [], [], [], 0

        def flush():
            nonlocal seq, held, docs_, lengths, size
            name = f"shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.planes"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(pack_shard(docs_, lengths, b"".join(held), enc.width, plane))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "name": [f"{uri}/{name}"], "n_docs": [len(docs_)], "n_ids": [sum(lengths)]})
            seq, held, docs_, lengths, size = seq + 1, [], [], [], 0
            return row

        for batch in batches:
            ends = np.cumsum(pc_lengths(batch.column(1)))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENCODE_BYTES, side="right")))
                few = batch.slice(at, to - at)
                at = to
                ids, stop = enc.encode(few.column(1))
                names, done = few.column(0).to_pylist(), 0
                while done < len(names):  # as many documents as the shard takes
                    past = int(stop[done - 1]) if done else 0
                    k = min(len(names), done + 1 + int(np.searchsorted(stop[done:], past + (SHARD_BYTES - size) // enc.width)))
                    held.append(ids[past : stop[k - 1]].tobytes())
                    docs_ += names[done:k]
                    lengths += np.diff(stop[done:k], prepend=past).tolist()
                    size, done = size + len(held[-1]), k
                    if size >= SHARD_BYTES:
                        yield flush()
        if docs_:
            yield flush()
        trim()

    # rows of the same doc_id differ in text, which is part of the order, or are the same
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = dealt.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange(n, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    made = written(dealt.mapInArrow(run, "part int, seq int, name string, n_docs long, n_ids long"), "shards")
    per = made.groupBy("part").agg(F.count("*").alias("files"), F.sum("n_ids").alias("ids"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    per = per.select("part", offset("files").alias("files"), offset("ids").alias("ids"))
    own = W.partitionBy("part").orderBy("seq")
    earlier = F.coalesce(F.sum("n_ids").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    manifest = made.withColumn("earlier", earlier).join(per, "part")
    manifest = manifest.select((F.col("files") + F.col("seq")).cast("int").alias("shard"), F.col("name").alias("path"), "n_docs", "n_ids", (F.col("ids") + F.col("earlier")).alias("start"))
    manifest.write.mode("overwrite").parquet(f"{uri}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{uri}/manifest")


def pc_lengths(texts) -> np.ndarray:
    """Bytes of each Arrow string; a null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def run(batches):
        import pandas as pd

        begin("token planes")
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"], strict=True):
                store, name = _store(path)
                with store.open_input_file(name) as source:
                    out = [(doc, int(start) + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, at, ids in Shard(source).documents()]
                cols = list(zip(*out, strict=True))
                yield pd.DataFrame({"doc_id": pd.array(cols[0], dtype="Int64"), "start": cols[1], "n_tokens": cols[2], "ids_crc32": cols[3]})

    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("path", "start").repartition(n).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_planes(docs: DataFrame, tokenizer: str, uri: str | None = None, end_id: int = 2, plane: str = "byte", memo: int = MEMO_UNITS) -> tuple[DataFrame, DataFrame]:
    """Encode, write and read back. Returns (documents as read back, manifest)."""
    uri = uri or fresh_path(docs.sparkSession, "planes")
    manifest = write_shards(docs, tokenizer, uri, end_id, plane, memo=memo)
    return read_shards(manifest), manifest


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plumbline.llm.common import table

    return encode_to_planes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))[0]
