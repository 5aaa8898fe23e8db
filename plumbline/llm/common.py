"""Pieces that several operators share: shared storage, table reading, byte-level text kernels."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP = 16 << 20  # bytes that a writer of an intermediate table holds before it writes them
MAX_CHUNK = 1 << 18  # bytes of text that one numpy pass handles; a longer text makes its own pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local master takes a temporary one (tests); on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_place = threading.local()  # top: where this thread's intermediate tables go while a pipeline's stage is at work


@contextlib.contextmanager
def scratch(path: str):
    """Within it this thread's intermediate tables go below path."""
    before, _place.top = getattr(_place, "top", None), path
    try:
        yield
    finally:
        _place.top = before


def own_dir(spark: SparkSession) -> str:
    """Where this application keeps its tables."""
    return f"{shared_dir(spark)}/plumbline/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that have not been read or written by then are lost."""
    remove(spark, own_dir(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{getattr(_place, 'top', None) or own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Arrow batches of fewer rows and bytes, for texts and sets are long: a Python worker and its JVM hold one at a time."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        digits = "".join(c for c in spark.conf.get(key) if c.isdigit())
        if not digits or not spark.conf.get(key).strip("b B").isdigit() or int(digits) > most or int(digits) <= 0:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Give memory that a task has freed back to the system; Python workers stay alive between tasks."""
    import ctypes
    import gc

    gc.collect()
    try:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trim_driver(spark: SparkSession) -> None:
    """The driver's JVM gives native memory that it has freed (of compiled plans, mostly) back to the system, where it knows how to."""
    from py4j.protocol import Py4JError

    try:
        server = spark._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        server.invoke(spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None)
    except Py4JError:  # another JVM, or an older one
        pass


_forget: list[Callable[[], object]] = []  # how to drop what operators keep in a Python worker between tasks
_at_work = ""


def held_by_worker(forget: Callable[[], object]) -> None:
    """Register how to drop something that an operator keeps in a Python worker for its next task there."""
    _forget.append(forget)


def begin(operator: str) -> None:
    """Called first in a task's Python function: workers outlive tasks, so what another operator left in this one is dropped."""
    global _at_work
    if _at_work not in ("", operator):
        for forget in _forget:
            forget()
        trim()
    _at_work = operator


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and every later use is a plain scan."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """Stands in for a missing doc_id: 62 bits of the text's hash over the range that ids take, so equal texts have equal keys and real ids come first."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2).bitwiseOR(F.lit(1 << 62))


def sized_broadcast(df: DataFrame, rows: int = 1_000_000, size: int = 64 << 20) -> DataFrame:
    """df (a cheap plan, such as a written table of keys) marked for broadcast if it has few rows and bytes, else as it is."""
    wide = {"string": lambda c: F.octet_length(c), "binary": lambda c: F.octet_length(c)}
    of = lambda c, kind: wide[kind](c) if kind in wide else (32 if "string" in kind else 12) * F.size(c) if kind.startswith("array") else F.lit(8)
    each = sum((F.coalesce(of(f"`{c}`", kind), F.lit(0)) + 8 for c, kind in df.dtypes), F.lit(16))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


# --- byte kernels -------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        step = np.uint64(_BASE if kind == "up" else _BASE_INV)
        got = np.full(max(n, MAX_CHUNK + 1), step, dtype=np.uint64)
        got[0] = 1
        np.cumprod(got, out=got)
        if n <= MAX_CHUNK + 1:
            _powers[kind] = got
    return got


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; a null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(offsets: np.ndarray, limit: int = MAX_CHUNK):
    """Row ranges of about limit bytes each; no text is cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of some texts, A-Z lower-cased, and the number of words of each text."""
    base, n_docs = int(offsets[0]), len(offsets) - 1
    buf = raw[base : int(offsets[-1])]
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    inside = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)  # a text may begin in the middle of what looks like one word
    edge[offsets - base] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power("up", len(buf)), _power("down", len(buf))
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[buf].astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    words = mix64((total[ends] - total[starts]) * down[starts])
    counts = np.diff(np.searchsorted(starts, offsets - base))
    return words, counts


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5):
    """Yield (row, sorted distinct 64-bit shingle hashes) for each text; shorter texts give one shingle of all words."""
    mult = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(size)]
    for i, j in chunks(offsets):
        words, counts = word_hashes(raw, offsets[i : j + 1])
        at = np.concatenate(([0], np.cumsum(counts)))
        if len(words) >= size:
            full = len(words) - size + 1
            rolled = np.zeros(full, dtype=np.uint64)
            for k in range(size):
                rolled += words[k : k + full] * mult[k]
            rolled = mix64(rolled)
        for r in range(j - i):
            a, b = at[r], at[r + 1]
            if b - a >= size:
                yield i + r, np.unique(rolled[a : b - size + 1])
            elif b > a:
                part = int(b - a)
                for w in words[a:b].tolist():
                    part = (part * 0xD6E8FEB86659FD93 + w) & 0xFFFFFFFFFFFFFFFF
                yield i + r, mix64(np.array([part], dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
            else:
                yield i + r, np.zeros(0, np.uint64)
