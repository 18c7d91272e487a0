"""Shared pieces of the training-data operators: column selection, the shared
folder, and numpy kernels over the UTF-8 buffers of Arrow string columns.

The kernels work on whole batches of bytes at once.  A text of n bytes needs
about 60 n bytes of working memory, so batches are cut at ``CHUNK`` bytes on
document borders first; only a single longer text makes a larger piece.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
U = np.uint64
#: Whether an execution deletes its shuffle files at its end.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# ---------------------------------------------------------------- Spark side
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, deleted when the application
    ends.  Only where that setting is unset, as in local tests, a folder in the
    warehouse stands in for it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    for folders in _scratch[-1:]:
        folders.append(path)
    return path


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Shared folders that are made inside go at the end: for what writes its result
    to a folder made before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop_path(spark, path)


def cut(df: DataFrame, name: str = "cut", folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives lost executors.  The shuffles of the write go with it, not only when the
    driver happens to collect its garbage."""
    spark = df.sparkSession
    folder = folder or shared_dir(spark)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(f"{folder}/{name}")
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    trim_driver(spark)
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.cut_folder = folder
    return out


def trim_driver(spark: SparkSession) -> bool:
    """Give free native memory of the driver's JVM back to the system: its hundreds of
    threads keep it in arenas of the C library's.  False where the JVM has no such command."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # by the interface: the server's own class is not open to reflection
        kind = jvm.java.lang.Class.forName
        kinds, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        for i, c in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = kind(c)
        kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` made, once all that reads them is written too."""
    for t in tables:
        drop_path(t.sparkSession, t.cut_folder)


def row_key(doc: str, text: str) -> Column:
    """A hash of a row's doc_id and text, nulls told apart from other values."""
    return F.xxhash64(F.col(doc).isNull(), doc, F.col(text).isNull(), text)


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


# ------------------------------------------------------------- Arrow buffers
def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets from 0; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, never splitting a row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def release_memory() -> None:
    """Give the free memory of Arrow's pool and of the C library back to the system: a
    worker that waits for its next task shares its executor's memory with other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of consecutive runs of ``values``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# ------------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Strings are hashed as polynomials modulo this prime: a string of n bytes collides
#: with another of n bytes for at most n of about 2 ** 61 bases.
PRIME = (1 << 61) - 1
BASE = 0x14B2F3C6D85A9E37
LOW, HIGH, TOP = U((1 << 32) - 1), U(32), U(61)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Sums of bytes times half powers stay below 2 ** 64 for so many bytes.
STRETCH = 1 << 23
_powers: dict[int, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x mod PRIME for x below 2 ** 63."""
    x = (x & U(PRIME)) + (x >> TOP)
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod PRIME, of numbers below PRIME, from products of 32-bit halves."""
    a1, a0, b1, b0 = a >> HIGH, a & LOW, b >> HIGH, b & LOW
    middle, last = a1 * b0 + a0 * b1, a0 * b0
    return _reduced(((a1 * b1) << U(3)) + (middle >> U(29)) + ((middle & U((1 << 29) - 1)) << HIGH) + (last & U(PRIME)) + (last >> TOP))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) mod PRIME, kept and doubled as needed up to a few chunks."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have, size = np.ones(1, U), max(n, CHUNK + (CHUNK >> 2))
        while len(have) < size:
            step = np.full(len(have), pow(base, len(have), PRIME), U)
            have = np.concatenate([have, product(have, step)[: size - len(have)]])
        if len(have) <= 8 * CHUNK:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Two running sums over bytes, of (byte + 1) times the low and the high 32 bits
    of BASE ** place, from which span_hash makes the hash of any span."""
    out = np.zeros((2, len(data) + 1), U)
    code, power = data.astype(U) + U(1), powers(BASE, len(data))
    np.cumsum(code * (power & LOW), out=out[0, 1:])
    np.cumsum(code * (power >> HIGH), out=out[1, 1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of the spans [start, end), some tens of thousands at a time,
    so that what they need in between stays in the cache."""
    start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
    back = powers(pow(BASE, -1, PRIME), prefix.shape[1])
    out = np.empty(len(start), U)
    for i in range(0, len(start), 1 << 15):
        out[i : i + (1 << 15)] = _span_hash(prefix, start[i : i + (1 << 15)], end[i : i + (1 << 15)], back)
    return out


def _span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, back: np.ndarray) -> np.ndarray:
    low, high = prefix
    total, at = np.zeros(len(start), U), start
    while True:
        to = np.minimum(at + STRETCH, end)
        a, b = low[to] - low[at], high[to] - high[at]
        total = _reduced(total + (a & U(PRIME)) + (a >> TOP) + _reduced((b >> U(29)) + ((b & U((1 << 29) - 1)) << HIGH)))
        at = to
        if (at == end).all():
            break
    return mix(product(total, back[start]))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word [^\\x20\\x09-\\x0D]+, and each row's first word."""
    n = len(data)
    inside = ~SPACE[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | border[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | border[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every k-word shingle (A-Z lower-cased), and the
    rows' word counts.  A row of 1 to k - 1 words has its whole sequence as one
    shingle; a row without words has none."""
    start, end, first = words(data, offsets)
    counts = np.diff(first)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, U), counts
    h = span_hash(prefix_hash(LOWER[data]), start, end)
    row = np.repeat(np.arange(len(counts)), counts)
    full = max(0, len(h) - k + 1)
    total = np.zeros(full, U)
    for j in range(k):
        total += h[j : j + full] * U((2 * j + 3) * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    keep = row[:full] == row[k - 1 : k - 1 + full]
    rows, found = [row[:full][keep]], [mix(total[keep])]
    for size in range(1, k):
        short = np.flatnonzero(counts == size)
        if len(short):
            total = np.full(len(short), size, U)
            for j in range(size):
                total += h[first[short] + j] * U((2 * j + 3) * 0x2545F4914F6CDD1D & (1 << 64) - 1)
            rows.append(short)
            found.append(mix(total))
    return np.concatenate(rows), np.concatenate(found), counts


def first_seen(node: np.ndarray, seen: set[int], bound: int = 500_000) -> np.ndarray:
    """The rows whose node isn't in ``seen`` or in an earlier row; they are added.
    Beyond ``bound`` nodes all are forgotten: callers take a repeat for a copy."""
    _, first = np.unique(node, return_index=True)
    fresh = np.array([i for i, x in zip(first.tolist(), node[first].tolist()) if x not in seen], np.int64)
    seen.update(node[fresh].tolist())
    if len(seen) > bound:
        seen.clear()
    return np.sort(fresh)


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """A map of ``bits`` bits, a power of two, with a bit for each value of a table
    with one long column."""
    (name,) = values.columns
    place = F.pmod(F.col(name), F.lit(bits))
    words = values.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(`{name}`, {bits}) & 63 as int))")).alias("x")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["x"].to_numpy()
    return out.view(np.uint8)


def in_bitmap(found: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values & U(len(found) * 8 - 1)
    return ((found[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8)) & 1).astype(bool)


#: Bits of the fixed-size filter that spares rows without a partner (8 MB).
FILTER_BITS = 1 << 26


def rows_with_keys(lists: DataFrame, kept: DataFrame, column: str, key: str) -> DataFrame:
    """(``key``, node) of the rows of ``lists`` (node, ``column``: an array of keys)
    whose key is in the table ``kept``, with the latter's other columns.

    A filter of a fixed size spares other keys the way to the join, which adaptive
    execution splits where a key is very common."""
    sent = lists.sparkSession.sparkContext.broadcast(bitmap(kept.select(key), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1)
            flat = keys.flatten().to_numpy()
            node = np.repeat(batch.column(0).to_numpy(), keys.value_lengths().to_numpy())
            keep = in_bitmap(sent.value, flat.view(U))
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), pa.array(node[keep])], names=[key, "node"])

    return lists.select("node", column).mapInArrow(run, f"{key} long, node long").join(kept, key)


def distinct_sets(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each of n rows, one after the other, and their counts."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[keep], np.bincount(row[keep], minlength=n)
