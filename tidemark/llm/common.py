"""Shared plumbing of the corpus operators: the shared folder, byte-level text
access from Arrow batches, and vectorised 64-bit hashing of byte ranges."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a Python worker; a longer document forms a chunk alone.
CHUNK_BYTES = 1 << 17


# ---------------------------------------------------------------- shared folder

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else (one local JVM, as in tests) an own one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = getattr(spark.sparkContext, "_own_shared_dir", None)
        if at is None:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is unset; set it to a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
            spark.sparkContext._own_shared_dir = at
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """The path goes when the driver's JVM ends."""
    fs, p = _file(spark, path)
    fs.deleteOnExit(p)


#: Arrow batches of at most so many rows and bytes, so that workers and the JVM's buffers hold little text at once.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch sizes where they are larger or unbounded. They are read when a result is
    planned, that is by the caller's write, so they stay lowered for the session; results don't depend on them."""
    for k, v in SMALL_BATCHES.items():
        now = spark.conf.get(k)
        if not (now.isdigit() and 0 < int(now) <= v):
            spark.conf.set(k, str(v))


@contextlib.contextmanager
def writing(spark: SparkSession):
    """Settings of intermediate writes: their shuffle files go when each ends (nothing reads them
    again), and Arrow batches are small."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | {k: str(v) for k, v in SMALL_BATCHES.items()}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes a Parquet table into the shared folder and reads it back."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with writing(spark):
        df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over all rows (one JVM scan, one row to the driver)."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def pow2_at_least(n: float, low: int, high: int) -> int:
    """The exponent of the power of two >= n, within [low, high]."""
    return int(min(high, max(low, int(np.ceil(np.log2(max(1.0, n)))))))


# ---------------------------------------------------------------- bytes of a batch

def _text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if "binary" in str(col.type) else "")
    kind = np.int64 if wide else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES):
    """Yields (row_from, row_to, bytes, offsets) over runs of whole rows of at most ``limit`` bytes."""
    raw, offs = _text_buffer(batch.column(text))
    n, at = len(offs) - 1, 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


# ---------------------------------------------------------------- tokens and hashes

# The ASCII blanks [\x20\x09-\x0D].
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 3
_POWERS: dict[str, np.ndarray] = {}


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mix = _splitmix
_TABLES = [_splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * s)) for s in range(2)]
#: A random word for each byte value.
BYTE_WORDS = _TABLES[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n; kept while not much larger than a chunk."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        m = max(n, CHUNK_BYTES + 16)
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for b in (_BASE, inverse):
            x = np.full(m, b & ((1 << 64) - 1), np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        if m > 4 * CHUNK_BYTES:
            return made[0], made[1]
        _POWERS["up"], _POWERS["down"] = made
    return _POWERS["up"], _POWERS["down"]


class RangeHash:
    """Hashes of byte ranges of one buffer, each in constant time.

    The hash of a range is the polynomial sum of a random word per byte value,
    taken from prefix sums modulo 2**64 and then mixed with the length, so equal
    bytes give equal hashes wherever they stand.
    """

    def __init__(self, data: np.ndarray, table: int = 0):
        self.up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[table][data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        return _splitmix(x + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class GramHash:
    """Hashes of byte ranges of at least ``k`` bytes over truncated hashes of their k-grams, which (unlike
    sums over the bytes) no regular pattern of bytes cancels."""

    def __init__(self, ranges: RangeHash, k: int = 8):
        self.k, self.down = k, ranges.down
        n = max(0, len(ranges.sums) - k)
        x = (ranges.sums[k:] - ranges.sums[: n]) * ranges.down[:n] >> np.uint64(32)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * ranges.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end - self.k + 1] - self.sums[start]) * self.down[start]
        return _splitmix(x + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def word_bounds(data: np.ndarray, offs: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes not in ``blank``) of every row, and the index of
    each row's first word (one more at the end)."""
    ink = ~blank[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    cut = offs[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = ink[cut]
    last = np.zeros(len(data) + 1, bool)
    last[1:] = ink
    last[1:-1] &= ~ink[1:]
    inner = offs[1:-1]
    inner = inner[inner > 0]
    last[inner] = ink[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offs)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def ints(col: pa.Array) -> np.ndarray:
    """A long column as an array; nulls become the smallest long (callers that care look at the mask)."""
    return col.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def text_key(text) -> F.Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text if isinstance(text, F.Column) else F.col(text), F.lit("")))


def as_docs(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads, whatever else (or however the rest is named) the table holds."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*cols, *more)
