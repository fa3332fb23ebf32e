"""What the operators share: the written-table cut of lineage, and byte-level text helpers over Arrow buffers.

The text helpers work on the raw UTF-8 buffers of an Arrow batch with NumPy, so no Python object is made for a
document or a word. Nothing here knows Spark plans; Spark partitions and shuffles the rows around them.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 1 << 20
WRITTEN: list[str] = []  # paths of the tables of this driver


def return_memory() -> None:
    """Make this Python worker give freed arrays and Arrow buffers of 256 KB or more back to the system at once.

    Workers live as long as their executor, so what one stage keeps adds to the next. Needs glibc (parameter -3 is its
    mapping threshold); elsewhere nothing changes."""
    if hasattr(ctypes.CDLL(None), "mallopt"):
        ctypes.CDLL(None).mallopt(-3, 1 << 18)
        pa.set_memory_pool(pa.system_memory_pool())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode (tests) a temporary one where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="stridelake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete the tables that this driver has written so far, and give their number. For when results have been taken:
    DataFrames that still read these tables fail afterwards."""
    for path in WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    n = len(WRITTEN)
    WRITTEN.clear()
    return n


def attach(rows: DataFrame, named: DataFrame, on: list[str], total: int, most_hot: int = 1_000) -> DataFrame:
    """rows with the other columns of `named`, which has each key of theirs once and the number n of rows that carry it.

    Keys of more than total / most_hot rows are sent to all tasks: as the n of all keys add up to `total`, these are fewer
    than most_hot. All other keys meet their rows in a shuffle, where none of them is large. Rows without a key in `named`
    are left out. Both tables are read twice, so they should be written ones.
    """
    hot = F.col("n") * most_hot > total
    hot_keys = F.broadcast(named.where(hot).drop("n"))
    rare = rows.join(hot_keys.select(*on), on, "left_anti").join(named.where(~hot).drop("n").hint("merge"), on)
    return rows.join(hot_keys, on).unionByName(rare)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most `rows` rows for what is run within, to bound memory where rows are wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes in the text column, by one aggregate."""
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def id_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text (null text: empty), so that other columns never clash."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows of about `most` bytes each (a longer row stands alone), to bound memory."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept for the life of the worker."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        _powers[:] = [
            np.concatenate([[U64(1)], np.cumprod(np.full(size - 1, b, U64))]) for b in (BASE, pow(BASE, -1, 1 << 64))
        ]
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """C with C[j]-C[i] the polynomial sum of bytes i..j-1; see span_hash."""
    c = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * powers(len(data))[0], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes start..end-1, the same wherever they stand."""
    return mix((c[end] - c[start]) * powers(len(c))[1][start])


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUE = BYTE_VALUE[LOWER]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and count per row of the words (runs of bytes other than white space)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]  # a row's edge is a word's edge
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.diff(np.searchsorted(start, offs))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with A-Z lower-cased, and words per row."""
    start, end, count = word_spans(data, offs)
    return span_hash(prefix_hash(data, LOWER_VALUE), start, end), count


def pack(values: np.ndarray, width: int = 8) -> bytes:
    """Little-endian unsigned integers as zstd-compressed byte planes of which the lowest `width` are kept."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, width: int = 8) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(blob, n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def segments(counts: np.ndarray) -> np.ndarray:
    """Row number of each item, for `counts` items per row."""
    return np.repeat(np.arange(len(counts)), counts)
