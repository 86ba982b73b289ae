"""Shared pieces of the text operators: package shipping, stored frames and byte kernels.

A word is a run of `[^\\x20\\x09-\\x0D]`. The kernels take the UTF-8 bytes of many texts
laid end to end (an Arrow string column) and their offsets, and never build Python
strings. Word and shingle identities are 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from claimspark.session import scratch_path, ship_package

#: Bytes of text handled at once by the kernels (a longer single text is one piece).
PIECE_BYTES = 1 << 20
#: Rows that a task hands to Python at once.
ARROW_ROWS = 1000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prepare(spark: SparkSession) -> None:
    """Ready a session for the operators: the package goes to the executors, and Arrow batches get shorter.

    Texts are long rows. Where the session still has Spark's own 10,000 rows a batch, `ARROW_ROWS` are set, so that a
    batch stays at a few megabytes on both sides; a setting of the user's own stays.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared checkpoint folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a frame made by `stored`, once nothing reads it any more."""
    path = getattr(df, "_stored_path", None)
    if path:
        spark = df.sparkSession
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now rather than at the driver's next full collection."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return memory that numpy and Arrow have freed to the system: Python workers live long and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- Arrow columns as bytes -----------------------------------------------------

def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]] if len(offs) else buf[:0], (offs - offs[0] if len(offs) else np.zeros(1, np.int64))


def pieces(buf: np.ndarray, offs: np.ndarray, limit: int = PIECE_BYTES):
    """Runs of whole texts of about `limit` bytes: (first row, end row, bytes, offsets)."""
    n, row = len(offs) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, buf[offs[row]:offs[end]], offs[row:end + 1] - offs[row]
        row = end


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], type=pa.binary())


# -- words and shingles ----------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = n + (n >> 2)
        for key, base in (("up", _ODD), ("down", _ODD_INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[key] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums from which `span_hash` gives the hash of any byte range."""
    up, _ = _powers(len(buf) + 1)
    out = np.empty(len(buf) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[buf] * up[:len(buf)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts, ends) -> np.ndarray:
    """Hash of the bytes of each range: equal bytes give equal hashes wherever they stand."""
    _, down = _powers(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, index of each text's first word, with the total at the end)."""
    inside = ~_SPACE[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offs] = True
    first, last = inside.copy(), inside.copy()
    if len(buf):
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(span_hash(prefix_sums(buf), starts, ends))


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5,
                   short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `width`-word windows of each text, in order, and each text's first window.

    With `short`, a text of one to `width - 1` words gives one window of all its words.
    """
    counts = np.diff(first)
    n = np.maximum(counts - (width - 1), 0)
    few = (counts > 0) & (n == 0) if short else np.zeros(len(counts), dtype=bool)
    at = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n + few, out=at[1:])
    out = np.empty(at[-1], dtype=np.uint64)
    if len(words) >= width:
        acc = words[:len(words) - width + 1].copy()
        for j in range(1, width):
            acc *= _ODD
            acc += words[j:len(words) - width + 1 + j]
        full = np.flatnonzero(n)
        if len(full):
            idx = np.arange(int(n.sum())) - np.repeat(np.cumsum(n[full]) - n[full], n[full])
            place = idx + np.repeat(at[full], n[full])
            out[place] = mix(acc[idx + np.repeat(first[full], n[full])])
    for k in np.flatnonzero(few):
        acc = np.uint64(counts[k])
        with np.errstate(over="ignore"):
            for w in words[first[k]:first[k + 1]]:
                acc = acc * _ODD + w
        out[at[k]] = mix(np.array([acc + np.uint64(0x51ED270B)], dtype=np.uint64))[0]
    return out, at


def distinct_per_text(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their offsets."""
    values = values.copy()
    for k in range(len(at) - 1):
        values[at[k]:at[k + 1]].sort()
    keep = np.ones(len(values), dtype=bool)
    if len(values):
        keep[1:] = values[1:] != values[:-1]
        keep[at[:-1][np.diff(at) > 0]] = True
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(keep, out=sums[1:])
    return values[keep], sums[at]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]
