"""Shared helpers: shared scratch tables, batches of text as byte buffers, vectorised word hashing.

Texts arrive in Arrow batches whose string column already is one contiguous UTF-8 buffer, so words are
found and hashed over whole slices of a batch with numpy, not per row.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
LONG_SPAN = 256
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes of eight


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share. Only a local session
    gets a temporary folder where the setting is missing."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors and
    gives later joins a true size."""
    path = path or shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has."""
    while name in df.columns:
        name = f"_{name}"
    return name


def tidy() -> None:
    """Hand freed memory back to the system at the end of a task: workers live on, and their allocators keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text is a
    run of its own. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spans(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one non-zero class; runs never cross a text's border."""
    n = len(classes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(classes[1:], classes[:-1], out=edge[1:n])
    edge[offsets[:-1]] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = classes[starts] != 0
    return starts[keep], ends[keep]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a polynomial hash count."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xCF1BBCDCBFA56363)
    return h ^ (h >> np.uint64(32))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]. Eight bytes at a time enter a state that a bijective mixer renews, and
    the length comes last; spans over LONG_SPAN bytes are hashed by xxhash. Nothing in it is linear, so
    different spans collide by chance alone: of d distinct ones some d * d / 2**65 pairs."""
    sizes = ends - starts
    eights = np.ndarray(len(buf) + 1, "<u8", np.append(buf, np.zeros(8, np.uint8)), strides=(1,))
    h = mix(eights[starts] & _FIRST_BYTES[np.minimum(sizes, 8)])
    more, at = np.flatnonzero((sizes > 8) & (sizes <= LONG_SPAN)), 8
    while len(more):
        h[more] = mix(h[more] ^ (eights[starts[more] + at] & _FIRST_BYTES[np.minimum(sizes[more] - at, 8)]))
        at += 8
        more = more[sizes[more] > at]
    for i in np.flatnonzero(sizes > LONG_SPAN).tolist():
        h[i] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(buf[starts[i] : ends[i]]))
    return mix(h ^ sizes.astype(np.uint64))


def word_counts(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text."""
    return np.diff(np.searchsorted(starts, offsets))


def hash_word(word: bytes) -> int:
    """The hash that ``hash_spans`` gives one word."""
    buf = np.frombuffer(word, np.uint8)
    return int(hash_spans(buf, np.array([0]), np.array([len(buf)]))[0])
