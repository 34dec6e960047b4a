"""An embedder fitted on a corpus: hashed words weighted by rarity, projected on the directions that carry most of it.

A text is a sparse row of FEATURES numbers: (1 + log of the count) of the words of a bucket times the bucket's inverse
document frequency, at length 1. Its vector is that row times a projection: the first right singular vectors of all rows,
found by a randomised range finder. Texts are read once, and their words stored as buckets and counts (``counted``). One pass over
these counts the documents of each bucket; then ``passes`` passes multiply all rows with a thin matrix and back (tasks hold one such matrix of partial sums, which Spark adds up by bucket); between them the driver
orthogonalises FEATURES x (dim + OVER) numbers, whatever the size of the corpus. All rows take part.

Null texts count as empty; a text without words has the zero vector. The fit depends on the rows alone, not on their order
but for rounding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.embed import KNOWN, Embedder, register_embedder
from quarry.functions.scratch import scratch_dir

FEATURES = 4096
OVER = 16  # columns of the thin matrix beyond the wanted ones
SLICE = 512  # texts at once
DENSE = 1 / 40  # share of numbers that aren't zero, from which a slice is multiplied as a dense matrix
COUNTED = "buckets array<int>, counts array<int>"
_WORD = re.compile(r"[^\W_]+")


def _words(texts: list[str | None], known: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each text, rising, and how many of its words each has."""
    none = np.zeros(0, np.int64)
    for text in texts:
        words = _WORD.findall((text or "").lower())
        if len(known) > KNOWN:
            known.clear()
        own = [known[w] if w in known else known.setdefault(w, zlib.crc32(w.encode()) % FEATURES) for w in words]
        yield np.unique(own, return_counts=True) if own else (none, none)


class Rows:
    """Texts as sparse rows: parallel arrays of row, bucket and weight, sorted by row."""

    def __init__(self, texts: list[str | None], rarity: np.ndarray | None, known: dict[str, int]):
        found, none = list(_words(texts, known)), np.zeros(0, np.int64)
        bucket, count = (np.concatenate([none, *x]) for x in zip((none, none), *found))
        self._set(len(found), np.array([len(x) for x, _ in found], np.int64), bucket, count, rarity)

    @classmethod
    def of_counts(cls, n: np.ndarray, bucket: np.ndarray, count: np.ndarray, rarity: np.ndarray | None) -> Rows:
        """Of the ``n`` buckets of each text and their counts."""
        out = cls.__new__(cls)
        out._set(len(n), n, bucket, count, rarity)
        return out

    def _set(self, texts: int, n: np.ndarray, bucket: np.ndarray, count: np.ndarray, rarity: np.ndarray | None) -> None:
        self.n, self.row, self.bucket = texts, np.repeat(np.arange(texts), n), bucket
        if rarity is not None:
            weight = (1 + np.log(count)) * rarity[self.bucket]
            length = np.sqrt(np.bincount(self.row, weight * weight, self.n))
            self.weight = weight / np.maximum(length[self.row], 1e-300)

    def _dense(self) -> np.ndarray | None:
        """The rows as a matrix, if they aren't too sparse for it."""
        if len(self.row) < DENSE * self.n * FEATURES or self.n > SLICE:
            return None
        out = np.zeros((self.n, FEATURES))
        out[self.row, self.bucket] = self.weight
        return out

    def there_and_back(self, thin: np.ndarray) -> np.ndarray:
        dense = self._dense()
        return self.back(self.times(thin)) if dense is None else dense.T @ (dense @ thin)

    @staticmethod
    def _summed(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Sums of ``values`` rows by sorted ``keys``."""
        out = np.zeros((n, values.shape[1]))
        if len(keys):
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            out[keys[first]] = np.add.reduceat(values, first, axis=0)
        return out

    def times(self, thin: np.ndarray) -> np.ndarray:
        return self._summed(self.row, self.weight[:, None] * thin[self.bucket], self.n)

    def back(self, thin: np.ndarray) -> np.ndarray:
        order = np.argsort(self.bucket, kind="stable")
        return self._summed(self.bucket[order], self.weight[order, None] * thin[self.row[order]], FEATURES)


def counted(df: DataFrame, text_col: str = "content") -> DataFrame:
    """(buckets, counts) of each text, stored: the passes of a fit don't read texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                found = list(_words(b.column(0).slice(lo, SLICE).to_pylist(), known))
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x, _ in found])), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays(lists, names=["buckets", "counts"])

    path = scratch_dir(df.sparkSession)
    df.select(text_col).mapInArrow(run, COUNTED).write.parquet(path)
    return df.sparkSession.read.schema(COUNTED).parquet(path)


def _slices(batches: Iterator[pa.RecordBatch], rarity: np.ndarray | None) -> Iterator[Rows]:
    for b in batches:
        for lo in range(0, b.num_rows, SLICE):
            own = b.slice(lo, SLICE)
            n = np.diff(own.column(0).offsets.to_numpy())
            bucket, count = (own.column(j).flatten().to_numpy().astype(np.int64) for j in (0, 1))
            yield Rows.of_counts(n, bucket, count, rarity)


def document_counts(df: DataFrame, text_col: str | None = None) -> tuple[int, np.ndarray]:
    """How many texts have a word, and how many of them each bucket; without ``text_col`` from what ``counted`` stored."""
    rows = df if text_col is None else counted(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for own in _slices(batches, None):
            total[:FEATURES] += np.bincount(own.bucket, minlength=FEATURES)
            total[FEATURES] += len(np.unique(own.row))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1), pa.int32()), pa.array(total)], names=["bucket", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    for bucket, n in rows.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return int(out[FEATURES]), out[:FEATURES]


def there_and_back(rows: DataFrame, rarity: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """Transposed rows times rows times ``thin``, over all texts of ``counted``."""
    width = thin.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((rarity, thin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, thin = shared.value
        total = np.zeros((FEATURES, width))
        for own in _slices(batches, rarity):
            total += own.there_and_back(thin)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["bucket", "v"])

    sums = rows.mapInArrow(run, "bucket int, v array<double>").groupBy("bucket").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v"))
    out = np.zeros_like(thin)
    for bucket, v in sums.collect():  # FEATURES rows
        out[bucket] = v
    shared.unpersist()
    return out


def fit(df: DataFrame, dim: int = 64, text_col: str = "content", passes: int = 2, seed: int = 7, rows: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rarity, projection): inverse document frequency of each bucket, and FEATURES x dim. ``rows``: what ``counted``
    stored of ``df``, if it is there."""
    rows = counted(df, text_col) if rows is None else rows
    n, counts = document_counts(rows)
    rarity = np.log((1 + n) / (1 + counts)) + 1
    thin = np.random.default_rng(seed).normal(size=(FEATURES, min(dim + OVER, FEATURES)))
    for i in range(passes):
        thin, _ = np.linalg.qr(thin if i == 0 else product)
        product = there_and_back(rows, rarity, thin)
    values, vectors = np.linalg.eigh(thin.T @ product)
    top = np.argsort(-values)[:dim]
    projection = thin @ vectors[:, top]
    return rarity, projection * np.where(projection[np.abs(projection).argmax(0), np.arange(len(top))] < 0, -1.0, 1.0)


def fitted_embedder(name: str, rarity: np.ndarray, projection: np.ndarray) -> Embedder:
    """A registered embedder of a fit; vectors have length 1, or 0 without words."""

    def make():
        known: dict[str, int] = {}

        def run(texts: list[str]) -> np.ndarray:
            own = Rows(texts, rarity, known)
            dense = own._dense()
            out = own.times(projection) if dense is None else dense @ projection
            length = np.sqrt((out * out).sum(1, keepdims=True))
            return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-12)

        return run

    return register_embedder(name, make, projection.shape[1])
