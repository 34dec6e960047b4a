"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

Words are runs of letters, of digits or of symbols. Each gives four n-grams: itself, itself with the word
before it, its shape with the shapes of the two before it, and whether it repeats the word before it. They
are hashed to 2**BITS weights; a text's features are its n-gram counts over the root of its number of
words, and its score is the sigmoid of their dot product with the weights.

Training sees a bounded sample of labelled rows (``max_rows`` of ``training_rows``) in an order fixed by
the texts' hashes, an epoch after the other; no text is held longer than its updates take. Scoring sees every whole
text. Null or empty text has no features: its score is the bias alone. No labelled rows: every score is 0.5. Of
several labels of one document the highest counts. Repeated rows score alike (and count as often in training);
texts of any length are taken a slice at a time; extra columns are ignored, also those named as the results,
which ``names`` can rename.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import hash_spans, mix, spans, text_slices, tidy, word_counts
from quarry.llm.language_id import held_out

BITS = 18
BIAS = 1 << BITS
THRESHOLD = 0.3

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def ngrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4, words) of hashed n-grams of a slice of texts, and the words of each text."""
    classes = _CLASS[buf]
    starts, ends = spans(classes, offsets)
    h = hash_spans(buf, starts, ends)
    counts = word_counts(starts, offsets)
    n = len(h)
    upper = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf >= 65) & (buf <= 90), out=upper[1:])
    n_upper = upper[ends] - upper[starts]
    shape = np.where(n_upper == 0, 1, np.where(n_upper == ends - starts, 2, 3)).astype(np.uint64)
    kind = classes[starts] if n else np.zeros(0, np.uint8)
    shape = np.where(kind == 1, shape, np.where(kind == 2, np.uint64(4), h | np.uint64(8)))
    first = np.zeros(n, bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    before, shape1 = np.roll(h, 1), np.roll(shape, 1)
    before[first], shape1[first] = 0, 0
    shape2 = np.roll(shape1, 1)
    shape2[first] = 0
    c = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    grams = np.stack([h, h * c[0] + before * c[1] + np.uint64(1), shape * c[0] + shape1 * c[1] + shape2 * c[2] + np.uint64(2), (h == before).astype(np.uint64) + np.uint64(3)])
    return (mix(grams) >> np.uint64(64 - BITS)).astype(np.int64), counts


class FTRL:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.2, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def _features(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse features of each text: indices (the bias last) and values."""
    grams, counts = ngrams(buf, offsets)
    at = 0
    for n in counts.tolist():
        i, c = np.unique(grams[:, at : at + n], return_counts=True)
        yield np.append(i, BIAS), np.append(c / np.sqrt(max(n, 1)), 1.0)
        at += n


def fit(labelled: DataFrame, label_col: str, text_col: str = "text", epochs: int = 2) -> np.ndarray:
    """Weights from a bounded sample of rows (see ``training_rows``). One task makes the passes; the driver
    gets the weights that aren't 0."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y"), F.xxhash64(text_col).alias("h"))
    sample = rows.repartition(1).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).sortWithinPartitions("epoch", "h", "y").select("t", "y")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = FTRL()
        for b in batches:
            labels = b.column(1).to_pylist()
            for lo, hi, buf, offsets in text_slices(b.column(0)):
                for (at, x), y in zip(_features(buf, offsets), labels[lo:hi]):
                    model.update(at, x, y)
        w = model.weights()
        keep = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(w[keep], pa.float64())], names=["i", "w"])
        tidy()

    out = np.zeros(BIAS + 1)
    for i, w in sample.mapInArrow(learn, "i bigint, w double").collect():
        out[i] = w
    return out


def score_texts(weights: np.ndarray, texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts))
    for lo, hi, buf, offsets in text_slices(texts):
        grams, counts = ngrams(buf, offsets)
        sums = np.zeros(grams.shape[1] + 1)
        np.cumsum(weights[grams].sum(0), out=sums[1:])
        end = np.cumsum(counts)
        dot = (sums[end] - sums[end - counts]) / np.sqrt(np.maximum(counts, 1)) + weights[BIAS]
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
    return out


def score(df: DataFrame, weights: np.ndarray, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns of ``df`` with score and predicted (or other ``names``)."""
    shared = df.sparkSession.sparkContext.broadcast(weights)  # 2**BITS numbers
    extra = [] if text_col in keep else [text_col]
    kept = df.select(*keep, *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_texts(shared.value, b.column(b.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*keep, *names])
        tidy()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    return kept.mapInArrow(run, f"{fields}, `{names[0]}` double, `{names[1]}` int")


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> DataFrame:
    """Texts of the learning folds with their label: at most ``max_rows`` labelled documents, in the order
    of their ids' hashes. That bound is what lets the ids be broadcast to the scan of the texts."""
    own = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some), "doc_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = fit(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "quality")
    return score(docs.withColumn("held_out", held_out()), weights, ["doc_id", "held_out"])
