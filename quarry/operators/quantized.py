"""Approximate search over product-quantised lists, with exact distances for a shortlist.

Every row is stored under the list of its nearest centroid as a code of ``parts`` bytes: its residual from the
centroid is cut into parts, each replaced by the nearest of up to 256 codewords. A query has one table of squared
distances for each list that it probes (parts by codewords), and a row's distance is estimated by ``parts`` look-ups.
Only the shortlist of a query is then read as vectors, for exact distances.

Centroids and codewords are fitted on bounded samples; every row is coded. Codes and vectors are stored apart, so that
the first pass reads a byte for each part and no vector. How many lists to probe, and how long a shortlist has to be, is
calibrated against the exact neighbours of a bounded sample of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.search import BROADCAST_HITS, DIGITS, MAX_LISTS, _id_type, _own, keep_nearest, matrix, nearest, no_hits, probes_of, query_blocks, ranked, train_centroids

WORDS = 256
SPREAD = 4  # files of a list
ROUNDS = 12
HELD_HITS = 50_000  # that a task holds at once


@dataclass(frozen=True)
class Quantizer:
    """``centroids`` (lists, dim); ``words`` (parts, codewords, dim / parts)."""

    centroids: np.ndarray
    words: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.words)

    def lists(self, x: np.ndarray) -> np.ndarray:
        return ((self.centroids * self.centroids).sum(1)[None, :] - 2 * x @ self.centroids.T).argmin(1)

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        """(rows, parts) of bytes."""
        own = residuals.reshape(len(residuals), self.parts, -1)
        return np.column_stack([((w * w).sum(1)[None, :] - 2 * own[:, m] @ w.T).argmin(1) for m, w in enumerate(self.words)]).astype(np.uint8)

    def table(self, query: np.ndarray, which: int) -> np.ndarray:
        """(parts, codewords): squared distances of the query's residual in a list."""
        own = (query - self.centroids[which]).reshape(self.parts, 1, -1)
        return ((own - self.words) ** 2).sum(2)


def _codewords(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from distinct rows; a codeword without rows stays where it is."""
    distinct = np.unique(x, axis=0)
    words = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        nearest_word = ((words * words).sum(1)[None, :] - 2 * x @ words.T).argmin(1)
        n = np.bincount(nearest_word, minlength=len(words))
        sums = np.column_stack([np.bincount(nearest_word, weights=c, minlength=len(words)) for c in x.T])
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def train(index: DataFrame, parts: int = 16, n_lists: int | None = None, vector_col: str = "embedding", sample_rows: int = 20_000, seed: int = 7) -> Quantizer:
    """Fit centroids, and codewords of each part of the residuals of ``sample_rows`` rows, a task for each part."""
    total = index.where(F.col(vector_col).isNotNull()).count()
    if not total:
        raise ValueError("no vectors to train on")
    known = index.where(F.col(vector_col).isNotNull())
    centroids = train_centroids(known, n_lists or max(1, min(MAX_LISTS, round(total**0.5))), vector_col)
    dim = centroids.shape[1]
    if dim % parts:
        raise ValueError(f"vectors of size {dim} can't be cut into {parts} parts")
    coarse = Quantizer(centroids, np.zeros((parts, 1, dim // parts)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0), dim)
            own = (x - centroids[coarse.lists(x)]).reshape(len(x), parts, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(parts, dtype=np.int32), len(x))), pa.array(list(own.reshape(-1, dim // parts)), pa.list_(pa.float64()))], names=["part", "v"])

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        own = table["v"].combine_chunks()
        words = _codewords(matrix(own, dim // parts), WORDS, seed + key[0].as_py())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words.ravel()], pa.list_(pa.float64()))})

    sample = known.select(vector_col).sample(min(1.0, sample_rows / total), seed) if total > sample_rows else known.select(vector_col)
    fitted = sample.mapInArrow(cut, "part int, v array<double>").groupBy("part").applyInArrow(fit, "part int, words array<double>").collect()  # parts rows
    words = [np.array(r.words).reshape(-1, dim // parts) for r in sorted(fitted)]
    most = max(map(len, words))  # a part with few distinct values repeats its last codeword
    return Quantizer(centroids, np.stack([np.concatenate([w, np.repeat(w[-1:], most - len(w), axis=0)]) for w in words]))


def write_quantized(index: DataFrame, root: str, model: Quantizer, id_col: str = "chunk_id", vector_col: str = "embedding") -> None:
    """Store the codes and the vectors of every row that has one, by list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), model.centroids.shape[1])
            lists = model.lists(x)
            raw = model.codes(x - model.centroids[lists])
            codes = pa.Array.from_buffers(pa.binary(model.parts), len(x), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists.astype(np.int32)), codes], names=[*b.schema.names, "list", "codes"])

    fields = ", ".join(f"`{c}` {index.schema[c].dataType.simpleString()}" for c in (id_col, vector_col))
    listed = index.where(F.col(vector_col).isNotNull()).select(id_col, vector_col).mapInArrow(run, f"{fields}, list int, codes binary")
    listed.repartition("list", F.pmod(F.xxhash64(id_col), F.lit(SPREAD))).write.partitionBy("list").parquet(root)


def shortlists(spark: SparkSession, root: str, model: Quantizer, queries: DataFrame, shortlist: int, n_probe: int, id_col: str = "chunk_id") -> DataFrame | None:
    """(query_id, rank, id, distance, list): the rows with the least estimated distances; codes alone are read."""
    listed, out = spark.read.parquet(root).select(id_col, "codes", "list"), None
    kind, id_type = _id_type(listed, id_col)
    for block in query_blocks(queries, shortlist):
        probes = probes_of(block, model.centroids, n_probe)

        def run(batches: Iterator[pa.RecordBatch], block: list = block, probes: dict = probes) -> Iterator[pa.RecordBatch]:
            q, at, part = np.array([v for _, _, v in block], np.float64), np.arange(model.parts), max(1, HELD_HITS // shortlist)
            asked: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(0, len(block), part)]
            for which, places in probes.items():
                places = np.array(places)
                for p in np.unique(places // part).tolist():
                    asked[p].append((which, places[places // part == p]))
            for b in batches:  # hits of some queries at a time: what a task holds doesn't grow with their number
                codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, model.parts)
                ids, lists = b.column(0).to_pylist(), b.column(2).to_numpy()
                rows_of = {which: np.flatnonzero(lists == which) for which in np.unique(lists).tolist()}
                for own in asked:
                    best: dict[int, list[tuple]] = {}
                    for which, places in own:
                        if (rows := rows_of.get(which)) is None:
                            continue
                        of_list, own_ids = codes[rows], [ids[j] for j in rows.tolist()]
                        for i in places.tolist():
                            keep_nearest(best, i, model.table(q[i], which)[at, of_list].sum(1), own_ids, shortlist)
                    if best:
                        yield _own(best, block, id_type)

        found = listed.where(F.col("list").isin(sorted(probes))).select(id_col, "codes", F.col("list").cast("int")).mapInArrow(run, f"query_id bigint, id {kind}, distance double, k bigint")
        out = ranked(found) if out is None else out.unionByName(ranked(found))
    return out


def nearest_quantized(spark: SparkSession, root: str, model: Quantizer, queries: DataFrame, k: int = 10, shortlist: int = 100, n_probe: int = 8, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """Approximate ``nearest`` (l2sq): exact distances and ranks of the rows of each query's shortlist."""
    listed = spark.read.parquet(root).select(id_col, vector_col)
    found = shortlists(spark, root, model, queries, shortlist, n_probe, id_col)
    if found is None:
        return no_hits(listed, id_col)
    most = queries.count() * shortlist
    few = F.broadcast if most <= BROADCAST_HITS else lambda df: df.hint("merge")
    pairs = listed.join(few(found.select("query_id", F.col("id").alias(id_col))), id_col).join(few(queries.select("query_id", F.col("embedding").alias("_q"))), "query_id")
    square = F.aggregate(F.zip_with(F.col(vector_col).cast("array<double>"), F.col("_q").cast("array<double>"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    return ranked(pairs.select("query_id", F.col(id_col).alias("id"), F.round(square, DIGITS).alias("distance"), F.lit(k).alias("k")))


def calibrate(spark: SparkSession, root: str, model: Quantizer, k: int = 10, recall: float = 0.95, n_sample: int = 50, most: int = 40, id_col: str = "chunk_id", vector_col: str = "embedding") -> tuple[int, int]:
    """(shortlist, n_probe) with which the shortlists of ``n_sample`` stored rows hold ``recall`` of their exact ``k`` nearest. A
    shortlist has at most ``most`` times k rows. What reaches the driver is bounded by these numbers."""
    stored = spark.read.parquet(root)
    some = stored.orderBy(F.xxhash64(id_col)).limit(n_sample).select(F.row_number().over(_by_hash(id_col)).cast("long").alias("query_id"), F.col(vector_col).alias("embedding")).cache()
    exact = {(r.query_id, r.id) for r in nearest(stored, some, k, "l2sq", id_col, vector_col).collect()}
    if not exact:
        return k, 1
    q, lists = {r.query_id: np.array(r.embedding, np.float64) for r in some.collect()}, len(model.centroids)
    at = {r[0]: r[1] for r in stored.select(id_col, "list").join(F.broadcast(spark.createDataFrame([(i,) for i in {x for _, x in exact}], f"`{id_col}` {_id_type(stored, id_col)[0]}")), id_col).collect()}
    order = {i: np.argsort(((model.centroids - v) ** 2).sum(1), kind="stable").tolist() for i, v in q.items()}
    depth = sorted(order[i].index(at[x]) + 1 for i, x in exact)
    share = (1 + recall) / 2  # half of what may be lost is lost by lists, half by estimates
    n_probe = min(lists, depth[min(len(depth) - 1, int(share * len(depth)))])
    rank = {(r.query_id, r.id): r.rank for r in shortlists(spark, root, model, some, most * k, n_probe, id_col).collect()}
    found = sorted(rank.get(pair, most * k + 1) for pair in exact)
    some.unpersist()
    return max(k, min(most * k, found[min(len(found) - 1, int(recall * len(found)))])), n_probe


def _by_hash(id_col: str):
    from pyspark.sql import Window

    return Window.orderBy(F.xxhash64(id_col))  # of n_sample rows
