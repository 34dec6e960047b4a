"""Exact nearest neighbours of every row of one table in another, for query sets of any size.

Rows of both sides are dealt to the cells of pivots (a bounded sample); near cells are packed into blocks of up to BLOCK rows,
a larger cell is cut by hash. First a query meets the block of its own cell: its k-th distance there bounds its true one. By
the triangle inequality a cell whose rows are within U of its pivot p has no row nearer to a query than d(q, p) - U, so a
query then goes only to the other blocks with a cell that can hold a neighbour; there it looks at such cells alone, and in a
cell at the ring of rows whose distance from p differs from its own by no more than the bound.

A group of queries meets a block of rows in one task, by matrix products: these, with a margin for their rounding, tell the
few pairs within the bound, whose distances are then summed as everywhere else. Of equal vectors of a block only the
k least ids take part. So a cell that has most rows, or that all queries visit, is many tasks of bounded size. A query is shuffled
once for each block that it visits: few where vectors cluster, all of them (n / BLOCK) where they don't; there the
work grows with queries times rows, which no exact search avoids. How many pairs were looked at is part of the result. The driver gets
pivots and one line for each cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scratch import scratch_dir
from quarry.operators.search import DIGITS, _distances, _id_type, matrix, ranked

MAX_PIVOTS = 512
BLOCK = 32_768  # rows, and queries, that meet in a task at most
LEAST_BLOCK = 2048  # smaller tables have smaller blocks, so that there are tasks for all cores
CHUNK = 256  # queries whose rings are looked at together
TILE = 4096  # rows in a matrix product
MANY, DENSE = 8, 0.5  # so many cells of a block, and the share of them that queries need, from which they look at all of the block
PAIRS = 100_000  # pairs whose exact distances are summed at once
SLACK = 2e-6  # of squared distances: more than rounding to DIGITS can move


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows with a vector, as floats if they are stored so."""
    kind = df.schema[vector_col].dataType.simpleString()
    return df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("x"))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _placed(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, x) with cell (the nearest pivot) and d (the distance from it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = np.sqrt(_distances(pivots, matrix(b.column(1), pivots.shape[1]), "l2sq"))
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell])], names=["id", "x", "cell", "d"])

    return df.mapInArrow(run, f"{_fields(df)}, cell int, d double")


def _layout(pivots: np.ndarray, sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The (first) block of each cell and in how many it is cut: near cells share a block, a cell of more than ``block`` has its own."""
    first, pieces, at, filled = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // block)), 0, 0
    left, c = set(range(len(sizes))), 0
    while left:
        c = min(left, key=((pivots - pivots[c]) ** 2).sum(1).__getitem__)  # the cell next to the last one
        left.remove(c)
        if filled and filled + sizes[c] > block:
            at, filled = at + 1, 0
        first[c] = at
        if pieces[c] > 1:
            at += pieces[c]
        else:
            filled += sizes[c]
    return first, pieces


def _of_cell(values: np.ndarray) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)


def _block(layout: tuple[np.ndarray, np.ndarray], seed: int) -> Column:
    return (_of_cell(layout[0]) + F.pmod(F.xxhash64("id", F.lit(seed)), _of_cell(layout[1]))).cast("int")


def _asked(queries: DataFrame, pivots: np.ndarray, reach: np.ndarray, sizes: np.ndarray, k: int) -> DataFrame:
    """(id, x) with cell (the nearest one with rows) and bound: as far as the cells go that together have k rows."""
    full = np.flatnonzero(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), pivots.shape[1])
            at, far = np.arange(len(x)), np.sqrt(_distances(pivots[full], x, "l2sq"))
            farthest = far + reach[full]
            order = np.argsort(farthest, axis=1, kind="stable")
            enough = np.minimum((np.cumsum(sizes[full][order], axis=1) < k).sum(1), len(full) - 1)
            bound = farthest[at, order[at, enough]] if sizes.sum() >= k else np.full(len(x), np.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(full[far.argmin(1)].astype(np.int32)), pa.array(np.sqrt(bound * bound + SLACK) * (1 + 1e-9))], names=["id", "x", "cell", "bound"])

    return queries.mapInArrow(run, f"{_fields(queries)}, cell int, bound double")


def _visits(queries: DataFrame, pivots: np.ndarray, reach: np.ndarray, sizes: np.ndarray, layout: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``queries`` (id, x, cell, bound, block, grp) with blocks: all but ``block`` with a cell that can hold one of a query's neighbours."""
    full = np.flatnonzero(sizes)
    holds = np.zeros((len(full), int((layout[0] + layout[1]).max())), np.float32)
    for i, c in enumerate(full):
        holds[i, layout[0][c] : layout[0][c] + layout[1][c]] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far, bound = np.sqrt(_distances(pivots[full], matrix(b.column(1), pivots.shape[1]), "l2sq")), b.column(3).to_numpy()
            which = (far - reach[full] <= bound[:, None]).astype(np.float32) @ holds > 0
            which[np.arange(len(which)), b.column(4).to_numpy()] = False
            blocks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(which.sum(1))), pa.int32()), pa.array(np.nonzero(which)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, blocks], names=[*b.schema.names, "blocks"])

    return queries.mapInArrow(run, f"{_fields(queries)}, blocks array<int>")


def _least(pair_of: np.ndarray, distance: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least (distance, rank) of each query."""
    order = np.lexsort((rank, distance, pair_of))
    own = pair_of[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return order[np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) < k]


def _few_copies(x: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows without those of equal vectors that have k lesser ids."""
    _, which = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    return np.sort(_least(which.ravel(), np.zeros(len(x)), rank, k))


def _met(visits: DataFrame, rows: DataFrame, pivots: np.ndarray, k: int, tighten: bool) -> DataFrame:
    """(query_id, id, distance, pairs): the k nearest rows within its bound of every block that a query (id, x, bound, grp, block)
    visits, and in rows without ids how many pairs a task looked at. ``tighten``: bounds are loose, and the k-th
    distances of the first cell of enough rows take their place."""
    pairs_of = _stored(visits.select("block", "grp").distinct())  # as many as groups of tasks
    held_by = rows.join(F.broadcast(pairs_of), "block")
    query_kind, kind = visits.schema["id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        names, ids, looked = asked["id"].combine_chunks(), held["id"].combine_chunks(), 0
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asked.num_rows and held.num_rows:
            dim, rank = pivots.shape[1], np.empty(held.num_rows, np.int64)
            rank[pc.sort_indices(ids).to_numpy()] = np.arange(held.num_rows)
            x, y = matrix(held["x"].combine_chunks(), dim), matrix(asked["x"].combine_chunks(), dim)
            cell, d = held["cell"].to_numpy(), held["d"].to_numpy()
            place = _few_copies(x, rank, k)
            place = place[np.lexsort((d[place], cell[place]))]
            x, rank, cell, d = x[place], rank[place], cell[place], d[place]
            start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            stop = np.append(start[1:], len(cell))
            near, reach = pivots[cell[start]], d[stop - 1]
            centre = near.mean(0)
            centred = x - centre
            square = (centred * centred).sum(1)
            wide = np.vstack([centred.T, -square / 2])  # with (q, 1): (|q|^2 - distance) / 2
            turn = np.argsort(asked["cell"].to_numpy(), kind="stable")
            bounds = asked["bound"].to_numpy()
            for lo in range(0, len(turn), CHUNK):
                some = turn[lo : lo + CHUNK]
                own, bound, far = y[some], bounds[some].copy(), np.sqrt(_distances(near, y[some], "l2sq"))
                q = np.column_stack([own - centre, np.ones(len(some))])
                q_square = (q[:, :-1] ** 2).sum(1)
                margin = 16 * (dim + 4) * np.finfo(np.float64).eps * (square.max() + q_square)
                found, loose, every = [], np.full(len(some), tighten), np.arange(len(some))
                needed = far - reach <= bound[:, None]
                if len(start) >= MANY and needed.mean() > DENSE:
                    parts = [(None, 0, len(x))]
                else:
                    parts = [(c, start[c], stop[c]) for c in np.argsort(far.mean(0), kind="stable").tolist() if needed[:, c].any()]
                for c, first, last in parts:
                    who = every
                    if c is not None:
                        who = np.flatnonzero(far[:, c] - reach[c] <= bound)
                        if not len(who):
                            continue
                        within = d[first:last]
                        first, last = first + np.searchsorted(within, (far[who, c] - bound[who]).min(), "left"), first + np.searchsorted(within, (far[who, c] + bound[who]).max(), "right")
                    for at in range(first, last, TILE):
                        end = min(at + TILE, last)
                        looked += len(who) * (end - at)
                        product = q[who] @ wide[:, at:end]
                        if end - at >= k and (these := np.flatnonzero(loose[who])).size:
                            kth = q_square[who[these]] - 2 * np.partition(product[these], end - at - k, axis=1)[:, end - at - k]
                            bound[who[these]] = np.fmin(bound[who[these]], np.sqrt(np.maximum(kth, 0) + margin[who[these]] + SLACK))
                            loose[who[these]] = False
                        limit = (q_square[who] - bound[who] ** 2 - SLACK - margin[who]) / 2
                        i, j = np.divmod(np.flatnonzero(product >= limit[:, None]), end - at)
                        found.append((who[i], at + j))
                if not found:
                    continue
                i, j = (np.concatenate(a) for a in zip(*found))
                distance = np.empty(len(i))
                for at in range(0, len(i), PAIRS):
                    a, b = x[j[at : at + PAIRS]], own[i[at : at + PAIRS]]
                    total = np.zeros(len(a))
                    for col in ((a - b) ** 2).T:  # in the order of the dimensions, as in _distances
                        total += col
                    distance[at : at + PAIRS] = np.round(total, DIGITS) + 0.0
                best = _least(i, distance, rank[j], k)
                out.append((some[i[best]], place[j[best]], distance[best]))
        none = np.zeros(0, np.int64)
        i, j, distance = (np.concatenate(a) for a in zip((none, none, np.zeros(0)), *out))
        counted = [pa.array([None], names.type), pa.array([None], ids.type), pa.array([None], pa.float64()), pa.array([int(looked)])]
        hits = [names.take(pa.array(i)), ids.take(pa.array(j)), pa.array(distance), pa.array(np.zeros(len(i), np.int64))]
        return pa.table([pa.chunked_array(list(c)) for c in zip(hits, counted)], names=["query_id", "id", "distance", "pairs"])

    return _stored(visits.groupBy("block", "grp").cogroup(held_by.groupBy("block", "grp")).applyInArrow(meet, f"query_id {query_kind}, id {kind}, distance double, pairs bigint"))


def knn_join(queries: DataFrame, rows: DataFrame, k: int = 10, id_col: str = "chunk_id", vector_col: str = "embedding", n_pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, id, distance) of the ``k`` nearest ``rows`` (squared distance, then id) of every query (query_id,
    embedding), and one row (queries, rows, pairs): pairs looked at. Rows and queries without a vector are left out; a
    query_id must be unique. Squared distances are rounded as in ``search.nearest``."""
    spark = rows.sparkSession
    kind, query_kind = _id_type(rows, id_col)[0], _id_type(queries, "query_id")[0]
    x, q = _vectors(rows, id_col, vector_col), _vectors(queries, "query_id", "embedding")
    n = x.count()
    if not n:
        return spark.createDataFrame([], f"query_id {query_kind}, rank int, id {kind}, distance double"), q.agg(F.count("*").alias("queries"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("pairs"))
    wanted = n_pivots or max(1, min(MAX_PIVOTS, round(n**0.5 / 2)))
    pivots = np.unique(np.array([r.x for r in x.orderBy(F.xxhash64("id")).limit(wanted).collect()], np.float64), axis=0)
    placed = _stored(_placed(x, pivots))
    sizes, reach = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for cell, m, far in placed.groupBy("cell").agg(F.count("*"), F.max("d")).collect():
        sizes[cell], reach[cell] = m, far
    asked = _stored(_asked(q, pivots, reach, sizes, k))
    asking = np.zeros(len(pivots), np.int64)
    for cell, m in asked.groupBy("cell").count().collect():
        asking[cell] = m
    small = lambda m: int(min(BLOCK, max(LEAST_BLOCK, m // 8)))
    layout, groups = _layout(pivots, sizes, small(n)), _layout(pivots, asking, small(asking.sum()))
    held = placed.withColumn("block", _block(layout, 0))
    grouped = asked.withColumns({"block": _block(layout, 2), "grp": _block(groups, 1)})
    # the k-th distance within the block of a query's own cell bounds its true one
    first = _met(grouped, held, pivots, k, True)
    kth = first.where("query_id IS NOT NULL").groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where(F.col("n") >= k)
    near = kth.select(F.col("query_id").alias("id"), (F.sqrt(F.col("far") + SLACK) * (1 + 1e-9)).alias("kth"))
    bounded = grouped.join(near.hint("merge"), "id", "left").select("id", "x", "cell", F.least("bound", "kth").alias("bound"), "block", "grp")
    others = _stored(_visits(bounded, pivots, reach, sizes, layout)).withColumn("block", F.explode("blocks")).drop("blocks")
    found = _met(others, held, pivots, k, False)
    hits = ranked(first.unionByName(found).where("query_id IS NOT NULL").withColumn("k", F.lit(k)))
    pairs = first.select("pairs").unionByName(found.select("pairs")).agg(F.sum("pairs").alias("pairs"))
    return hits, pairs.select(F.lit(int(asking.sum())).alias("queries"), F.lit(n).alias("rows"), "pairs")
