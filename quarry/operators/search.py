"""Nearest chunks: exact by blocks of query vectors, or by inverted lists of centroids.

The query set is stated by the caller and small; it goes to the tasks as one matrix after a check of its
size. A task keeps the k nearest of its rows for each query before anything is shuffled, and the final rank is
by distance, rounded to DIGITS, then id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.conditions import condition

DIGITS = 6
METRICS = ("l2sq", "cosine", "ip")
MAX_QUERY_CELLS = 4_000_000  # numbers in a block of query vectors; more queries go in further blocks
MAX_DISTANCES = 2_000_000  # distances that a task holds at once
BROADCAST_HITS = 100_000
MAX_LISTS = 4096
SPREAD = 4  # files of a list


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows), summed in the order of the dimensions so that equal rows get equal numbers."""
    out = np.zeros((len(q), len(x)))
    for j in range(x.shape[1]):
        a, b = x[:, j][None, :], q[:, j][:, None]
        out += (a - b) ** 2 if metric == "l2sq" else a * b
    if metric == "l2sq":
        return out
    if metric == "ip":
        return 1 - out
    nx, nq = np.sqrt((x * x).sum(1))[None, :], np.sqrt((q * q).sum(1))[:, None]
    return 1 - np.divide(out, nx * nq, out=np.zeros_like(out), where=nx * nq > 0)


def _own(found: dict[int, list[tuple]], queries: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    """Rows (query_id, id, distance, k) of a task's hits."""
    rows = [(queries[i][0], x, d, queries[i][1]) for i, own in found.items() for d, x in own]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64())], names=["query_id", "id", "distance", "k"])


def _id_type(index: DataFrame, id_col: str) -> tuple[str, pa.DataType]:
    kind = index.schema[id_col].dataType.simpleString()
    return kind, pa.int64() if kind in ("bigint", "int") else pa.string()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) of a column of vectors, as doubles."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(x) != len(column) * dim:
        raise ValueError("index and query vectors differ in size")
    return x.reshape(len(column), dim)


def keep_nearest(best: dict[int, list[tuple]], i: int, distances: np.ndarray, ids: list, k: int) -> None:
    """Put the ``k`` nearest of some rows among those kept of query ``i``; of equal distances the lesser ids stay."""
    limit = np.partition(distances, k - 1)[k - 1] if k < len(ids) else np.inf
    best[i] = sorted(best.get(i, []) + [(distances[j], ids[j]) for j in np.flatnonzero(distances <= limit).tolist()])[:k]


def local_nearest(index: DataFrame, queries: list[tuple], metric: str, id_col: str, vector_col: str, probes: dict[int, list[int]] | None = None) -> DataFrame:
    """(query_id, id, distance, k): of each task's rows the k nearest for each query (id, k, vector). ``probes``: the
    places of the queries that meet the rows of a list (column ``list``); other rows of the list meet none."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}")
    dim = {len(v) for _, _, v in queries}
    if len(dim) > 1:
        raise ValueError("query vectors differ in size")
    kind, id_type = _id_type(index, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.array([v for _, _, v in queries], np.float64)
        best: dict[int, list[tuple]] = {}

        def meet(x: np.ndarray, ids: list, places: np.ndarray) -> None:
            step = max(1, MAX_DISTANCES // max(1, len(x)))
            for lo in range(0, len(places), step):
                some = places[lo : lo + step]
                for i, d in zip(some.tolist(), np.round(_distances(x, q[some], metric), DIGITS) + 0.0):  # no -0.0
                    keep_nearest(best, i, d, ids, queries[i][1])

        for b in batches:
            x, ids = matrix(b.column(1), q.shape[1]), b.column(0).to_pylist()
            if probes is None:
                meet(x, ids, np.arange(len(q)))
                continue
            lists = b.column(2).to_numpy()
            for which in np.unique(lists).tolist():
                rows = np.flatnonzero(lists == which)
                meet(x[rows], [ids[j] for j in rows.tolist()], np.array(probes.get(which, []), np.int64))
        yield _own(best, queries, id_type)

    more = [] if probes is None else [F.col("list").cast("int").alias("list")]
    return index.where(F.col(vector_col).isNotNull()).select(id_col, vector_col, *more).mapInArrow(run, f"query_id bigint, id {kind}, distance double, k bigint")


def query_blocks(queries: DataFrame, k: int | str) -> Iterator[list[tuple]]:
    """The stated query set in blocks of bounded size: (query_id, k, vector)."""
    own_k = F.least(F.greatest(F.col(k), F.lit(1)), F.lit(20)) if isinstance(k, str) else F.lit(k)
    block: list[tuple] = []
    for r in queries.select("query_id", own_k.cast("long").alias("k"), "embedding").orderBy("query_id").toLocalIterator():
        block.append((r[0], r[1], list(r[2])))
        if len(block) * len(block[0][2]) >= MAX_QUERY_CELLS:
            yield block
            block = []
    if block:
        yield block


def ranked(found: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("k")).select("query_id", "rank", "id", "distance")


def no_hits(index: DataFrame, id_col: str) -> DataFrame:
    return index.sparkSession.createDataFrame([], f"query_id bigint, rank int, id {_id_type(index, id_col)[0]}, distance double")


def nearest(index: DataFrame, queries: DataFrame, k: int | str = 10, metric: str = "l2sq", id_col: str = "chunk_id", vector_col: str = "embedding", where: dict | None = None) -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest rows. ``queries``: query_id, embedding; ``k`` may name
    a column with each query's own k, held between 1 and 20. ``where``: a filter tree (``conditions``) over the
    index's columns and metadata; distances are computed for the rows that it leaves."""
    index = index.where(condition(index, where)) if where else index
    out = None
    for block in query_blocks(queries, k):
        own = ranked(local_nearest(index, block, metric, id_col, vector_col))
        out = own if out is None else out.unionByName(own)
    return no_hits(index, id_col) if out is None else out


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)


def preview(content: Column, n: int = 500, more: str = "\n... (truncated)") -> Column:
    return F.when(F.length(content) > n, F.concat(F.left(content, F.lit(n)), F.lit(more))).otherwise(content)


def with_chunks(hits: DataFrame, chunks: DataFrame, most_hits: int, id_col: str = "chunk_id") -> DataFrame:
    """Hits with the columns of their chunks. ``most_hits``: queries times k; so few are sent to the scan of the
    chunks, more meet them in a shuffle."""
    few = F.broadcast(hits) if most_hits <= BROADCAST_HITS else hits.hint("shuffle_hash")
    return chunks.join(few, chunks[id_col] == few["id"])


def result_rows(hits: DataFrame, chunks: DataFrame, most_hits: int, id_col: str = "chunk_id", show_content: bool = True) -> DataFrame:
    """Hits with their chunks' file, lines, kind, language and similarity, and a preview of the content."""
    rows = with_chunks(hits, chunks, most_hits, id_col)
    out = [
        "query_id",
        "rank",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "path",
        F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("lines"),
        "chunk_type",
        "language",
        F.round(similarity(F.col("distance")), DIGITS).alias("similarity"),
    ]
    return rows.select(*out, *[preview(F.col("content")).alias("preview")] * show_content)


def train_centroids(index: DataFrame, n_lists: int, vector_col: str = "embedding", seed: int = 7, max_rows: int = 100_000) -> np.ndarray:
    """Centroids from a bounded sample of vectors (``max_rows``)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    total = index.count()
    sample = index.select(array_to_vector(F.col(vector_col)).alias("features"))
    if total > max_rows:
        sample = sample.sample(max_rows / total, seed)
    return np.array(KMeans(k=n_lists, seed=seed, maxIter=10).fit(sample).clusterCenters())


def assign_lists(df: DataFrame, centroids: np.ndarray, n: int = 1, vector_col: str = "embedding") -> DataFrame:
    """``df`` with lists: its ``n`` nearest centroids. Every row is indexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.schema.get_field_index(vector_col)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            d = (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T
            lists = np.argsort(d, axis=1, kind="stable")[:, :n]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*b.schema.names, "lists"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, lists array<int>")


def write_lists(index: DataFrame, root: str, n_lists: int | None = None, id_col: str = "chunk_id", vector_col: str = "embedding") -> np.ndarray:
    """Store every row under the list of its nearest centroid, a folder each; about as many lists as the root of the
    rows' number. Returns the centroids."""
    centroids = train_centroids(index, n_lists or max(1, min(MAX_LISTS, round(index.count() ** 0.5))), vector_col)
    listed = assign_lists(index.select(id_col, vector_col), centroids, 1, vector_col).select(id_col, vector_col, F.col("lists")[0].alias("list"))
    listed.repartition("list", F.pmod(F.xxhash64(id_col), F.lit(SPREAD))).write.partitionBy("list").parquet(root)
    return centroids


def probes_for(index: DataFrame, centroids: np.ndarray, k: int = 10, recall: float = 0.95, n_sample: int = 50, id_col: str = "chunk_id", vector_col: str = "embedding") -> int:
    """How many lists a query has to probe: enough to hold ``recall`` of the true ``k`` nearest rows of
    ``n_sample`` rows of the index. What reaches the driver is bounded by these numbers and the lists."""
    some = index.orderBy(F.xxhash64(id_col)).limit(n_sample).select(F.col(id_col).alias("own_id"), F.col(vector_col).alias("embedding"))
    rows = assign_lists(some, centroids, len(centroids)).collect()
    queries = index.sparkSession.createDataFrame([(i, list(r.embedding)) for i, r in enumerate(rows)], "query_id long, embedding array<double>")
    hits = nearest(index, queries, k, "l2sq", id_col, vector_col).select("query_id", "id")
    found = index.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding")).join(F.broadcast(hits), "id")  # n_sample * k rows
    rank = sorted(rows[r.query_id].lists.index(r.lists[0]) + 1 for r in assign_lists(found, centroids, 1, "embedding").select("query_id", "lists").collect())
    return rank[min(len(rank) - 1, int(recall * len(rank)))] if rank else 1


def probes_of(block: list[tuple], centroids: np.ndarray, n_probe: int) -> dict[int, list[int]]:
    """List: the places in ``block`` of the queries that have it among their ``n_probe`` nearest."""
    q = np.array([v for _, _, v in block], np.float64)
    near = np.argsort((centroids * centroids).sum(1)[None, :] - 2 * q @ centroids.T, axis=1, kind="stable")[:, :n_probe]
    out: dict[int, list[int]] = {}
    for i, lists in enumerate(near.tolist()):
        for which in lists:
            out.setdefault(which, []).append(i)
    return out


def nearest_ivf(spark: SparkSession, root: str, centroids: np.ndarray, queries: DataFrame, k: int = 10, n_probe: int = 8, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """Approximate ``nearest`` (l2sq) over stored lists: a query meets the rows of its ``n_probe`` nearest lists. Lists that
    no query probes aren't read; vectors stay where they are scanned, and what is shuffled is each task's k nearest."""
    listed, out = spark.read.parquet(root), None
    for block in query_blocks(queries, k):
        probes = probes_of(block, centroids, n_probe)
        own = ranked(local_nearest(listed.where(F.col("list").isin(sorted(probes))), block, "l2sq", id_col, vector_col, probes))
        out = own if out is None else out.unionByName(own)
    return no_hits(listed, id_col) if out is None else out
