"""Exact joins and quantised lists against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import knn_join, quantized, search

VECTORS = "chunk_id long, embedding array<double>"


def brute(queries, rows, k):
    out = set()
    for i, q in queries:
        far = sorted((round(sum((float(a) - float(b)) ** 2 for a, b in zip(q, x)), 6) + 0.0, j) for j, x in rows)
        out |= {(i, r + 1, j, d) for r, (d, j) in enumerate(far[:k])}
    return out


def clustered(n, dim=8, centres=10, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim)) * 10
    return [(i, list(map(float, c[i % centres] + rng.normal(size=dim) * 0.1))) for i in range(n)]


@pytest.mark.parametrize("block", [16, 2048])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knn_join, "BLOCK", block)
    monkeypatch.setattr(knn_join, "CHUNK", 4)
    rows = clustered(300)
    rows += [(1000 + i, rows[0][1]) for i in range(80)]  # one hot vector
    queries = [(i + 5000, [a + 0.01 for a in x]) for i, x in rows[100:160]] + rows[:20]
    df, q = spark.createDataFrame(rows + [(9, None)], VECTORS), spark.createDataFrame([*queries, (77777, None)], VECTORS).withColumnRenamed("chunk_id", "query_id")
    hits, counts = knn_join.knn_join(q, df, 5)
    got = {(r.query_id, r.rank, r.id, r.distance) for r in hits.collect()}
    want = brute(queries, rows, 5)
    assert {g[:3] for g in got} == {w[:3] for w in want} and len(got) == len(want)
    n = counts.first()
    assert (n.queries, n.rows) == (80, 380) and n.pairs < 0.5 * n.queries * n.rows


def test_join_edges(spark):
    df = spark.createDataFrame(clustered(3), VECTORS)
    q = df.withColumnRenamed("chunk_id", "query_id")
    hits, counts = knn_join.knn_join(q, df, 5, n_pivots=2)
    assert hits.count() == 9 and counts.first().pairs >= 9
    assert knn_join.knn_join(q, df.limit(0), 5)[0].count() == 0
    assert knn_join.knn_join(q.limit(0), df, 5)[0].count() == 0
    named = df.withColumn("chunk_id", F.concat(F.lit("c"), F.col("chunk_id")))
    assert {r.id for r in knn_join.knn_join(q, named, 1)[0].collect()} == {"c0", "c1", "c2"}


def test_lists_are_searched_without_a_shuffle_of_vectors(spark, tmp_path):
    rows = clustered(400)
    df, q = spark.createDataFrame(rows, VECTORS), spark.createDataFrame(rows[:12], VECTORS).withColumnRenamed("chunk_id", "query_id")
    root = str(tmp_path / "ivf")
    centroids = search.write_lists(df, root, 10)
    found = search.nearest_ivf(spark, root, centroids, q, 5, 10)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in search.nearest(df, q, 5).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan[: plan.index("MapInArrow")] and "BroadcastHashJoin" not in plan
    assert search.nearest_ivf(spark, root, centroids, q.limit(0), 5).count() == 0


def test_quantised_lists(spark, tmp_path):
    rows = clustered(600, dim=16, centres=6)
    df = spark.createDataFrame(rows + [(9999, None)], VECTORS)
    q = spark.createDataFrame(rows[:10], VECTORS).withColumnRenamed("chunk_id", "query_id")
    root = str(tmp_path / "pq")
    model = quantized.train(df, parts=4, n_lists=6)
    quantized.write_quantized(df, root, model)
    stored = spark.read.parquet(root)
    assert stored.count() == 600 and {len(r.codes) for r in stored.select("codes").collect()} == {4}
    for r in stored.limit(50).collect():  # a code is the nearest codeword of each part of the residual
        parts = (np.array(r.embedding) - model.centroids[r.list]).reshape(4, -1)
        near = [((w - p) ** 2).sum(1) for w, p in zip(model.words, parts)]
        assert all(d[c] <= d.min() + 1e-9 for d, c in zip(near, r.codes))
    shortlist, n_probe = quantized.calibrate(spark, root, model, 5)
    near = quantized.nearest_quantized(spark, root, model, q, 5, shortlist, n_probe).collect()
    exact = {(r.query_id, r.id): r.distance for r in search.nearest(df, q, 5).collect()}
    assert len(near) == 50 and sum((r.query_id, r.id) in exact for r in near) >= 45
    assert all(abs(exact[r.query_id, r.id] - r.distance) < 2e-6 for r in near if (r.query_id, r.id) in exact)
    plan = quantized.shortlists(spark, root, model, q, shortlist, n_probe)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan  # codes alone are read
    assert quantized.nearest_quantized(spark, root, model, q.limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="can't be cut"):
        quantized.train(df, parts=5, n_lists=2)
    with pytest.raises(ValueError, match="no vectors"):
        quantized.train(df.limit(0))


def test_quantised_lists_of_few_distinct_vectors(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(40)], VECTORS)
    root = str(tmp_path / "few")
    model = quantized.train(df, parts=2, n_lists=2)
    quantized.write_quantized(df, root, model)
    q = df.limit(3).withColumnRenamed("chunk_id", "query_id")
    got = quantized.nearest_quantized(spark, root, model, q, 3, 40, 2)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in search.nearest(df, q, 3).collect()}


def test_join_of_vectors_without_clusters_isnt_dealt_by_cell(spark, monkeypatch):
    """Where queries can't leave out cells, they go once to each block of rows, not once to each cell."""
    stored, plain = [], knn_join._stored

    def counted(df):
        out = plain(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(knn_join, "_stored", counted)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x[:40] = x[0]  # more copies than neighbours
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).round(4)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], VECTORS)
    hits, _ = knn_join.knn_join(df.withColumnRenamed("chunk_id", "query_id"), df, 5)
    got = {(r.query_id, r.rank): r.id for r in hits.collect()}
    far = np.round(sum((x[:, None, j] - x[None, :, j]) ** 2 for j in range(32)), 6)
    want = {(i, r + 1): int(j) for i in range(3000) for r, j in enumerate(np.lexsort((np.arange(3000), far[i]))[:5])}
    assert got == want
    assert max(stored) < 12 * 3000


def test_shortlists_hold_bounded_hits(spark, tmp_path, monkeypatch):
    """A task holds the hits of some queries at a time, however many there are; the result is the same."""
    held, plain = spark.sparkContext.accumulator(0), quantized._own

    def own(best, block, id_type):
        held.add(int(sum(map(len, best.values())) > 60))
        return plain(best, block, id_type)

    rows = clustered(300, dim=8, centres=4)
    df = spark.createDataFrame(rows, VECTORS).coalesce(1)
    root, model = str(tmp_path / "held"), quantized.train(df, parts=4, n_lists=4)
    quantized.write_quantized(df, root, model)
    q = df.where("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    want = {tuple(r) for r in quantized.shortlists(spark, root, model, q, 20, 4).collect()}
    assert len(want) == 40 * 20
    monkeypatch.setattr(quantized, "_own", own)
    monkeypatch.setattr(quantized, "HELD_HITS", 60, raising=False)
    assert {tuple(r) for r in quantized.shortlists(spark, root, model, q, 20, 4).collect()} == want and held.value == 0
