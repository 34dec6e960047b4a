"""The fitted embedder against a dense decomposition, and the vector store across runs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import fitted
from quarry.functions.embed import Embedder, embed, embedder, hashing_embedder
from quarry.operators import vectors


def texts(n=120, seed=4):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ona", "eri", "ulo", "ami")]
    topics = [rng.sample(words, 8) for _ in range(6)]
    return [" ".join(rng.choices(topics[i % 6], k=30) + rng.choices(words, k=10) + ["the", "and"] * 10) for i in range(n)]


def dense(some, rarity):
    rows = fitted.Rows(some, rarity, {})
    out = np.zeros((len(some), fitted.FEATURES))
    out[rows.row, rows.bucket] = rows.weight
    return out


def test_fit_equals_a_dense_decomposition(spark):
    some = texts() + ["", None, "!!"]
    df = spark.createDataFrame([(t,) for t in some], "content string").repartition(5)
    rarity, projection = fitted.fit(df, dim=6, passes=4)
    words = [set(fitted.Rows([t], None, {}).bucket.tolist()) for t in some]
    n = sum(map(bool, words))
    for b in {x for w in words for x in w}:
        assert abs(rarity[b] - (np.log((1 + n) / (1 + sum(b in w for w in words))) + 1)) < 1e-12
    x = dense(some, rarity)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(projection.T @ projection, np.eye(6), atol=1e-9)
    assert np.allclose(np.linalg.norm(x @ projection, axis=0), s[:6], rtol=1e-3)
    two = fitted.fit(df, dim=6)[1]
    assert np.linalg.norm(x @ two) ** 2 > 0.99 * (s[:6] ** 2).sum()
    by = fitted.fitted_embedder("fitted-test", rarity, projection)
    assert embedder("fitted-test") is by
    rows = embed(df, by, precise=True).collect()
    for r in rows:
        want = x[some.index(r.content)] @ projection
        length = np.linalg.norm(want)
        assert np.allclose(r.embedding, want / length if length else want, atol=1e-9) and r.embed_ok


def test_near_copies_rank_first_more_often_than_with_plain_hashing(spark):
    rng, some = random.Random(9), texts(200)
    boiler = "all rights reserved this page may not be copied or shared without the consent of its owner " * 3
    near = []
    for t in some[:60]:
        words = t.split()
        for _ in range(14):
            words[rng.randrange(len(words))] = rng.choice(["the", "and", "of"])
        near.append(boiler + " ".join(words))
    df = spark.createDataFrame([(t,) for t in some], "content string")
    by = fitted.fitted_embedder("fitted-copies", *fitted.fit(df, dim=32))

    def first(one):
        function = one.make()
        a, b = function(some), function(near)
        return np.mean((b @ a.T).argmax(1) == np.arange(60))

    assert first(by) > first(hashing_embedder(32))


def failing(bad, name="picky"):
    def make():
        def run(some):
            if any(bad in t for t in some):
                raise RuntimeError("no")
            return np.array([[len(t), t.count("a")] for t in some], float)

        return run

    return Embedder(name, make, 2)


def test_a_second_build_embeds_nothing_and_failures_heal(spark, tmp_path):
    root = str(tmp_path / "v")
    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None), (5, "bad"), (6, "")], "id long, content string")
    run = lambda by, frame=df, **kw: vectors.embed_missing(frame, by, root, batch=1, **kw)
    assert run(failing("bad")) == 4 and run(failing("bad")) == 1 and run(failing("no such")) == 1 and run(failing("bad")) == 0
    got = {r.id: (r.embedding, r.embed_ok) for r in vectors.embed_stored(df, failing("bad"), root).collect()}
    assert got == {1: ([2, 2], True), 2: ([1, 0], True), 3: ([2, 2], True), 4: ([0, 0], True), 5: ([3, 1], True), 6: ([0, 0], True)}
    assert run(failing("bad", "other")) == 4  # another embedder has vectors of its own
    worse = df.where("id = 1").withColumn("content", F.lit("worse"))
    assert [run(failing("worse"), worse, attempts=3) for _ in range(4)] == [1, 1, 1, 0]
    assert vectors.embed_stored(worse, failing("worse"), root).first().embed_ok is False
    assert vectors.embed_stored(df.limit(0), failing("bad"), root).count() == 0
    assert vectors.embed_stored(df.limit(0), failing("bad"), str(tmp_path / "new")).count() == 0


@pytest.mark.parametrize("column", ["embedding", "embed_ok"])
def test_stored_vectors_keep_other_columns(spark, tmp_path, column):
    df = spark.createDataFrame([(1, "aa", "x")], "id long, content string, digest string")
    got = vectors.embed_stored(df, failing("bad"), str(tmp_path / "v")).first()
    assert got.digest == "x" and got[column] is not None


def test_chunks_are_embedded_in_one_python_pass(spark, sf_dir):
    from quarry.operators import chunking
    from quarry.plans import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = chunking.chunk_lines(docs, ["doc_id"], by=hashing_embedder(64))
    two = embed(chunking.chunk_lines(docs, ["doc_id"]), hashing_embedder(64), precise=True)
    assert one.schema == two.schema and one.exceptAll(two).count() == 0 and one.count() == two.count()
    plan = queries._indexed(queries._index_files(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_fit_reads_texts_once(spark, monkeypatch):
    """The passes of a fit go over stored counts: texts are taken apart once, whatever the number of passes is."""
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, f"word{i % 7} word{i % 11} other" if i % 9 else None) for i in range(60)], "id long, content string").coalesce(1)

    def run(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rows = df.mapInArrow(run, "id long, content string")
    many = fitted.fit(rows, dim=4, passes=5)
    assert calls.value == 60
    few = fitted.fit(df, dim=4, passes=5, rows=fitted.counted(df))
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(many, few))
    assert fitted.document_counts(df, "content")[0] == 53


def test_dense_slices_equal_sparse_ones(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(400))) for _ in range(40)]
    thin, rarity = np.random.default_rng(1).normal(size=(fitted.FEATURES, 6)), np.ones(fitted.FEATURES)
    rows = fitted.Rows(texts, rarity, {})
    assert rows._dense() is not None
    assert np.allclose(rows.there_and_back(thin), rows.back(rows.times(thin)), atol=1e-9)
