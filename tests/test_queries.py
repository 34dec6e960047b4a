"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from quarry.plans.queries import ORACLES, QUERIES

TABLES = ("documents", "embeddings", "benchmark", "conversations", "labels", "pages")


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_ivf_recall(spark, sf_dir):
    exact = {(r.query_id, r.id) for r in QUERIES["knn_exact"](spark, sf_dir).collect()}
    found = {(r.query_id, r.id) for r in QUERIES["knn_ivf"](spark, sf_dir).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
