"""Vectors stored by content, so that building again embeds only what was never embedded.

The store is a table of (embedder, digest of the content, vector, embed_ok, attempt). A run embeds each distinct content
that has no good vector and fewer than ``attempts`` failures, appends what came out, good or failed, and joins the
vectors to all rows. A run that stops half-way has stored nothing or its whole table; what is there is used by the next. Rows
whose content failed have a zero vector and embed_ok false, and are tried again by later runs until they are given up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.embed import BATCH, Embedder, embed
from quarry.operators import snapshots
from quarry.operators.index import content_digest

ATTEMPTS = 3
STORED = "embedder string, digest binary, embedding array<double>, embed_ok boolean, attempt int"


def best(spark: SparkSession, root: str, embedder: str) -> DataFrame:
    """(digest, embedding, embed_ok, attempt): a good vector of each content if there is one, else its last failure."""
    if not snapshots.exists(spark, root):
        return spark.createDataFrame([], STORED).drop("embedder")
    own = spark.read.schema(STORED).parquet(root).where(F.col("embedder") == embedder)
    return own.groupBy("digest").agg(F.max_by(F.struct("embedding", "embed_ok", "attempt"), F.struct("embed_ok", "attempt")).alias("x")).select("digest", "x.*")


def embed_missing(df: DataFrame, by: Embedder, root: str, text_col: str = "content", attempts: int = ATTEMPTS, batch: int = BATCH) -> int:
    """Embed the contents of ``df`` that lack a good vector; returns how many were tried. Null texts count as empty."""
    spark = df.sparkSession
    wanted = df.select(content_digest(F.coalesce(text_col, F.lit(""))).alias("digest"), F.coalesce(text_col, F.lit("")).alias("content"))
    state = best(spark, root, by.name).select("digest", F.col("attempt"), F.col("embed_ok").alias("ok"))
    settled = state.where(F.col("ok") | (F.col("attempt") >= attempts)).select("digest")
    left = wanted.join(settled.hint("merge"), "digest", "left_anti").groupBy("digest").agg(F.first("content").alias("content"))
    tried = left.join(state.select("digest", "attempt").hint("merge"), "digest", "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)) + 1)
    done = embed(tried, by, "content", batch, precise=True).select(F.lit(by.name).alias("embedder"), "digest", "embedding", "embed_ok", F.col("attempt").cast("int").alias("attempt"))
    before = spark.read.schema(STORED).parquet(root).count() if snapshots.exists(spark, root) else 0
    done.write.mode("append").partitionBy("embedder").parquet(root)
    return spark.read.schema(STORED).parquet(root).count() - before


def embed_stored(df: DataFrame, by: Embedder, root: str, text_col: str = "content", attempts: int = ATTEMPTS, batch: int = BATCH) -> DataFrame:
    """``df`` with embedding and embed_ok from the store at ``root``, after what it lacks was embedded. Copies of a content
    share one vector; the join that hands it to many rows can be split."""
    embed_missing(df, by, root, text_col, attempts, batch)
    keyed = df.withColumn("_digest", content_digest(F.coalesce(text_col, F.lit(""))))
    found = best(df.sparkSession, root, by.name).select(F.col("digest").alias("_digest"), "embedding", "embed_ok")
    return keyed.join(found.hint("merge"), "_digest", "left").drop("_digest")
