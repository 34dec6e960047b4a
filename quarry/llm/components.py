"""Connected components of links, by alternating large-star and small-star steps.

Each round joins every node to the least node among its neighbours, first for larger neighbours, then for
smaller ones; when a round changes nothing each node is linked to the least of its component. Rounds grow
with the logarithm of a component's size. Links are written to the shared folder after each round. A node
with very many neighbours meets only minimum aggregates, which Spark combines before the shuffle, and joins
that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b). Large star: each larger neighbour of a node goes to the least of its neighbourhood;
    small star: the smaller neighbours and the node itself do."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        joined = links.join(least.hint("merge"), "a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected(pairs: DataFrame) -> DataFrame:
    """(node, component) of every node that a pair (a, b) links to another; component: its least node."""
    links = stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        links = stored(_star(_star(links, True), False))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
