"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquill.session import materialize


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node with a link other than to itself.

    ``links`` has two columns of one type. Every round is written, so a lost executor costs one round. Rounds grow with the
    logarithm of the nodes. A round's joins are on single nodes and left to adaptive skew splitting for nodes with many links.
    """
    first, second = (F.col(column) for column in links.columns)
    edges = links.where(first != second).select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"))
    edges = materialize(edges.distinct(), "links")
    before = None
    while (now := _mark(edges)) != before:
        before = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialize(large, "large-star")
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(lowest, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = materialize(moved.unionAll(lowest.select("a", F.col("low").alias("b"))).distinct(), "small-star")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
