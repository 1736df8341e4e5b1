"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Point neighbours (the larger ones, or with ``small`` the smaller ones) at the least neighbour."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if small:
        out = linked.select(F.col("v").alias("a"), "m").unionByName(least.select(F.col("u").alias("a"), "m"))
    else:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), "m")
    return out.filter("a > m").distinct().select(F.col("a").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of ``edges`` reaches.

    Each round is written to the shared folder; it ends when a round changes nothing.
    """
    now = edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stored(now, "cc")
    mark = None
    while True:
        now = stored(_star(_star(now, False), True), "cc")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == mark:
            break
        mark = (row[0], row[1])
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
