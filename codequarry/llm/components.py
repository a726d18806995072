"""Connected components by alternating stars: every step is an aggregate and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codequarry.session import cut


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links reach, for each id of a link (a, b). Nulls and loops are ignored.

    Each step hangs the larger neighbours of an id under its smallest neighbour, then the smaller ones; the minimum of
    a neighbourhood is an aggregate with partial sums, so a hub costs one row per task. Steps end when nothing moves:
    after about the logarithm of the longest chain.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("id")))
