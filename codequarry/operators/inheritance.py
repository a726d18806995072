"""Inheritance edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codequarry.operators.counts import top
from codequarry.operators.graph import spread
from codequarry.operators.symbols import in_repo


def implementations(inheritance: DataFrame, parent: str, repo: str | None = None) -> DataFrame:
    return in_repo(inheritance, repo).where(F.col("parent_name") == parent).withColumn("indirect", F.lit(False)).orderBy("child_name", "file_path", "line_number")


def all_implementations(inheritance: DataFrame, parent: str, repo: str | None = None) -> DataFrame:
    """Direct and indirect children; a child of two reached parents is listed under both."""
    edges = in_repo(inheritance, repo)
    seeds = edges.sparkSession.range(1).select(F.lit(parent).alias("node"))
    reached = spread(edges, seeds, "parent_name", "child_name", seeds_visited=True).select(F.col("node").alias("parent_name"))
    return edges.join(reached, "parent_name", "left_semi").withColumn("indirect", F.col("parent_name") != parent).select(*edges.columns, "indirect")


def parents(inheritance: DataFrame, child: str, repo: str | None = None) -> DataFrame:
    return in_repo(inheritance, repo).where(F.col("child_name") == child).orderBy("parent_name")


def hierarchy(inheritance: DataFrame, name: str, repo: str | None = None) -> DataFrame:
    """Relatives of one class as rows: implements, extends, implemented_by, extended_by."""
    edges = in_repo(inheritance, repo)
    up = edges.where(F.col("child_name") == name).select(
        F.when(F.col("relation_type") == "implements", "implements").otherwise("extends").alias("relation"), F.col("parent_name").alias("name")
    )
    down = edges.where(F.col("parent_name") == name).select(
        F.when(F.col("relation_type") == "implements", "implemented_by").otherwise("extended_by").alias("relation"), F.col("child_name").alias("name")
    )
    return up.unionByName(down)


def stats(inheritance: DataFrame) -> DataFrame:
    """Total, counts by relation, and the ten most frequent parents, as labelled rows."""
    by_relation = (
        inheritance.groupingSets([[], ["relation_type"]], "relation_type")
        .agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
        .select(F.when(F.col("g") == 1, "total").otherwise("relation").alias("dimension"), F.coalesce("relation_type", F.lit("all")).alias("value"), "n")
    )
    frequent = top(inheritance, "parent_name", 10).select(F.lit("parent").alias("dimension"), F.col("parent_name").alias("value"), "n")
    return by_relation.unionByName(frequent)
