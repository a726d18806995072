"""Answers merged from a language server, where there is one, and from the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codequarry.operators.counts import keep_one
from codequarry.operators.symbols import in_repo, lookup

LOCATION = "file_path string, line int, context string, repo_name string, confidence double, backend string"


def no_server(df: DataFrame) -> DataFrame:
    """What an unavailable language server answers: nothing, in the right shape."""
    return df.sparkSession.createDataFrame([], LOCATION)


def definition(symbols: DataFrame, name: str, repo: str | None = None) -> DataFrame:
    return lookup(symbols, name, repo).limit(1).select(
        "name", "qualified_name", "symbol_type", "file_path", F.col("start_line").alias("line"), "repo_name", F.lit(0.9).alias("confidence"), F.lit("index").alias("backend")
    )


def references(calls: DataFrame, name: str, repo: str | None = None, server: DataFrame | None = None) -> DataFrame:
    """Call sites of a symbol; a place the server also knows is the server's, with confidence 1."""
    from_index = in_repo(calls, repo).where(F.col("callee") == name).select(
        F.col("caller_file").alias("file_path"), F.col("caller_line").alias("line"), F.col("caller").alias("context"), "repo_name", F.lit(0.85).alias("confidence"), F.lit("index").alias("backend")
    )
    from_server = server if server is not None else no_server(calls)
    ranked = from_server.withColumn("source", F.lit(0)).unionByName(from_index.withColumn("source", F.lit(1)))
    return keep_one(ranked, ["file_path", "line"], [F.col("source"), F.col("repo_name"), F.col("context")]).drop("source")


def implementations(inheritance: DataFrame, name: str, repo: str | None = None) -> DataFrame:
    return in_repo(inheritance, repo).where(F.col("parent_name") == name).select(
        F.col("child_name").alias("name"), "file_path", F.col("line_number").alias("line"), "repo_name", F.lit(0.85).alias("confidence"), F.lit("index").alias("backend")
    )


def hierarchy(inheritance: DataFrame, name: str, repo: str | None = None) -> DataFrame:
    from codequarry.operators.inheritance import hierarchy as relatives

    return relatives(inheritance, name, repo).withColumn("confidence", F.lit(0.9)).withColumn("backend", F.lit("index"))
