"""Snapshots, differences and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codequarry.operators.counts import keep_one


def snapshot_diff(before: DataFrame, now: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """New, modified and deleted files by modification time and size (columns ``mtime``, ``size``)."""
    keys = keys or ["repo_name", "file_path"]
    old = before.select(*keys, F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"))
    new = now.select(*keys, F.col("mtime").alias("new_mtime"), F.col("size").alias("new_size"))
    change = (
        F.when(F.col("old_mtime").isNull(), "new")
        .when(F.col("new_mtime").isNull(), "deleted")
        .when((F.col("old_mtime") != F.col("new_mtime")) | (F.col("old_size") != F.col("new_size")), "modified")
    )
    return old.join(new, keys, "full_outer").withColumn("change", change).where("change is not null").select(*keys, "change")


def first_change_wins(committed: DataFrame, working_tree: DataFrame) -> DataFrame:
    """Committed changes before uncommitted ones; one row per path."""
    both = committed.withColumn("rank", F.lit(0)).unionByName(working_tree.withColumn("rank", F.lit(1)))
    return keep_one(both, ["repo_name", "file_path"], [F.col("rank"), F.col("change")]).drop("rank")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], wins: str = "last", order: list[str] | None = None) -> DataFrame:
    """Existing and incoming rows, one per key. Within one side ``order`` decides, then the whole row."""
    tie = order or [c for c, t in existing.dtypes if not t.startswith("map")]
    both = existing.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)))
    return keep_one(both, keys, [F.col("__side"), *[F.col(c) for c in tie]], last=(wins == "last")).drop("__side")


def without_files(df: DataFrame, gone: DataFrame, path: str = "file_path") -> DataFrame:
    """Rows of files that did not vanish or change."""
    return df.join(gone.select("repo_name", F.col("file_path").alias(path)).distinct(), ["repo_name", path], "left_anti")


def files_of_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Manifest rows: every scanned file with the ids of its chunks (none for an empty file)."""
    ids = chunks.groupBy("repo_name", "file_path").agg(F.sort_array(F.collect_list("id")).alias("chunk_ids"))
    return files.join(ids, ["repo_name", "file_path"], "left").select(
        "repo_name", "file_path", "mtime", "size", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids")
    )
