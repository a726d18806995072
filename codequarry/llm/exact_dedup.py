"""Exact deduplication: group by a 128-bit content hash, compare bytes inside groups, keep the smallest id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from codequarry.llm.common import SPACES, id_and_text
from codequarry.session import cut


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space is made one space; null counts as empty and
    forms one group with empty texts. The key of the first aggregation is (hash, text): Spark compares the bytes
    of equal hashes there, and copies collapse inside each task before the shuffle, so a hot group sends one row
    per task. Rows then find their group by hash alone; only hashes that two texts share are joined by text as
    well. Rows that repeat one doc_id with one text all carry ``kept``: the id names the document. A null doc_id
    stays only where its group has no other id. Other columns are ignored; an empty table gives no rows.
    """
    base = id_and_text(docs).select("doc_id", F.regexp_replace("text", SPACES, " ").alias("body"))
    keyed = base.select("doc_id", "body", hashed(F.col("body")).alias("hash"))
    groups = keyed.groupBy("hash", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    short = groups.select("hash", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256"))
    per_hash = short.groupBy("hash").agg(
        F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"), F.min("text_sha256").alias("text_sha256"),
    )
    table = cut(per_hash)
    rows = keyed.select("doc_id", "hash").join(table.filter("texts = 1"), "hash")
    clashing = table.filter("texts > 1").select("hash")
    if not clashing.isEmpty():
        among = keyed.join(clashing, "hash", "left_semi")
        sized = among.groupBy("hash", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        rows = rows.drop("texts").unionByName(among.join(sized, ["hash", "body"]).withColumn("text_sha256", F.sha2("body", 256)).drop("body"))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi")
