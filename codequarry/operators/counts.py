"""Counting operators shared by the statistics reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value combination, most frequent first."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *columns)


def top(df: DataFrame, column: str, k: int = 10, alias: str = "n") -> DataFrame:
    """The ``k`` most frequent values; a partial aggregate precedes the shuffle, so a hot value is cheap."""
    return df.groupBy(column).agg(F.count("*").alias(alias)).orderBy(F.col(alias).desc(), column).limit(k)


def count_by_each(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by every single column and in total, in one pass (grouping sets)."""
    sets = [[]] + [[c] for c in columns]
    width = len(columns)
    grouped = df.groupingSets(sets, *columns).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    everything = (1 << width) - 1
    name: Column = F.lit("total")
    for i, column in enumerate(columns):
        name = F.when(F.col("g") == everything - (1 << (width - 1 - i)), column).otherwise(name)
    return grouped.select(name.alias("dimension"), F.coalesce(*[F.col(c).cast("string") for c in columns], F.lit("all")).alias("value"), "n")


def keep_one(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``.

    An aggregate of whole rows, so copies of a hot key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    row = F.struct(*[F.col(c) for c in rest])
    chosen = F.max_by(row, rank) if last else F.min_by(row, rank)
    return df.groupBy(*keys).agg(chosen.alias("row")).select(*keys, "row.*").select(*df.columns)
