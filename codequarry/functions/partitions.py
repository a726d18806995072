"""Partition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Narrow rows with heavy work that one task takes.
ROWS_PER_TASK = 20_000


def widened(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores if it has fewer tasks than cores.

    One small file is one task, whatever runs on each row. A scan of many splits, which is every
    large table, is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if tasks >= cores else df.repartition(cores)


def dealt(df: DataFrame) -> DataFrame:
    """Deal out the rows of a narrow table whose rows become heavy, such as texts to parse, in even shares.

    Splits of a file do not tell how many tasks get rows: a row group belongs to one split, and a million narrow rows fit
    into one. The shuffle moves only the columns that are used.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // ROWS_PER_TASK)))
