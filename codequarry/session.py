"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of an execution go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "codequarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; extra ``conf`` wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # a stored sort order by callee or name only pays off with filters pushed to the reader
        "spark.sql.parquet.filterPushdown": "true",
        # building large column trees is several times faster without a call site per column
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # a page of search hits is asked for by id
        "spark.sql.parquet.pushdown.inFilterThreshold": "100",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a folder of this machine.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="codequarry-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Materialize ``df`` as a table in the shared folder and drop its lineage.

    Unlike a checkpointed RDD a written table has a size, so the planner broadcasts a small
    frontier and shuffles only when it has to; and an executor lost later costs nothing.
    With ``drop_shuffles`` the shuffle files of the write go as soon as the table is there, not when the driver collects garbage.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, f"cuts-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}")
    if drop_shuffles:
        before = spark.conf.get(SHUFFLE_CLEANUP, "false")
        spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(folder)
        finally:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    else:
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_cut(table: DataFrame) -> None:
    """Remove a table that ``cut`` wrote, before the application ends; frames built on it are gone too."""
    spark = table.sparkSession
    for folder in {os.path.dirname(f) for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder below the checkpoint folder, for staged tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def drop_cuts(spark: SparkSession) -> None:
    """Remove the tables ``cut`` wrote for this application; frames built on them are gone too."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark, f"cuts-{spark.sparkContext.applicationId}"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
