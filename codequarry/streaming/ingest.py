"""Index new and changed files as they arrive.

The stream only names files; every micro-batch is an incremental update of the stored tables.
A file stream cannot see deletions: run ``update_repo`` on a full scan now and then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from codequarry.operators import counts, search, snapshots
from codequarry.plans.indexing import _deduplicated, _parse
from codequarry.plans.store import Store
from codequarry.sources import files as sf


def file_stream(store: Store, root: str, glob: str = sf.SOURCE_GLOB, files_per_batch: int = 1000) -> DataFrame:
    """Arriving files below ``root/<repository>/``."""
    plain = F.regexp_replace("path", "^file:/+", "/")
    relative = F.regexp_replace(plain, "^" + sf.rx.quote(root.rstrip("/")) + "/", "")
    stream = (
        store.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(root)
    )
    return stream.select(relative.alias("relative"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), "content").select(
        F.substring_index("relative", "/", 1).alias("repo_name"), F.regexp_replace("relative", "^[^/]*/", "").alias("file_path"), "size", "mtime", "content"
    )


def apply_batch(store: Store, files: DataFrame, model: str = "mock") -> None:
    """Replace the arrived files in every table. A replayed batch gives the same tables."""
    latest = store.staged(counts.keep_one(sf.source_files(files), ["repo_name", "file_path"], [F.col("mtime")], last=True))
    if latest.isEmpty():
        return
    tables = _parse(store, latest)
    keys = latest.select("repo_name", "file_path")
    old = store.read("chunks").join(keys, ["repo_name", "file_path"], "left_semi").select("repo_name", F.col("id").alias("file_path"))
    ids = store.staged(old.unionByName(tables.chunks.select("repo_name", F.col("id").alias("file_path"))).distinct())
    for table in ("chunks", "calls", "inheritance"):
        store.replace_files(table, _deduplicated(table, getattr(tables, table)), keys)
    store.replace_files("embeddings", search.embed_chunks(_deduplicated("chunks", tables.chunks), model), ids)
    store.replace_files("manifest", snapshots.files_of_chunks(latest.drop("content"), tables.chunks), keys)


def start(store: Store, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run over the files waiting now, or keep running."""
    writer = file_stream(store, root).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply_batch(store, batch))
    return (writer.trigger(availableNow=True) if once else writer).start()
