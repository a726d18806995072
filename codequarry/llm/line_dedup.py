"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from codequarry.llm.common import id_and_text, lower_ascii
from codequarry.session import cut, shared_folder

RUN = StructType([StructField("key", BinaryType()), StructField("docs", LongType()), StructField("last_id", LongType())])
EDGE_SPACES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def line_key(line: Column) -> Column:
    return lower_ascii(F.regexp_replace(line, EDGE_SPACES, ""))


class LineRuns:
    """Runs of (key, docs, last_id) in the shared folder, sorted by key inside their parts.

    A run of level L+1 is the merge of ``fanout`` runs of level L, so a key is rewritten a logarithmic number of
    times. A run, once written, never changes: a lost executor costs a retried task only.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder = shared_folder(spark, f"line-runs-{uuid.uuid4().hex}")
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.folder}/level{level}-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("key").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def merged(self, paths: list[str] | None = None) -> DataFrame:
        """All runs as one: counts added up, the largest id of each key."""
        paths = [p for level in self.levels for p in level] if paths is None else paths
        if not paths:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*paths).groupBy("key").agg(F.sum("docs").alias("docs"), F.max("last_id").alias("last_id"))

    def settled(self) -> DataFrame:
        """Keys found in enough documents already; later batches, which hold smaller ids, cannot change them."""
        return self.merged().filter(F.col("docs") >= self.min_docs)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (doc_id, key), whose ids lie below those of earlier batches: what the runs have not settled becomes a run."""
        own = lines.groupBy("key").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last_id"))
        if any(self.levels):
            own = own.join(self.settled().select("key"), "key", "left_anti")
        self._write(own, 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                paths, self.levels[level] = self.levels[level], []
                self._write(self.merged(paths), level + 1)
            level += 1


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """(doc_id, dropped): for each document that loses lines, their numbers from 0. Null ids take no part."""
    spark = docs.sparkSession
    folder = shared_folder(spark, f"line-keys-{uuid.uuid4().hex}")
    bounds = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).head()[0] if batches > 1 else None
    batch = F.lit(0)
    for bound in sorted(set(bounds or [])):
        batch = batch + F.when(F.col("doc_id") >= bound, 1).otherwise(0)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).select("doc_id", "line_no", line_key(F.col("line")).alias("body"))
    keyed = lines.filter((F.length("body") >= min_chars) & F.col("doc_id").isNotNull()).select("doc_id", "line_no", F.unhex(F.md5("body")).alias("key"), batch.alias("batch"))
    keyed.write.partitionBy("batch").parquet(folder)
    schema = StructType([StructField("doc_id", LongType()), StructField("line_no", IntegerType()), StructField("key", BinaryType()), StructField("batch", IntegerType())])
    stored = spark.read.schema(schema).parquet(folder)
    runs = LineRuns(spark, min_docs)
    for number in range(len(set(bounds or [])), -1, -1):
        runs.add(stored.filter(F.col("batch") == number).select("doc_id", "key"))
    settled = cut(runs.settled().select("key", "last_id"))  # a stored side lets the join split a key that a third of all lines have
    doomed = stored.join(settled, "key").filter(F.col("doc_id") != F.col("last_id"))
    return doomed.groupBy("doc_id").agg(F.collect_set("line_no").alias("dropped"))


def deduplicate_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, plus n_lines and n_dropped.

    A line's key is the line without white space at its ends and with A-Z lower-cased, hashed to 128 bits. Keys of
    at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except in the
    largest doc_id holding them. Documents go into the runs in ``batches`` from the largest ids down, so the first
    batch that holds a key has its largest id, and a key that is settled never enters a run again. Null and empty
    texts are one empty line. Rows with one doc_id are one document for counting; rows with a null id are left as they
    are. Columns named n_lines or n_dropped are replaced. A document's dropped line numbers are no more than its lines.
    """
    plain = id_and_text(docs)
    gone = repeated_lines(plain, min_chars, min_docs, batches).withColumnsRenamed({"doc_id": "__line_doc", "dropped": "__dropped"})
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    body = docs.withColumn("__body", F.coalesce(F.col("text"), F.lit("")))
    joined = body.join(gone, F.col("doc_id").cast("long") == F.col("__line_doc"), "left")
    pieces = F.split("__body", "\n", -1)
    kept = F.array_join(F.filter(pieces, lambda line, i: ~F.array_contains(F.col("__dropped"), i)), "\n")
    return joined.select(
        *rest, F.when(F.col("__dropped").isNull(), F.col("__body")).otherwise(kept).alias("text"),
        F.size(pieces).cast("long").alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
