"""Stored tables: Parquet by repository and file bucket.

A bucket is a hash of the file path, so an update rewrites the buckets of the changed files, never
a whole repository. Writes are staged in the shared folder first, since a table cannot be
overwritten from itself, then replace whole partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codequarry import schema
from codequarry.operators.snapshots import upsert
from codequarry.session import shared_folder

BUCKETS = 64
TABLES = {
    "chunks": (schema.CHUNK, "file_path", "name"),
    "calls": (schema.CALL, "caller_file", "callee"),
    "inheritance": (schema.INHERITANCE, "file_path", "parent_name"),
    "class_dependencies": (schema.CLASS_DEPENDENCY, "class_name", "class_name"),
    "embeddings": (schema.EMBEDDING, "id", "id"),
    "manifest": (schema.MANIFEST, "file_path", "file_path"),
    "endpoints": (schema.ENDPOINT, "file_path", "qualified_name"),
    "api_calls": (schema.API_CALL, "file_path", "url"),
    "route_links": (schema.ROUTE_LINK, "call_id", "endpoint_id"),
}
# columns asked for by value: a bloom filter per row group lets a scan skip the others
LOOKUPS = {"chunks": ["id", "name"], "calls": ["caller", "callee"], "inheritance": ["child_name", "parent_name"], "embeddings": ["id"]}


class Store:
    """The tables below one folder. Choose ``buckets`` so that a bucket of the largest repository is about a gigabyte."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _filesystem(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def exists(self, table: str) -> bool:
        filesystem, target = self._filesystem(self.path(table))
        return filesystem.exists(target)

    def read(self, table: str) -> DataFrame:
        """A table, empty before its first write; the schema is fixed, so repository names stay texts."""
        ddl = TABLES[table][0]
        if not self.exists(table):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(f"{ddl}, bucket int").parquet(self.path(table)).drop("bucket")

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, df: DataFrame) -> None:
        """Replace the partitions that occur in ``df``; rows are sorted by the lookup column for min/max skipping."""
        ddl, path_column, lookup = TABLES[table]
        spread = df.withColumn("bucket", self._bucket(path_column))
        # rebalancing merges small buckets into one task and splits a bucket that outgrows a task
        laid_out = spread.hint("rebalance", F.col("repo_name"), F.col("bucket")).sortWithinPartitions("repo_name", "bucket", lookup)
        writer = laid_out.write.mode("overwrite")
        for column in LOOKUPS.get(table, []):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("repo_name", "bucket").parquet(self.path(table))

    def _escaped(self, repo: str) -> str:
        return self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo)

    def _partitions(self, table: str, repos: list[str]) -> set[tuple[str, int]]:
        """Buckets present for some repositories: a listing of folders, no scan."""
        found = set()
        for repo in repos:
            filesystem, target = self._filesystem(f"{self.path(table)}/repo_name={self._escaped(repo)}")
            if filesystem.exists(target):
                names = [status.getPath().getName() for status in filesystem.listStatus(target)]
                found |= {(repo, int(n.removeprefix("bucket="))) for n in names if n.startswith("bucket=")}
        return found

    def _drop_partitions(self, table: str, partitions: set[tuple[str, int]]) -> None:
        for repo, bucket in partitions:
            filesystem, target = self._filesystem(f"{self.path(table)}/repo_name={self._escaped(repo)}/bucket={bucket}")
            filesystem.delete(target, True)

    def staged(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df`` written to the shared folder and read back; ``by`` lets readers prune on a column."""
        folder = f"{shared_folder(self.spark, 'staging')}/{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def replace_repos(self, table: str, df: DataFrame, repos: list[str]) -> None:
        """All rows of the repositories become ``df``, which must not read this very table."""
        before = self._partitions(table, repos)
        self._write(table, df)
        column = TABLES[table][1]
        after = {(r[0], r[1]) for r in df.select("repo_name", self._bucket(column).alias("bucket")).distinct().collect()} if before else set()
        self._drop_partitions(table, before - after)

    def replace_files(self, table: str, df: DataFrame, changed: DataFrame) -> None:
        """Rows of the changed files (repo_name, file_path) become ``df``; other files keep theirs."""
        column = TABLES[table][1]
        keys = changed.select("repo_name", F.col("file_path").alias(column)).distinct()
        touched = keys.select("repo_name", self._bucket(column).alias("bucket")).distinct()
        pairs = {(r[0], r[1]) for r in touched.collect()}  # at most buckets x changed repositories
        if not pairs:
            return
        kept = self.spark.createDataFrame([], TABLES[table][0])
        if self.exists(table):
            stored = self.spark.read.schema(f"{TABLES[table][0]}, bucket int").parquet(self.path(table))
            wanted = F.lit(False)
            for repo in {r for r, _ in pairs}:
                wanted = wanted | ((F.col("repo_name") == repo) & F.col("bucket").isin(sorted(b for r, b in pairs if r == repo)))
            kept = stored.where(wanted).join(keys, ["repo_name", column], "left_anti").select(*kept.columns)
        staged = self.staged(kept.unionByName(df.select(*kept.columns)))
        self._write(table, staged)
        after = {(r[0], r[1]) for r in staged.select("repo_name", self._bucket(column).alias("bucket")).distinct().collect()}
        self._drop_partitions(table, pairs - after)

    def upsert(self, table: str, df: DataFrame) -> dict[str, int]:
        """Add rows by key; returns how many came in and how many keys they are."""
        keys, wins = schema.KEYS[table]
        column = TABLES[table][1]
        staged = self.staged(df)
        touched = staged.select("repo_name", self._bucket(column).alias("bucket")).distinct()
        pairs = {(r[0], r[1]) for r in touched.collect()}
        old = self.spark.createDataFrame([], TABLES[table][0])
        if self.exists(table) and pairs:
            stored = self.spark.read.schema(f"{TABLES[table][0]}, bucket int").parquet(self.path(table))
            wanted = F.lit(False)
            for repo in {r for r, _ in pairs}:
                wanted = wanted | ((F.col("repo_name") == repo) & F.col("bucket").isin(sorted(b for r, b in pairs if r == repo)))
            old = stored.where(wanted).select(*old.columns)
        self._write(table, self.staged(upsert(old, staged, keys, wins, [keys[0]])))
        return {"received": staged.count(), "distinct": staged.select(*keys).distinct().count()}

    def delete_files(self, files: DataFrame) -> None:
        """Drop everything that came from some files (repo_name, file_path)."""
        keys = self.staged(files.select("repo_name", "file_path").distinct())
        chunks = self.staged(self.read("chunks").join(keys, ["repo_name", "file_path"], "left_semi").select("repo_name", "id", "chunk_type", "name"))
        for table in ("chunks", "calls", "inheritance", "manifest"):
            self.replace_files(table, self.spark.createDataFrame([], TABLES[table][0]), keys)
        self.replace_files("embeddings", self.spark.createDataFrame([], schema.EMBEDDING), chunks.select("repo_name", F.col("id").alias("file_path")))
        classes = chunks.where("chunk_type = 'class'").select("repo_name", F.col("name").alias("file_path"))
        self.replace_files("class_dependencies", self.spark.createDataFrame([], schema.CLASS_DEPENDENCY), classes)

    def delete_chunks(self, ids: DataFrame) -> None:
        """Drop chunks and their vectors by id (repo_name, id)."""
        keys = self.staged(ids.select("repo_name", "id").distinct())
        chunks = self.read("chunks")
        files = self.staged(chunks.join(keys, ["repo_name", "id"], "left_semi").select("repo_name", "file_path").distinct())
        kept = chunks.join(files, ["repo_name", "file_path"], "left_semi").join(keys, ["repo_name", "id"], "left_anti").select(*chunks.columns)
        self.replace_files("chunks", kept, files)
        self.replace_files("embeddings", self.spark.createDataFrame([], schema.EMBEDDING), keys.select("repo_name", F.col("id").alias("file_path")))

    def clear_repo(self, repo: str) -> None:
        """Drop a repository from every table."""
        for table in TABLES:
            filesystem, target = self._filesystem(f"{self.path(table)}/repo_name={self._escaped(repo)}")
            filesystem.delete(target, True)

    def clear_all(self) -> None:
        for table in TABLES:
            filesystem, target = self._filesystem(self.path(table))
            filesystem.delete(target, True)

    def last_commit(self, repo: str) -> str | None:
        """The commit the repository was indexed at."""
        if not self.exists("commits"):
            return None
        row = self.spark.read.schema("commit string, repo_name string").parquet(self.path("commits")).where(F.col("repo_name") == repo).first()
        return row[0] if row else None

    def save_commit(self, repo: str, commit: str) -> None:
        row = self.spark.createDataFrame([(commit, repo)], "commit string, repo_name string")
        row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_name").parquet(self.path("commits"))
