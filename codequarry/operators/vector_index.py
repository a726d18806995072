"""Inverted lists of vectors: a coarse quantiser, a table partitioned by list, searches that read the nearest lists.

The quantiser is fitted on a bounded sample, then every vector goes to the list of its nearest centroid. A list knows how
far its farthest vector lies from the centroid, so a search can also prove which lists cannot hold a better hit: ``exact``
reads the nearest lists first, then those that the proof leaves, and gives the rows of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codequarry.functions import vectors
from codequarry.session import cut

#: Rows that the quantiser is fitted on at most: chosen by a hash of the key, so any corpus gives an even sample.
SAMPLE = 32_768
#: Vectors of one list that one task scores; a longer list is dealt out to several tasks.
ROWS_PER_TASK = 65_536
#: Queries of one block of a full scan; a task meets one block with one share of the vectors.
QUERIES_PER_TASK = 16_384
#: Scores that are held at once, whatever the numbers of queries, vectors and lists.
SCORES = 1 << 21
#: Lists without a centroid: vectors that have no direction (null, empty, all zeros, another dimension).
NOWHERE = -1
ROUNDING = 1e-6


def unit_rows(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, whether a row has a direction); rows without one are zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    dimension = dimension or max(int(lengths.max(initial=0)), 1)
    usable = lengths == dimension
    out = np.zeros((len(lists), dimension))
    if usable.any():
        out[usable] = lists.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    norms = np.sqrt(np.einsum("ij,ij->i", out, out))
    usable &= np.isfinite(norms) & (norms > 0)
    out[~usable] = 0.0
    return out / np.where(usable, norms, 1.0)[:, None], usable


def tiles(rows: int, width: int) -> Iterator[slice]:
    """Slices of ``rows`` whose scores against ``width`` others are few enough to hold."""
    step = max(1, SCORES // max(width, 1))
    return (slice(at, at + step) for at in range(0, rows, step))


def nearest_centroids(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, cosine to it) of each unit row."""
    own, best = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for part in tiles(len(rows), len(centroids)):
        cosines = rows[part] @ centroids.T
        own[part] = np.argmax(cosines, axis=1)
        best[part] = cosines[np.arange(len(cosines)), own[part]]
    return own, best


def best_of(queries: np.ndarray, rows: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the best ``k`` unit rows for each unit query; equal scores go by ``order``."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for part in tiles(len(queries), len(rows)):
        scores = np.maximum(0.0, 1.0 - (1.0 - queries[part] @ rows.T) / 2.0)
        floor = np.partition(scores, -k, axis=1)[:, -k] if k < len(rows) else np.zeros(len(scores))
        at, row = np.nonzero(scores >= floor[:, None])
        value = scores[at, row]
        sorted_ = np.lexsort((order[row], -value, at))
        at, row, value = at[sorted_], row[sorted_], value[sorted_]
        top = np.arange(len(at)) - np.searchsorted(at, at) < k
        found.append((at[top] + part.start, row[top], value[top]))
    return tuple(np.concatenate(c) for c in zip(*found))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts are spread out: each next one is the sample row farthest from all before it."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(lists, len(sample)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - ROUNDING:
            break  # every row equals some centroid
        chosen.append(far)
        nearest = np.maximum(nearest, sample @ sample[far])
    centroids = sample[chosen]
    for _ in range(rounds):
        own, _ = nearest_centroids(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norms = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        moved = np.where((norms > 0)[:, None], sums / np.where(norms > 0, norms, 1.0)[:, None], centroids)
        if np.abs(moved - centroids).max() < 1e-9:
            break
        centroids = moved
    return centroids


def highest_cosines(queries: np.ndarray, centroids: np.ndarray, reach: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The largest cosine a row of each list can have: its angle is at least the centroid's less the list's reach."""
    angle = np.arccos(np.clip(queries @ centroids.T, -1, 1))
    widest = np.arccos(np.clip(reach, -1, 1))
    return np.where(sizes > 0, np.cos(np.maximum(angle - widest, 0.0)), -2.0)


@dataclass
class VectorIndex:
    """``vectors``: the stored rows with ``list`` and ``cosine`` (to the centroid), partitioned by list. ``centroids``: one
    unit row per list; ``reach``: the smallest cosine in a list, ``sizes``: its rows. Both are bounded by the number of lists."""

    spark: SparkSession
    root: str
    key: str
    centroids: np.ndarray
    reach: np.ndarray
    sizes: np.ndarray
    columns: str

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.columns).parquet(f"{self.root}/vectors")

    # ---- building -----------------------------------------------------------------------

    @classmethod
    def build(cls, embeddings: DataFrame, root: str, key: str = "id", lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Fit on at most ``sample`` rows, then store every row. ``lists``: the root of the number of rows by default."""
        spark = embeddings.sparkSession
        lists = lists or max(1, round(math.sqrt(embeddings.count())))
        rows = embeddings.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64(key), key).limit(min(sample, 64 * lists)).select("embedding").toArrow()
        picked, usable = unit_rows(rows.column(0).combine_chunks()) if rows.num_rows else (np.zeros((0, 1)), np.zeros(0, bool))
        centroids = fit_centroids(picked[usable], lists) if usable.any() else np.zeros((0, 1))
        index = cls(spark, root.rstrip("/"), key, centroids, np.ones(len(centroids)), np.zeros(len(centroids), np.int64), "")
        index.columns = index.assigned(embeddings).schema.toDDL()
        index._append(embeddings, "overwrite")
        return index

    @classmethod
    def load(cls, spark: SparkSession, root: str, key: str = "id") -> VectorIndex:
        rows = spark.read.parquet(f"{root.rstrip('/')}/lists").orderBy("list").collect()  # one row per list
        centroids = np.array([r["centroid"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
        return cls(spark, root.rstrip("/"), key, centroids, np.array([r["reach"] for r in rows]), np.array([r["n"] for r in rows], dtype=np.int64), spark.read.parquet(f"{root.rstrip('/')}/columns").first()[0])

    def add(self, embeddings: DataFrame) -> None:
        """Assign more rows to the lists there are; keys must be new."""
        self._append(embeddings, "append")

    def _append(self, embeddings: DataFrame, mode: str) -> None:
        placed = self.assigned(embeddings).hint("rebalance", F.col("list")).sortWithinPartitions("list", self.key)
        placed.write.mode(mode).partitionBy("list").parquet(f"{self.root}/vectors")
        self.reach, self.sizes = np.ones(len(self.centroids)), np.zeros(len(self.centroids), np.int64)
        for r in self.vectors.where(F.col("list") >= 0).groupBy("list").agg(F.min("cosine").alias("reach"), F.count("*").alias("n")).collect():
            self.reach[r["list"]], self.sizes[r["list"]] = r["reach"], r["n"]
        self.spark.createDataFrame([(self.columns,)], "ddl string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/columns")
        rows = [(i, c.tolist(), float(r), int(n)) for i, (c, r, n) in enumerate(zip(self.centroids, self.reach, self.sizes))]
        self.spark.createDataFrame(rows, "list int, centroid array<double>, reach double, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/lists")

    def assigned(self, embeddings: DataFrame) -> DataFrame:
        """Every row with its list and the cosine to its centroid; map-only."""
        centroids = self.centroids

        @F.arrow_udf("struct<list:int,cosine:double>")
        def place(column: pa.Array) -> pa.Array:
            rows, usable = unit_rows(column, centroids.shape[1])
            if not len(centroids):
                usable[:] = False
                return pa.StructArray.from_arrays([pa.array(np.full(len(rows), NOWHERE, np.int32)), pa.array(np.zeros(len(rows)))], ["list", "cosine"])
            own, best = nearest_centroids(rows, centroids)
            return pa.StructArray.from_arrays([pa.array(np.where(usable, own, NOWHERE).astype(np.int32)), pa.array(best)], ["list", "cosine"])

        return embeddings.withColumn("placed", place("embedding")).select(*embeddings.columns, "placed.list", "placed.cosine")

    # ---- searching ----------------------------------------------------------------------

    def nearest(self, query: list[float], k: int, probes: int = 8, exact: bool = False, where: str | None = None) -> DataFrame:
        """Top k by cosine from the ``probes`` nearest lists, or of all rows if ``exact``. Only folders of these lists are
        read. ``where`` filters rows before the top k is taken."""
        wanted = np.asarray(query, dtype=np.float64)
        norm = np.sqrt(wanted @ wanted)
        if not len(self.centroids) or len(wanted) != self.centroids.shape[1] or not norm > 0:
            return self._scored([], query, k, where)
        unit = wanted / norm
        order = np.argsort(-np.where(self.sizes > 0, self.centroids @ unit, -2.0), kind="stable")
        first = [int(i) for i in order[:probes]]
        if exact:
            found = [r["score"] for r in self._scored(first, query, k, where).select("score").collect()]
            floor = found[-1] * 2 - 1 if len(found) == k else -1.0
            first = sorted({*first, *np.flatnonzero(highest_cosines(unit[None], self.centroids, self.reach, self.sizes)[0] >= floor - ROUNDING).tolist()})
        return self._scored(first, query, k, where)

    def _scored(self, lists: list[int], query: list[float], k: int, where: str | None) -> DataFrame:
        rows = self.vectors.where(F.col("list").isin(lists) if lists else F.lit(False))
        rows = (rows.where(where) if where else rows).drop("list", "cosine")
        scored = rows.withColumn("score", vectors.similarity_to(F.col("embedding"), query)).where("score is not null")
        return scored.drop("embedding").orderBy(F.col("score").desc(), self.key).limit(k)

    def nearest_many(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """(query, ``key``, score, rank) for every row (query, embedding): queries travel to the lists they probe."""
        first = self._met(self._routed(queries, probes), k)
        if exact:
            floor = ranked(first, self.key, k).groupBy("query").agg(F.min("score").alias("low"), F.count("*").alias("n"))
            floor = floor.select("query", F.when(F.col("n") >= k, F.col("low") * 2 - 1).otherwise(-1.0).alias("floor"))
            rest = queries.join(floor, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0)))
            first = first.unionByName(self._met(self._routed(rest, probes, beyond=True), k))
        return ranked(first, self.key, k)

    def probes_for(self, embeddings: DataFrame, queries: DataFrame, k: int = 10, wanted: float = 0.9, truth: DataFrame | None = None) -> int:
        """The fewest lists (1, 2, 4, ...) with which ``nearest_many`` finds the share ``wanted`` of what a full scan of the
        indexed rows finds for some sample queries; ``truth`` is that scan's result, if it is there already."""
        truth = cut(exact_many(embeddings, queries, k, self.key)) if truth is None else truth
        probes = 1
        while probes < len(self.centroids):
            share = recall(self.nearest_many(queries, k, probes), truth, self.key).first()["recall"]
            if share is None or share >= wanted:
                break
            probes *= 2
        return max(1, min(probes, len(self.centroids)))

    def _routed(self, queries: DataFrame, probes: int, beyond: bool = False) -> DataFrame:
        """A row (query, embedding, list) for each list a query probes, or for each further list that may hold a hit above its floor."""
        centroids, sizes, reach = self.centroids, self.sizes, self.reach

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for part in tiles(whole.num_rows, len(centroids)):
                    batch = whole.slice(part.start, part.stop - part.start)
                    rows, usable = unit_rows(batch.column("embedding"), centroids.shape[1])
                    order = np.argsort(-np.where(sizes > 0, rows @ centroids.T, -2.0), axis=1, kind="stable")
                    wanted = np.zeros(order.shape, dtype=bool)
                    np.put_along_axis(wanted, order[:, :probes], True, axis=1)
                    if beyond:
                        floor = batch.column("floor").to_numpy()
                        wanted = ~wanted & (highest_cosines(rows, centroids, reach, sizes) >= floor[:, None] - ROUNDING)
                    wanted &= usable[:, None] & (sizes > 0)
                    at, own = np.nonzero(wanted)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("query").take(pa.array(at)), batch.column("embedding").take(pa.array(at)), pa.array(own.astype(np.int32))], ["query", "embedding", "list"],
                    )

        if not len(centroids):
            return queries.where("false").select("query", "embedding", F.lit(0).alias("list"))
        types = dict(queries.dtypes)
        columns = ["query", "embedding", *(["floor"] if beyond else [])]
        return queries.select(*columns).mapInArrow(route, f"query {types['query']}, embedding {types['embedding']}, list int")

    def _met(self, routed: DataFrame, k: int) -> DataFrame:
        """The best k of each list for each query that probes it. Long lists are dealt out; their queries go to every share."""
        shares = np.maximum(1, -(-self.sizes // ROWS_PER_TASK))
        share_of = F.element_at(F.array(*[F.lit(int(s)) for s in shares]), F.col("list") + 1) if len(shares) and shares.max() > 1 else F.lit(1)
        asked = routed.withColumn("share", F.explode(F.sequence(F.lit(0), share_of - 1)))
        stored = self.vectors.where("list >= 0").select(self.key, "embedding", "list").withColumn("share", F.pmod(F.xxhash64(self.key), share_of).cast("int"))
        return met(asked, stored, ["list", "share"], k, self.key, self.centroids.shape[1])


def met(asked: DataFrame, stored: DataFrame, group: list[str], k: int, key: str, dimension: int) -> DataFrame:
    """(query, ``key``, score): the best k of the stored vectors of each group for each query asked there."""
    types = dict(stored.dtypes) | {"query": dict(asked.dtypes)["query"]}

    def score(asked: pa.Table, stored: pa.Table) -> pa.Table:
        schema = pa.schema([("query", asked.schema.field("query").type), (key, stored.schema.field(key).type), ("score", pa.float64())])
        if not asked.num_rows or not stored.num_rows:
            return schema.empty_table()
        rows, there = unit_rows(stored.column("embedding").combine_chunks(), dimension)
        wanted, usable = unit_rows(asked.column("embedding").combine_chunks(), dimension)
        names, queries = stored.column(key).combine_chunks().filter(pa.array(there)), asked.column("query").combine_chunks().filter(pa.array(usable))
        order = np.argsort(pc.sort_indices(names).to_numpy(), kind="stable")
        at, row, value = best_of(wanted[usable], rows[there], order, k)
        return pa.Table.from_arrays([queries.take(pa.array(at)), names.take(pa.array(row)), pa.array(value)], schema=schema)

    return asked.groupBy(*group).cogroup(stored.groupBy(*group)).applyInArrow(score, f"query {types['query']}, {key} {types[key]}, score double")


def ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_many(embeddings: DataFrame, queries: DataFrame, k: int, key: str = "id", block: int = QUERIES_PER_TASK) -> DataFrame:
    """(query, ``key``, score, rank) by brute force: each block of queries meets each share of the vectors in one group, so
    the work is queries times vectors, dealt out, and a task holds one block and one share."""
    longest = queries.agg(F.max(F.size("embedding"))).first()[0]
    n, cores = embeddings.count(), embeddings.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-queries.count() // block))
    shares = max(1, -(-n // ROWS_PER_TASK), min(cores, -(-n // 4096)))
    asked = queries.select("query", "embedding", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    stored = embeddings.select(key, "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64(key), F.lit(shares)).cast("int").alias("share"))
    return ranked(met(asked, stored, ["block", "share"], k, key, max(longest or 0, 1)), key, k)


def recall(found: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """One row: queries, hits of the exact search, hits found again, recall."""
    both = truth.select("query", key).join(found.select("query", key, F.lit(1).alias("hit")), ["query", key], "left")
    sums = both.agg(F.countDistinct("query").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return sums.withColumn("recall", F.col("found") / F.col("wanted"))
