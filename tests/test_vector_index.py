"""Inverted lists against full scans."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codequarry.operators import search, vector_index
from codequarry.operators.vector_index import VectorIndex

SCHEMA = "id string, repo_name string, embedding array<float>"


def rows(rng, n, start=0, dim=8):
    centers = rng.normal(size=(6, dim))
    return [(f"v{start + i:05d}", f"r{i % 3}", (centers[i % 6] + 0.3 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    data = rows(rng, 400) + [("none", "r0", None), ("zero", "r0", [0.0] * 8), ("short", "r1", [1.0]), ("twin1", "r1", [1.0] * 8), ("twin2", "r2", [2.0] * 8)]
    table = spark.createDataFrame(data, SCHEMA).repartition(3)
    return table, VectorIndex.build(table, str(tmp_path_factory.mktemp("lists") / "ix"), lists=12), data


def test_every_row_lies_in_one_list(built):
    table, index, data = built
    stored = index.vectors.groupBy("id").count().collect()
    assert {r["id"] for r in stored} == {d[0] for d in data} and all(r["count"] == 1 for r in stored)
    assert index.sizes.sum() == len(data) - 3  # null, zero and short vectors have no list
    again = VectorIndex.load(index.spark, index.root)
    assert np.allclose(again.centroids, index.centroids) and (again.sizes == index.sizes).all() and np.allclose(again.reach, index.reach)


@pytest.mark.parametrize("seed", range(4))
def test_exact_search_equals_a_full_scan(built, seed):
    table, index, _ = built
    query = np.random.default_rng(seed).normal(size=8).tolist()
    for k in (1, 7, 500):
        want = [(r["id"], r["repo_name"]) for r in search.nearest(table, query, k).collect()]
        assert [(r["id"], r["repo_name"]) for r in index.nearest(query, k, probes=1, exact=True).collect()] == want
    some = index.nearest(query, 5, probes=12, where="repo_name = 'r1'").collect()
    assert [r["id"] for r in some] == [r["id"] for r in search.nearest(table.where("repo_name = 'r1'"), query, 5).collect()]


def test_ties_go_by_key_and_odd_queries_find_nothing(built):
    _, index, _ = built
    assert [r["id"] for r in index.nearest([1.0] * 8, 2, exact=True).collect()] == ["twin1", "twin2"]
    assert index.nearest([0.0] * 8, 3).collect() == [] and index.nearest([1.0], 3).collect() == []


def test_only_folders_of_probed_lists_are_read(built):
    _, index, _ = built
    plan = index.nearest([1.0] * 8, 3, probes=2)._jdf.queryExecution().toString()
    values = re.search(r"PartitionFilters: \[list#\d+ IN \(([\d,]+)\)", plan).group(1).split(",")
    assert len(values) == 2 and set(map(int, values)) <= set(range(12))


def test_many_queries(built):
    table, index, _ = built
    queries = table.where("id like 'v000%' or id in ('none', 'zero')").select(F.col("id").alias("query"), "embedding")
    truth = vector_index.exact_many(table, queries, 5)
    pairs = lambda df: sorted((r["query"], r["rank"], r["id"]) for r in df.collect())
    assert pairs(index.nearest_many(queries, 5, probes=1, exact=True)) == pairs(truth)
    probes = index.probes_for(table, queries, 5, 0.9)
    assert vector_index.recall(index.nearest_many(queries, 5, probes), truth).first()["recall"] >= 0.9
    for row in truth.where("query = 'v00007'").orderBy("rank").collect():
        assert row["rank"] > 1 or row["id"] == "v00007"


def test_long_lists_are_dealt_out(built, monkeypatch):
    table, index, _ = built
    monkeypatch.setattr(vector_index, "ROWS_PER_TASK", 9)
    queries = table.where("id like 'v0000%'").select(F.col("id").alias("query"), "embedding")
    pairs = lambda df: sorted((r["query"], r["rank"], r["id"]) for r in df.collect())
    assert pairs(index.nearest_many(queries, 5, probes=12)) == pairs(vector_index.exact_many(table, queries, 5))


def test_added_rows_are_found(spark, tmp_path):
    rng = np.random.default_rng(8)
    first, more = rows(rng, 60), rows(rng, 40, 100)
    index = VectorIndex.build(spark.createDataFrame(first, SCHEMA), str(tmp_path / "ix"), lists=4)
    index.add(spark.createDataFrame(more, SCHEMA))
    both = spark.createDataFrame(first + more, SCHEMA)
    query = more[3][2]
    assert [r["id"] for r in index.nearest(query, 9, 1, exact=True).collect()] == [r["id"] for r in search.nearest(both, query, 9).collect()]


def test_empty_table(spark, tmp_path):
    index = VectorIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "ix"))
    assert index.nearest([1.0, 2.0], 3, exact=True).collect() == []
    queries = spark.createDataFrame([("q", [1.0, 2.0])], "query string, embedding array<float>")
    assert index.nearest_many(queries, 3, exact=True).collect() == []


def test_hits_without_a_chunk_take_no_place(spark, tmp_path):
    names = "id name repo_name chunk_type language docstring content".split()
    chunk = lambda i: (f"c{i:03d}", f"name{i}", "r", "function", "python", "", "text")
    chunks = spark.createDataFrame([chunk(i) for i in range(20, 30)], names)
    vectors = spark.createDataFrame([(f"c{i:03d}", "r", [1.0, i / 100]) for i in range(40)], SCHEMA)
    want = [f"c{i:03d}" for i in range(20, 25)]
    assert [r["id"] for r in search.hybrid(chunks, vectors, [1.0, 0.0], 5).collect()] == want
    index = VectorIndex.build(vectors, str(tmp_path / "ix"), lists=3)
    assert [r["id"] for r in search.hybrid(chunks, vectors, [1.0, 0.0], 5, index=index).collect()] == want
    assert search.hybrid(chunks, vectors, [1.0, 0.0], 60).count() == 10  # more ids than are asked for by value


def test_scores_are_held_in_tiles(monkeypatch):
    rng = np.random.default_rng(3)
    rows, _ = vector_index.unit_rows(pa.array(rng.integers(-2, 3, (300, 3)).astype(float).tolist()))
    order = rng.permutation(300)
    scores = np.maximum(0.0, 1.0 - (1.0 - rows[:50] @ rows.T) / 2.0)
    largest = []
    real = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *more, **named: largest.append(a.size) or real(a, *more, **named))
    monkeypatch.setattr(vector_index, "SCORES", 1000)
    at, row, value = vector_index.best_of(rows[:50], rows, order, 7)
    assert max(largest) <= 1000
    assert at.tolist() == np.repeat(np.arange(50), 7).tolist()
    for i in range(50):  # integer vectors give many ties
        assert np.allclose(value[at == i], np.sort(scores[i])[::-1][:7])
        assert all(order[a] < order[b] or x > y for a, b, x, y in zip(row[at == i], row[at == i][1:], value[at == i], value[at == i][1:]))
    assert len(vector_index.best_of(rows[:2], rows[:3], order[:3], 7)[0]) == 6


def test_a_full_scan_takes_any_number_of_queries(spark):
    point = F.transform(F.array(F.lit(0.0), F.lit(1.5)), lambda x: F.cos(F.col("id") / 1000 - x).cast("float"))
    queries = spark.range(4200).select(F.col("id").alias("query"), point.alias("embedding"))
    found = vector_index.exact_many(spark.range(4200).select("id", point.alias("embedding")), queries, 1, block=1000)
    assert found.where("query = id and rank = 1").count() == 4200
