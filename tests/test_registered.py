"""Registered queries against a second engine, on the smallest supplied scale."""

import os

import pytest

from codequarry.registered import catalog
from codequarry.registered.views import TABLES

SF = "/root/testdata/sf0.001"
QUICK = [
    "vector_topk_per_label", "hybrid_search", "keyword_boost", "chunk_texts", "symbol_prefix_search", "callees_bfs_depth3", "dead_code", "cycles_scc", "di_resolved_callees",
    "line_metrics", "halstead", "secret_scan", "pattern_share", "find_usages", "golden_files", "route_normalize", "route_match_score", "spec_coverage_full_outer", "snapshot_diff",
    "chunk_upsert_last_wins", "codeowners_last_match", "reviewers_topk", "parse_python_chunks", "parse_brace_chunks", "diagram_sequence", "vector_index_many",
    "vector_index_recall", "symbol_index_search", "symbol_index_phrases", "parse_forms_chunks", "parse_forms_calls", "parse_partial", "affected_tests",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are not here")


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v):
        if isinstance(v, (list, tuple)):
            return str([text(x) for x in v])
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(text(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert all(sql for _, sql in catalog.all_queries().values())
    assert not [n for n in catalog.all_queries() if "pipeline" in n or n.startswith("op")]


@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, engine, name):
    query, sql = catalog.all_queries()[name]
    result = query(spark, SF)
    other = engine.execute(sql)
    names = [c[0] for c in other.description]
    assert sorted(names) == sorted(result.columns)
    assert normal([tuple(r) for r in result.collect()], result.columns) == normal(other.fetchall(), names)
