"""Parsed files of every language as chunk, call, inheritance and dependency tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from codequarry.functions import names
from codequarry.schema import PARTS
from codequarry.sources.brace_code import parse_braces
from codequarry.sources.python_code import parse_python


@dataclass
class ParsedTables:
    chunks: DataFrame
    calls: DataFrame
    inheritance: DataFrame
    class_dependencies: DataFrame
    files: DataFrame


def parse_files(files: DataFrame, wanted: Sequence[str] = PARTS) -> DataFrame:
    """One row per file (columns repo_name, file_path, content, language): chunks, calls, bases as far as ``wanted``, error, n_chunks.

    Unreadable texts keep a row with their error, so nothing is lost silently.
    """
    readable = files.where("content is not null")
    python = parse_python(readable.where("language = 'python'"), wanted)
    braces = parse_braces(readable.where("language in ('java', 'typescript', 'javascript')"), wanted)
    broken = files.where("content is null").select("repo_name", "file_path", F.lit("not valid UTF-8").alias("error"))
    return python.unionByName(braces).unionByName(broken, allowMissingColumns=True)


def tables_of(parsed: DataFrame) -> ParsedTables:
    """Flat tables; ``parsed`` should be written or persisted, since each table reads it.

    Arrays that are built by columns open with ``inline_outer``: before ``inline`` the planner would put a filter on the size of the
    array, pushed down to where the whole array is built once more for it.
    """
    calls = parsed.select("repo_name", "file_path", F.inline("calls")).select(
        "caller", "callee", F.col("file_path").alias("caller_file"), F.col("line").alias("caller_line"), "repo_name", "call_type"
    )
    inheritance = parsed.select("repo_name", "file_path", F.inline_outer("bases")).where("child_name is not null").select(
        "child_name", "child_qualified", "parent_name", "relation_type", "file_path", "repo_name", "line_number"
    )
    chunks = parsed.select(F.inline_outer("chunks")).where("id is not null")
    dependencies = chunks.select("repo_name", F.col("name").alias("class_name"), F.inline("metadata.dependencies")).select(
        "class_name", F.col("name").alias("field_name"), F.col("type").alias("field_type"), "injection_type", "repo_name"
    )
    files = parsed.select("repo_name", "file_path", "error", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    return ParsedTables(chunks, calls, inheritance, dependencies, files)


def counters(files: DataFrame) -> DataFrame:
    """Processed and skipped files of each repository."""
    return files.groupBy("repo_name").agg(
        F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("skipped"), F.sum("n_chunks").alias("chunks")
    )
