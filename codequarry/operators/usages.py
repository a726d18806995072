"""Usages and tests of a symbol."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import lines as lf, names, regex as rx
from codequarry.operators.symbols import in_repo


def usage_rules(symbol: str) -> list[tuple[str, str, str]]:
    """(category, pattern, flags) for every way a text can mention the symbol."""
    quoted = rx.quote(symbol)
    return [(category, pattern.replace("{s}", quoted), flags) for category, pattern, flags in fixed.USAGE_PATTERNS]


def find_usages(
    chunks: DataFrame, calls: DataFrame, symbol: str, repo: str | None = None, include_definitions: bool = False, limit: int | None = None
) -> DataFrame:
    """One row per usage: category, place, context. A line counts once per category; ``limit`` lists the first of each category only."""
    qualified = names.qualified_name(F.col("parent_name"), F.col("name"))
    defines = (F.col("name") == symbol) | (qualified == symbol)
    mentioning = in_repo(chunks, repo).where(~defines & F.contains("content", F.lit(symbol)))

    def mentions(number: int, category: str, regex: str, flags: str) -> Column:
        constant = [F.lit(category).alias("category"), F.lit(number).alias("rule_no")]
        return F.transform(
            lf.located(F.col("content"), regex, flags),
            lambda m: F.struct(*constant, m["line"].alias("line"), m["column"].alias("column"), m["matched"].alias("matched"), F.get(F.split("content", "\n"), m["line"]).alias("text")),
        )

    found = F.flatten(F.array(*[mentions(i, *rule) for i, rule in enumerate(usage_rules(symbol))]))
    hits = mentioning.select("repo_name", "file_path", "start_line", F.inline(found))
    context = (
        F.when(F.col("category").isin("type_hints", "assignments"), names.line_context(F.col("text"), F.col("column")))
        .when(F.col("category") == "imports", F.substring(rx.strip(F.col("matched")), 1, 80))
        .otherwise(rx.strip(F.col("matched")))
    )
    textual = (
        hits.groupBy("category", "repo_name", "file_path", (F.col("start_line") + F.col("line")).alias("line"))
        .agg(F.min_by(context, F.struct(F.col("rule_no"), context)).alias("context"))
    )
    called = in_repo(calls, repo).where(F.col("callee") == symbol).select(
        F.lit("calls").alias("category"), "repo_name", F.col("caller_file").alias("file_path"), F.col("caller_line").alias("line"), F.col("caller").alias("context")
    )
    usages = called.unionByName(textual)
    if include_definitions:
        usages = usages.unionByName(
            in_repo(chunks, repo).where(defines).select(
                F.lit("definitions").alias("category"), "repo_name", "file_path", F.col("start_line").alias("line"), F.col("name").alias("context")
            )
        )
    return usages if limit is None else listed(usages, limit)


def listed(usages: DataFrame, limit: int) -> DataFrame:
    """The first usages of each category."""
    w = Window.partitionBy("category").orderBy("repo_name", "file_path", "line", "context")
    return usages.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("rank")


def usage_totals(usages: DataFrame) -> DataFrame:
    return usages.groupBy("category").agg(F.count("*").alias("n"))


def looks_like_test(path: Column) -> Column:
    return rx.any_contains(F.lower(path), fixed.TEST_PATH_PARTS)


def _snake(name: str) -> str:
    return re.sub("([a-z0-9])([A-Z])", r"\1_\2", re.sub("(.)([A-Z][a-z]+)", r"\1_\2", name)).lower()


def _test_names(symbol: str) -> list[str]:
    lower, snake = symbol.lower(), _snake(symbol)
    return [f"test_{snake}", f"test_{lower}", f"{snake}_test", f"{lower}_test", f"{symbol}Test".lower(), f"{symbol}Spec".lower(), f"{symbol}.test".lower(), f"{symbol}.spec".lower()]


def _mentions(symbol: str) -> Column:
    return F.contains("content", F.lit(symbol)) | F.contains(F.lower("content"), F.lit(symbol.lower()))


def test_files(chunks: DataFrame, symbol: str, repo: str | None = None) -> DataFrame:
    """Test files of a symbol with the strongest reason: file name, content, import."""
    by_name = rx.any_contains(F.lower(names.file_name(F.col("file_path"))), _test_names(symbol))
    by_content = _mentions(symbol)
    by_import = F.contains(F.lower("content"), F.lit("import")) & F.contains("content", F.lit(symbol))
    reason = F.when(by_name, 1).when(by_content, 2).when(by_import, 3)
    return (
        in_repo(chunks, repo).where(looks_like_test(F.col("file_path")))
        .select("repo_name", "file_path", reason.alias("reason_no")).where("reason_no is not null")
        .groupBy("repo_name", "file_path").agg(F.min("reason_no").alias("reason_no"))
        .select(
            "repo_name", "file_path",
            F.when(F.col("reason_no") == 1, "filename_pattern").when(F.col("reason_no") == 2, "content_reference").otherwise("imports_symbol").alias("match_reason"),
        )
    )


def test_methods(chunks: DataFrame, symbol: str, repo: str | None = None) -> DataFrame:
    """Test functions and methods of a symbol, one row per (repository, file, name)."""
    lower, snake = rx.quote(symbol.lower()), rx.quote(_snake(symbol))
    name = F.lower("name")
    by_name = rx.matches(name, f"test.*{snake}|test.*{lower}|should.*{lower}|it.*{lower}", "i")
    is_test = rx.any_prefix(name, ["test", "it_", "should_"]) | F.coalesce(F.contains(F.lower("parent_name"), F.lit("test")), F.lit(False))
    reason = F.when(by_name, 1).when(is_test & _mentions(symbol), 2)
    qualified = names.qualified_name(F.col("parent_name"), F.col("name"))
    return (
        in_repo(chunks, repo).where(looks_like_test(F.col("file_path")) & F.col("chunk_type").isin("function", "method"))
        .select("repo_name", "file_path", "name", "start_line", qualified.alias("qualified_name"), reason.alias("reason_no")).where("reason_no is not null")
        .groupBy("repo_name", "file_path", "name")
        .agg(F.min(F.struct("reason_no", "start_line", "qualified_name")).alias("first"))
        .select(
            "repo_name", "file_path", "name", "first.qualified_name", F.col("first.start_line").alias("line"),
            F.when(F.col("first.reason_no") == 1, "method_name_pattern").otherwise("content_reference").alias("match_reason"),
        )
    )


IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"


def affected_tests(chunks: DataFrame, modified: DataFrame, per_symbol: int | None = None) -> DataFrame:
    """Tests of many modified symbols (columns repo_name, name) in one join: repo_name, tests_symbol, file_path, name,
    qualified_name, line, match_reason; ``per_symbol`` keeps the first ones of each symbol only.

    A test is found by its name (``test``, ``should`` or ``it``, then somewhere the words of the symbol, however they are
    joined), or by an identifier of its code that equals the symbol, letter case aside. Both are keys: no text meets more
    than the symbols it names.
    """
    tests = chunks.where(looks_like_test(F.col("file_path")) & F.col("chunk_type").isin("function", "method"))
    words = F.filter(F.split(names.snake_case(F.col("name")), "[_-]+"), lambda w: w != "")
    n = F.size("words")
    runs = F.flatten(F.transform(F.sequence(F.lit(2), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice("words", i, j - i + 1), ""))))
    by_name = F.when((n >= 2) & F.get("words", F.lit(0)).isin("test", "should", "it"), runs).otherwise(F.array().cast("array<string>"))
    is_test = rx.any_prefix(F.lower("name"), ["test", "it_", "should_"]) | F.coalesce(F.contains(F.lower("parent_name"), F.lit("test")), F.lit(False))
    used = F.when(is_test, F.transform(F.regexp_extract_all("content", F.lit(f"({IDENTIFIER})")), F.lower)).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(F.transform(by_name, lambda k: F.struct(F.lit(1).alias("reason_no"), k.alias("key"))), F.transform(used, lambda k: F.struct(F.lit(2).alias("reason_no"), k.alias("key")))))
    posted = tests.withColumn("words", words).select(
        "repo_name", "file_path", "name", F.col("start_line").alias("line"), names.qualified_name(F.col("parent_name"), F.col("name")).alias("qualified_name"), F.inline(keys),
    )
    symbol = modified.select("repo_name", F.col("name").alias("tests_symbol")).where("tests_symbol <> ''").distinct()
    joined = F.array(
        F.struct(F.lit(1).alias("reason_no"), F.replace(names.snake_case(F.col("tests_symbol")), F.lit("_"), F.lit("")).alias("key")),
        F.struct(F.lit(2).alias("reason_no"), F.lower("tests_symbol").alias("key")),
    )
    found = posted.join(symbol.select("repo_name", "tests_symbol", F.inline(joined)), ["repo_name", "reason_no", "key"])
    # tests of one name in one file count once, by the strongest reason
    best = found.groupBy("repo_name", "tests_symbol", "file_path", "name").agg(F.min(F.struct("reason_no", "line", "qualified_name")).alias("first"))
    reason = F.when(F.col("first.reason_no") == 1, "method_name_pattern").otherwise("content_reference")
    if per_symbol is not None:
        order = Window.partitionBy("repo_name", "tests_symbol").orderBy("first.reason_no", "file_path", "first.line", "name")
        best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_symbol)
    return best.select("repo_name", "tests_symbol", "file_path", "name", "first.qualified_name", "first.line", reason.alias("match_reason"))
