"""Metrics per function and per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import metrics as mf, names

FUNCTION_TYPES = ["function", "method", "constructor"]


def function_metrics(chunks: DataFrame) -> DataFrame:
    """All metrics of functions, methods and constructors; a pure projection of the chunk scan."""
    code, language = F.col("content"), F.col("language")
    base = chunks.where(F.col("chunk_type").isin(*FUNCTION_TYPES)).select(
        "id", "repo_name", "file_path", "start_line", "end_line", "name",
        names.qualified_name(F.col("parent_name"), F.col("name")).alias("qualified_name"),
        "language",
        mf.cyclomatic(code, language).alias("cyclomatic"),
        mf.cognitive(code, language).alias("cognitive"),
        mf.line_counts(code, language).alias("loc"),
        mf.parameter_count(code, language).alias("parameter_count"),
        mf.rx.count(code, r"\breturn\b").alias("return_count"),
        mf.halstead(code, language)["volume"].alias("volume"),
    )
    limit = fixed.COMPLEX_ABOVE
    complex_function = (
        (F.col("cyclomatic") > limit["cyclomatic"])
        | (F.col("cognitive.complexity") > limit["cognitive"])
        | (F.col("loc.source_lines") > limit["source_lines"])
        | (F.col("parameter_count") > limit["parameters"])
    )
    return base.select(
        "*",
        mf.cyclomatic_rating(F.col("cyclomatic")).alias("cyclomatic_rating"),
        mf.cognitive_rating(F.col("cognitive.complexity")).alias("cognitive_rating"),
        complex_function.alias("is_complex"),
    )


def hotspots(functions: DataFrame, k: int = 10) -> DataFrame:
    return (
        functions.select(
            F.col("qualified_name").alias("name"),
            F.concat_ws(":", "file_path", F.col("start_line").cast("string")).alias("file"),
            "repo_name",
            "cyclomatic",
            F.col("cognitive.complexity").alias("cognitive"),
            F.col("loc.source_lines").alias("lines"),
            F.col("cyclomatic_rating").alias("rating"),
        )
        .orderBy(F.col("cyclomatic").desc(), "name", "file", "repo_name")
        .limit(k)
    )


def repository_metrics(chunks: DataFrame, by_repo: bool = False) -> DataFrame:
    """Sums, averages and the maintainability index, for all chunks or per repository; the index uses the mean Halstead volume of all functions."""
    scope = ["repo_name"] if by_repo else []
    code, language = F.col("content"), F.col("language")
    counted = F.col("chunk_type").isin(*FUNCTION_TYPES)
    typed = F.col("chunk_type").isin("class", "interface")
    limit = fixed.COMPLEX_ABOVE
    per_chunk = chunks.select(
        "id", "repo_name", "file_path", counted.alias("is_function"), typed.alias("is_class"),
        mf.line_counts(code, language).alias("loc"),
        F.when(counted, mf.cyclomatic(code, language)).alias("cyclomatic"),
        F.when(counted, mf.cognitive(code, language)["complexity"]).alias("cognitive"),
        F.when(counted, mf.parameter_count(code, language)).alias("parameters"),
    )
    is_complex = F.col("is_function") & (
        (F.col("cyclomatic") > limit["cyclomatic"]) | (F.col("cognitive") > limit["cognitive"])
        | (F.col("loc.source_lines") > limit["source_lines"]) | (F.col("parameters") > limit["parameters"])
    )
    totals = per_chunk.groupBy(*scope).agg(
        F.count_if("is_function").alias("total_functions"),
        F.count_if("is_class").alias("total_classes"),
        F.sum("loc.total_lines").alias("total_lines"),
        F.sum("loc.source_lines").alias("source_lines"),
        F.sum("loc.comment_lines").alias("comment_lines"),
        F.sum("loc.blank_lines").alias("blank_lines"),
        F.coalesce(F.avg("cyclomatic"), F.lit(0.0)).alias("avg_cyclomatic"),
        F.coalesce(F.avg("cognitive"), F.lit(0.0)).alias("avg_cognitive"),
        F.count_if(is_complex).alias("complex_function_count"),
    )
    files = (
        chunks.where(counted | typed).select("repo_name", "file_path").distinct()
        .groupBy(*scope).agg(F.count("*").alias("total_files"))
    )
    volumes = chunks.where(counted).select(*scope, mf.halstead(code, language)["volume"].alias("volume")).groupBy(*scope).agg(F.avg("volume").alias("avg_volume"))
    if by_repo:
        joined = totals.join(files, scope, "left").join(volumes, scope, "left")
    else:
        joined = totals.crossJoin(files).crossJoin(volumes)  # one-row frames
    n_files = F.coalesce("total_files", F.lit(0))
    avg_lines = F.when(n_files > 0, F.col("source_lines") / n_files).otherwise(1.0)
    index = mf.maintainability(F.coalesce("avg_volume", F.lit(0.0)), F.col("avg_cyclomatic"), avg_lines)
    share = F.when(F.col("total_functions") > 0, F.col("complex_function_count") / F.col("total_functions") * 100).otherwise(0.0)
    ratio = F.when(F.col("source_lines") > 0, F.bround(F.col("comment_lines") / F.col("source_lines"), 3)).otherwise(0.0)
    return joined.select(
        *scope,
        n_files.alias("total_files"),
        "total_functions", "total_classes", "total_lines", "source_lines", "comment_lines", "blank_lines",
        ratio.alias("comment_ratio"),
        F.bround("avg_cyclomatic", 2).alias("avg_cyclomatic"),
        F.bround("avg_cognitive", 2).alias("avg_cognitive"),
        "complex_function_count",
        F.bround(share, 1).alias("complex_function_percentage"),
        F.bround(index, 1).alias("maintainability_index"),
    )


def symbol_metrics(chunks: DataFrame, symbol: str, repo: str | None = None) -> DataFrame:
    """Metrics of the first function, method or constructor with this name or qualified name."""
    named = (F.col("name") == symbol) | (names.qualified_name(F.col("parent_name"), F.col("name")) == symbol)
    df = chunks.where(named & F.col("chunk_type").isin(*FUNCTION_TYPES))
    if repo is not None:
        df = df.where(F.col("repo_name") == repo)
    return function_metrics(df.orderBy("id").limit(1))
