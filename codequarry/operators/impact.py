"""Change impact and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import metrics as mf, regex as rx


def modified_symbols(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Symbols of the changed files (columns repo_name, file_path)."""
    return symbols.join(changed.select("repo_name", "file_path").distinct(), ["repo_name", "file_path"], "left_semi")


def impacted_callers(calls: DataFrame, modified: DataFrame) -> DataFrame:
    """Call sites of modified symbols, each once, with the first symbol it calls."""
    targets = modified.select("repo_name", F.col("qualified_name").alias("callee")).distinct()
    return (
        calls.join(targets, ["repo_name", "callee"])
        .groupBy("repo_name", "caller", "caller_file", "caller_line")
        .agg(F.min(F.struct("callee", "call_type")).alias("first"))
        .select("repo_name", "caller", "caller_file", "caller_line", F.col("first.callee").alias("calls"), "first.call_type")
    )


def _steps(value: Column, *bounds: tuple[int, int]) -> Column:
    result = F.lit(0)
    for above, points in reversed(bounds):
        result = F.when(value > above, points).otherwise(result)
    return result


def diff_risk(files: Column, symbols: Column, callers: Column) -> Column:
    """Risk level of a diff from its three sizes."""
    score = (
        _steps(files, (10, 3), (5, 2), (2, 1))
        + _steps(symbols, (20, 3), (10, 2), (5, 1))
        + _steps(callers, (50, 4), (20, 3), (10, 2), (5, 1))
    )
    return F.when(score >= 8, "high").when(score >= 4, "medium").otherwise("low")


def change_risk(direct: Column, transitive: Column, tests: Column, change_type: Column) -> Column:
    """Risk level of changing one symbol."""
    factor = F.lit(1.0)
    for kind, value in fixed.CHANGE_MULTIPLIER.items():
        factor = F.when(change_type == kind, value).otherwise(factor)
    impact = (direct + transitive * 0.5) * factor
    impact = F.when((tests == 0) & (direct > 0), impact * 1.5).otherwise(impact)
    return F.when(impact <= 3, "low").when(impact <= 10, "medium").when(impact <= 25, "high").otherwise("critical")


def diff_summary(changed: DataFrame, modified: DataFrame, impacted: DataFrame) -> DataFrame:
    """Sizes and risk of a diff, one row per repository with changes."""
    files = changed.select("repo_name", "file_path").distinct().groupBy("repo_name").agg(F.count("*").alias("changed_files"))
    symbols = modified.groupBy("repo_name").agg(F.count("*").alias("modified_symbols"))
    callers = impacted.groupBy("repo_name").agg(F.count("*").alias("impacted_callers"))
    joined = files.join(symbols, "repo_name", "left").join(callers, "repo_name", "left").na.fill(0)
    return joined.withColumn("risk_level", diff_risk(F.col("changed_files"), F.col("modified_symbols"), F.col("impacted_callers")))


def data_flow(signature: Column, docstring: Column) -> Column:
    """Inputs, outputs and side effects as far as a signature and docstring tell."""
    signature, lowered = F.coalesce(signature, F.lit("")), F.lower(F.coalesce(docstring, F.lit("")))
    inner = F.regexp_extract(signature, r"(?s)\((.*)\)", 1)
    inputs = F.filter(mf.split_arguments(inner, "[<", "]>"), lambda p: ~p.isin("self", "cls"))
    output = F.regexp_replace(rx.strip(F.substring_index(signature, "->", -1)), ":+$", "")
    effects = F.array(*[F.when(F.contains(lowered, F.lit(w)), F.lit(f"May {w}")) for w in fixed.SIDE_EFFECT_WORDS])
    return F.struct(
        inputs.alias("inputs"),
        F.when(F.contains(signature, F.lit("->")), F.array(output)).otherwise(F.array().cast("array<string>")).alias("outputs"),
        F.filter(effects, lambda e: e.isNotNull()).alias("side_effects"),
    )


def explore_tokens(detail: Column, has_definition: Column, callers: Column, callees: Column, tests: Column) -> Column:
    per_level = F.lit(fixed.TOKENS_PER_ITEM["full"])
    for level, tokens in fixed.TOKENS_PER_ITEM.items():
        per_level = F.when(detail == level, tokens).otherwise(per_level)
    return 100 + F.when(has_definition, per_level).otherwise(0) + 30 * (callers + callees) + 20 * tests


def health_score(dead: Column, file_cycles: Column, function_cycles: Column) -> Column:
    """Health out of 100 and a verdict."""
    score = F.greatest(
        F.lit(0),
        100 - F.least(F.lit(20), dead * 2) - F.least(F.lit(30), file_cycles * 5) - F.least(F.lit(20), function_cycles),
    )
    verdict = (
        F.when(score >= 80, "Good architecture health")
        .when(score >= 50, "Consider refactoring to reduce dependencies")
        .otherwise("Architecture needs significant refactoring")
    )
    return F.struct(score.alias("health_score"), verdict.alias("recommendation"))
