"""Source files, ignore rules and repository discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import names, regex as rx

SOURCE_GLOB = "*.{py,java,ts,tsx,js,jsx,mjs}"


def read_tree(spark: SparkSession, root: str, repo: str | None = None, glob: str | None = SOURCE_GLOB) -> DataFrame:
    """Files below ``root`` with relative path, size and modification time; texts load only when selected.

    Without ``repo`` the first directory below the root names the repository.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    plain = F.regexp_replace("path", "^file:/+", "/")
    files = reader.load(base).select(
        F.regexp_replace(plain, "^" + rx.quote(base) + "/", "").alias("relative"),
        F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), "content",
    )
    if repo is not None:
        return files.select(F.lit(repo).alias("repo_name"), F.col("relative").alias("file_path"), "size", "mtime", "content")
    return files.where(F.contains("relative", F.lit("/"))).select(
        F.substring_index("relative", "/", 1).alias("repo_name"), F.regexp_replace("relative", "^[^/]*/", "").alias("file_path"), "size", "mtime", "content"
    )


def decoded(files: DataFrame) -> DataFrame:
    """Texts and languages; a file that is not UTF-8 keeps its row with a null text."""
    return files.withColumn("content", F.expr("try_validate_utf8(cast(content as string))")).withColumn(
        "language", names.language_of(F.col("file_path"))
    )


def gitignore_rules(text: str) -> list[tuple[str, bool]]:
    """(pattern, negated) of each effective line."""
    lines = [line.strip() for line in text.splitlines()]
    return [(l.lstrip("!") if l.startswith("!") else l, l.startswith("!")) for l in lines if l and not l.startswith("#")]


def gitignore_match(path: Column, pattern: str) -> Column:
    """Does one pattern name this path, one of its directories, or any part of it?"""
    parts = F.split(path, "/")
    if pattern.endswith("/"):
        regex = rx.glob_regex(pattern[:-1])
        return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.rlike(regex))
    if "/" in pattern:
        bare = pattern.removeprefix("/")
        return path.rlike(rx.glob_regex(bare)) | path.rlike(rx.glob_regex(bare + "/*"))
    regex = rx.glob_regex(pattern)
    return F.exists(parts, lambda p: p.rlike(regex))


def gitignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last matching rule decides: a chain of conditions from the last rule to the first."""
    if not rules:
        return F.lit(False)
    chain = None
    for pattern, negated in reversed(rules):
        hit = gitignore_match(path, pattern)
        chain = F.when(hit, not negated) if chain is None else chain.when(hit, not negated)
    return chain.otherwise(False)


def config_ignored(path: Column, globs: list[str]) -> Column:
    result = F.lit(False)
    for glob in globs:
        if "**" not in glob:
            result = result | path.rlike(rx.glob_regex(glob))
        elif glob.startswith("**/") and "*" not in glob[3:].replace("*.", ""):
            result = result | F.endswith(path, F.lit(glob[3:].replace("*", "")))
    return result


def ignored(path: Column, rules: list[tuple[str, bool]] | None = None, globs: list[str] | None = None) -> Column:
    """Skipped directories, generated files, ignore file and configured globs."""
    directories = F.array(*[F.lit(d) for d in fixed.IGNORED_DIRECTORIES])
    return (
        F.arrays_overlap(F.split(path, "/"), directories)
        | rx.any_suffix(path, fixed.IGNORED_SUFFIXES)
        | gitignored(path, rules or [])
        | config_ignored(path, fixed.DEFAULT_IGNORE_GLOBS if globs is None else globs)
    )


def source_files(files: DataFrame, rules: list[tuple[str, bool]] | None = None, globs: list[str] | None = None) -> DataFrame:
    """Files of a known language that no rule ignores."""
    return files.where(names.language_of(F.col("file_path")).isNotNull() & ~ignored(F.col("file_path"), rules, globs))


def discover(
    files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, minimum: int = 1, explicit: list[str] | None = None
) -> DataFrame:
    """Repositories with enough source files, by name; an explicit list replaces the patterns."""
    counted = files.where(names.language_of(F.col("file_path")).isNotNull()).groupBy("repo_name").agg(F.count("*").alias("source_files"))
    if explicit:
        return counted.where(F.col("repo_name").isin(explicit)).orderBy("repo_name")

    def any_glob(globs: list[str]) -> Column:
        hit = F.lit(False)
        for glob in globs:
            hit = hit | F.col("repo_name").rlike(rx.glob_regex(glob))
        return hit

    kept = counted.where(~any_glob(exclude or []) & any_glob(include or ["*"]))
    return kept.where(F.col("source_files") >= minimum).orderBy("repo_name")
