"""Git history as rows. Git runs where the working copy is: on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import regex as rx
from codequarry.operators.snapshots import first_change_wins


def run(repo_path: str, *arguments: str, timeout: int = 30) -> str:
    """Output of one git command, empty when it fails."""
    try:
        done = subprocess.run(["git", *arguments], cwd=repo_path, capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout if done.returncode == 0 else ""


def head(repo_path: str) -> str | None:
    return run(repo_path, "rev-parse", "HEAD").strip() or None


def _lines(spark: SparkSession, text: str) -> DataFrame:
    rows = [(i, line) for i, line in enumerate(text.split("\n")) if line.strip()]
    return spark.createDataFrame(rows, "position int, line string")


def _status_rows(spark: SparkSession, text: str, repo: str) -> DataFrame:
    """``A/M/D/R`` lines as changes; a rename deletes the old path and adds the new one."""
    parts = F.split("line", "\t")
    code = F.substring(parts[0], 1, 1)
    change = F.when(code == "A", F.array(F.struct(F.lit("new").alias("change"), parts[1].alias("file_path")))).when(
        code == "D", F.array(F.struct(F.lit("deleted").alias("change"), parts[1].alias("file_path")))
    ).when(
        code == "R", F.array(F.struct(F.lit("deleted").alias("change"), parts[1].alias("file_path")), F.struct(F.lit("new").alias("change"), F.get(parts, F.lit(2)).alias("file_path")))
    ).when(code == "M", F.array(F.struct(F.lit("modified").alias("change"), parts[1].alias("file_path"))))
    return _lines(spark, text).select(F.lit(repo).alias("repo_name"), F.inline(change)).select("repo_name", "file_path", "change")


def changes(spark: SparkSession, repo_path: str, repo: str, since: str) -> DataFrame:
    """Files changed since a commit: committed, then working tree; the first entry of a path wins."""
    committed = _status_rows(spark, run(repo_path, "diff", "--name-status", f"{since}..HEAD"), repo)
    working = _status_rows(spark, run(repo_path, "diff", "--name-status", "HEAD"), repo)
    return first_change_wins(committed, working)


def changed_source_files(spark: SparkSession, repo_path: str, repo: str, since: str = "HEAD~1") -> DataFrame:
    """Names of changed source files, staged ones included, sorted."""
    text = run(repo_path, "diff", "--name-only", since) + "\n" + run(repo_path, "diff", "--name-only", "--cached")
    named = _lines(spark, text).select(F.lit(repo).alias("repo_name"), F.trim("line").alias("file_path")).distinct()
    return named.where(rx.any_suffix(F.col("file_path"), fixed.CHANGED_FILE_EXTENSIONS)).orderBy("file_path")


def blame(spark: SparkSession, repo_path: str, repo: str, paths: list[str]) -> DataFrame:
    """One row per line of each file with its author."""
    rows = []
    for path in paths:
        rows += [(repo, path, line[7:].strip()) for line in run(repo_path, "blame", "--porcelain", path).split("\n") if line.startswith("author ")]
    return spark.createDataFrame(rows, "repo_name string, file_path string, author string")


def log(spark: SparkSession, repo_path: str, repo: str, paths: list[str] | None = None) -> DataFrame:
    """Commits (per file when paths are given): author, mail, time."""
    schema = "repo_name string, file_path string, author string, email string, at string"
    rows = []
    for path in paths or [None]:
        extra = ["--", path] if path else []
        for line in run(repo_path, "log", "--format=%an|%ae|%aI", *extra).split("\n"):
            if line.count("|") >= 2:
                author, email, at = line.split("|", 2)
                rows.append((repo, path, author, email, at))
    return spark.createDataFrame(rows, schema).withColumn("authored_at", F.to_timestamp("at")).drop("at")
