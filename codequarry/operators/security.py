"""Secret scans over any table with a path and a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import names, regex as rx, secrets as sf


def scan(texts: DataFrame, text: str, keep: list[str], min_severity: str = "info", min_confidence: float = 0.5) -> DataFrame:
    """One row per finding with ``keep`` columns and the line number.

    Texts without any hint of a secret are dropped whole, then lines, before the rules run.
    The plan is one narrow stage: no shuffle whatever the size.
    """
    lines = (
        texts.where(sf.could_hold_secret(F.col(text)))
        .select(*keep, F.posexplode(F.split(text, "\n")).alias("line_index", "line"))
        .where(sf.could_hold_secret(F.col("line")))
    )
    found = lines.select(*keep, "line_index", "line", F.inline(sf.findings(F.col("line"), min_severity)))
    scored = found.withColumn("confidence", sf.confidence(F.col("line"), F.col("matched"), F.col("secret_type")))
    return scored.where(F.col("confidence") >= min_confidence).select(
        *keep,
        (F.col("line_index") + 1).alias("line_number"),
        "secret_type",
        "severity",
        "description",
        sf.redacted(F.col("matched")).alias("matched_text"),
        F.concat(F.lit("SEC-"), F.upper("secret_type")).alias("rule_id"),
        "confidence",
        "recommendation",
    )


def by_severity(findings: DataFrame) -> DataFrame:
    """Counts for every level, zero included."""
    levels = findings.sparkSession.createDataFrame([(i, s) for i, s in enumerate(fixed.SEVERITIES)], "severity_rank int, severity string")
    counted = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return levels.join(counted, "severity", "left").select("severity", "severity_rank", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def scannable(files: DataFrame, root_relative: str = "file_path", size: str = "length", hidden_files: bool = True, max_bytes: int | None = None) -> DataFrame:
    """Files worth scanning: no skipped or hidden directory, no binary suffix, no lock file, of any size.

    ``hidden_files`` keeps files such as ``.env``; without it they are skipped like hidden directories. ``max_bytes``
    leaves out larger files, as ``fixed_values.SECRET_MAX_BYTES`` does in the published tool.
    """
    path = F.col(root_relative)
    parts = F.split(path, "/")
    directories = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    checked = directories if hidden_files else parts
    skipped = F.exists(checked, lambda p: p.isin(*fixed.SECRET_SKIP_DIRECTORIES) | F.startswith(p, F.lit(".")))
    return files.where(
        (F.lit(True) if max_bytes is None else F.col(size) <= max_bytes)
        & ~skipped
        & ~rx.any_suffix(F.lower(path), fixed.SECRET_SKIP_EXTENSIONS)
        & ~names.file_name(path).isin(*fixed.SECRET_SKIP_FILES)
    )


def scan_result(findings: DataFrame, scanned: DataFrame, file_columns: list[str]) -> DataFrame:
    """One row: files scanned, findings, and the count of each severity."""
    counts = findings.agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITIES],
    )
    files = scanned.select(*file_columns).distinct().agg(F.count("*").alias("total_files_scanned"))
    return files.crossJoin(counts)  # one-row frames
