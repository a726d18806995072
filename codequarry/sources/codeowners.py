"""CODEOWNERS files: the first of four places counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codequarry import fixed_values as fixed
from codequarry.operators.counts import keep_one
from codequarry.operators.ownership import parse_codeowners


def rules_of(files: DataFrame) -> DataFrame:
    """Rules per repository from a file table (repo_name, file_path, content as text)."""
    places = F.array(*[F.lit(p) for p in fixed.CODEOWNERS_PATHS])
    found = files.where(F.col("file_path").isin(*fixed.CODEOWNERS_PATHS)).select("repo_name", "file_path", "content", F.array_position(places, F.col("file_path")).alias("place"))
    return parse_codeowners(keep_one(found, ["repo_name"], [F.col("place")]))
