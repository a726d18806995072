"""Views of chunks at three levels of detail, token budgets and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import names

LEVELS = ["summary", "preview", "full"]


def summary_columns() -> list[Column]:
    return [
        F.col("name"),
        names.qualified_name(F.col("parent_name"), F.col("name")).alias("qualified_name"),
        F.col("chunk_type").alias("type"),
        F.coalesce(F.nullif("signature", F.lit("")), F.concat_ws(" ", "chunk_type", "name")).alias("signature"),
        F.concat(F.col("file_path"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line")).alias("location"),
        F.col("repo_name").alias("repo"),
        F.col("language"),
    ]


def preview_text(content: Column, max_lines: int = 10) -> Column:
    lines = F.split(content, "\n")
    more = F.size(lines) - max_lines
    head = F.array_join(F.slice(lines, 1, max_lines), "\n")
    return F.when(more > 0, F.concat(head, F.lit("\n... ("), more.cast("string"), F.lit(" more lines)"))).otherwise(content)


def view(chunks: DataFrame, level: str = "summary", extra: list[str] | None = None) -> DataFrame:
    """Chunks at a level of detail; ``extra`` columns (such as the score) pass through."""
    columns = summary_columns()
    if level in ("preview", "full"):
        parent = F.nullif("parent_name", F.lit(""))
        columns.append((F.substring("docstring", 1, 500) if level == "preview" else F.col("docstring")).alias("docstring"))
        if level == "preview":
            columns.append(preview_text(F.col("content")).alias("preview"))
            columns.append(F.when(parent.isNotNull(), F.struct(parent.alias("name"), F.col("parent_type").alias("type"))).alias("parent"))
        else:
            columns += [F.col(c) for c in ("id", "file_path", "start_line", "end_line", "content", "parent_name", "parent_type", "imports", "metadata", "summary")]
    return chunks.select(*columns, *(extra or []))


def vector_metadata(chunks: DataFrame) -> DataFrame:
    """The scalar fields kept beside a vector."""
    return chunks.select(
        "id", "repo_name", "file_path", "start_line", "end_line", "chunk_type", "name", F.coalesce("parent_name", F.lit("")).alias("parent_name"),
        "language", F.coalesce(F.col("docstring") != "", F.lit(False)).alias("has_docstring"),
    )


def fit_to_budget(found: Column, level: Column, budget: Column, max_results: Column) -> Column:
    """Level and number of results that fit a token budget.

    Full steps down to preview, preview to summary, as long as that lets more results in.
    """
    tokens = fixed.TOKENS_PER_ITEM
    room = {l: F.floor(budget / tokens[l]) for l in LEVELS}

    def fits(l: str) -> Column:
        return (found <= room[l]) & (found <= max_results)

    helps = (room["summary"] >= found) | (room["summary"] > room["preview"])
    after_preview = F.when(fits("preview") | ~helps, "preview").otherwise("summary")
    chosen = (
        F.when(level == "full", F.when(fits("full"), "full").otherwise(after_preview))
        .when(level == "preview", after_preview)
        .otherwise("summary")
    )
    space = F.when(chosen == "full", room["full"]).when(chosen == "preview", room["preview"]).otherwise(room["summary"])
    count = F.least(space, max_results, found).cast("int")
    per_item = F.when(chosen == "full", tokens["full"]).when(chosen == "preview", tokens["preview"]).otherwise(tokens["summary"])
    return F.struct(chosen.alias("detail_level"), count.alias("returned"), (count * per_item).cast("int").alias("estimated_tokens"))


def fit_on_driver(found: int, level: str, budget: int, max_results: int) -> tuple[str, int]:
    """``fit_to_budget`` for one request."""
    tokens = fixed.TOKENS_PER_ITEM
    while True:
        room = budget // tokens[level]
        if found <= room and found <= max_results:
            return level, found
        summary_room = budget // tokens["summary"]
        if level == "full":
            level = "preview"
        elif level == "preview" and (summary_room >= found or summary_room > room):
            level = "summary"
        else:
            return level, min(room, max_results, found)


def grouped(results: DataFrame, by: str) -> DataFrame:
    """Result groups: items stay rows, with their group, its size and their position.

    ``by`` is ``file``, ``type`` or ``repo`` of a summary view.
    """
    key = {"file": F.substring_index("location", ":", 1), "type": F.col("type"), "repo": F.col("repo")}[by]
    keyed = results.withColumn("group", key)
    sizes = keyed.groupBy("group").agg(F.count("*").alias("count"))
    return keyed.join(sizes, "group")
