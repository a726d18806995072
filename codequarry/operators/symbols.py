"""Symbol table operators: symbols are a projection of the chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codequarry.functions import names


def symbols(chunks: DataFrame) -> DataFrame:
    """One row per named chunk; texts and vectors stay behind."""
    return chunks.select(
        "name",
        names.qualified_name(F.col("parent_name"), F.col("name")).alias("qualified_name"),
        F.col("chunk_type").alias("symbol_type"),
        "file_path",
        "repo_name",
        "start_line",
        "end_line",
        "signature",
        "parent_name",
        "language",
        F.col("id").alias("chunk_id"),
    )


def in_repo(df: DataFrame, repo: str | None) -> DataFrame:
    return df if repo is None else df.where(F.col("repo_name") == repo)


def chunk_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """One chunk; a stored table skips the row groups whose bloom filter excludes the id."""
    return chunks.where(F.col("id") == chunk_id)


def chunks_by_file(chunks: DataFrame, repo: str, path: str) -> DataFrame:
    return chunks.where((F.col("repo_name") == repo) & (F.col("file_path") == path)).orderBy("start_line", "id")


def lookup(table: DataFrame, name: str, repo: str | None = None) -> DataFrame:
    """Exact match of name or qualified name, exact names first."""
    hit = (F.col("name") == name) | (F.col("qualified_name") == name)
    # a qualified name ends in the name: a condition on the stored column, which the scan can skip by
    parts = name.split(".")
    endings = [".".join(parts[i:]) for i in range(len(parts))]
    return in_repo(table, repo).where(F.col("name").isin(endings)).where(hit).orderBy(
        F.when(F.col("name") == name, 0).otherwise(1), "repo_name", "file_path", "start_line"
    )


def tokens(text: Column) -> Column:
    """Index tokens: maximal runs of letters and digits, lower-cased; camelCase stays whole."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def prefix_search(table: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """Names with a token that starts with ``prefix``; exact tokens, then short names, first."""
    wanted = prefix.rstrip("*").lower()
    found = F.concat(tokens(F.col("name")), tokens(F.col("qualified_name")))
    return (
        table.where(F.contains(F.lower(F.col("qualified_name")), F.lit(wanted)))
        .where(F.exists(found, lambda t: F.startswith(t, F.lit(wanted))))
        .withColumn("exact_token", F.exists(found, lambda t: t == wanted))
        .withColumn("token_count", F.size(found))
        .orderBy(F.col("exact_token").desc(), "token_count", "qualified_name", "repo_name", "file_path", "start_line")
        .limit(limit)
    )


def text_search(
    table: DataFrame, query: str, symbol_type: str | None = None, repo: str | None = None, limit: int = 50
) -> DataFrame:
    """Word search: bare terms must all occur, ``OR`` gives alternatives, ``term*`` a prefix, quotes a phrase."""
    found = F.concat(tokens(F.col("name")), tokens(F.col("qualified_name")))
    joined = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))

    def term(raw: str) -> Column:
        text = raw.strip('"').lower()
        if text.endswith("*"):
            return F.exists(found, lambda t: F.startswith(t, F.lit(text[:-1])))
        words = " ".join(w for w in "".join(c if c.isalnum() else " " for c in text).split())
        return F.contains(joined, F.lit(f" {words} "))

    def alternative(part: str) -> Column:
        pieces = part.split('"')
        terms = [t for i, piece in enumerate(pieces) for t in ([piece] if i % 2 else piece.split())]
        return reduce(lambda a, b: a & b, [term(t) for t in terms if t.strip()], F.lit(True))

    hit = reduce(lambda a, b: a | b, [alternative(p) for p in query.split(" OR ")])
    df = in_repo(table, repo).where(hit)
    if symbol_type:
        df = df.where(F.col("symbol_type") == symbol_type)
    return df.orderBy(F.size(found), "qualified_name", "repo_name", "file_path", "start_line").limit(limit)


def by_type(table: DataFrame, symbol_type: str, repo: str | None = None, limit: int | None = None) -> DataFrame:
    df = in_repo(table, repo).where(F.col("symbol_type") == symbol_type).orderBy("name", "repo_name", "file_path", "start_line")
    return df if limit is None else df.limit(limit)


def by_file(table: DataFrame, repo: str, path: str) -> DataFrame:
    return table.where((F.col("repo_name") == repo) & (F.col("file_path") == path)).orderBy("start_line", "name")


def children(table: DataFrame, parent: str, repo: str | None = None) -> DataFrame:
    return in_repo(table, repo).where(F.col("parent_name") == parent).orderBy("start_line", "name", "repo_name", "file_path")


def files_ending_with(table: DataFrame, path: str, repo: str | None = None) -> DataFrame:
    """The file named ``path``, else the first file whose path ends so."""
    files = in_repo(table, repo).where(F.endswith(F.col("file_path"), F.lit(path))).select("repo_name", "file_path").distinct()
    return files.orderBy(F.when(F.col("file_path") == path, 0).otherwise(1), "repo_name", "file_path").limit(1)


def path_like(table: DataFrame, pattern: str, column: str) -> DataFrame:
    """``*`` in a path pattern matches anything."""
    return table.where(F.col(column).like(pattern.replace("*", "%")))


def fuzzy(table: DataFrame, name: str, repo: str | None = None, limit: int = 5) -> DataFrame:
    """Equal name first, then equal qualified name, then names that contain the text."""
    lowered = name.lower()
    exact = F.col("name") == name
    qualified = F.col("qualified_name") == name
    part = F.contains(F.lower(F.col("name")), F.lit(lowered))
    return (
        in_repo(table, repo)
        .where(exact | qualified | part)
        .orderBy((~exact).cast("int"), (~qualified).cast("int"), "qualified_name", "repo_name", "file_path", "start_line")
        .limit(limit)
    )


def index_stats(chunks: DataFrame) -> DataFrame:
    """Total, repositories, and counts by language and by type, from one scan."""
    return (
        chunks.groupingSets([[], ["repo_name"], ["language"], ["chunk_type"]], "repo_name", "language", "chunk_type")
        .agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
        .select(
            F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "repo").when(F.col("g") == 5, "language").otherwise("type").alias("dimension"),
            F.coalesce("repo_name", "language", "chunk_type", F.lit("all")).alias("value"),
            "n",
        )
    )


def related(chunks: DataFrame, target: DataFrame, sibling_limit: int | None = None, file_limit: int | None = None) -> DataFrame:
    """Parents, siblings and top-level neighbours of the target chunks, ranked by place; the limits only cut what is listed."""
    keys = target.select(
        F.col("id").alias("target_id"), F.col("repo_name").alias("t_repo"), F.col("file_path").alias("t_file"),
        F.col("name").alias("t_name"), F.col("parent_name").alias("t_parent"),
    )
    same_file = keys.join(
        chunks, (F.col("t_repo") == F.col("repo_name")) & (F.col("t_file") == F.col("file_path")) & (F.col("id") != F.col("target_id"))
    )
    has_parent = F.nullif(F.col("t_parent"), F.lit("")).isNotNull()
    relation = (
        F.when(has_parent & (F.col("name") == F.col("t_parent")), "parent")
        .when(has_parent & (F.col("parent_name") == F.col("t_parent")) & (F.col("name") != F.col("t_name")), "sibling")
        .when(~has_parent & F.nullif(F.col("parent_name"), F.lit("")).isNull(), "same_file")
    )
    ranked = same_file.withColumn("relation", relation).where("relation is not null").withColumn(
        "rank", F.expr("row_number() over (partition by target_id, relation order by start_line, name, id)")
    )
    for name, limit in (("sibling", sibling_limit), ("same_file", file_limit)):
        if limit is not None:
            ranked = ranked.where((F.col("relation") != name) | (F.col("rank") <= limit))
    return ranked.select("target_id", "relation", "rank", "id", "name", "chunk_type", "signature", "start_line")


def class_members(table: DataFrame) -> DataFrame:
    """Members beside the class that holds them, one row per member; a class without members has one row."""
    types = table.where(F.col("symbol_type").isin("class", "interface")).select(
        "repo_name", "file_path", F.col("name").alias("class_name"), F.col("start_line").alias("class_line"), F.col("symbol_type").alias("class_type")
    )
    members = table.where(F.nullif(F.col("parent_name"), F.lit("")).isNotNull()).select(
        "repo_name", "file_path", F.col("parent_name").alias("class_name"), F.col("name").alias("member_name"),
        F.col("symbol_type").alias("member_type"), F.col("start_line").alias("member_line"),
    )
    return types.join(members, ["repo_name", "file_path", "class_name"], "left")
