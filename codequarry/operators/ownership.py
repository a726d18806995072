"""Code owners, contributors and reviewers."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window, functions as F

from codequarry.functions import regex as rx


def parse_codeowners(files: DataFrame) -> DataFrame:
    """Rules of CODEOWNERS texts (columns repo_name, content): pattern, owners, line number."""
    lines = files.select("repo_name", F.posexplode(F.split("content", "\n")).alias("i", "raw")).select(
        "repo_name", (F.col("i") + 1).alias("line_number"), rx.strip(F.col("raw")).alias("line")
    )
    parts = F.split("line", r"\s+")
    return (
        lines.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
        .select("repo_name", "line_number", F.get(parts, F.lit(0)).alias("pattern"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("owners"))
        .where(F.size("owners") > 0)
    )


def rule_regex(pattern: Column) -> Column:
    """A CODEOWNERS pattern as a regex over a path without leading slash."""
    bare = F.regexp_replace(pattern, "^/+", "")

    def translated(glob: Column) -> Column:
        escaped = F.regexp_replace(glob, r"([\\.^$|+(){}])", r"\\$1")
        return F.regexp_replace(F.regexp_replace(escaped, r"\*", "(?s:.*)"), r"(?<!\()\?", "(?s:.)")

    literal = F.regexp_replace(pattern, r"([\\.^$|?*+(){}\[\]])", r"\\$1")
    return (
        F.when(F.endswith(pattern, F.lit("/")), F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(bare, "/+$", ""), r"([\\.^$|?*+(){}\[\]])", r"\\$1"), F.lit("/")))
        .when(F.startswith(pattern, F.lit("/")), F.concat(F.lit("^"), translated(F.substr(pattern, F.lit(2))), F.lit("$")))
        .when(F.contains(pattern, F.lit("*")), F.concat(F.lit("(^|/)"), F.regexp_replace(translated(pattern), "^", ""), F.lit("$")))
        .otherwise(F.concat(F.lit("(^|/)"), literal, F.lit("$")))
    )


def owners_of(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Each file with the owners of its last matching rule.

    The rules of a repository travel as one array (a CODEOWNERS file is small), and each file
    keeps the last hit of that array: no file-by-rule pairs are ever rows.
    """
    compiled = rules.withColumn("regex", rule_regex(F.col("pattern")))
    bundled = compiled.groupBy("repo_name").agg(
        F.sort_array(F.collect_list(F.struct("line_number", "regex", "pattern", "owners"))).alias("rules")
    )
    path = F.regexp_replace("file_path", "^/+", "")
    joined = files.join(bundled, "repo_name", "left").withColumn("__path", path)
    hits = F.filter("rules", lambda r: F.regexp_like("__path", r["regex"]))
    last = F.when(F.size(hits) > 0, F.element_at(hits, -1))
    return joined.withColumn("last", last).select(
        *files.columns, F.coalesce("last.owners", F.array().cast("array<string>")).alias("owners"), F.col("last.pattern").alias("pattern"), F.col("last.line_number").alias("rule_line")
    )


def team_patterns(rules: DataFrame) -> DataFrame:
    """Patterns of each owner, one row each in file order."""
    return rules.select("repo_name", F.explode("owners").alias("owner"), "pattern", "line_number")


def contributor_stats(commits: DataFrame, now: Column, since_days: int = 90) -> DataFrame:
    """Commits per author since some days (columns name, email, authored_at)."""
    recent = commits.where(F.col("authored_at") >= now - F.make_interval(days=F.lit(since_days)))
    return recent.groupBy("name", "email").agg(F.count("*").alias("commit_count")).orderBy(F.col("commit_count").desc(), "name", "email")


def top_contributors(blame: DataFrame, k: int = 5) -> DataFrame:
    """Authors by lines per file (columns repo_name, file_path, author: one row per line)."""
    counts = blame.groupBy("repo_name", "file_path", "author").agg(F.count("*").alias("lines"))
    w = Window.partitionBy("repo_name", "file_path").orderBy(F.col("lines").desc(), "author")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def last_modifier(commits: DataFrame) -> DataFrame:
    """Latest author per file (columns repo_name, file_path, author, authored_at)."""
    return commits.groupBy("repo_name", "file_path").agg(
        F.max(F.struct("authored_at", "author")).alias("last")
    ).select("repo_name", "file_path", F.col("last.author").alias("last_modified_by"), F.col("last.authored_at").alias("last_modified_date"))


def suggest_reviewers(
    owned: DataFrame, contributors: DataFrame, scope: list[str] | None = None, exclude: str | None = None, k: int | None = 3
) -> DataFrame:
    """Reviewers of a set of files.

    ``owned``: file_no, file_path, owners. ``contributors``: file_no, author, lines, rank (best three per file).
    An owner starts at 0.9, a contributor at 0.5 + 0.05 per line (0.85 at most); every later file that names the
    person as owner adds 0.1, up to 1.0. Who is a contributor first and owner of the same or a later file starts lower.
    """
    scope = scope or []
    as_owner = owned.select(*scope, F.explode("owners").alias("name"), "file_no", F.lit(0).alias("kind"), F.lit(0.9).alias("start"), F.lit(0).cast("bigint").alias("lines"))
    as_author = contributors.where("rank <= 3").select(
        *scope, F.col("author").alias("name"), "file_no", F.lit(1).alias("kind"), F.least(0.5 + F.col("lines") * 0.05, F.lit(0.85)).alias("start"), F.col("lines").cast("bigint").alias("lines")
    )
    mentions = as_owner.unionByName(as_author)
    if exclude is not None:
        mentions = mentions.where(F.col("name") != exclude)
    # files are visited in order, owners before contributors within a file
    people = mentions.groupBy(*scope, "name").agg(
        F.min(F.struct("file_no", "kind", "start", "lines")).alias("first"), F.count_if(F.col("kind") == 0).alias("owner_of")
    )
    later = F.col("owner_of") - F.when(F.col("first.kind") == 0, 1).otherwise(0)
    confidence = F.least(F.col("first.start") + 0.1 * later, F.greatest(F.lit(1.0), F.col("first.start")))
    scored = people.select(*scope, "name", F.bround(confidence, 6).alias("confidence"), (F.col("first.kind") == 0).alias("expertise_match"), F.col("first.file_no").alias("file_no"), F.col("first.lines").alias("lines"))
    if k is None:
        return scored
    if not scope:
        return scored.orderBy(F.col("confidence").desc(), "name").limit(k)
    w = Window.partitionBy(*scope).orderBy(F.col("confidence").desc(), "name")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
