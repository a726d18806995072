"""Patterns, libraries, testing conventions and exemplary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import lines as lf, names, regex as rx


def pattern_hits(chunks: DataFrame, category: str | None = None, places: bool = False) -> DataFrame:
    """Per chunk and pattern the number of matches, and on demand all places; a narrow projection."""
    per_pattern = []
    for group, patterns in fixed.CODE_PATTERNS.items():
        if category is not None and group != category:
            continue
        for name, regexes in patterns.items():
            total = F.lit(0)
            for regex in regexes:
                total = total + rx.count(F.col("content"), regex)
            fields = [F.lit(group).alias("category"), F.lit(name).alias("pattern_name"), total.alias("n")]
            if places:
                fields.append(F.flatten(F.array(*[lf.located(F.col("content"), r) for r in regexes])).alias("places"))
            per_pattern.append(F.struct(*fields))
    return chunks.select("id", "repo_name", "file_path", "start_line", F.inline(F.array(*per_pattern))).where("n > 0")


def pattern_report(hits: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Occurrences, share within the category and the most used pattern (ties by name).

    The window runs over the aggregated table: at most 22 rows per scope.
    """
    scope = scope or []
    counts = hits.groupBy(*scope, "category", "pattern_name").agg(F.sum("n").alias("occurrence_count"))
    group = Window.partitionBy(*scope, "category")
    best = group.orderBy(F.col("occurrence_count").desc(), "pattern_name")
    return counts.select(
        *scope, "category", "pattern_name", "occurrence_count",
        F.bround(F.col("occurrence_count") / F.sum("occurrence_count").over(group) * 100, 1).alias("percentage"),
        (F.row_number().over(best) == 1).alias("recommended"),
    )


def pattern_examples(hits: DataFrame, k: int = 3) -> DataFrame:
    """The first places of every pattern (hits with places); the limit applies before and after the shuffle."""
    places = hits.select("category", "pattern_name", "repo_name", "file_path", "start_line", F.explode("places").alias("p")).select(
        "category", "pattern_name", "repo_name", "file_path", (F.col("start_line") + F.col("p.line")).alias("line_number"),
        F.substring("p.matched", 1, 100).alias("code_snippet"), F.lit(0.9).alias("confidence"),
    )
    w = Window.partitionBy("category", "pattern_name").orderBy("repo_name", "file_path", "line_number", "code_snippet")
    return places.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def momentum(uses: DataFrame, name: str, moment: str, now: Column, days: int = 30) -> DataFrame:
    """Recent against previous period: more than 20 % up is increasing, 20 % down decreasing."""
    recent = (F.col(moment) > now - F.make_interval(days=F.lit(days))) & (F.col(moment) <= now)
    previous = (F.col(moment) > now - F.make_interval(days=F.lit(2 * days))) & (F.col(moment) <= now - F.make_interval(days=F.lit(days)))
    counted = uses.groupBy(name).agg(F.count_if(recent).alias("recent"), F.count_if(previous).alias("previous"))
    trend = (
        F.when(F.col("recent") > F.col("previous") * 1.2, "increasing")
        .when(F.col("recent") < F.col("previous") * 0.8, "decreasing")
        .otherwise("stable")
    )
    return counted.withColumn("momentum", trend)


def library_of_import(statement: Column) -> Column:
    """Library named by an import statement of any supported language."""
    tries = [
        F.regexp_extract(statement, r"^(?U)from\s+(\w+)", 1),
        F.regexp_extract(statement, r"^(?U)import\s+(\w+)", 1),
        F.regexp_extract(statement, r"(?U)from\s+['\"](@?\w+)", 1),
        F.regexp_extract(statement, r"^(?U)import\s+[\w.]+\.(\w+);?", 1),
    ]
    return F.lower(F.coalesce(*[F.nullif(t, F.lit("")) for t in tries]))


def library_category(name: Column) -> Column:
    result = F.lit(None).cast("string")
    for category, libraries in reversed(list(fixed.LIBRARY_CATEGORIES.items())):
        result = F.when(F.lower(name).isin(*libraries), category).otherwise(result)
    return result


def library_calls(content: Column, category: str | None = None) -> Column:
    """Every ``library.`` in a text, found in one pass over all known names."""
    known = [l for c, ls in fixed.LIBRARY_CATEGORIES.items() if category in (None, c) for l in ls]
    regex = r"(?iU)\b(" + "|".join(rx.quote(l) for l in known) + r")\."
    return F.transform(F.regexp_extract_all(content, F.lit(regex), F.lit(1)), lambda l: F.lower(l))


def library_uses(chunks: DataFrame, category: str | None = None) -> DataFrame:
    """One row per chunk and library with its import and call counts."""
    imports = chunks.select("repo_name", "file_path", "start_line", "id", F.explode("imports").alias("statement")).select(
        "repo_name", "file_path", "start_line", "id", library_of_import(F.col("statement")).alias("library"), F.lit(1).alias("imports"), F.lit(0).alias("calls")
    )
    calls = chunks.select("repo_name", "file_path", "start_line", "id", F.explode(library_calls(F.col("content"), category)).alias("library")).select(
        "repo_name", "file_path", "start_line", "id", "library", F.lit(0).alias("imports"), F.lit(1).alias("calls")
    )
    return imports.where("library is not null").unionByName(calls)


def library_report(uses: DataFrame, category: str | None = None) -> DataFrame:
    """Imports, importing files and calls of each library."""
    importing = F.when(F.col("imports") > 0, F.struct("repo_name", "file_path"))
    report = uses.groupBy("library").agg(
        F.sum("imports").alias("import_count"),
        F.countDistinct(importing).alias("file_count"),
        F.sum("calls").alias("call_count"),
    ).withColumn("category", library_category(F.col("library")))
    return report if category is None else report.where(F.col("category") == category)


def library_examples(uses: DataFrame, k: int = 3) -> DataFrame:
    """The first chunks that call each library."""
    places = uses.where("calls > 0").select("library", "repo_name", "file_path", "start_line").distinct()
    w = Window.partitionBy("library").orderBy("repo_name", "file_path", "start_line")
    return places.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_libraries(report: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("category").orderBy((F.col("import_count") + F.col("call_count")).desc(), "library")
    return report.where("category is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def testing_conventions(chunks: DataFrame) -> DataFrame:
    """Frameworks by file name, with the file patterns and assertion styles seen."""
    framework, shown = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, regex, label in reversed(fixed.TEST_FILE_CONVENTIONS):
        hit = rx.matches(F.col("file_path"), regex)
        framework = F.when(hit, name).otherwise(framework)
        shown = F.when(hit, label).otherwise(shown)
    files = (
        chunks.select(framework.alias("framework"), shown.alias("shown")).where("framework is not null")
        .groupBy("framework").agg(F.count("*").alias("usage_count"), F.sort_array(F.collect_set("shown")).alias("file_patterns"))
    )
    styles = F.array(*[F.when(rx.matches(F.col("content"), regex), F.struct(F.lit(name).alias("framework"), F.lit(label).alias("style")))
                       for name, regex, label in fixed.ASSERTION_STYLES])
    seen = (
        chunks.select(F.inline(F.filter(styles, lambda s: s.isNotNull()))).distinct()
        .groupBy("framework").agg(F.sort_array(F.collect_set("style")).alias("common_assertions"))
    )
    mock = F.create_map(*[F.lit(x) for pair in fixed.MOCK_LIBRARIES.items() for x in pair])
    return files.join(seen, "framework", "left").select(
        "framework", "usage_count", "file_patterns",
        F.coalesce("common_assertions", F.array().cast("array<string>")).alias("common_assertions"),
        mock[F.col("framework")].alias("mock_library"),
    )


def is_test_file(path: Column) -> Column:
    lowered = F.lower(path)
    return rx.any_contains(lowered, ["test_", "_test.", ".test.", ".spec.", "/tests/", "/test/"]) | F.contains(path, F.lit("Test."))


def import_references(chunks: DataFrame) -> DataFrame:
    """How many chunks of other files import each file, by file stem.

    An import mentions a file when one of its identifiers equals the stem, so the count is an
    equality join on identifiers instead of a substring test of every file against every import.
    """
    mentions = (
        chunks.select("id", "repo_name", "file_path", F.explode("imports").alias("statement"))
        .select("id", "repo_name", "file_path", F.explode(F.array_distinct(F.split(F.lower("statement"), r"[^\p{L}\p{N}_\-]+"))).alias("stem"))
        .where("stem <> ''").distinct()
    )
    by_stem = mentions.groupBy("repo_name", "stem").agg(F.count("*").alias("n"))
    own = mentions.where(F.col("stem") == F.lower(names.file_stem(F.col("file_path")))).groupBy("repo_name", "file_path").agg(F.count("*").alias("own"))
    files = chunks.select("repo_name", "file_path").distinct().withColumn("stem", F.lower(names.file_stem(F.col("file_path"))))
    return (
        files.join(by_stem, ["repo_name", "stem"]).join(own, ["repo_name", "file_path"], "left")
        .select("repo_name", "file_path", (F.col("n") - F.coalesce("own", F.lit(0))).alias("ref_count"))
    )


def tested_files(files: DataFrame) -> DataFrame:
    """Source files with a test file named after them, in the same repository."""
    stem = names.file_stem(F.col("file_path"))
    suffix = F.regexp_extract("file_path", r"(\.[^./]*)$", 1)
    candidates = F.array(
        F.concat(F.lit("test_"), stem, suffix), F.concat(stem, F.lit("_test"), suffix), F.concat(stem, F.lit(".test"), suffix),
        F.concat(stem, F.lit(".spec"), suffix), F.concat(stem, F.lit("Test"), suffix),
    )
    wanted = files.select("repo_name", "file_path", F.explode(candidates).alias("test_name"))
    present = files.select("repo_name", names.file_name(F.col("file_path")).alias("test_name")).distinct()
    return wanted.join(present, ["repo_name", "test_name"], "left_semi").select("repo_name", "file_path").distinct()


def golden_files(chunks: DataFrame, k: int | None = 10) -> DataFrame:
    """Exemplary files by points for documentation, density, tests, size and references."""
    points = fixed.GOLDEN_POINTS
    files = (
        chunks.where(~is_test_file(F.col("file_path")))
        .groupBy("repo_name", "file_path")
        .agg(
            F.count("*").alias("symbol_count"),
            F.max("end_line").alias("line_count"),
            F.coalesce(F.max((F.col("docstring") != "")), F.lit(False)).alias("documented"),
        )
        .where("symbol_count >= 2")
    )
    tested = tested_files(chunks.select("repo_name", "file_path").distinct()).withColumn("tested", F.lit(True))
    joined = files.join(tested, ["repo_name", "file_path"], "left").join(import_references(chunks), ["repo_name", "file_path"], "left")
    dense = (F.col("line_count") > 0) & (F.col("symbol_count") / F.col("line_count") * 100 > 5)
    has_test = F.coalesce("tested", F.lit(False))
    references = F.coalesce("ref_count", F.lit(0))
    rules = [
        (F.col("documented"), points["docstring"], F.lit("Contains documentation")),
        (dense, points["dense"], F.lit("Well-structured code")),
        (has_test, points["tested"], F.lit("Has associated tests")),
        (F.col("symbol_count") >= 5, points["large"], F.lit("Comprehensive implementation")),
        (references >= 3, points["referenced"], F.concat(F.lit("Referenced by "), references.cast("string"), F.lit(" files"))),
    ]
    score = F.lit(0)
    for condition, value, _ in rules:
        score = score + F.when(condition, value).otherwise(0)
    scored = joined.select(
        "repo_name", "file_path", "symbol_count", F.least(score, F.lit(100)).alias("score"), has_test.alias("test_coverage_indicator"),
        F.filter(F.array(*[F.when(c, text) for c, _, text in rules]), lambda r: r.isNotNull()).alias("reasons"),
    ).where(F.col("score") >= points["minimum"])
    ordered = scored.orderBy(F.col("score").desc(), "repo_name", "file_path")
    return scored if k is None else ordered.limit(k)
