"""Endpoints, API calls and the links between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import names, routes as rf
from codequarry.session import cut


def endpoints_of(chunks: DataFrame) -> DataFrame:
    """Backend endpoints from chunk metadata."""
    route = F.col("metadata.route")
    method = F.upper(F.coalesce(route["method"], F.lit("GET")))
    path = F.coalesce(route["path"], F.lit("/"))
    return chunks.where(route.isNotNull()).select(
        names.short_hash(F.col("repo_name"), F.col("file_path"), method, path).alias("id"),
        rf.normalized(path, method, route["framework"]).alias("route"),
        F.col("id").alias("chunk_id"),
        names.qualified_name(F.col("parent_name"), F.col("name")).alias("qualified_name"),
        "file_path",
        "repo_name",
        "language",
    )


def api_calls_of(chunks: DataFrame) -> DataFrame:
    """Outgoing API calls from chunk metadata."""
    called = chunks.select("*", F.explode("metadata.outgoing_api_calls").alias("call")).where("call.url <> ''")
    method = F.upper(F.coalesce("call.method", F.lit("GET")))
    return called.select(
        names.short_hash(F.col("repo_name"), F.col("file_path"), F.col("start_line"), method, F.col("call.url")).alias("id"),
        rf.normalized(F.col("call.url"), method).alias("route"),
        F.col("call.url").alias("url"),
        F.col("id").alias("chunk_id"),
        names.qualified_name(F.col("parent_name"), F.col("name")).alias("caller_qualified_name"),
        "file_path",
        "repo_name",
        F.col("start_line").alias("line_number"),
    )


def find_endpoints(endpoints: DataFrame, method: str | None = None, path: str | None = None, repo: str | None = None, language: str | None = None) -> DataFrame:
    """Endpoints by any of verb, path pattern (``*`` matches anything), repository and language."""
    found = endpoints
    if method is not None:
        found = found.where(F.col("route.method") == method.upper())
    if path is not None:
        found = found.where(F.col("route.path_pattern").like(path.replace("*", "%")))
    for column, value in (("repo_name", repo), ("language", language)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found.orderBy("route.path_pattern", "route.method", "id")


def find_api_calls(api_calls: DataFrame, method: str | None = None, url: str | None = None, repo: str | None = None) -> DataFrame:
    """Calls by any of verb, address (``*`` matches anything) and repository."""
    found = api_calls
    if method is not None:
        found = found.where(F.col("route.method") == method.upper())
    if url is not None:
        found = found.where(F.col("url").like(url.replace("*", "%")))
    if repo is not None:
        found = found.where(F.col("repo_name") == repo)
    return found.orderBy("url", "route.method", "id")


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """First ``k`` ids per key; the limit is applied before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy("id")
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def link(
    api_calls: DataFrame,
    endpoints: DataFrame,
    min_confidence: float = fixed.ROUTE_MIN_CONFIDENCE,
    per_call: int = fixed.ROUTE_MATCHES_PER_CALL,
    margin: float = fixed.ROUTE_AMBIGUITY_MARGIN,
) -> DataFrame:
    """The best endpoints of each call.

    Method, segment count and static segments must agree, which is equality of method and
    canonical path: a hash join. A score depends only on the spelled-out paths, the repositories
    and the endpoint language, so calls and endpoints that agree in those are one class each.
    A class needs no more than its first ``per_call`` ids, of the caller's repository and overall;
    thus one hot route never pairs all its calls with all its endpoints, and nothing is lost.
    """
    calls = api_calls.select(
        F.col("id").alias("call_id"), F.col("route.method").alias("method"), rf.canonical(F.col("route.path_segments")).alias("canonical"),
        F.col("route.path_segments").alias("call_segments"), F.col("repo_name").alias("call_repo"),
    )
    known = F.lower("language").isin(*fixed.ROUTE_LANGUAGES)
    targets = endpoints.select(
        "id", F.col("route.method").alias("method"), rf.canonical(F.col("route.path_segments")).alias("canonical"),
        F.col("route.path_segments").alias("endpoint_segments"), F.col("repo_name").alias("endpoint_repo"),
        F.when(known, F.lit("python")).otherwise("").alias("language"),
    )
    call_classes = calls.select("method", "canonical", "call_segments", "call_repo").distinct()
    shape = ["method", "canonical", "endpoint_segments", "language"]
    overall = _first(targets, shape, per_call)
    local = _first(targets, [*shape, "endpoint_repo"], per_call)
    everywhere = call_classes.join(overall, ["method", "canonical"])
    at_home = call_classes.join(local.withColumn("call_repo", F.col("endpoint_repo")), ["method", "canonical", "call_repo"])
    candidates = everywhere.unionByName(at_home).distinct()
    score = rf.match_scores(F.col("call_segments"), F.col("endpoint_segments"), F.col("call_repo") == F.col("endpoint_repo"), F.col("language"))
    scored = candidates.withColumn("score", score).where(F.col("score.confidence") >= min_confidence)
    group = ["method", "canonical", "call_segments", "call_repo"]
    w = Window.partitionBy(*group).orderBy(F.col("score.confidence").desc(), "id")
    kept = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_call)
    whole = Window.partitionBy(*group)
    best, alternatives = F.max("score.confidence").over(whole), F.count("*").over(whole)
    ambiguous = (alternatives > 1) & (best - F.col("score.confidence") <= margin)
    classes = kept.select(
        *group, F.col("id").alias("endpoint_id"), "rank", "score", ambiguous.alias("is_ambiguous"),
        F.when(ambiguous, alternatives).otherwise(0).cast("int").alias("alternatives"),
    )
    return calls.join(classes, group).select(
        "call_id", "endpoint_id", F.col("score.confidence").alias("confidence"), "is_ambiguous", "alternatives", "rank",
        F.struct("score.path_structure", "score.param_position", "score.param_name", "score.context").alias("match_details"),
    )


def wide_links(links: DataFrame, api_calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Links beside their call and endpoint."""
    calls = api_calls.select(
        F.col("id").alias("call_id"), "caller_qualified_name", "url", F.col("file_path").alias("call_file"),
        F.col("line_number").alias("call_line"), F.col("repo_name").alias("call_repo"),
    )
    targets = endpoints.select(
        F.col("id").alias("endpoint_id"), "qualified_name", F.col("route.path_pattern").alias("path_pattern"),
        F.col("file_path").alias("endpoint_file"), F.col("repo_name").alias("endpoint_repo"),
    )
    return links.join(calls, "call_id").join(targets, "endpoint_id")


def ambiguous_links(links: DataFrame, api_calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    return wide_links(links.where("is_ambiguous"), api_calls, endpoints)


def unlinked_calls(api_calls: DataFrame, links: DataFrame) -> DataFrame:
    return api_calls.join(links.select(F.col("call_id").alias("id")), "id", "left_anti")


def unlinked_endpoints(endpoints: DataFrame, links: DataFrame) -> DataFrame:
    return endpoints.join(links.select(F.col("endpoint_id").alias("id")), "id", "left_anti")


def pattern_conflicts(endpoints: DataFrame) -> DataFrame:
    """Routes with more than one registered endpoint, by exact pattern."""
    return (
        endpoints.groupBy(F.col("route.method").alias("method"), F.col("route.path_pattern").alias("path_pattern"))
        .agg(F.count("*").alias("n_handlers"), F.min("qualified_name").alias("first_handler"), F.max("qualified_name").alias("last_handler"))
        .where("n_handlers > 1")
    )


def handler_conflicts(endpoints: DataFrame) -> DataFrame:
    """Routes whose canonical form has more than one distinct handler."""
    return (
        endpoints.groupBy(F.col("route.method").alias("method"), rf.canonical(F.col("route.path_segments")).alias("canonical"))
        .agg(F.countDistinct("qualified_name").alias("n_handlers"), F.count("*").alias("n_endpoints"))
        .where("n_handlers > 1")
    )


def conflict_members(endpoints: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The endpoints of the pattern conflicts, one row each (a hot route stays rows, not one long list)."""
    keyed = endpoints.withColumn("method", F.col("route.method")).withColumn("path_pattern", F.col("route.path_pattern"))
    return keyed.join(conflicts.select("method", "path_pattern"), ["method", "path_pattern"], "left_semi").select(
        "method", "path_pattern", "id", "qualified_name", "repo_name"
    )


def registry_stats(endpoints: DataFrame, api_calls: DataFrame, links: DataFrame) -> DataFrame:
    """One row: the link figures never depend on a repository filter of the other two."""
    n_endpoints = endpoints.agg(F.count("*").alias("total_endpoints"))
    n_calls = api_calls.agg(F.count("*").alias("total_calls"))
    linked = links.agg(
        F.count("*").alias("total_links"),
        F.coalesce(F.count_if("is_ambiguous"), F.lit(0)).alias("ambiguous_links"),
        F.coalesce(F.bround(F.avg("confidence"), 3), F.lit(0.0)).alias("average_confidence"),
    )
    return n_endpoints.crossJoin(n_calls).crossJoin(linked)  # three one-row frames


def linking_stats(endpoints: DataFrame, api_calls: DataFrame, links: DataFrame, edges_created: int = 0) -> DataFrame:
    """The figures of a linking run as (statistic, value) rows; the links are computed once."""
    links = cut(links.select("call_id", "endpoint_id", "is_ambiguous"))

    def row(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("value")).select(F.lit(name).alias("statistic"), "value")

    parts = [
        row("endpoints_found", endpoints),
        row("api_calls_found", api_calls),
        row("links_matched", links),
        row("links_confident", links.where("not is_ambiguous")),
        row("links_ambiguous", links.where("is_ambiguous")),
        row("unlinked_calls", unlinked_calls(api_calls, links)),
        row("unlinked_endpoints", unlinked_endpoints(endpoints, links)),
        row("conflicts_detected", handler_conflicts(endpoints)),
        links.agg(F.lit(edges_created).cast("bigint").alias("value")).select(F.lit("edges_created").alias("statistic"), "value"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def spec_coverage(code: DataFrame, spec: DataFrame) -> DataFrame:
    """Code endpoints against specification endpoints on method and pattern.

    Inputs have ``method, path_pattern, qualified_name``. A specification route pairs with the
    first code endpoint of its key; further ones are missing from the specification.
    """
    code_first = code.groupBy("method", "path_pattern").agg(F.min("qualified_name").alias("code_endpoint"), F.count("*").alias("n_code"))
    spec_last = spec.groupBy("method", "path_pattern").agg(F.max("qualified_name").alias("spec_endpoint"))
    joined = code_first.join(spec_last, ["method", "path_pattern"], "full_outer")
    status = (
        F.when(F.col("code_endpoint").isNull(), "missing_from_code")
        .when(F.col("spec_endpoint").isNull(), "missing_from_spec")
        .otherwise("matching")
    )
    missing = F.when(status == "missing_from_spec", F.col("n_code")).when(status == "matching", F.col("n_code") - 1).otherwise(0)
    return joined.select("method", "path_pattern", "code_endpoint", "spec_endpoint", status.alias("status"), missing.alias("code_missing_from_spec"))


def coverage_percent(coverage: DataFrame, n_spec: int | None = None) -> DataFrame:
    matched = F.count_if(F.col("status") == "matching")
    total = F.count_if(F.col("status") != "missing_from_spec")
    return coverage.agg(
        matched.alias("matching_count"),
        total.alias("total_spec_routes"),
        F.when(total == 0, 0.0).otherwise(F.bround(matched / total * 100, 1)).alias("coverage_percent"),
    )


def merge_spec_links(code_links: DataFrame, spec_links: DataFrame) -> DataFrame:
    """Specification matches only for calls no code endpoint answers."""
    extra = spec_links.join(code_links.select("call_id"), "call_id", "left_anti")
    return code_links.unionByName(extra)


def api_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Routes removed and added between two versions."""
    key = ["method", "path_pattern"]
    removed = before.select(*key).subtract(after.select(*key)).withColumn("change", F.lit("removed"))
    added = after.select(*key).subtract(before.select(*key)).withColumn("change", F.lit("added"))
    return removed.unionByName(added)


def clear(repo: str, endpoints: DataFrame, api_calls: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The registry without one repository: its rows, and every link that touches them."""
    gone_calls = api_calls.where(F.col("repo_name") == repo).select(F.col("id").alias("call_id"))
    gone_endpoints = endpoints.where(F.col("repo_name") == repo).select(F.col("id").alias("endpoint_id"))
    kept = links.join(gone_calls, "call_id", "left_anti").join(gone_endpoints, "endpoint_id", "left_anti")
    return endpoints.where(F.col("repo_name") != repo), api_calls.where(F.col("repo_name") != repo), kept
