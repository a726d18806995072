"""Dictionary-shaped tools over an index.

Each tool composes operators and collects only what it shows: lists are cut to their stated
length on the cluster, totals are counted there. Errors are values.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import names
from codequarry.operators import (
    conventions, counts, diagrams, formatting, graph, impact, inheritance as inh, metrics, ownership, routes, search, security, symbols, usages,
)
from codequarry.plans import rendering
from codequarry.session import cut

CHUNK_TYPES = ["module", "class", "interface", "function", "method", "constructor", "property", "constant", "import", "comment", "documentation"]


@dataclass
class Index:
    """The tables the tools read."""

    chunks: DataFrame
    calls: DataFrame
    inheritance: DataFrame
    embeddings: DataFrame | None = None
    class_dependencies: DataFrame | None = None
    model: str = "mock"
    settings: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, store, model: str = "mock") -> Index:
        return cls(store.read("chunks"), store.read("calls"), store.read("inheritance"), store.read("embeddings"), store.read("class_dependencies"), model)

    @property
    def symbols(self) -> DataFrame:
        return symbols.symbols(self.chunks)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _count(df: DataFrame) -> int:
    return df.count()


def _named(symbol: str) -> dict | None:
    return None if symbol and symbol.strip() else {"error": "Symbol name cannot be empty"}


# ---- search ---------------------------------------------------------------------------------


def semantic_grep(
    index: Index, query: str, n_results: int = 10, repo_filter: str | None = None, type_filter: str | None = None, language_filter: str | None = None,
    similarity_threshold: float | None = None, detail_level: str = "preview", token_budget: int | None = None,
) -> dict:
    if not query or not query.strip():
        return {"error": "Query cannot be empty"}
    if type_filter and type_filter.lower() not in CHUNK_TYPES:
        return {"error": f"Invalid type_filter. Options: {CHUNK_TYPES}"}
    if detail_level.lower() not in formatting.LEVELS:
        return {"error": f"Invalid detail_level. Options: {formatting.LEVELS}"}
    threshold = fixed.SIMILARITY_THRESHOLD if similarity_threshold is None else similarity_threshold
    hits = search.hybrid(
        index.chunks, index.embeddings.where(F.col("model") == index.model), search.embed_query(query, index.model), n_results, repo_filter,
        type_filter.lower() if type_filter else None, language_filter, query, threshold,
    )
    level, shown = detail_level.lower(), n_results
    found = hits.count() if token_budget else None
    if token_budget:
        level, shown = formatting.fit_on_driver(found, level, token_budget, n_results)
    score = F.round("score", 3).alias("similarity")
    rows = _rows(formatting.view(hits.limit(shown), level, ["score"]).select("*", score).drop("score").orderBy(F.col("similarity").desc(), "location"))
    return {
        "query": query, "results": rows, "total_results": len(rows),
        "stats": {"detail_level": level, "estimated_tokens": len(rows) * fixed.TOKENS_PER_ITEM[level], "threshold": threshold},
    }


def get_context(index: Index, symbol_name: str, repo_filter: str | None = None, include_related: bool = True) -> dict:
    if error := _named(symbol_name):
        return error
    table = symbols.fuzzy(index.symbols, symbol_name, repo_filter, 5)
    chunks = index.chunks.join(F.broadcast(table.select(F.col("chunk_id").alias("id"))), "id", "left_semi")
    matches = _rows(formatting.view(chunks, "full").orderBy(F.col("name") != symbol_name, "qualified_name", "location"))
    if not matches:
        return {"symbol": symbol_name, "found": False, "message": f"Symbol '{symbol_name}' not found"}
    result: dict = {"symbol": symbol_name, "found": True, "matches": matches}
    if include_related:
        result["related"] = _rows(symbols.related(index.chunks, chunks, 10, 5).orderBy("target_id", "relation", "rank"))
    return result


def file_summary(index: Index, file_path: str, repo_name: str | None = None) -> dict:
    if not file_path or not file_path.strip():
        return {"error": "File path cannot be empty"}
    found = symbols.files_ending_with(index.symbols, file_path, repo_name).first()
    if not found:
        return {"error": f"No symbols found for file: {file_path}"}
    members = _rows(symbols.by_file(index.symbols, found["repo_name"], found["file_path"]))
    classes = [
        {**m, "members": [c for c in members if c["parent_name"] == m["name"]]} for m in members if m["symbol_type"] in ("class", "interface")
    ]
    functions = [m for m in members if not m["parent_name"] and m["symbol_type"] not in ("class", "interface")]
    return {"file": found["file_path"], "repo": found["repo_name"], "classes": classes, "functions": functions, "total_symbols": len(members)}


def get_index_stats(index: Index) -> dict:
    rows = _rows(symbols.index_stats(index.chunks))
    pick = lambda d: {r["value"]: r["n"] for r in rows if r["dimension"] == d}
    return {"total_chunks": pick("total").get("all", 0), "repositories": sorted(pick("repo")), "by_language": pick("language"), "by_type": pick("type")}


def get_symbol_stats(index: Index) -> dict:
    rows = _rows(counts.count_by_each(index.symbols, ["symbol_type", "repo_name", "language"]))
    calls = _rows(graph.call_stats(index.calls))[0]
    hot = _rows(counts.top(index.calls, "callee", 10, "call_count"))
    return {"symbols": rows, "calls": {**calls, "hotspots": hot, "by_repo": _rows(counts.count_by(index.calls, "repo_name"))}}


# ---- navigation --------------------------------------------------------------------------------


def lookup_symbol(index: Index, name: str, repo_filter: str | None = None, exact: bool = True, limit: int = 50) -> dict:
    found = symbols.lookup(index.symbols, name, repo_filter) if exact else symbols.prefix_search(symbols.in_repo(index.symbols, repo_filter), name, limit)
    return {"symbol": name, "total": _count(found), "results": _rows(found.limit(limit))}


def find_callers(index: Index, symbol: str, repo_filter: str | None = None, max_depth: int = 1, limit: int = 20) -> dict:
    found = graph.find_callers(index.calls, symbol, repo_filter, max_depth)
    return {"symbol": symbol, "total_callers": _count(found), "callers": _rows(found.orderBy("caller", "caller_file", "caller_line").limit(limit))}


def find_callees(index: Index, symbol: str, repo_filter: str | None = None, max_depth: int = 1, limit: int = 20) -> dict:
    found = graph.find_callees(index.calls, symbol, repo_filter, max_depth)
    return {"symbol": symbol, "total_callees": _count(found), "callees": _rows(found.orderBy("callee", "caller_file", "caller_line").limit(limit))}


def find_call_path(index: Index, from_symbol: str, to_symbol: str, repo_filter: str | None = None, max_depth: int = 10) -> dict:
    row = graph.find_path(index.calls, from_symbol, to_symbol, repo_filter, max_depth).first()
    return {"from": from_symbol, "to": to_symbol, "found": row is not None, "path": list(row["path"]) if row else None, "length": row["length"] if row else None}


def get_symbol_context(index: Index, symbol: str, repo_filter: str | None = None) -> dict:
    definition = symbols.lookup(index.symbols, symbol, repo_filter).limit(1)
    return {"symbol": symbol, "definition": _rows(definition), "callers": find_callers(index, symbol, repo_filter), "callees": find_callees(index, symbol, repo_filter)}


def get_class_members(index: Index, class_name: str, repo_filter: str | None = None, limit: int = 500) -> dict:
    found = symbols.children(index.symbols, class_name, repo_filter)
    return {"class": class_name, "total": _count(found), "members": _rows(found.limit(limit))}


def find_usages(index: Index, symbol_name: str, repo_filter: str | None = None, include_definitions: bool = False, limit: int = 50) -> dict:
    if error := _named(symbol_name):
        return error
    found = cut(usages.find_usages(index.chunks, index.calls, symbol_name, repo_filter, include_definitions))
    rows = _rows(usages.listed(found, limit).orderBy("category", "repo_name", "file_path", "line"))
    grouped: dict[str, list] = {}
    for row in rows:
        grouped.setdefault(row.pop("category"), []).append(row)
    return {"symbol": symbol_name, "total_usages": _count(found), "usages": grouped}


def find_implementations(index: Index, interface_name: str, repo_filter: str | None = None, include_indirect: bool = False, limit: int = 500) -> dict:
    if error := _named(interface_name):
        return error
    found = inh.all_implementations(index.inheritance, interface_name, repo_filter) if include_indirect else inh.implementations(index.inheritance, interface_name, repo_filter)
    return {"interface": interface_name, "total": _count(found), "implementations": _rows(found.orderBy("indirect", "child_name", "file_path").limit(limit))}


def find_hierarchy(index: Index, class_name: str, repo_filter: str | None = None, limit: int = 500) -> dict:
    if error := _named(class_name):
        return error
    rows = _rows(inh.hierarchy(index.inheritance, class_name, repo_filter).orderBy("relation", "name").limit(limit))
    result: dict = {"class": class_name, "implements": [], "extends": [], "implemented_by": [], "extended_by": []}
    for row in rows:
        result[row["relation"]].append(row["name"])
    return result


def find_tests(index: Index, symbol_name: str, repo_filter: str | None = None, limit: int = 500) -> dict:
    if error := _named(symbol_name):
        return error
    files = usages.test_files(index.chunks, symbol_name, repo_filter)
    methods = usages.test_methods(index.chunks, symbol_name, repo_filter)
    return {
        "symbol": symbol_name, "test_files_count": _count(files), "test_methods_count": _count(methods),
        "test_files": _rows(files.orderBy("repo_name", "file_path").limit(limit)), "test_methods": _rows(methods.orderBy("repo_name", "file_path", "line").limit(limit)),
    }


# ---- change ---------------------------------------------------------------------------------------


def diff_impact(index: Index, changed: DataFrame, include_tests: bool = True) -> dict:
    """Impact of changed files (columns repo_name, file_path); ``sources.git`` lists them for a working copy."""
    modified = impact.modified_symbols(index.symbols, changed)
    impacted = impact.impacted_callers(index.calls, modified)
    summary = _rows(impact.diff_summary(changed, modified, impacted))
    result: dict = {
        "status": "analyzed" if summary else "no_changes", "summary": summary,
        "modified_symbols": _rows(modified.orderBy("repo_name", "file_path", "start_line").limit(50)),
        "impacted_callers": _rows(impacted.orderBy("repo_name", "caller", "caller_line").limit(50)),
    }
    if include_tests:
        tests = cut(usages.affected_tests(index.chunks, modified))
        result["total_affected_tests"] = _count(tests)
        result["affected_tests"] = _rows(tests.orderBy("repo_name", "tests_symbol", "match_reason", "file_path", "line", "name").limit(20))
    return result


def _base(symbol: str) -> str:
    return symbol.rsplit(".", 1)[-1]


def explore(
    index: Index, symbol_name: str, repo_filter: str | None = None, depth: str = "normal", max_callers: int = 10, max_callees: int = 10, detail_level: str = "summary"
) -> dict:
    if error := _named(symbol_name):
        return error
    if depth.lower() not in ("shallow", "normal", "deep"):
        return {"error": "Invalid depth. Options: ['shallow', 'normal', 'deep']"}
    if detail_level.lower() not in formatting.LEVELS:
        return {"error": f"Invalid detail_level. Options: {formatting.LEVELS}"}
    level = detail_level.lower()
    definition = _definition(index, symbol_name, level, repo_filter)
    callers, callees = find_callers(index, symbol_name, repo_filter, 1, max_callers), find_callees(index, symbol_name, repo_filter, 1, max_callees)
    result: dict = {
        "symbol": symbol_name, "depth": depth.lower(), "definition": definition, "callers": callers["callers"], "total_callers": callers["total_callers"],
        "callees": callees["callees"], "total_callees": callees["total_callees"],
    }
    if depth.lower() != "shallow":
        result["tests"] = _rows(usages.test_methods(index.chunks, _base(symbol_name), repo_filter).orderBy("repo_name", "file_path", "line").limit(5))
    result["impact_radius"] = graph.impact_radius(index.calls, symbol_name, repo_filter, depth.lower() == "deep").first()[0]
    tokens = 100 + (fixed.TOKENS_PER_ITEM[level] if definition else 0) + 30 * (len(result["callers"]) + len(result["callees"])) + 20 * len(result.get("tests", []))
    result["stats"] = {"detail_level": level, "estimated_tokens": tokens}
    return result


def _definition(index: Index, symbol: str, level: str, repo: str | None) -> dict | None:
    hit = symbols.lookup(index.symbols, symbol, repo).select("chunk_id").first()
    if hit is None:
        return None
    rows = _rows(formatting.view(index.chunks.where(F.col("id") == hit[0]), level))
    return rows[0] if rows else None


def understand(index: Index, symbol_name: str, repo_filter: str | None = None, include_implementation: bool = True, max_depth: int = 2) -> dict:
    if error := _named(symbol_name):
        return error
    result: dict = {"symbol": symbol_name}
    if include_implementation:
        result["definition"] = _definition(index, symbol_name, "full", repo_filter)
        if result["definition"]:
            result["implementation"] = result["definition"]["content"]
    result["hierarchy"] = find_hierarchy(index, symbol_name.split(".")[0], repo_filter)
    chain = _rows(graph.dependency_chain(index.calls, symbol_name, repo_filter, show=20))
    result["dependencies"] = {k: [r["name"] for r in chain if r["kind"] == k and (k == "direct" or max_depth > 1)] for k in ("direct", "transitive")}
    if result.get("definition"):
        row = index.chunks.where(F.col("id") == result["definition"]["id"]).select(impact.data_flow(F.col("signature"), F.col("docstring")).alias("f")).first()
        result["data_flow"] = row["f"].asDict(recursive=True)
    totals = _rows(usages.usage_totals(usages.find_usages(index.chunks, index.calls, symbol_name, repo_filter, limit=None)))
    found = {r["category"]: r["n"] for r in totals}
    result["usage_summary"] = {k: found.get(k, 0) for k in ("calls", "type_hints", "inheritance", "imports")}
    return result


def prepare_change(index: Index, symbol_name: str, repo_filter: str | None = None, change_type: str = "modify") -> dict:
    if error := _named(symbol_name):
        return error
    if change_type not in fixed.CHANGE_MULTIPLIER:
        return {"error": f"Invalid change_type. Options: {list(fixed.CHANGE_MULTIPLIER)}"}
    reach = graph.dependents(index.calls, symbol_name, repo_filter)
    hops = {r["hop"]: r["n"] for r in reach.groupBy("hop").agg(F.count("*").alias("n")).collect()}
    direct, transitive = hops.get(1, 0), hops.get(2, 0)
    first_files = _rows(
        graph.direct_callers(index.calls, symbol_name, repo_filter).groupBy(F.col("caller_file").alias("file"))
        .agg(F.min(F.struct(F.col("caller").alias("symbol"), F.col("caller_line").alias("line"))).alias("f")).select("file", "f.line", "f.symbol").orderBy("symbol", "file").limit(15)
    )
    tests = find_tests(index, _base(symbol_name), repo_filter, 10)
    affected_tests = [t["name"] for t in tests["test_methods"]]
    files = reach.select("caller_file")
    risks = {
        "modify": [], "delete": [f"Deleting will break {direct} direct callers"],
        "rename": [f"Renaming requires updating {direct} call sites"] + ([f"Update {tests['test_methods_count']} tests that reference this symbol"] if tests["test_methods_count"] else []),
        "signature": ["Signature changes may require updating all call sites"],
    }[change_type]
    if change_type == "signature" and "." in symbol_name:
        n = _count(inh.implementations(index.inheritance, symbol_name.rsplit(".", 1)[0], repo_filter))
        risks += [f"May affect {n} implementations"] if n else []
    impact_size = (direct + 0.5 * transitive) * fixed.CHANGE_MULTIPLIER[change_type] * (1.5 if not affected_tests and direct else 1.0)
    level = next((name for bound, name in ((3, "low"), (10, "medium"), (25, "high")) if impact_size <= bound), "critical")
    review = [f["file"] for f in first_files] + [t["file_path"] for t in tests["test_files"][:5]]
    return {
        "symbol": symbol_name, "change_type": change_type, "direct_dependents": direct, "transitive_dependents": transitive, "affected_tests": affected_tests,
        "affected_files": [{**f, "reason": f"calls {symbol_name}"} for f in first_files], "breaking_risks": risks, "recommended_review": list(dict.fromkeys(review))[:10],
        "impact_summary": {
            "total_affected_symbols": direct + transitive, "total_affected_files": files.distinct().count(), "total_affected_tests": tests["test_methods_count"], "risk_level": level,
        },
    }


# ---- architecture ------------------------------------------------------------------------------------


def find_dead_code(index: Index, repo_name: str | None = None, limit: int = 100, include_entry_points: bool = True) -> dict:
    calls, chunks = symbols.in_repo(index.calls, repo_name), symbols.in_repo(index.chunks, repo_name)
    entries = graph.entry_points(chunks)
    dead = cut(graph.unreachable(calls, entries.select("node").distinct()))
    home = chunks.groupBy(names.qualified_name(F.col("parent_name"), F.col("name")).alias("node")).agg(F.min("file_path").alias("file"))
    shown = dead.orderBy("node").limit(limit).join(home, "node", "left").select(F.col("node").alias("symbol"), F.coalesce("file", F.lit("unknown")).alias("file"))
    n_dead = _count(dead)
    result = {
        "dead_code": _rows(shown.orderBy("symbol")),
        "statistics": {"total_symbols": _count(graph.all_symbols(calls)), "entry_point_count": _count(entries), "dead_count": n_dead, "showing": min(n_dead, limit)},
    }
    if include_entry_points:
        result["entry_points"] = _rows(entries.select(F.col("node").alias("symbol"), F.col("file_path").alias("file")).orderBy("symbol", "file").limit(50))
    return result


def detect_circular_dependencies(index: Index, repo_name: str | None = None, file_level: bool = True, limit: int = 50) -> dict:
    calls = symbols.in_repo(index.calls, repo_name)
    members = graph.file_cycles(calls) if file_level else graph.cycles(calls, "caller", "callee", ["repo_name"])
    members = cut(members)
    sizes = members.groupBy("repo_name", "component").agg(F.count("*").alias("size"))
    first = sizes.orderBy("repo_name", "component").limit(limit)
    shown = _rows(members.join(F.broadcast(first), ["repo_name", "component"]).orderBy("repo_name", "component", "node").limit(limit * 100))
    cycles: dict = {}
    for row in shown:
        cycles.setdefault((row["repo_name"], row["component"], row["size"]), []).append(row["node"])
    return {
        "level": "file" if file_level else "function", "cycles": [{"repo": k[0], "members": v, "size": k[2]} for k, v in cycles.items()],
        "statistics": {"total_cycles": _count(sizes), "largest": sizes.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]},
    }


def analyze_architecture(index: Index, repo_name: str | None = None) -> dict:
    dead = find_dead_code(index, repo_name, include_entry_points=False)
    files, functions = detect_circular_dependencies(index, repo_name, True), detect_circular_dependencies(index, repo_name, False)
    n = (dead["statistics"]["dead_count"], files["statistics"]["total_cycles"], functions["statistics"]["total_cycles"])
    row = index.chunks.sparkSession.range(1).select(impact.health_score(*[F.lit(x) for x in n]).alias("h")).first()["h"]
    texts = ("potentially unreachable symbols", "file-level circular dependencies", "function-level circular dependencies")
    return {
        "dead_code": dead, "circular_dependencies_file": files, "circular_dependencies_function": functions,
        "summary": {"health_score": row["health_score"], "issues": [f"{k} {t}" for k, t in zip(n, texts) if k], "recommendation": row["recommendation"]},
    }


def analyze_api_links(index: Index, repo_name: str | None = None, spec: DataFrame | None = None, min_confidence: float = fixed.ROUTE_MIN_CONFIDENCE, limit: int = 50) -> dict:
    """Links of calls to endpoints; calls no code answers may match a specification (endpoint rows of ``sources.openapi``)."""
    chunks = symbols.in_repo(index.chunks, repo_name)
    endpoints, calls = routes.endpoints_of(chunks), routes.api_calls_of(chunks)
    links = routes.link(calls, endpoints, min_confidence)
    known = endpoints
    if spec is not None:
        links = routes.merge_spec_links(links, routes.link(calls, spec, min_confidence))
        known = endpoints.unionByName(spec.select(*endpoints.columns))
    links = cut(links)
    wide = routes.wide_links(links, calls, known)
    order = ["confidence", "call_id", "endpoint_id"]
    return {
        "statistics": {r["statistic"]: r["value"] for r in _rows(routes.linking_stats(known, calls, links))},
        "linked": _rows(wide.where("not is_ambiguous").orderBy(F.col("confidence").desc(), *order[1:]).limit(limit)),
        "ambiguous": _rows(wide.where("is_ambiguous").orderBy(F.col("confidence").desc(), *order[1:]).limit(limit)),
        "unlinked_calls": _rows(routes.unlinked_calls(calls, links).select("id", "url", "repo_name", "file_path").orderBy("id").limit(limit)),
        "unlinked_endpoints": _rows(routes.unlinked_endpoints(known, links).select("id", "qualified_name", "repo_name").orderBy("id").limit(limit)),
        "conflicts": _rows(routes.handler_conflicts(known).orderBy("method", "canonical").limit(limit)),
    }


def validate_spec(index: Index, spec: DataFrame, repo_name: str | None = None, limit: int = 50) -> dict:
    flat = [F.col("route.method").alias("method"), F.col("route.path_pattern").alias("path_pattern"), F.col("qualified_name")]
    coverage = routes.spec_coverage(routes.endpoints_of(symbols.in_repo(index.chunks, repo_name)).select(*flat), spec.select(*flat))
    coverage = cut(coverage)
    shown = {s: _rows(coverage.where(F.col("status") == s).orderBy("method", "path_pattern").limit(limit)) for s in ("matching", "missing_from_spec", "missing_from_code")}
    return {"summary": _rows(routes.coverage_percent(coverage))[0], **shown}


# ---- conventions, ownership, security, metrics -----------------------------------------------------------


def analyze_patterns(index: Index, category: str | None = None, repo_filter: str | None = None, full_summary: bool = False, include_golden_files: bool = False, include_testing: bool = False) -> dict:
    if category and category not in fixed.CODE_PATTERNS:
        return {"error": f"Invalid category. Options: {list(fixed.CODE_PATTERNS)}"}
    chunks = symbols.in_repo(index.chunks, repo_filter)
    hits = conventions.pattern_hits(chunks, category, places=True)
    report = _rows(conventions.pattern_report(hits).orderBy("category", F.col("occurrence_count").desc(), "pattern_name"))
    examples = _rows(conventions.pattern_examples(hits).orderBy("category", "pattern_name", "rank"))
    result: dict = {"patterns": [{**r, "momentum": "stable", "examples": [e for e in examples if e["pattern_name"] == r["pattern_name"] and e["category"] == r["category"]],
                                  "alternatives": [o["pattern_name"] for o in report if o["category"] == r["category"] and not o["recommended"] and o is not r][:3]} for r in report]}
    if full_summary:
        top = conventions.top_libraries(conventions.library_report(conventions.library_uses(chunks)))
        result["library_usage"] = _rows(top.orderBy("category", "rank"))
    if include_testing or full_summary:
        result["testing"] = _rows(conventions.testing_conventions(chunks).orderBy(F.col("usage_count").desc(), "framework").limit(3))
    if include_golden_files or full_summary:
        result["golden_files"] = _rows(conventions.golden_files(chunks, 5))
    return result


def get_coding_conventions(index: Index, repo_filter: str | None = None) -> dict:
    return analyze_patterns(index, None, repo_filter, full_summary=True)


def analyze_ownership(
    index: Index | None, rules: DataFrame, files: DataFrame | None = None, blame: DataFrame | None = None, commits: DataFrame | None = None, suggest_reviewers: bool = False, exclude_author: str | None = None
) -> dict:
    """Rules per owner, owners of the given files, recent contributors and, on demand, reviewers."""
    teams = _rows(ownership.team_patterns(rules).orderBy("owner", "line_number").limit(1000))
    by_team: dict[str, list[str]] = {}
    for row in teams:
        by_team.setdefault(row["owner"], []).append(row["pattern"])
    result: dict = {"codeowners_rules": _count(rules), "ownership_by_team": by_team}
    if commits is not None:
        recent = ownership.contributor_stats(commits.withColumnRenamed("author", "name"), F.current_timestamp(), 30)
        result["top_contributors"] = _rows(recent.limit(10))
    if files is not None:
        owned = ownership.owners_of(files, rules)
        result["file_ownership"] = {r["file_path"]: r["owners"] or ["unowned"] for r in _rows(owned.select("file_path", "owners").orderBy("file_path").limit(20))}
        if suggest_reviewers:
            numbered = owned.withColumn("file_no", F.col("file_path"))
            lines = blame if blame is not None else files.sparkSession.createDataFrame([], "repo_name string, file_path string, author string")
            best = ownership.top_contributors(lines, 3).withColumn("file_no", F.col("file_path"))
            result["suggested_reviewers"] = _rows(ownership.suggest_reviewers(numbered, best, exclude=exclude_author))
    return result


def scan_secrets(index: Index | None = None, files: DataFrame | None = None, repo_filter: str | None = None, min_severity: str = "low", limit: int = 100) -> dict:
    """Secrets in indexed chunks, or in a file table (repo_name, file_path, length, content as text)."""
    if min_severity not in fixed.SEVERITIES:
        return {"error": f"Invalid min_severity. Options: {fixed.SEVERITIES}"}
    texts = security.scannable(files) if files is not None else symbols.in_repo(index.chunks, repo_filter)
    found = security.scan(texts, "content", ["repo_name", "file_path"], min_severity)
    order = [security.sf.severity_rank(F.col("severity")).desc(), F.col("repo_name"), F.col("file_path"), F.col("line_number")]
    return {**_rows(security.scan_result(found, texts, ["repo_name", "file_path"]))[0], "findings": _rows(found.orderBy(*order).limit(limit))}


def get_metrics(index: Index, repo_filter: str | None = None, symbol_name: str | None = None) -> dict:
    if symbol_name:
        rows = _rows(metrics.symbol_metrics(index.chunks, symbol_name, repo_filter))
        return rows[0] if rows else {"error": f"Symbol '{symbol_name}' not found"}
    chunks = symbols.in_repo(index.chunks, repo_filter)
    summary = _rows(metrics.repository_metrics(chunks))[0]
    return {"repo_name": repo_filter or "all", **summary, "hotspots": _rows(metrics.hotspots(metrics.function_metrics(chunks))), "language_breakdown": {r["language"]: r["n"] for r in _rows(counts.count_by(chunks, "language"))}}


# ---- diagrams ---------------------------------------------------------------------------------------------


DIAGRAMS = {"architecture": (30, 2), "dataflow": (25, 3), "callflow": (30, 3), "class": (20, 1), "sequence": (10, 5), "dependency": (25, 2)}


def generate_diagram(
    index: Index, query: str, diagram_type: str = "architecture", repo_name: str | None = None, output_format: str = "mermaid", max_nodes: int | None = None,
    depth: int | None = None, include_external: bool = False,
) -> dict:
    if output_format.lower() not in rendering.FORMATS:
        return {"error": "Invalid format. Valid options: mermaid, plantuml, dot, ascii"}
    kind = diagram_type.lower()
    if kind not in DIAGRAMS:
        return {"error": f"Unknown diagram type: {diagram_type}. Options: {list(DIAGRAMS)}"}
    max_nodes, depth = max_nodes or DIAGRAMS[kind][0], depth or DIAGRAMS[kind][1]
    # a page of hits, collected once so that every branch of the graph reads the same rows
    found = search.hybrid(index.chunks, index.embeddings.where(F.col("model") == index.model), search.embed_query(query, index.model), max_nodes, repo_name)
    local = index.chunks.sparkSession.createDataFrame(found.collect(), found.schema)
    hits = local.withColumn("rank", F.expr("row_number() over (order by score desc, id)"))
    n_hits = hits.count()
    title = f"{kind.title()} Diagram: {query}"
    if not n_hits:
        return {"diagram": "No results found for query", "format": output_format.lower(), "type": kind, "title": f"Empty Diagram: {query}", "nodes": [], "edges": [], "statistics": {"nodes": 0, "edges": 0}}
    calls = symbols.in_repo(index.calls, repo_name)
    built = {
        "architecture": lambda: diagrams.architecture(hits, calls, index.chunks), "dependency": lambda: diagrams.dependency(hits, calls, index.chunks),
        "dataflow": lambda: diagrams.dataflow(hits, calls, depth), "callflow": lambda: diagrams.callflow(hits, calls, depth),
        "class": lambda: diagrams.classes(hits, symbols.in_repo(index.inheritance, repo_name)), "sequence": lambda: diagrams.sequence(hits, calls, depth),
    }[kind]()
    shown = diagrams.limited(built, max_nodes, include_external)
    nodes = _rows(shown.nodes.orderBy("position", "id"))
    edges = _rows(shown.edges.orderBy("position", "source", "target").limit(1000))
    return {
        "diagram": rendering.render(output_format.lower(), kind, query, nodes, edges), "format": output_format.lower(), "type": kind, "title": title,
        "nodes": [{"id": n["id"], "label": n["label"], "type": n["type"], "file": n["file"], **{k: v for k, v in n["extra"].items() if v is not None}} for n in nodes],
        "edges": [{"source": e["source"], "target": e["target"], "label": e["label"], "type": e["type"], **({"sequence": e["position"]} if kind == "sequence" else {"line": e["position"]} if kind == "callflow" else {})} for e in edges],
        "statistics": {"nodes": len(nodes), "edges": len(edges), "search_results": n_hits, "depth": depth},
    }


def _diagram(kind: str):
    def tool(index: Index, query: str, repo_name: str | None = None, output_format: str = "mermaid", **options) -> dict:
        return generate_diagram(index, query, kind, repo_name, output_format, **options)

    tool.__name__ = f"generate_{kind}_diagram"
    return tool


generate_architecture_diagram, generate_dataflow_diagram, generate_callflow_diagram = _diagram("architecture"), _diagram("dataflow"), _diagram("callflow")
generate_class_diagram, generate_sequence_diagram, generate_dependency_diagram = _diagram("class"), _diagram("sequence"), _diagram("dependency")

TOOLS = {
    f.__name__: f
    for f in (
        semantic_grep, get_context, get_index_stats, file_summary, find_usages, find_implementations, find_tests, diff_impact, explore, understand, prepare_change,
        analyze_patterns, get_coding_conventions, analyze_ownership, scan_secrets, get_metrics, generate_architecture_diagram, generate_dataflow_diagram,
        generate_callflow_diagram, generate_class_diagram, generate_sequence_diagram, generate_dependency_diagram, generate_diagram, lookup_symbol, find_callers,
        find_callees, find_call_path, get_symbol_context, get_class_members, get_symbol_stats, find_hierarchy, find_dead_code, detect_circular_dependencies,
        analyze_architecture, analyze_api_links, validate_spec,
    )
}


def call_tool(name: str, index: Index, arguments: dict) -> dict:
    """Run a tool by name; a failure is an answer too."""
    if name not in TOOLS:
        return {"error": f"Unknown tool: {name}", "tool": name, "arguments": arguments}
    try:
        return TOOLS[name](index, **arguments)
    except Exception as failure:  # noqa: BLE001 - the caller gets the failure as data
        return {"error": str(failure), "tool": name, "arguments": arguments}
