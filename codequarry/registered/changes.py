"""Queries over routes, snapshots, risk, ownership and result shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import names, routes as rf
from codequarry.operators import counts, formatting, graph, impact, ownership, routes, search, snapshots, symbols, usages
from codequarry.registered import views

ROUTES_CTE = f"raw AS ({views.cte(views.ROUTES)})"
CALLS_CTE = f"calls AS ({views.cte(views.CALLS)})"
CHUNK_CTE = f"chunks AS ({views.cte(views.CHUNKS)})"


def _segments_sql(path: str) -> str:
    seg = r"""CASE WHEN regexp_matches(s, '^\$\{[^}]+\}$') THEN '{' || regexp_extract(s, '^\$\{([^}]+)\}$', 1) || '}'
 WHEN regexp_matches(s, '^\{[^}]+\}$') THEN s WHEN regexp_matches(s, ':[a-zA-Z_][a-zA-Z0-9_]*') THEN regexp_replace(s, ':([a-zA-Z_][a-zA-Z0-9_]*)', '{\1}', 'g')
 WHEN regexp_matches(s, '<[^>]+>') THEN regexp_replace(s, '<([^>]+)>', '{\1}', 'g') ELSE lower(s) END"""
    return f"list_transform(list_filter(string_split(regexp_replace({path}, '[?].*$', ''), '/'), lambda s: s <> ''), lambda s: {seg})"


CANONICAL_SQL = "'/' || array_to_string(list_transform(seg, lambda s: CASE WHEN starts_with(s, '{') AND ends_with(s, '}') THEN '{}' ELSE lower(s) END), '/')"
NORMAL_CTE = f"{ROUTES_CTE}, norm AS (SELECT *, {_segments_sql('path')} AS seg FROM raw), can AS (SELECT *, {CANONICAL_SQL} AS canonical, '/' || array_to_string(seg, '/') AS path_pattern FROM norm)"


def route_normalize(spark, sf_dir):
    """Every page address, and every derived path with the address's query, normalized."""
    raw = views.view(spark, sf_dir, views.ROUTES)
    query = F.regexp_extract("url", r"[?]([^#]*)", 1)
    path = F.when(query != "", F.concat("path", F.lit("?"), query)).otherwise(F.col("path"))
    both = raw.select("page_id", F.lit("url").alias("kind"), F.col("url").alias("address"), "method").unionByName(
        raw.select("page_id", F.lit("path").alias("kind"), path.alias("address"), "method")
    )
    r = both.select("page_id", "kind", rf.normalized(F.col("address"), F.col("method")).alias("r"))
    return r.select(
        "page_id", "kind", "r.method", "r.path_pattern", "r.base_path", F.array_join("r.query_params", ",").alias("query_params"),
        rf.canonical(F.col("r.path_segments")).alias("canonical"),
        F.array_join(F.transform("r.parameters", lambda p: F.concat(p["position"].cast("string"), F.lit(":"), p["name"])), ",").alias("parameters"),
    )


ROUTE_NORMALIZE_SQL = f"""WITH {ROUTES_CTE}, q AS (SELECT *, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM raw),
b AS (SELECT page_id, 'url' AS kind, method, regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', '') AS p, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base_path, '' AS query FROM q
 UNION ALL SELECT page_id, 'path', method, path, NULL, query FROM q),
n AS (SELECT *, {_segments_sql('p')} AS seg FROM b)
SELECT page_id, kind, method, '/' || array_to_string(seg, '/') AS path_pattern, base_path,
 array_to_string(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1)), ',') AS query_params, {CANONICAL_SQL} AS canonical,
 array_to_string(list_transform(list_filter(range(len(seg)), lambda i: starts_with(seg[i + 1], '{{') AND ends_with(seg[i + 1], '}}')), lambda i: i || ':' || seg[i + 1][2:-2]), ',') AS parameters FROM n"""


def _registry(spark, sf_dir):
    chunks = views.route_chunks(spark, sf_dir)
    return routes.endpoints_of(chunks), routes.api_calls_of(chunks)


def _links(spark, sf_dir):
    endpoints, calls = _registry(spark, sf_dir)
    return endpoints, calls, routes.link(calls, endpoints)


def route_match_score(spark, sf_dir):
    """The three best endpoints of every call, with partial scores and the ambiguity flag."""
    _, _, links = _links(spark, sf_dir)
    return links.select(
        "call_id", "endpoint_id", F.round("confidence", 6).alias("confidence"), "is_ambiguous", F.col("alternatives").cast("bigint").alias("alternatives"),
        F.col("rank").cast("bigint").alias("rank"), F.round("match_details.param_name", 6).alias("param_name"), F.round("match_details.context", 6).alias("context"),
    )


_SNAKE = r"replace(lower(regexp_replace(regexp_replace({0}, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '-', '_')"
LINK_CTE = NORMAL_CTE + f""", ep AS (SELECT sha256(concat_ws(':', repo_name, file_path, method, path))[1:16] AS id, * FROM can WHERE is_endpoint),
ac AS (SELECT sha256(concat_ws(':', repo_name, file_path, page_id, method, path))[1:16] AS id, * FROM can WHERE NOT is_endpoint),
pairs AS (SELECT ac.id AS call_id, ep.id AS endpoint_id, ac.repo_name = ep.repo_name AS same_repo, ep.language,
  list_filter(list_zip(ac.seg, ep.seg), lambda z: starts_with(z[2], '{{') AND ends_with(z[2], '}}')) AS ps FROM ac JOIN ep USING (method, canonical)),
ns AS (SELECT *, CASE WHEN len(ps) = 0 THEN 1::DOUBLE ELSE list_sum(list_transform(ps, lambda z: (lower(z[1]) = lower(z[2]) OR {_SNAKE.format('z[1]')} = {_SNAKE.format('z[2]')})::INT)) / len(ps) END AS param_name,
  least(1, 0.5::DOUBLE + CASE WHEN same_repo THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN language IN ('typescript', 'javascript', 'python', 'java') THEN 0.2::DOUBLE ELSE 0 END) AS context FROM pairs),
sc AS (SELECT *, 0.4::DOUBLE + 0.25::DOUBLE + param_name * 0.2::DOUBLE + context * 0.15::DOUBLE AS conf FROM ns),
rk AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY conf DESC, endpoint_id) AS rank FROM sc WHERE conf >= 0.65),
kept AS (SELECT *, count(*) OVER (PARTITION BY call_id) AS n, max(conf) OVER (PARTITION BY call_id) AS best FROM rk WHERE rank <= 3),
links AS (SELECT *, n > 1 AND best - conf <= 0.1::DOUBLE AS is_ambiguous FROM kept)"""


def route_ambiguous(spark, sf_dir):
    endpoints, calls, links = _links(spark, sf_dir)
    return routes.ambiguous_links(links, calls, endpoints).select("call_id", "endpoint_id", "caller_qualified_name", "qualified_name", "path_pattern", "call_repo", "endpoint_repo")


def unlinked_calls(spark, sf_dir):
    _, calls, links = _links(spark, sf_dir)
    return routes.unlinked_calls(calls, links).select("id", "url", "repo_name")


def unlinked_endpoints(spark, sf_dir):
    endpoints, _, links = _links(spark, sf_dir)
    return routes.unlinked_endpoints(endpoints, links).select("id", "qualified_name", "repo_name")


def route_conflicts(spark, sf_dir):
    endpoints, _ = _registry(spark, sf_dir)
    return routes.pattern_conflicts(endpoints)


def route_conflict_members(spark, sf_dir):
    endpoints, _ = _registry(spark, sf_dir)
    return routes.conflict_members(endpoints, routes.pattern_conflicts(endpoints))


def handler_conflicts(spark, sf_dir):
    endpoints, _ = _registry(spark, sf_dir)
    return routes.handler_conflicts(endpoints)


def registry_stats(spark, sf_dir):
    endpoints, calls, links = _links(spark, sf_dir)
    return routes.registry_stats(endpoints, calls, links).withColumn("average_confidence", F.round("average_confidence", 3))


def linking_stats(spark, sf_dir):
    endpoints, calls, links = _links(spark, sf_dir)
    return routes.linking_stats(endpoints, calls, links)


def http_edges(spark, sf_dir):
    endpoints, calls, links = _links(spark, sf_dir)
    return graph.as_http_edges(routes.wide_links(links, calls, endpoints))


def _flat(endpoints):
    return endpoints.select(F.col("route.method").alias("method"), F.col("route.path_pattern").alias("path_pattern"), "qualified_name")


def find_endpoints(spark, sf_dir):
    endpoints, _ = _registry(spark, sf_dir)
    return routes.find_endpoints(endpoints, "get", "/*/items/*", language="typescript").select("id", "qualified_name", "route.path_pattern")


def find_api_calls(spark, sf_dir):
    _, calls = _registry(spark, sf_dir)
    return routes.find_api_calls(calls, url="/en/*", repo="repo_com").select("id", "url", "caller_qualified_name")


def spec_coverage(spark, sf_dir):
    """Secure pages as code, plain pages as the specification."""
    endpoints, calls = _registry(spark, sf_dir)
    spec = calls.select(F.col("route.method").alias("method"), F.col("route.path_pattern").alias("path_pattern"), F.col("caller_qualified_name").alias("qualified_name"))
    return routes.spec_coverage(_flat(endpoints), spec)


def spec_coverage_percent(spark, sf_dir):
    return routes.coverage_percent(spec_coverage(spark, sf_dir))


SPEC_CTE = NORMAL_CTE + """, code AS (SELECT method, path_pattern, min(name) AS code_endpoint, count(*) AS n_code FROM can WHERE is_endpoint GROUP BY ALL),
spec AS (SELECT method, path_pattern, max(name) AS spec_endpoint FROM can WHERE NOT is_endpoint GROUP BY ALL),
cov AS (SELECT method, path_pattern, code_endpoint, spec_endpoint, CASE WHEN code_endpoint IS NULL THEN 'missing_from_code' WHEN spec_endpoint IS NULL THEN 'missing_from_spec' ELSE 'matching' END AS status,
 CASE WHEN code_endpoint IS NULL THEN 0 WHEN spec_endpoint IS NULL THEN n_code ELSE n_code - 1 END AS code_missing_from_spec FROM code FULL JOIN spec USING (method, path_pattern))"""


def api_diff(spark, sf_dir):
    endpoints, calls = _registry(spark, sf_dir)
    flat_calls = calls.select(F.col("route.method").alias("method"), F.col("route.path_pattern").alias("path_pattern"))
    return routes.api_diff(flat_calls, _flat(endpoints))


def registry_clear(spark, sf_dir):
    """Sizes of the registry after one repository is cleared."""
    endpoints, calls, links = _links(spark, sf_dir)
    e, c, l = routes.clear("repo_com", endpoints, calls, links)
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("kind"), "n") for n, d in (("endpoints", e), ("api_calls", c), ("links", l))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def paths_match(spark, sf_dir):
    """Does the endpoint form of a page's path match its call form, loosely and strictly?"""
    raw = views.view(spark, sf_dir, views.ROUTES).withColumn("a", rf.segments(F.col("path")))
    other = rf.segments(F.concat(F.lit("/"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1), F.lit("/{PageID}/items/{item_id}")))
    return raw.withColumn("b", other).select("page_id", rf.paths_match(F.col("a"), F.col("b")).alias("loose"), rf.paths_match(F.col("a"), F.col("b"), True).alias("strict"))


# ---- snapshots -------------------------------------------------------------------------------


def _snapshots(spark, sf_dir):
    """Documents with a label are the old snapshot, toxic ones have changed size; long texts are the new one."""
    docs = views.read(spark, sf_dir, "documents").join(views.read(spark, sf_dir, "labels"), "doc_id", "left")
    file = [F.col("source").alias("repo_name"), F.concat(F.lit("f"), F.col("doc_id")).alias("file_path"), F.lit(0.0).alias("mtime")]
    old = docs.where("quality is not null").select(*file, F.col("n_chars").alias("size"))
    new = docs.where("n_chars >= 500").select(*file, (F.col("n_chars") + F.coalesce("toxic", F.lit(0)) + F.coalesce(1 - F.col("quality"), F.lit(0))).alias("size"))
    return old, new


SNAP_CTE = """d AS (SELECT source AS repo_name, 'f' || doc_id AS file_path, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
diff AS (SELECT repo_name, file_path, CASE WHEN quality IS NULL AND n_chars >= 500 THEN 'new' WHEN quality IS NOT NULL AND n_chars < 500 THEN 'deleted'
 WHEN quality IS NOT NULL AND toxic + 1 - quality <> 0 THEN 'modified' END AS change FROM d)"""


def snapshot_diff(spark, sf_dir):
    return snapshots.snapshot_diff(*_snapshots(spark, sf_dir))


def chunk_upsert_last_wins(spark, sf_dir):
    """Documents replaced by the longest answer of the conversation with the same number."""
    docs = views.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("hash"))
    turns = views.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("hash"))
    return snapshots.upsert(docs, turns, ["id"], "last", ["size", "hash"])


def files_of_chunks(spark, sf_dir):
    """Chunk ids of every file."""
    chunks = views.chunks(spark, sf_dir)
    files = chunks.select("repo_name", "file_path").distinct().select("*", F.lit(0.0).alias("mtime"), F.lit(0).cast("bigint").alias("size"))
    return snapshots.files_of_chunks(files, chunks).select("repo_name", "file_path", F.array_join("chunk_ids", ",").alias("chunk_ids"))


# ---- impact -----------------------------------------------------------------------------------


def _changed(spark, sf_dir):
    """Files of returned goods: where open lines were called back."""
    calls = views.calls(spark, sf_dir)
    syms = calls.select("repo_name", F.col("caller").alias("qualified_name"), F.col("caller_file").alias("file_path")).distinct()
    changed = calls.where("caller like 'Supplier%' and caller_line >= 6").select("repo_name", F.col("caller_file").alias("file_path")).distinct()
    return calls, syms, changed


def diff_impact(spark, sf_dir):
    """Call sites hit by the changed files of every repository."""
    calls, syms, changed = _changed(spark, sf_dir)
    return impact.impacted_callers(calls, impact.modified_symbols(syms, changed))


def affected_tests(spark, sf_dir):
    """Tests of all symbols that a large change touches: named orders and the first word of every second text."""
    chunks = views.chunks(spark, sf_dir, heavy=True)
    symbol = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("fetchOrder"), F.col("doc_id") + 1)).otherwise(F.regexp_extract("text", "[A-Za-z]+", 0))
    modified = views.read(spark, sf_dir, "documents").select(F.col("source").alias("repo_name"), symbol.alias("name"))
    return usages.affected_tests(chunks, modified).drop("qualified_name")


AFFECTED_SQL = f"""WITH chunks AS ({views.cte(views.CHUNKS)}),
m AS (SELECT DISTINCT source AS repo_name, CASE WHEN doc_id % 2 = 0 THEN 'fetchOrder' || (doc_id + 1) ELSE regexp_extract(text, '[A-Za-z]+') END AS sym FROM documents),
t AS (SELECT *, regexp_extract(name, '[0-9]+$') AS k, list_distinct(list_transform(regexp_extract_all(content, '[A-Za-z_$][A-Za-z0-9_$]*'), lambda x: lower(x))) AS ids FROM chunks
 WHERE chunk_type IN ('function', 'method') AND contains(lower(file_path), 'test_') AND starts_with(name, 'test_')),
h AS (SELECT repo_name, sym AS tests_symbol, file_path, name, start_line AS line, CASE WHEN list_contains(['fetch', 'fetchorder', 'fetchorder' || k, 'order', 'order' || k, k], lower(sym)) THEN 1 WHEN list_contains(ids, lower(sym)) THEN 2 END AS r
 FROM t JOIN m USING (repo_name) WHERE sym <> ''),
f AS (SELECT repo_name, tests_symbol, file_path, name, min((r, line)) AS f FROM h WHERE r IS NOT NULL GROUP BY ALL)
SELECT repo_name, tests_symbol, file_path, name, f[2] AS line, CASE f[1] WHEN 1 THEN 'method_name_pattern' ELSE 'content_reference' END AS match_reason FROM f"""


def risk_levels(spark, sf_dir):
    calls, syms, changed = _changed(spark, sf_dir)
    modified = impact.modified_symbols(syms, changed)
    return impact.diff_summary(changed, modified, impact.impacted_callers(calls, modified))


IMPACT_CTE = CALLS_CTE + """, syms AS (SELECT DISTINCT repo_name, caller AS qualified_name, caller_file AS file_path FROM calls),
changed AS (SELECT DISTINCT repo_name, caller_file AS file_path FROM calls WHERE caller LIKE 'Supplier%' AND caller_line >= 6),
modified AS (SELECT syms.* FROM syms JOIN changed USING (repo_name, file_path)),
hit AS (SELECT repo_name, caller, caller_file, caller_line, min((callee, call_type)) AS f FROM calls WHERE (repo_name, callee) IN (SELECT (repo_name, qualified_name) FROM modified) GROUP BY ALL),
impacted AS (SELECT repo_name, caller, caller_file, caller_line, f[1] AS calls, f[2] AS call_type FROM hit)"""


def change_risk(spark, sf_dir):
    """Risk of changing each called symbol: direct sites, second-hop sites, tests by name."""
    calls = views.calls(spark, sf_dir)
    direct = calls.groupBy("callee").agg(F.count("*").alias("direct"))
    fan = calls.groupBy("caller", "callee").agg(F.count("*").alias("n")).join(
        direct.select(F.col("callee").alias("caller"), F.col("direct").alias("above")), "caller"
    )
    transitive = fan.groupBy("callee").agg(F.sum(F.col("n") * F.col("above")).alias("transitive"))
    kind = F.when(F.col("callee").like("Part%"), "signature").otherwise("modify")
    joined = direct.join(transitive, "callee", "left").select("callee", "direct", F.coalesce("transitive", F.lit(0)).alias("transitive"), kind.alias("change_type"))
    return joined.withColumn("risk_level", impact.change_risk(F.col("direct"), F.col("transitive"), F.lit(0), F.col("change_type")))


def data_flow(spark, sf_dir):
    flow = impact.data_flow(F.col("signature"), F.col("docstring"))
    return views.chunks(spark, sf_dir).select("id", flow.alias("f")).select(
        "id", F.array_join("f.inputs", "|").alias("inputs"), F.array_join("f.outputs", "|").alias("outputs"), F.array_join("f.side_effects", "|").alias("side_effects")
    )


def explore_tokens(spark, sf_dir):
    """Token estimate of exploring each symbol at each level."""
    calls = views.calls(spark, sf_dir)
    sizes = calls.groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("callers"))
    level = F.explode(F.array(F.lit("summary"), F.lit("preview"), F.lit("full"))).alias("detail")
    return sizes.select("name", "callers", level).select("name", "detail", impact.explore_tokens(F.col("detail"), F.lit(True), F.col("callers"), F.lit(0), F.lit(5)).alias("tokens"))


# ---- results --------------------------------------------------------------------------------------


def token_budget_fit(spark, sf_dir):
    """Level and size of the answer for each repository's chunks within a budget of its own."""
    sizes = views.chunks(spark, sf_dir).groupBy("repo_name").agg(F.count("*").alias("found"), F.sum("end_line").alias("budget"))
    level = F.explode(F.array(F.lit("summary"), F.lit("preview"), F.lit("full"))).alias("level")
    fitted = sizes.select("*", level).withColumn("fit", formatting.fit_to_budget(F.col("found"), F.col("level"), F.col("budget"), F.lit(50)))
    return fitted.select("repo_name", "level", "fit.detail_level", F.col("fit.returned").cast("bigint").alias("returned"), F.col("fit.estimated_tokens").cast("bigint").alias("estimated_tokens"))


def grouped_results(spark, sf_dir):
    """All chunks as summaries, grouped by file: rows with their group and its size."""
    summary = formatting.view(views.chunks(spark, sf_dir), "summary", ["id"])
    return formatting.grouped(summary, "file").select("group", "count", "id", "location")


# ---- ownership --------------------------------------------------------------------------------------


def _owner_rules(spark, sf_dir):
    """A CODEOWNERS text per region: a comment, then a rule of each of its nations."""
    nation = views.read(spark, sf_dir, "nation").join(views.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    shape = (
        F.when(key % 5 == 0, F.concat(F.lit("*"), key % 10)).when(key % 5 == 1, F.concat(F.lit("/docs/*_"), key, F.lit("*")))
        .when(key % 5 == 2, F.concat(F.lit("/src/n"), key, F.lit("/"))).when(key % 5 == 3, F.concat(F.lit("f_"), key)).otherwise(F.concat(F.lit("src/*/c*"), key))
    )
    line = F.concat(shape, F.lit(" @"), F.lower("n_name"), F.when(key % 2 == 0, F.concat(F.lit(" @lead"), key)).otherwise(""))
    texts = nation.groupBy("r_name").agg(F.concat_ws("\n", F.lit("# owners"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, line.alias("line")))), lambda s: s["line"]), "\n")).alias("content"))
    return ownership.parse_codeowners(texts.select(F.col("r_name").alias("repo_name"), "content"))


def codeowners_rules(spark, sf_dir):
    return _owner_rules(spark, sf_dir).select("repo_name", F.col("line_number").cast("bigint").alias("line_number"), "pattern", F.array_join("owners", " ").alias("owners"))


def _owned_files(spark, sf_dir):
    """Customers as files of their region's repository."""
    c = views.read(spark, sf_dir, "customer").join(views.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(views.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("docs/a_"), "c_nationkey", F.lit("_"), "c_custkey")).when(
        F.col("c_custkey") % 3 == 1, F.concat(F.lit("src/n"), "c_nationkey", F.lit("/c"), "c_custkey")
    ).otherwise(F.concat(F.lit("lib/f_"), "c_nationkey"))
    return c.select("c_custkey", F.col("r_name").alias("repo_name"), path.alias("file_path"))


def codeowners_last_match(spark, sf_dir):
    owned = ownership.owners_of(_owned_files(spark, sf_dir), _owner_rules(spark, sf_dir))
    return owned.select("c_custkey", "repo_name", "file_path", F.array_join("owners", " ").alias("owners"), "pattern")


OWNER_CTE = """rules AS (SELECT r_name AS repo_name, n_nationkey AS k, 1 + row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS line_number,
 CASE k % 5 WHEN 0 THEN '*' || k % 10 WHEN 1 THEN '/docs/*_' || k || '*' WHEN 2 THEN '/src/n' || k || '/' WHEN 3 THEN 'f_' || k ELSE 'src/*/c*' || k END AS pattern,
 '@' || lower(n_name) || CASE WHEN k % 2 = 0 THEN ' @lead' || k ELSE '' END AS owners FROM nation JOIN region ON n_regionkey = r_regionkey),
files AS (SELECT c_custkey, r_name AS repo_name, CASE c_custkey % 3 WHEN 0 THEN 'docs/a_' || c_nationkey || '_' || c_custkey WHEN 1 THEN 'src/n' || c_nationkey || '/c' || c_custkey ELSE 'lib/f_' || c_nationkey END AS file_path
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
hits AS (SELECT f.*, r.pattern, r.owners, r.line_number FROM files f JOIN rules r ON f.repo_name = r.repo_name AND CASE k % 5 WHEN 0 THEN split_part(file_path, '/', -1) GLOB pattern OR file_path GLOB pattern
 WHEN 1 THEN starts_with(file_path, 'docs/') AND contains(substr(file_path, 6), '_' || k) WHEN 2 THEN starts_with(file_path, 'src/n' || k || '/') WHEN 3 THEN ends_with(file_path, '/f_' || k)
 ELSE regexp_matches(file_path, '(^|/)src/.*/c.*' || k || '$') END),
owned AS (SELECT f.c_custkey, f.repo_name, f.file_path, coalesce(max_by(h.owners, h.line_number), '') AS owners, max_by(h.pattern, h.line_number) AS pattern FROM files f LEFT JOIN hits h USING (c_custkey) GROUP BY ALL)"""


def team_patterns(spark, sf_dir):
    return ownership.team_patterns(_owner_rules(spark, sf_dir)).select("repo_name", "owner", "pattern")


def _blame(spark, sf_dir):
    """Order lines as lines of code: the order's customer is the file, the supplier the author."""
    lines = views.read(spark, sf_dir, "lineitem").join(views.read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.lit("shop").alias("repo_name"), F.concat(F.lit("c"), "o_custkey").alias("file_path"), F.concat(F.lit("s"), "l_suppkey").alias("author"), F.col("o_orderdate").alias("authored_at"), "o_custkey")


def contributors_topk(spark, sf_dir):
    return ownership.top_contributors(_blame(spark, sf_dir), 3).select("repo_name", "file_path", "author", "lines", F.col("rank").cast("bigint").alias("rank"))


def last_modifier(spark, sf_dir):
    return ownership.last_modifier(_blame(spark, sf_dir))


def contributor_stats(spark, sf_dir):
    """Orders of the last ninety days before a date, by customer."""
    orders = views.read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("name"), F.col("o_orderpriority").alias("email"), F.col("o_orderdate").alias("authored_at"))
    return ownership.contributor_stats(orders, F.lit("1998-08-01 00:00:00").cast("timestamp"), 90)


BLAME_CTE = "blame AS (SELECT 'shop' AS repo_name, 'c' || o_custkey AS file_path, 's' || l_suppkey AS author, o_orderdate AS authored_at, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
TOP_CTE = BLAME_CTE + """, cnt AS (SELECT repo_name, file_path, author, o_custkey, count(*) AS lines FROM blame GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY lines DESC, author) AS rank FROM cnt)"""


def reviewers_topk(spark, sf_dir):
    """Reviewers of the changed files of every region: owners by rule, suppliers by lines."""
    owned = ownership.owners_of(_owned_files(spark, sf_dir), _owner_rules(spark, sf_dir)).select("repo_name", F.col("c_custkey").alias("file_no"), "file_path", "owners")
    best = ownership.top_contributors(_blame(spark, sf_dir), 3).withColumn("file_no", F.substr("file_path", F.lit(2)).cast("bigint"))
    home = _owned_files(spark, sf_dir).select(F.col("c_custkey").alias("file_no"), "repo_name")
    authors = best.drop("repo_name").join(home, "file_no").select("repo_name", "file_no", "author", "lines", "rank")
    return ownership.suggest_reviewers(owned, authors, ["repo_name"]).select("repo_name", "name", "confidence", "expertise_match")


REVIEW_SQL = "WITH " + OWNER_CTE + ", " + TOP_CTE + """, mentions AS (SELECT repo_name, unnest(string_split(owners, ' ')) AS name, c_custkey AS file_no, 0 AS kind, 0.9::DOUBLE AS start FROM owned WHERE owners <> ''
 UNION ALL SELECT f.repo_name, author, o_custkey, 1, least(0.5::DOUBLE + lines * 0.05::DOUBLE, 0.85::DOUBLE) FROM top JOIN files f ON f.c_custkey = o_custkey WHERE rank <= 3),
p AS (SELECT repo_name, name, min((file_no, kind, start)) AS f, count(*) FILTER (kind = 0) AS n FROM mentions GROUP BY ALL),
s AS (SELECT repo_name, name, round(least(f[3] + 0.1::DOUBLE * (n - CASE WHEN f[2] = 0 THEN 1 ELSE 0 END), greatest(1, f[3])), 6) AS confidence, f[2] = 0 AS expertise_match FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY confidence DESC, name) AS rk FROM s) SELECT repo_name, name, confidence, expertise_match FROM r WHERE rk <= 3"""

FLOW_SQL = f"""WITH {CHUNK_CTE} SELECT id, CASE WHEN signature IS NULL THEN '' ELSE 'a: Dict[str, int]|' || regexp_extract(signature, '(b=[0-9]+)', 1) END AS inputs,
 CASE WHEN signature IS NULL THEN '' ELSE 'List[str]' END AS outputs, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(docstring), '{w}') THEN 'May {w}' END" for w in fixed.SIDE_EFFECT_WORDS)}], lambda x: x IS NOT NULL), '|') AS side_effects FROM chunks"""

BUDGET_SQL = f"""WITH {CHUNK_CTE}, s AS (SELECT repo_name, count(*) AS found, sum(end_line)::BIGINT AS budget FROM chunks GROUP BY ALL), l AS (SELECT *, unnest(['summary', 'preview', 'full']) AS level FROM s),
r AS (SELECT *, budget // 500 AS rf, budget // 200 AS rp, budget // 50 AS rs FROM l),
c AS (SELECT *, CASE WHEN level = 'full' AND found <= rf AND found <= 50 THEN 'full' WHEN level = 'summary' THEN 'summary' WHEN (found <= rp AND found <= 50) OR NOT (rs >= found OR rs > rp) THEN 'preview' ELSE 'summary' END AS detail_level FROM r),
n AS (SELECT *, least(CASE detail_level WHEN 'full' THEN rf WHEN 'preview' THEN rp ELSE rs END, 50, found)::BIGINT AS returned FROM c)
SELECT repo_name, level, detail_level, returned, (returned * CASE detail_level WHEN 'full' THEN 500 WHEN 'preview' THEN 200 ELSE 50 END)::BIGINT AS estimated_tokens FROM n"""

QUERIES = {
    "route_normalize": (route_normalize, ROUTE_NORMALIZE_SQL),
    "route_match_score": (route_match_score, f"WITH {LINK_CTE} SELECT call_id, endpoint_id, round(conf, 6) AS confidence, is_ambiguous, CASE WHEN is_ambiguous THEN n ELSE 0 END AS alternatives, rank, round(param_name, 6) AS param_name, round(context, 6) AS context FROM links"),
    "route_ambiguous": (route_ambiguous, f"WITH {LINK_CTE} SELECT call_id, endpoint_id, ac.name AS caller_qualified_name, ep.name AS qualified_name, ep.path_pattern, ac.repo_name AS call_repo, ep.repo_name AS endpoint_repo FROM links JOIN ac ON ac.id = call_id JOIN ep ON ep.id = endpoint_id WHERE is_ambiguous"),
    "unlinked_calls": (unlinked_calls, f"WITH {LINK_CTE} SELECT id, path AS url, repo_name FROM ac WHERE id NOT IN (SELECT call_id FROM links)"),
    "unlinked_endpoints": (unlinked_endpoints, f"WITH {LINK_CTE} SELECT id, name AS qualified_name, repo_name FROM ep WHERE id NOT IN (SELECT endpoint_id FROM links)"),
    "route_conflicts": (route_conflicts, f"WITH {NORMAL_CTE} SELECT method, path_pattern, count(*) AS n_handlers, min(name) AS first_handler, max(name) AS last_handler FROM can WHERE is_endpoint GROUP BY ALL HAVING count(*) > 1"),
    "route_conflict_members": (route_conflict_members, f"WITH {LINK_CTE} SELECT method, path_pattern, id, name AS qualified_name, repo_name FROM ep WHERE (method, path_pattern) IN (SELECT (method, path_pattern) FROM ep GROUP BY method, path_pattern HAVING count(*) > 1)"),
    "handler_conflicts": (handler_conflicts, f"WITH {NORMAL_CTE} SELECT method, canonical, count(DISTINCT name) AS n_handlers, count(*) AS n_endpoints FROM can WHERE is_endpoint GROUP BY ALL HAVING count(DISTINCT name) > 1"),
    "registry_stats": (registry_stats, f"WITH {LINK_CTE} SELECT (SELECT count(*) FROM ep) AS total_endpoints, (SELECT count(*) FROM ac) AS total_calls, count(*) AS total_links, count(*) FILTER (is_ambiguous) AS ambiguous_links, round(avg(conf), 3) AS average_confidence FROM links"),
    "linking_stats": (linking_stats, f"WITH {LINK_CTE} SELECT 'endpoints_found' AS statistic, count(*) AS value FROM ep UNION ALL SELECT 'api_calls_found', count(*) FROM ac UNION ALL SELECT 'links_matched', count(*) FROM links UNION ALL SELECT 'links_confident', count(*) FROM links WHERE NOT is_ambiguous UNION ALL SELECT 'links_ambiguous', count(*) FROM links WHERE is_ambiguous UNION ALL SELECT 'unlinked_calls', count(*) FROM ac WHERE id NOT IN (SELECT call_id FROM links) UNION ALL SELECT 'unlinked_endpoints', count(*) FROM ep WHERE id NOT IN (SELECT endpoint_id FROM links) UNION ALL SELECT 'conflicts_detected', count(*) FROM (SELECT 1 FROM ep GROUP BY method, canonical HAVING count(DISTINCT name) > 1) UNION ALL SELECT 'edges_created', 0"),
    "http_edges": (http_edges, f"WITH {LINK_CTE} SELECT ac.name AS caller, ep.name AS callee, ac.file_path AS caller_file, ac.page_id::INT AS caller_line, ac.repo_name, 'http_request' AS call_type FROM links JOIN ac ON ac.id = call_id JOIN ep ON ep.id = endpoint_id WHERE NOT is_ambiguous"),
    "find_endpoints": (find_endpoints, f"WITH {LINK_CTE} SELECT id, name AS qualified_name, path_pattern FROM ep WHERE method = 'GET' AND path_pattern LIKE '/%/items/%' AND language = 'typescript'"),
    "find_api_calls": (find_api_calls, f"WITH {LINK_CTE} SELECT id, path AS url, name AS caller_qualified_name FROM ac WHERE path LIKE '/en/%' AND repo_name = 'repo_com'"),
    "spec_coverage_full_outer": (spec_coverage, f"WITH {SPEC_CTE} SELECT * FROM cov"),
    "spec_coverage_percent": (spec_coverage_percent, f"WITH {SPEC_CTE} SELECT count(*) FILTER (status = 'matching') AS matching_count, count(*) FILTER (status <> 'missing_from_spec') AS total_spec_routes, round_even(matching_count / total_spec_routes * 100, 1) AS coverage_percent FROM cov"),
    "api_diff": (api_diff, f"WITH {NORMAL_CTE}, b AS (SELECT DISTINCT method, path_pattern FROM can WHERE NOT is_endpoint), a AS (SELECT DISTINCT method, path_pattern FROM can WHERE is_endpoint) SELECT method, path_pattern, 'removed' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT method, path_pattern, 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"),
    "registry_clear": (registry_clear, f"WITH {LINK_CTE} SELECT 'endpoints' AS kind, count(*) AS n FROM ep WHERE repo_name <> 'repo_com' UNION ALL SELECT 'api_calls', count(*) FROM ac WHERE repo_name <> 'repo_com' UNION ALL SELECT 'links', count(*) FROM links JOIN ac ON ac.id = call_id JOIN ep ON ep.id = endpoint_id WHERE ac.repo_name <> 'repo_com' AND ep.repo_name <> 'repo_com'"),
    "paths_match": (paths_match, f"WITH {NORMAL_CTE} SELECT page_id, len(seg) = 4 AND (starts_with(seg[2], '{{') OR true) AS loose, len(seg) = 4 AND (NOT starts_with(seg[2], '{{') OR seg[2] <> '{{page}}') AS strict FROM can"),
    "snapshot_diff": (snapshot_diff, f"WITH {SNAP_CTE} SELECT * FROM diff WHERE change IS NOT NULL"),
    "chunk_upsert_last_wins": (chunk_upsert_last_wins, "WITH b AS (SELECT doc_id AS id, 0 AS side, n_chars AS size, sha256(text) AS hash FROM documents UNION ALL SELECT conv_id, 1, length(text), sha256(text) FROM conversations) SELECT id, max((side, size, hash))[2] AS size, max((side, size, hash))[3] AS hash FROM b GROUP BY id"),
    "files_of_chunks": (files_of_chunks, f"WITH {CHUNK_CTE} SELECT repo_name, file_path, string_agg(id, ',' ORDER BY id) AS chunk_ids FROM chunks GROUP BY ALL"),
    "affected_tests": (affected_tests, AFFECTED_SQL),
    "diff_impact": (diff_impact, f"WITH {IMPACT_CTE} SELECT * FROM impacted"),
    "risk_levels": (risk_levels, f"WITH {IMPACT_CTE}, s AS (SELECT repo_name, count(*) AS changed_files, coalesce((SELECT count(*) FROM modified m WHERE m.repo_name = c.repo_name), 0) AS modified_symbols, coalesce((SELECT count(*) FROM impacted i WHERE i.repo_name = c.repo_name), 0) AS impacted_callers FROM changed c GROUP BY repo_name), p AS (SELECT *, CASE WHEN changed_files > 10 THEN 3 WHEN changed_files > 5 THEN 2 WHEN changed_files > 2 THEN 1 ELSE 0 END + CASE WHEN modified_symbols > 20 THEN 3 WHEN modified_symbols > 10 THEN 2 WHEN modified_symbols > 5 THEN 1 ELSE 0 END + CASE WHEN impacted_callers > 50 THEN 4 WHEN impacted_callers > 20 THEN 3 WHEN impacted_callers > 10 THEN 2 WHEN impacted_callers > 5 THEN 1 ELSE 0 END AS points FROM s) SELECT repo_name, changed_files, modified_symbols, impacted_callers, CASE WHEN points >= 8 THEN 'high' WHEN points >= 4 THEN 'medium' ELSE 'low' END AS risk_level FROM p"),
    "change_risk": (change_risk, f"WITH {CALLS_CTE}, d AS (SELECT callee, count(*) AS direct FROM calls GROUP BY ALL), t AS (SELECT c.callee, sum(d.direct)::BIGINT AS transitive FROM calls c JOIN d ON d.callee = c.caller GROUP BY ALL), j AS (SELECT d.callee, direct, coalesce(transitive, 0) AS transitive, CASE WHEN d.callee LIKE 'Part%' THEN 'signature' ELSE 'modify' END AS change_type FROM d LEFT JOIN t USING (callee)), r AS (SELECT *, (direct + transitive * 0.5) * CASE change_type WHEN 'signature' THEN 1.5 ELSE 1 END * 1.5 AS i FROM j) SELECT callee, direct, transitive, change_type, CASE WHEN i <= 3 THEN 'low' WHEN i <= 10 THEN 'medium' WHEN i <= 25 THEN 'high' ELSE 'critical' END AS risk_level FROM r"),
    "data_flow": (data_flow, FLOW_SQL),
    "explore_tokens": (explore_tokens, f"WITH {CALLS_CTE}, s AS (SELECT callee AS name, count(*) AS callers FROM calls GROUP BY ALL), l AS (SELECT *, unnest(['summary', 'preview', 'full']) AS detail FROM s) SELECT name, detail, 200 + CASE detail WHEN 'summary' THEN 50 WHEN 'preview' THEN 200 ELSE 500 END + 30 * callers AS tokens FROM l"),
    "token_budget_fit": (token_budget_fit, BUDGET_SQL),
    "grouped_results": (grouped_results, f"WITH {CHUNK_CTE} SELECT file_path AS \"group\", count(*) OVER (PARTITION BY file_path) AS count, id, file_path || ':' || start_line || '-' || end_line AS location FROM chunks"),
    "codeowners_rules": (codeowners_rules, f"WITH {OWNER_CTE} SELECT repo_name, line_number, pattern, owners FROM rules"),
    "codeowners_last_match": (codeowners_last_match, f"WITH {OWNER_CTE} SELECT * FROM owned"),
    "team_patterns": (team_patterns, f"WITH {OWNER_CTE} SELECT repo_name, unnest(string_split(owners, ' ')) AS owner, pattern FROM rules"),
    "contributors_topk": (contributors_topk, f"WITH {TOP_CTE} SELECT repo_name, file_path, author, lines, rank FROM top WHERE rank <= 3"),
    "last_modifier": (last_modifier, f"WITH {BLAME_CTE} SELECT repo_name, file_path, max((authored_at, author))[2] AS last_modified_by, max(authored_at) AS last_modified_date FROM blame GROUP BY ALL"),
    "contributor_stats": (contributor_stats, "SELECT 'c' || o_custkey AS name, o_orderpriority AS email, count(*) AS commit_count FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 90 DAY GROUP BY ALL"),
    "reviewers_topk": (reviewers_topk, REVIEW_SQL),
}
