"""Call graph and inheritance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import counts, graph, impact, inheritance as inh, snapshots, symbols
from codequarry.registered import views

START = "Supplier7"
CALLS_CTE = f"calls AS ({views.cte(views.CALLS)})"
SYMBOLS_CTE = f"symbols AS ({views.cte(views.SYMBOLS)})"
INH_CTE = f"inheritance AS ({views.cte(views.INHERITANCE)})"
CALL_COLUMNS = "caller, callee, caller_file, caller_line, repo_name, call_type"


def _calls(spark, sf_dir):
    return views.calls(spark, sf_dir)


def direct_callers(spark, sf_dir):
    return graph.find_callers(_calls(spark, sf_dir), START)


def direct_callees(spark, sf_dir):
    return graph.find_callees(_calls(spark, sf_dir), START, "m199607")


def callers_bfs_depth3(spark, sf_dir):
    """One month is one repository; the walk starts from a supplier and keeps the first relation of each caller."""
    return graph.find_callers(_calls(spark, sf_dir), START, "m199607", max_depth=3)


def callees_bfs_depth3(spark, sf_dir):
    return graph.find_callees(_calls(spark, sf_dir), START, max_depth=3)


def _bfs_sql(near: str, far: str, where: str, depth: int = 3) -> str:
    """Level by level, the smallest (near, file, line, repo, type) per new node."""
    steps, seen = [], []
    previous = f"SELECT '{START}' AS node"
    for d in range(1, depth + 1):
        excluded = " AND ".join(f"c.{far} NOT IN (SELECT node FROM l{i})" for i in seen) or "true"
        steps.append(
            f"l{d} AS MATERIALIZED (SELECT c.{far} AS node, {d}::INT AS depth, min({{'near': c.{near}, 'caller_file': c.caller_file, 'caller_line': c.caller_line, "
            f"'repo_name': c.repo_name, 'call_type': c.call_type}}) AS via FROM c WHERE c.{near} IN (SELECT node FROM ({previous})) AND {excluded} GROUP BY c.{far})"
        )
        seen.append(d)
        previous = f"SELECT node FROM l{d}"
    union = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(1, depth + 1))
    return (
        f"WITH {CALLS_CTE}, c AS (SELECT * FROM calls WHERE {where}), {', '.join(steps)} "
        f"SELECT node AS {far}, via.near AS {near}, via.caller_file AS caller_file, via.caller_line AS caller_line, via.repo_name AS repo_name, "
        f"via.call_type AS call_type, depth FROM ({union})"
    )


def call_path(spark, sf_dir):
    """Shortest path between two parts; a path alternates between parts and suppliers."""
    return graph.find_path(_calls(spark, sf_dir), "Part5", "Part6").select(F.array_join("path", ">").alias("path"), F.col("length").cast("bigint").alias("length"))


PATH_SQL = f"""WITH RECURSIVE {CALLS_CTE}, e AS (SELECT DISTINCT caller, callee FROM calls),
w(node, depth) AS (SELECT 'Part5', 0 UNION SELECT e.callee, w.depth + 1 FROM w JOIN e ON e.caller = w.node WHERE w.depth < 4),
m AS (SELECT node, min(depth) AS depth FROM w WHERE depth > 0 OR node = 'Part5' GROUP BY node),
p(node, path, depth) AS (SELECT 'Part5', ['Part5'], 0 UNION
  SELECT e.callee, list_append(p.path, e.callee), p.depth + 1 FROM p JOIN e ON e.caller = p.node JOIN m ON m.node = e.callee AND m.depth = p.depth + 1
  WHERE p.depth < (SELECT depth FROM m WHERE node = 'Part6'))
SELECT array_to_string(min(path), '>') AS path, (len(min(path)) - 1)::BIGINT AS length FROM p WHERE node = 'Part6'"""


def call_node(spark, sf_dir):
    return graph.call_node(_calls(spark, sf_dir), START, "m199607").select("side", "other", "caller_file", "caller_line")


def all_symbols_union(spark, sf_dir):
    return graph.all_symbols(_calls(spark, sf_dir), ["repo_name"])


def no_callers_except(spark, sf_dir):
    return graph.never_called(_calls(spark, sf_dir), ["repo_name"])


def _entries(spark, sf_dir):
    """Routes of the symbol table, offered to every repository in which the symbol occurs."""
    entry = graph.entry_points(views.symbol_chunks(spark, sf_dir)).select("node").distinct()
    known = graph.all_symbols(_calls(spark, sf_dir), ["repo_name"])
    return known.join(entry, "node", "left_semi")


def entry_points(spark, sf_dir):
    return graph.entry_points(views.symbol_chunks(spark, sf_dir))


def reachable_from_entries(spark, sf_dir):
    """Distance from the nearest entry point, per repository."""
    return graph.reachable(_calls(spark, sf_dir), _entries(spark, sf_dir), ["repo_name"])


def dead_code(spark, sf_dir):
    return graph.unreachable(_calls(spark, sf_dir), _entries(spark, sf_dir), ["repo_name"])


ENTRY_CTE = f"{SYMBOLS_CTE}, ent AS (SELECT DISTINCT name AS node FROM symbols WHERE has_route)"
KNOWN_CTE = "known AS (SELECT repo_name, caller AS node FROM calls UNION SELECT repo_name, callee FROM calls)"
REACH_CTE = f"""{CALLS_CTE}, {ENTRY_CTE}, {KNOWN_CTE}, e AS (SELECT DISTINCT repo_name, caller, callee FROM calls),
r(repo_name, node, depth) USING KEY (repo_name, node) AS (SELECT repo_name, node, 0::INT FROM known WHERE node IN (SELECT node FROM ent)
 UNION SELECT e.repo_name, e.callee, min(r.depth) + 1 FROM r JOIN e ON e.repo_name = r.repo_name AND e.caller = r.node
 LEFT JOIN recurring.r AS v ON v.repo_name = e.repo_name AND v.node = e.callee WHERE v.node IS NULL GROUP BY e.repo_name, e.callee)"""


def cycles_scc(spark, sf_dir):
    """Components of mutual calls in every month."""
    return graph.cycles(_calls(spark, sf_dir), "caller", "callee", ["repo_name"])


def file_cycles(spark, sf_dir):
    return graph.file_cycles(_calls(spark, sf_dir))


def file_edges(spark, sf_dir):
    return graph.file_edges(_calls(spark, sf_dir))


FILE_EDGES_CTE = f"""{CALLS_CTE}, home AS (SELECT repo_name, caller AS callee, min(caller_file) AS callee_file FROM calls GROUP BY ALL),
fe AS (SELECT DISTINCT c.repo_name, c.caller_file AS src, h.callee_file AS dst FROM calls c JOIN home h USING (repo_name, callee) WHERE c.caller_file <> h.callee_file)"""


def _scc_sql(edges_cte: str) -> str:
    """Mutual reachability: closure per repository of nodes that can lie on a cycle."""
    return f"""WITH RECURSIVE {edges_cte},
c(repo_name, src, dst) AS (SELECT repo_name, src, dst FROM ed UNION SELECT c.repo_name, c.src, ed.dst FROM c JOIN ed ON ed.repo_name = c.repo_name AND ed.src = c.dst)
SELECT a.repo_name, a.src AS node, least(a.src, min(a.dst)) AS component FROM c a JOIN c b ON a.repo_name = b.repo_name AND a.src = b.dst AND a.dst = b.src
WHERE a.src <> a.dst GROUP BY a.repo_name, a.src"""


def call_stats(spark, sf_dir):
    return graph.call_stats(_calls(spark, sf_dir))


def call_hotspots(spark, sf_dir):
    return counts.top(_calls(spark, sf_dir), "callee", 10, "call_count")


def calls_by_repo(spark, sf_dir):
    return counts.count_by(_calls(spark, sf_dir), "repo_name")


def repo_hotspots(spark, sf_dir):
    """Three most called symbols of each repository."""
    per = _calls(spark, sf_dir).groupBy("repo_name", "callee").agg(F.count("*").alias("n"))
    return per.withColumn("rank", F.expr("row_number() over (partition by repo_name order by n desc, callee)")).where("rank <= 3")


def calls_first_wins(spark, sf_dir):
    """Duplicate call sites collapse to the first by call type."""
    return counts.keep_one(_calls(spark, sf_dir), ["repo_name", "caller", "callee", "caller_file", "caller_line"], [F.col("call_type")])


def di_resolved_callees(spark, sf_dir):
    """Calls through a field of the caller are resolved by the class's injected fields.

    Lines call ``supplier.ship``; a part has that field when it is large.
    """
    calls, deps = _di_inputs(spark, sf_dir)
    return graph.resolve_callees(calls, deps).groupBy("caller", "callee", "call_type").agg(F.count("*").alias("n"))


def _di_inputs(spark, sf_dir):
    lines = views.read(spark, sf_dir, "lineitem")
    calls = lines.select(
        F.concat(F.lit("Part"), F.col("l_partkey"), F.lit(".order")).alias("caller"),
        F.concat(F.when(F.col("l_linestatus") == "O", "supplier").otherwise("this"), F.lit(".ship")).alias("callee"),
        F.lit("f").alias("caller_file"), F.col("l_linenumber").alias("caller_line"), F.lit("shop").alias("repo_name"), F.lit("method").alias("call_type"),
    )
    part = views.read(spark, sf_dir, "part")
    deps = part.where("p_size >= 25").select(
        F.concat(F.lit("Part"), F.col("p_partkey")).alias("class_name"), F.lit("supplier").alias("field_name"),
        F.concat(F.lit("Supplier"), F.initcap(F.lower("p_type"))).alias("field_type"), F.lit("field").alias("injection_type"), F.lit("shop").alias("repo_name"),
    )
    return calls, deps


DI_SQL = """WITH c AS (SELECT 'Part' || l_partkey || '.order' AS caller, l_partkey, CASE WHEN l_linestatus = 'O' THEN 'supplier' ELSE 'this' END AS field FROM lineitem),
r AS (SELECT caller, CASE WHEN field = 'supplier' AND p_size >= 25 THEN 'Supplier' || upper(p_type[1:1]) || lower(p_type[2:]) ELSE field END || '.ship' AS callee,
 CASE WHEN field = 'supplier' AND p_size >= 25 THEN 'resolved' ELSE 'method' END AS call_type FROM c LEFT JOIN part ON p_partkey = l_partkey)
SELECT caller, callee, call_type, count(*) AS n FROM r GROUP BY ALL"""


def _poly_inputs(spark, sf_dir):
    calls = _calls(spark, sf_dir).withColumn("callee", F.concat("callee", F.lit(".run")))
    syms = symbols.symbols(views.symbol_chunks(spark, sf_dir))
    edges = _calls(spark, sf_dir).where("caller like 'Part%'").select(
        F.col("caller").alias("child_name"), F.col("callee").alias("parent_name"), F.lit("implements").alias("relation_type"), F.lit("any").alias("repo_name")
    ).distinct()
    none = calls.select("repo_name", F.col("caller").alias("class_name"), F.col("caller").alias("field_name"), F.col("caller").alias("field_type")).where("false")
    return calls, none, syms, edges


def polymorphic_callees(spark, sf_dir):
    """What Part5 calls, and the same method on every part that implements a called supplier interface."""
    calls, none, syms, edges = _poly_inputs(spark, sf_dir)
    return graph.polymorphic_callees(calls, "Part5", none, syms, edges)


def polymorphic_callers(spark, sf_dir):
    calls, _, _, edges = _poly_inputs(spark, sf_dir)
    return graph.polymorphic_callers(calls, "Part5.run", edges)


POLY_CTE = f"""{CALLS_CTE}, {SYMBOLS_CTE}, c AS (SELECT * REPLACE (callee || '.run' AS callee) FROM calls),
inh AS (SELECT DISTINCT caller AS child_name, callee AS parent_name FROM calls WHERE caller LIKE 'Part%')"""


def dependency_chain(spark, sf_dir):
    return graph.dependency_chain(_calls(spark, sf_dir), "Part5")


def two_hop_dependents(spark, sf_dir):
    return graph.dependents(_calls(spark, sf_dir), START).groupBy("hop").agg(F.count("*").alias("sites"), F.countDistinct("caller_file").alias("files"))


def impact_radius(spark, sf_dir):
    return graph.impact_radius(_calls(spark, sf_dir), START, deep=True)


def callflow_edges(spark, sf_dir):
    """Call edges up to two levels from a part, each edge with the level that expands it."""
    calls = _calls(spark, sf_dir)
    return graph.expand_calls(calls, spark.sql("SELECT 'Part5' AS node"), 2)


def modules_calling(spark, sf_dir):
    """Modules with a call into one supplier module."""
    from codequarry.functions import names

    module = views.symbol_chunks(spark, sf_dir).select(names.module_name(F.col("file_path")).alias("module"), F.col("name").alias("qualified_name"))
    return graph.modules_calling(_calls(spark, sf_dir), module, "supplier_3")


# ---- inheritance --------------------------------------------------------------------


def _inh(spark, sf_dir):
    return views.inheritance(spark, sf_dir)


def implementations_direct(spark, sf_dir):
    return inh.implementations(_inh(spark, sf_dir), "Nation3")


def implementations_transitive(spark, sf_dir):
    return inh.all_implementations(_inh(spark, sf_dir), "Region1")


def parents_of(spark, sf_dir):
    return inh.parents(_inh(spark, sf_dir), "Customer5")


def type_hierarchy(spark, sf_dir):
    return inh.hierarchy(_inh(spark, sf_dir), "Nation3")


def inheritance_stats(spark, sf_dir):
    return inh.stats(_inh(spark, sf_dir))


# ---- architecture ------------------------------------------------------------------------


def health_score(spark, sf_dir):
    """Health of every repository from its dead symbols and its cycles."""
    dead = dead_code(spark, sf_dir).groupBy("repo_name").agg(F.count("*").alias("dead"))
    fn = cycles_scc(spark, sf_dir).groupBy("repo_name").agg(F.countDistinct("component").alias("function_cycles"))
    files = file_cycles(spark, sf_dir).groupBy("repo_name").agg(F.countDistinct("component").alias("file_cycles"))
    repos = _calls(spark, sf_dir).select("repo_name").distinct()
    joined = repos.join(dead, "repo_name", "left").join(files, "repo_name", "left").join(fn, "repo_name", "left").na.fill(0)
    scored = joined.withColumn("health", impact.health_score(F.col("dead"), F.col("file_cycles"), F.col("function_cycles")))
    return scored.select("repo_name", "dead", "file_cycles", "function_cycles", F.col("health.health_score").cast("bigint").alias("health_score"), "health.recommendation")


def index_stats(spark, sf_dir):
    return symbols.index_stats(views.chunks(spark, sf_dir))


def symbol_stats_grouping_sets(spark, sf_dir):
    return counts.count_by_each(symbols.symbols(views.symbol_chunks(spark, sf_dir)), ["symbol_type", "repo_name", "language"])


SCC_CALLS = f"{CALLS_CTE}, ed AS (SELECT DISTINCT repo_name, caller AS src, callee AS dst FROM calls)"
SCC_FILES = f"{FILE_EDGES_CTE}, ed AS (SELECT * FROM fe)"

def _scc_ctes(name: str, edges: str) -> str:
    return f"""{name}_c(repo_name, src, dst) AS (SELECT repo_name, src, dst FROM {edges} UNION SELECT c.repo_name, c.src, e.dst FROM {name}_c c JOIN {edges} e ON e.repo_name = c.repo_name AND e.src = c.dst),
{name} AS (SELECT a.repo_name, least(a.src, min(a.dst)) AS component FROM {name}_c a JOIN {name}_c b ON a.repo_name = b.repo_name AND a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.repo_name, a.src)"""


HEALTH_SQL = f"""WITH RECURSIVE {REACH_CTE}, home AS (SELECT repo_name, caller AS callee, min(caller_file) AS callee_file FROM calls GROUP BY ALL),
fe AS (SELECT DISTINCT c.repo_name, c.caller_file AS src, h.callee_file AS dst FROM calls c JOIN home h USING (repo_name, callee) WHERE c.caller_file <> h.callee_file),
ce AS (SELECT DISTINCT repo_name, caller AS src, callee AS dst FROM calls), {_scc_ctes('fn', 'ce')}, {_scc_ctes('fl', 'fe')},
d AS (SELECT repo_name, count(*) AS dead FROM (SELECT repo_name, node FROM known EXCEPT SELECT repo_name, node FROM r) GROUP BY ALL),
n AS (SELECT repo_name, coalesce(dead, 0) AS dead, coalesce((SELECT count(DISTINCT component) FROM fl WHERE fl.repo_name = q.repo_name), 0) AS file_cycles,
 coalesce((SELECT count(DISTINCT component) FROM fn WHERE fn.repo_name = q.repo_name), 0) AS function_cycles FROM (SELECT DISTINCT repo_name FROM calls) q LEFT JOIN d USING (repo_name)),
s AS (SELECT *, greatest(0, 100 - least(20, dead * 2) - least(30, file_cycles * 5) - least(20, function_cycles))::BIGINT AS health_score FROM n)
SELECT *, CASE WHEN health_score >= 80 THEN 'Good architecture health' WHEN health_score >= 50 THEN 'Consider refactoring to reduce dependencies' ELSE 'Architecture needs significant refactoring' END AS recommendation FROM s"""

QUERIES = {
    "direct_callers": (direct_callers, f"WITH {CALLS_CTE} SELECT {CALL_COLUMNS} FROM calls WHERE callee = '{START}'"),
    "direct_callees": (direct_callees, f"WITH {CALLS_CTE} SELECT {CALL_COLUMNS} FROM calls WHERE caller = '{START}' AND repo_name = 'm199607'"),
    "callers_bfs_depth3": (callers_bfs_depth3, _bfs_sql("callee", "caller", "repo_name = 'm199607'")),
    "callees_bfs_depth3": (callees_bfs_depth3, _bfs_sql("caller", "callee", "true")),
    "call_path": (call_path, PATH_SQL),
    "call_node": (call_node, f"WITH {CALLS_CTE} SELECT 'caller' AS side, caller AS other, caller_file, caller_line FROM calls WHERE callee = '{START}' AND repo_name = 'm199607' UNION ALL SELECT 'callee', callee, caller_file, caller_line FROM calls WHERE caller = '{START}' AND repo_name = 'm199607'"),
    "all_symbols_union": (all_symbols_union, f"WITH {CALLS_CTE}, {KNOWN_CTE} SELECT repo_name, node FROM known"),
    "no_callers_except": (no_callers_except, f"WITH {CALLS_CTE} SELECT repo_name, caller AS node FROM calls EXCEPT SELECT repo_name, callee FROM calls"),
    "entry_points": (entry_points, f"WITH {SYMBOLS_CTE} SELECT name AS node, repo_name, file_path FROM symbols WHERE has_route"),
    "reachable_from_entries": (reachable_from_entries, f"WITH RECURSIVE {REACH_CTE} SELECT repo_name, node, depth FROM r"),
    "dead_code": (dead_code, f"WITH RECURSIVE {REACH_CTE} SELECT repo_name, node FROM known EXCEPT SELECT repo_name, node FROM r"),
    "cycles_scc": (cycles_scc, _scc_sql(SCC_CALLS)),
    "file_edges": (file_edges, f"WITH {FILE_EDGES_CTE} SELECT * FROM fe"),
    "file_cycles": (file_cycles, _scc_sql(SCC_FILES)),
    "call_stats": (call_stats, f"WITH {CALLS_CTE} SELECT count(*) AS total_edges, count(DISTINCT caller) AS unique_callers, count(DISTINCT callee) AS unique_callees FROM calls"),
    "call_hotspots": (call_hotspots, f"WITH {CALLS_CTE} SELECT callee, count(*) AS call_count FROM calls GROUP BY ALL ORDER BY call_count DESC, callee LIMIT 10"),
    "calls_by_repo": (calls_by_repo, f"WITH {CALLS_CTE} SELECT repo_name, count(*) AS n FROM calls GROUP BY ALL"),
    "repo_hotspots": (repo_hotspots, f"WITH {CALLS_CTE}, n AS (SELECT repo_name, callee, count(*) AS n FROM calls GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY n DESC, callee)::INT AS rank FROM n) SELECT * FROM r WHERE rank <= 3"),
    "calls_first_wins": (calls_first_wins, f"WITH {CALLS_CTE} SELECT caller, callee, caller_file, caller_line, repo_name, min(call_type) AS call_type FROM calls GROUP BY ALL"),
    "di_resolved_callees": (di_resolved_callees, DI_SQL),
    "polymorphic_callees": (polymorphic_callees, f"WITH {POLY_CTE} SELECT {CALL_COLUMNS} FROM c WHERE caller = 'Part5' UNION ALL SELECT c.caller, inh.child_name || '.run', c.caller_file, c.caller_line, c.repo_name, 'virtual' FROM c JOIN inh ON c.callee = inh.parent_name || '.run' WHERE c.caller = 'Part5' AND inh.parent_name IN (SELECT name FROM symbols WHERE chunk_type = 'interface')"),
    "polymorphic_callers": (polymorphic_callers, f"WITH {POLY_CTE} SELECT {CALL_COLUMNS} FROM c WHERE callee = 'Part5.run' UNION ALL SELECT c.caller, 'Part5.run', c.caller_file, c.caller_line, c.repo_name, 'virtual' FROM c JOIN inh ON c.callee = inh.parent_name || '.run' WHERE inh.child_name = 'Part5'"),
    "dependency_chain": (dependency_chain, f"WITH {CALLS_CTE}, d AS (SELECT DISTINCT callee AS name FROM calls WHERE caller = 'Part5'), t AS (SELECT DISTINCT callee AS name FROM calls WHERE caller IN (SELECT name FROM d) AND callee NOT IN (SELECT name FROM d)) SELECT 'direct' AS kind, name FROM d UNION ALL SELECT 'transitive', name FROM t"),
    "two_hop_dependents": (two_hop_dependents, f"WITH {CALLS_CTE}, r AS (SELECT 1 AS hop, caller_file FROM calls WHERE callee = '{START}' UNION ALL SELECT 2, caller_file FROM calls WHERE callee IN (SELECT caller FROM calls WHERE callee = '{START}')) SELECT hop, count(*) AS sites, count(DISTINCT caller_file) AS files FROM r GROUP BY hop"),
    "impact_radius": (impact_radius, f"WITH {CALLS_CTE} SELECT (SELECT count(*) FROM calls WHERE callee = '{START}') + (SELECT count(*) FROM calls WHERE callee IN (SELECT caller FROM calls WHERE callee = '{START}')) AS impact_radius"),
    "callflow_edges": (callflow_edges, f"WITH {CALLS_CTE}, n AS (SELECT 'Part5' AS caller, 0::INT AS depth UNION ALL SELECT DISTINCT callee, 1::INT FROM calls WHERE caller = 'Part5' AND callee <> 'Part5') SELECT caller, callee, caller_file, caller_line, depth FROM calls JOIN n USING (caller)"),
    "modules_calling": (modules_calling, f"WITH {CALLS_CTE}, {SYMBOLS_CTE}, m AS (SELECT name, regexp_extract(file_path, 'src/(.*)[.]py', 1) AS module FROM symbols) SELECT DISTINCT module FROM m WHERE name IN (SELECT caller FROM calls WHERE callee IN (SELECT name FROM m WHERE module = 'supplier_3'))"),
    "implementations_direct": (implementations_direct, f"WITH {INH_CTE} SELECT *, false AS indirect FROM inheritance WHERE parent_name = 'Nation3'"),
    "implementations_transitive": (implementations_transitive, f"WITH RECURSIVE {INH_CTE}, r(node) AS (SELECT 'Region1' UNION SELECT child_name FROM inheritance JOIN r ON parent_name = node) SELECT *, parent_name <> 'Region1' AS indirect FROM inheritance WHERE parent_name IN (SELECT node FROM r)"),
    "parents_of": (parents_of, f"WITH {INH_CTE} SELECT * FROM inheritance WHERE child_name = 'Customer5'"),
    "type_hierarchy": (type_hierarchy, f"WITH {INH_CTE} SELECT CASE WHEN relation_type = 'implements' THEN 'implements' ELSE 'extends' END AS relation, parent_name AS name FROM inheritance WHERE child_name = 'Nation3' UNION ALL SELECT CASE WHEN relation_type = 'implements' THEN 'implemented_by' ELSE 'extended_by' END, child_name FROM inheritance WHERE parent_name = 'Nation3'"),
    "inheritance_stats": (inheritance_stats, f"WITH {INH_CTE}, p AS (SELECT parent_name, count(*) AS n FROM inheritance GROUP BY ALL ORDER BY n DESC, parent_name LIMIT 10) SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM inheritance UNION ALL SELECT 'relation', relation_type, count(*) FROM inheritance GROUP BY ALL UNION ALL SELECT 'parent', parent_name, n FROM p"),
    "index_stats": (index_stats, "WITH chunks AS (" + views.cte(views.CHUNKS) + ") SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM chunks UNION ALL SELECT 'repo', repo_name, count(*) FROM chunks GROUP BY ALL UNION ALL SELECT 'language', language, count(*) FROM chunks GROUP BY ALL UNION ALL SELECT 'type', chunk_type, count(*) FROM chunks GROUP BY ALL"),
    "symbol_stats_grouping_sets": (symbol_stats_grouping_sets, f"WITH {SYMBOLS_CTE} SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM symbols UNION ALL SELECT 'symbol_type', chunk_type, count(*) FROM symbols GROUP BY ALL UNION ALL SELECT 'repo_name', repo_name, count(*) FROM symbols GROUP BY ALL UNION ALL SELECT 'language', 'python', count(*) FROM symbols"),
    "health_score": (health_score, HEALTH_SQL),
}
