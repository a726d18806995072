"""Graph operators over edge tables.

Every traversal is a loop of joins: the frontier holds each node once, the
edges keep their own layout, and adaptive execution picks a broadcast for a
small frontier or splits a hot key of a large one. Each level is cut with a
reliable checkpoint, so a lost executor never replays the whole walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codequarry.operators.contraction import distances, strong_components, union
from codequarry.session import cut

CALL_ORDER = ["callee", "caller_file", "caller_line", "repo_name", "call_type"]


def _in_repo(df: DataFrame, repo: str | None) -> DataFrame:
    return df if repo is None else df.where(F.col("repo_name") == repo)


def direct_callers(calls: DataFrame, symbol: str, repo: str | None = None) -> DataFrame:
    """One row per call site, ordered by caller."""
    return _in_repo(calls, repo).where(F.col("callee") == symbol).orderBy("caller", "caller_file", "caller_line", "repo_name")


def direct_callees(calls: DataFrame, symbol: str, repo: str | None = None) -> DataFrame:
    return _in_repo(calls, repo).where(F.col("caller") == symbol).orderBy("callee", "caller_file", "caller_line", "repo_name")


def spread(
    edges: DataFrame,
    seeds: DataFrame,
    near: str,
    far: str,
    max_depth: int | None = None,
    scope: list[str] | None = None,
    payload: list[str] | None = None,
    seeds_visited: bool = False,
    carry: list[str] | None = None,
) -> DataFrame:
    """Breadth-first levels from ``seeds`` (column ``node``) along ``near`` -> ``far``.

    Columns: scope, carry, ``node``, ``depth``; with ``payload`` also ``via``, the smallest
    (near, payload) of the edges that reach the node at its depth. With ``scope`` every graph is
    walked separately; ``carry`` names seed columns (such as the start) whose walks over one graph
    are kept apart. A bounded walk reads the edges as they are; a full one contracts them first (``distances``).
    """
    scope, carry = scope or [], carry or []
    key = [*scope, *carry, "node"]
    if payload is None and max_depth is None and not carry and seeds_visited:
        return distances(edges.select(*scope, F.col(near).alias("s"), F.col(far).alias("t")), seeds, scope)
    hops = edges.select(*scope, F.col(near).alias("__near"), F.col(far).alias("__far"))
    if payload is not None:
        via = F.struct(F.col(near).alias("near"), *[F.col(c) for c in payload])
        hops = edges.select(*scope, F.col(near).alias("__near"), F.col(far).alias("__far"), via.alias("__via"))
    found = [] if payload is None else ["via"]
    frontier = seeds.select(*key).distinct()
    levels: list[DataFrame] = []
    if seeds_visited:
        start = frontier.select(*key, F.lit(0).alias("depth"))
        if found:
            start = start.withColumn("via", F.lit(None).cast(hops.schema["__via"].dataType))
        frontier = cut(start)
        levels.append(frontier)
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        near_side = frontier.select(*scope, *carry, F.col("node").alias("__near"))
        reached = hops.join(near_side, [*scope, "__near"]).withColumnRenamed("__far", "node")
        step = reached.groupBy(*key).agg(F.min("__via").alias("via")) if found else reached.select(*key).distinct()
        if levels:
            step = step.join(union(levels).select(*key), key, "left_anti")
        frontier = cut(step.select(*key, F.lit(depth).alias("depth"), *found))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) >= 8:
            levels = [cut(union(levels))]
            if payload is None and not carry:
                # edges into visited nodes lead nowhere new
                seen = levels[0].select(*scope, F.col("node").alias("__far"))
                hops = cut(hops.join(seen, [*scope, "__far"], "left_anti"))
    return union(levels) if levels else frontier


def transitive_callers(calls: DataFrame, symbol: str, max_depth: int, repo: str | None = None) -> DataFrame:
    """Each new caller once, with the first relation that reached it. The start is not marked visited,
    so inside a cycle it is reported as its own caller."""
    edges = _in_repo(calls, repo)
    seeds = edges.sparkSession.range(1).select(F.lit(symbol).alias("node"))
    found = spread(edges, seeds, "callee", "caller", max_depth, payload=["caller_file", "caller_line", "repo_name", "call_type"])
    return found.select(
        F.col("node").alias("caller"), F.col("via.near").alias("callee"), "via.caller_file", "via.caller_line",
        "via.repo_name", "via.call_type", "depth",
    )


def transitive_callees(calls: DataFrame, symbol: str, max_depth: int, repo: str | None = None) -> DataFrame:
    edges = _in_repo(calls, repo)
    seeds = edges.sparkSession.range(1).select(F.lit(symbol).alias("node"))
    found = spread(edges, seeds, "caller", "callee", max_depth, payload=["caller_file", "caller_line", "repo_name", "call_type"])
    return found.select(
        F.col("via.near").alias("caller"), F.col("node").alias("callee"), "via.caller_file", "via.caller_line",
        "via.repo_name", "via.call_type", "depth",
    )


def find_callers(calls: DataFrame, symbol: str, repo: str | None = None, max_depth: int = 1) -> DataFrame:
    return direct_callers(calls, symbol, repo) if max_depth <= 1 else transitive_callers(calls, symbol, max_depth, repo)


def find_callees(calls: DataFrame, symbol: str, repo: str | None = None, max_depth: int = 1) -> DataFrame:
    return direct_callees(calls, symbol, repo) if max_depth <= 1 else transitive_callees(calls, symbol, max_depth, repo)


def find_path(calls: DataFrame, source: str, target: str, repo: str | None = None, max_depth: int = 10) -> DataFrame:
    """Shortest call path with at most ``max_depth`` edges, the lexicographically first of its length; no row if none."""
    edges = cut(_in_repo(calls, repo).select("caller", "callee").distinct())
    spark = edges.sparkSession
    frontier = spark.range(1).select(F.lit(source).alias("node"), F.array(F.lit(source)).alias("path"))
    visited = [frontier.select("node")]
    for _ in range(max_depth):
        step = cut(
            edges.join(frontier.withColumnRenamed("node", "caller"), "caller")
            .groupBy(F.col("callee").alias("node"))
            .agg(F.min("path").alias("path"))
            .select("node", F.concat("path", F.array("node")).alias("path"))
        )
        hit = step.where(F.col("node") == target)
        if not hit.isEmpty():
            return hit.select("path", (F.size("path") - 1).alias("length"))
        frontier = cut(step.join(union(visited), "node", "left_anti"))
        if frontier.isEmpty():
            break
        visited.append(frontier.select("node"))
    return spark.createDataFrame([], "path array<string>, length int")


def all_symbols(calls: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or []
    callers = calls.select(*scope, F.col("caller").alias("node"))
    return callers.union(calls.select(*scope, F.col("callee").alias("node"))).distinct()


def never_called(calls: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or []
    callers = calls.select(*scope, F.col("caller").alias("node")).distinct()
    return callers.join(calls.select(*scope, F.col("callee").alias("node")), [*scope, "node"], "left_anti")


def is_entry_point(route, name, react, file_path):
    """Routes, mains, page components and tests start a program."""
    page = F.coalesce(react, F.lit(False)) & (F.contains(file_path, F.lit("/pages/")) | F.contains(file_path, F.lit("/app/")))
    test = F.startswith(name, F.lit("test_")) | F.startswith(name, F.lit("Test"))
    return route.isNotNull() | F.lower(name).isin("main", "__main__") | page | test


def is_diagram_entry(route, name):
    lowered = F.lower(name)
    return route.isNotNull() | lowered.isin("main", "__main__") | F.startswith(lowered, F.lit("test_"))


def entry_points(chunks: DataFrame) -> DataFrame:
    from codequarry.functions.names import qualified_name

    flag = is_entry_point(F.col("metadata.route"), F.col("name"), F.col("metadata.is_react_component"), F.col("file_path"))
    return chunks.where(flag).select(qualified_name(F.col("parent_name"), F.col("name")).alias("node"), "repo_name", "file_path")


def reachable(calls: DataFrame, entries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Everything some entry point leads to, entries included, with its distance."""
    return spread(calls, entries, "caller", "callee", scope=scope, seeds_visited=True)


def unreachable(calls: DataFrame, entries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Symbols that no entry point leads to: marks of both kinds meet in one aggregate."""
    key = [*(scope or []), "node"]
    marks = [calls.select(*key[:-1], F.col(c).alias("node"), F.lit(False).alias("met")) for c in ("caller", "callee")]
    marks.append(reachable(calls, entries, scope).select(*key, F.lit(True).alias("met")))
    return union(marks).groupBy(*key).agg(F.max("met").alias("met")).where("not met").select(*key)


def cycles(edges: DataFrame, src: str, dst: str, scope: list[str] | None = None) -> DataFrame:
    """Strongly connected components with more than one node: scope, ``node``, ``component`` (its smallest node)."""
    scope = scope or []
    members = strong_components(edges.select(*scope, F.col(src).alias("s"), F.col(dst).alias("t")), scope)
    named = members.groupBy(*scope, "colour").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    return members.join(named, [*scope, "colour"]).select(*scope, "node", "component")


def file_edges(calls: DataFrame) -> DataFrame:
    """Call edges between files: the callee's file is where it appears as a caller (the first by name)."""
    homes = calls.groupBy("repo_name", F.col("caller").alias("callee")).agg(F.min("caller_file").alias("callee_file"))
    return (
        calls.select("repo_name", "callee", "caller_file")
        .join(homes, ["repo_name", "callee"])
        .where("caller_file <> callee_file")
        .select("repo_name", F.col("caller_file").alias("src"), F.col("callee_file").alias("dst"))
        .distinct()
    )


def file_cycles(calls: DataFrame) -> DataFrame:
    """Components of files that call each other; their edges are few and read several times, so they are written first."""
    return cycles(cut(file_edges(calls)), "src", "dst", ["repo_name"])


def call_node(calls: DataFrame, symbol: str, repo: str | None = None) -> DataFrame:
    """Callers and callees of one symbol as rows with a side and a position, plus its reference file."""
    callers = direct_callers(calls, symbol, repo).select(F.lit("caller").alias("side"), F.col("caller").alias("other"), "caller_file", "caller_line", "repo_name")
    callees = direct_callees(calls, symbol, repo).select(F.lit("callee").alias("side"), F.col("callee").alias("other"), "caller_file", "caller_line", "repo_name")
    return callers.unionByName(callees)


def resolve_callees(calls: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``field.method`` becomes ``Type.method`` when the caller's class has that injected field."""
    head = F.substring_index("callee", ".", 1)
    keyed = calls.withColumn("class_name", F.substring_index("caller", ".", 1)).withColumn(
        "field_name", F.when(F.contains("callee", F.lit(".")) & ~head.isin("this", "self", "super"), head)
    )
    fields = dependencies.groupBy("repo_name", "class_name", "field_name").agg(F.min("field_type").alias("field_type"))
    joined = keyed.join(fields, ["repo_name", "class_name", "field_name"], "left")
    target = F.concat(F.col("field_type"), F.substr("callee", F.length("field_name") + 1))
    return joined.select(
        "caller",
        F.coalesce(target, F.col("callee")).alias("callee"),
        "caller_file",
        "caller_line",
        "repo_name",
        F.when(F.col("field_type").isNotNull() & (target != F.col("callee")), "resolved").otherwise(F.col("call_type")).alias("call_type"),
    )


def polymorphic_callees(
    calls: DataFrame, symbol: str, dependencies: DataFrame, symbols: DataFrame, inheritance: DataFrame, repo: str | None = None
) -> DataFrame:
    """Resolved callees of a symbol, and for interface methods the same method of each implementation."""
    mine = resolve_callees(direct_callees(calls, symbol, repo), dependencies)
    holder, method = F.regexp_extract("callee", r"^(.*)\.[^.]*$", 1), F.substring_index("callee", ".", -1)
    # what one symbol calls is few: it picks interfaces and implementations before anything is shuffled or made distinct
    called = F.broadcast(mine.where(holder != "").select(holder.alias("parent_name")).distinct())
    interfaces = symbols.where(F.col("symbol_type") == "interface")
    interface_names = interfaces.select(F.col("name").alias("parent_name")).union(interfaces.select("qualified_name")).join(called, "parent_name", "left_semi").distinct()
    parents = _in_repo(inheritance, repo).join(called, "parent_name", "left_semi").join(interface_names, "parent_name", "left_semi").select("parent_name", "child_name")
    virtual = (
        mine.where(holder != "")
        .withColumn("parent_name", holder)
        .join(parents, "parent_name")
        .select(
            "caller", F.concat_ws(".", "child_name", method).alias("callee"), "caller_file", "caller_line", "repo_name",
            F.lit("virtual").alias("call_type"),
        )
    )
    return mine.unionByName(virtual)


def polymorphic_callers(calls: DataFrame, symbol: str, inheritance: DataFrame, repo: str | None = None) -> DataFrame:
    """Direct callers, and callers of the same method on an interface the symbol's class implements."""
    mine = direct_callers(calls, symbol, repo).select("caller", "callee", "caller_file", "caller_line", "repo_name", "call_type")
    if "." not in symbol:
        return mine
    holder, method = symbol.rsplit(".", 1)
    parents = _in_repo(inheritance, repo).where((F.col("child_name") == holder) & (F.col("relation_type") == "implements"))
    methods = parents.select(F.concat("parent_name", F.lit("." + method)).alias("callee"))
    through = _in_repo(calls, repo).join(F.broadcast(methods), "callee").select(
        "caller", F.lit(symbol).alias("callee"), "caller_file", "caller_line", "repo_name", F.lit("virtual").alias("call_type")
    )
    return mine.unionByName(through)


# ---- two-hop reports -----------------------------------------------------------


def dependency_chain(calls: DataFrame, symbol: str, repo: str | None = None, show: int | None = None) -> DataFrame:
    """Direct callees, and the callees of these that are not direct themselves; ``show`` limits what each kind lists."""
    calls = _in_repo(calls, repo)
    direct = calls.where(F.col("caller") == symbol).select(F.col("callee").alias("name")).distinct()
    further = (
        calls.join(direct.withColumnRenamed("name", "caller"), "caller", "left_semi")
        .select(F.col("callee").alias("name"))
        .distinct()
        .join(direct, "name", "left_anti")
    )
    if show is not None:
        direct, further = direct.orderBy("name").limit(show), further.orderBy("name").limit(show)
    return direct.select(F.lit("direct").alias("kind"), "name").unionByName(further.select(F.lit("transitive").alias("kind"), "name"))


def dependents(calls: DataFrame, symbol: str, repo: str | None = None) -> DataFrame:
    """Direct call sites (hop 1), and the call sites of all their callers (hop 2), each once."""
    calls = _in_repo(calls, repo)
    direct = calls.where(F.col("callee") == symbol)
    second = calls.join(direct.select(F.col("caller").alias("callee")).distinct(), "callee", "left_semi")
    return (
        direct.select(F.lit(1).alias("hop"), "caller", "callee", "caller_file", "caller_line")
        .unionByName(second.select(F.lit(2).alias("hop"), "caller", "callee", "caller_file", "caller_line"))
    )


def impact_radius(calls: DataFrame, symbol: str, repo: str | None = None, deep: bool = False) -> DataFrame:
    reach = dependents(calls, symbol, repo)
    return (reach if deep else reach.where("hop = 1")).agg(F.count("*").alias("impact_radius"))


def expand_calls(calls: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """All call edges of nodes less than ``max_depth`` away from a start; a node expands once, edges are all kept."""
    nodes = spread(calls, starts, "caller", "callee", max_depth - 1, seeds_visited=True).select(F.col("node").alias("caller"), "depth")
    return calls.join(nodes, "caller").select("caller", "callee", "caller_file", "caller_line", "depth")


def call_stats(calls: DataFrame) -> DataFrame:
    return calls.agg(
        F.count("*").alias("total_edges"),
        F.countDistinct("caller").alias("unique_callers"),
        F.countDistinct("callee").alias("unique_callees"),
    )


def modules_calling(calls: DataFrame, chunks_module: DataFrame, target_module: str) -> DataFrame:
    """Modules with a call into ``target_module``: their callee is a symbol of it."""
    targets = chunks_module.where(F.col("module") == target_module).select(F.col("qualified_name").alias("callee"))
    callers = calls.join(targets, "callee", "left_semi").select(F.col("caller").alias("qualified_name")).distinct()
    return chunks_module.join(callers, "qualified_name", "left_semi").select("module").distinct()


def as_http_edges(links: DataFrame) -> DataFrame:
    """Confident route links as call edges."""
    return links.where("not is_ambiguous").select(
        F.col("caller_qualified_name").alias("caller"),
        F.col("qualified_name").alias("callee"),
        F.col("call_file").alias("caller_file"),
        F.col("call_line").alias("caller_line"),
        F.col("call_repo").alias("repo_name"),
        F.lit("http_request").alias("call_type"),
    )
