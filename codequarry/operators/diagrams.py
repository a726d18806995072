"""Diagram graphs: node and edge tables built from search hits.

Hits (columns of chunks plus ``rank``) are at most one page of search results, so hints on them
are bounded. A node has id, label, type, file, position and a struct of extras; an edge has
source, target, label, type and position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import names, regex as rx
from codequarry.operators.graph import expand_calls, is_diagram_entry, spread

EXTRA = (
    "struct<layer:string,chunk_count:bigint,dataflow_type:string,is_entry:boolean,line:int,depth:int,methods:array<string>,"
    "is_interface:boolean,external:boolean,symbol_count:bigint>"
)


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def _extra(**fields: Column) -> Column:
    kinds = dict(part.split(":", 1) for part in EXTRA[7:-1].split(","))
    return F.struct(*[fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])


def _words(text: Column, table: dict[str, list[str]], default: Column) -> Column:
    result = default
    for name, words in reversed(list(table.items())):
        result = F.when(rx.any_contains(F.lower(text), words), name).otherwise(result)
    return result


def layer(module: Column, has_route: Column) -> Column:
    """Layer by words of the module name, else ``api`` for modules with routes, else ``service``."""
    return _words(module, fixed.LAYER_WORDS, F.when(has_route, "api").otherwise("service"))


def dataflow_type(name: Column) -> Column:
    return _words(name, {"source": fixed.SOURCE_WORDS, "sink": fixed.SINK_WORDS}, F.lit("processor"))


def flow_label(target: Column) -> Column:
    return _words(target, fixed.FLOW_LABELS, F.lit("process"))


def _qualified(hits: DataFrame) -> DataFrame:
    named = hits.withColumn("qualified_name", names.qualified_name(F.col("parent_name"), F.col("name")))
    return named.withColumn("module", names.module_name(F.col("file_path")))


def _node(node_id: Column, label: Column, kind: Column, file: Column, position: Column, extra: Column) -> list[Column]:
    return [
        names.node_id(node_id).alias("id"), label.alias("label"), kind.alias("type"), file.alias("file"), position.cast("bigint").alias("position"), extra.alias("extra"),
    ]


def _edge(source: Column, target: Column, label: Column, kind: str, position: Column) -> list[Column]:
    return [names.node_id(source).alias("source"), names.node_id(target).alias("target"), label.alias("label"), F.lit(kind).alias("type"), position.cast("bigint").alias("position")]


def _module_edges(hits: DataFrame, calls: DataFrame, chunks: DataFrame, label: str, kind: str) -> DataFrame:
    """Modules of hits whose symbols call a symbol defined in another hit module."""
    callers = F.broadcast(hits.select(F.col("qualified_name").alias("caller"), F.col("module").alias("source_module")).distinct())
    called = calls.join(callers, "caller").select("source_module", "callee").distinct()
    homes = chunks.select(names.qualified_name(F.col("parent_name"), F.col("name")).alias("callee"), names.module_name(F.col("file_path")).alias("target_module")).distinct()
    shown = F.broadcast(hits.select(F.col("module").alias("target_module")).distinct())
    pairs = called.join(homes, "callee").join(shown, "target_module", "left_semi").where("source_module <> target_module")
    return pairs.select("source_module", "target_module").distinct().select(*_edge(F.col("source_module"), F.col("target_module"), F.lit(label), kind, F.lit(0)))


def architecture(hits: DataFrame, calls: DataFrame, chunks: DataFrame) -> Graph:
    named = _qualified(hits)
    modules = named.groupBy("module").agg(
        F.min("rank").alias("rank"), F.min_by("file_path", "rank").alias("file"), F.count("*").alias("n"), F.max(F.col("metadata.route").isNotNull()).alias("has_route")
    )
    extra = _extra(layer=layer(F.col("module"), F.col("has_route")), chunk_count=F.col("n"))
    nodes = modules.select(*_node(F.col("module"), F.col("module"), F.lit("component"), F.col("file"), F.col("rank"), extra))
    return Graph(nodes, _module_edges(named, calls, chunks, "uses", "dependency"))


def dependency(hits: DataFrame, calls: DataFrame, chunks: DataFrame) -> Graph:
    named = _qualified(hits)
    modules = named.groupBy("module").agg(F.min("rank").alias("rank"), F.min_by("file_path", "rank").alias("file"))
    sizes = named.groupBy("module", "file_path").agg(F.count("*").alias("n")).withColumnRenamed("file_path", "file")
    joined = modules.join(sizes, ["module", "file"])
    label = F.substring_index("module", ".", -1)
    nodes = joined.select(*_node(F.col("module"), label, F.lit("module"), F.col("file"), F.col("rank"), _extra(symbol_count=F.col("n"))))
    return Graph(nodes, _module_edges(named, calls, chunks, "imports", "import"))


def _symbol_nodes(named: DataFrame) -> DataFrame:
    """The first hit of every qualified name."""
    return named.withColumn("n", F.row_number().over(Window.partitionBy("qualified_name").orderBy("rank"))).where("n = 1")


def _calls_from(hits: DataFrame, calls: DataFrame, depth: int) -> DataFrame:
    """(origin, callee, depth) for everything each hit reaches within ``depth`` calls."""
    starts = hits.select(F.col("qualified_name").alias("origin"), F.col("qualified_name").alias("node")).distinct()
    return spread(calls, starts, "caller", "callee", depth, carry=["origin"]).select("origin", F.col("node").alias("callee"), "depth")


def dataflow(hits: DataFrame, calls: DataFrame, depth: int = 3) -> Graph:
    named = _symbol_nodes(_qualified(hits))
    kind = dataflow_type(F.col("name"))
    nodes = named.select(*_node(F.col("qualified_name"), F.col("name"), kind, F.col("file_path"), F.col("rank"), _extra(dataflow_type=kind)))
    reached = _calls_from(named, calls, depth).join(F.broadcast(named.select(F.col("qualified_name").alias("callee"))), "callee", "left_semi")
    return Graph(nodes, reached.select(*_edge(F.col("origin"), F.col("callee"), flow_label(F.col("callee")), "dataflow", F.col("depth"))))


def callflow(hits: DataFrame, calls: DataFrame, depth: int = 3) -> Graph:
    named = _symbol_nodes(_qualified(hits))
    entry = is_diagram_entry(F.col("metadata.route"), F.col("name"))
    shown = named.select(
        *_node(F.col("qualified_name"), F.col("name"), F.when(entry, "entry").otherwise(F.col("chunk_type")), F.col("file_path"), F.col("rank"), _extra(is_entry=entry, line=F.col("start_line")))
    )
    flow = expand_calls(calls, named.select(F.col("qualified_name").alias("node")), depth)
    edges = flow.select(*_edge(F.col("caller"), F.col("callee"), F.lit("calls"), "call", F.col("caller_line")))
    called = flow.groupBy("callee").agg(F.min(F.struct("depth", "caller_file")).alias("first")).join(F.broadcast(named.select(F.col("qualified_name").alias("callee"))), "callee", "left_anti")
    reached = called.select(
        *_node(F.col("callee"), F.substring_index("callee", ".", -1), F.lit("function"), F.col("first.caller_file"), 1000 * (F.col("first.depth") + 1), _extra(depth=F.col("first.depth") + 1))
    )
    return Graph(shown.unionByName(reached), edges)


def classes(hits: DataFrame, inheritance: DataFrame) -> Graph:
    """Classes of the hits with the methods found beside them; parents that are no hit are external."""
    types = hits.where(F.col("chunk_type").isin("class", "interface"))
    first = types.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("rank"))).where("n = 1")
    methods = hits.where("parent_name is not null").groupBy(F.col("parent_name").alias("name")).agg(
        F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda m: m["name"]), 1, 10).alias("methods")
    )
    interface = F.col("chunk_type") == "interface"
    nodes = first.join(methods, "name", "left").select(
        *_node(F.col("name"), F.col("name"), F.when(interface, "interface").otherwise("class"), F.col("file_path"), F.col("rank"), _extra(methods=F.coalesce("methods", F.array().cast("array<string>")), is_interface=interface))
    )
    relations = inheritance.join(F.broadcast(first.select(F.col("name").alias("child_name"))), "child_name", "left_semi").select("child_name", "parent_name", "relation_type").distinct()
    kind = F.when(F.col("relation_type") == "extends", "extends").otherwise("implements")
    edges = relations.select(names.node_id(F.col("child_name")).alias("source"), names.node_id(F.col("parent_name")).alias("target"), F.lit(None).cast("string").alias("label"), kind.alias("type"), F.lit(0).cast("bigint").alias("position"))
    parents = relations.join(F.broadcast(first.select(F.col("name").alias("parent_name"))), "parent_name", "left_anti").groupBy("parent_name").agg(F.max("relation_type").alias("relation"))
    external = parents.select(
        *_node(F.col("parent_name"), F.col("parent_name"), F.when(F.col("relation") == "implements", "interface").otherwise("class"), F.lit(None).cast("string"), F.lit(10_000), _extra(external=F.lit(True)))
    )
    return Graph(nodes.unionByName(external), edges)


def sequence(hits: DataFrame, calls: DataFrame, depth: int = 5) -> Graph:
    """Messages from the entry points among the hits (else from the best hit), numbered in call order."""
    named = _qualified(hits)
    entries = named.withColumn("is_entry", is_diagram_entry(F.col("metadata.route"), F.col("name")))
    best = entries.agg(F.max("is_entry").alias("any"), F.min("rank").alias("top"))
    chosen = entries.join(F.broadcast(best), (F.col("is_entry") & F.col("any")) | (~F.col("any") & (F.col("rank") == F.col("top"))))
    starts = chosen.select("qualified_name", "rank", F.coalesce(F.nullif("parent_name", F.lit("")), F.col("module")).alias("participant"), "file_path")
    reached = _calls_from(starts, calls, depth).join(F.broadcast(starts.withColumnRenamed("qualified_name", "origin")), "origin")
    # numbers: a running number within (start, depth), offset by the sizes of the groups before it
    groups = reached.groupBy("rank", "depth").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("rank", "depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = groups.select("rank", "depth", before.alias("offset"))
    inner = F.row_number().over(Window.partitionBy("rank", "depth").orderBy("callee"))
    messages = reached.withColumn("inner", inner).join(F.broadcast(offsets), ["rank", "depth"]).withColumn("sequence", F.col("inner") + F.col("offset"))
    target = F.substring_index("callee", ".", 1)
    edges = messages.select(*_edge(F.col("participant"), target, F.substring_index("callee", ".", -1), "call", F.col("sequence")))
    own = starts.groupBy("participant").agg(F.min_by("file_path", "rank").alias("file"), F.min("rank").alias("rank"))
    nodes = own.select(*_node(F.col("participant"), F.col("participant"), F.lit("participant"), F.col("file"), F.col("rank"), _extra()))
    called = messages.groupBy(target.alias("participant")).agg(F.min("sequence").alias("first")).join(F.broadcast(own.select("participant")), "participant", "left_anti")
    others = called.select(*_node(F.col("participant"), F.col("participant"), F.lit("participant"), F.lit(None).cast("string"), 10_000 + F.col("first"), _extra()))
    return Graph(nodes.unionByName(others), edges)


def limited(graph: Graph, max_nodes: int, include_external: bool = False) -> Graph:
    """The first nodes, and the edges with both ends among them."""
    nodes = graph.nodes
    if not include_external:
        nodes = nodes.where(F.col("file").isNotNull() | ~F.coalesce(F.col("extra.external"), F.lit(False)))
    nodes = nodes.orderBy("position", "id").limit(max_nodes)
    ids = F.broadcast(nodes.select("id"))
    edges = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(nodes, edges.select("source", "target", "label", "type", "position"))
