"""Python files to chunks, calls and base classes.

One syntax tree per file, read with the standard library inside an Arrow batch; everything
around it (ids, routes into metadata, flattening) is columns.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codequarry.functions import names
from codequarry.schema import BASE_CLASS, CALL_SITE, CHUNK, METADATA, PARTS, as_struct

UNIT = (
    "name string, chunk_type string, parent_name string, start_line int, end_line int, signature string, docstring string, "
    "route_method string, route_path string"
)
PARSED = (
    f"repo_name string, file_path string, content string, units array<{as_struct(UNIT)}>, calls array<{as_struct(CALL_SITE)}>, "
    f"bases array<{as_struct(BASE_CLASS)}>, imports array<string>, error string, n_chunks int"
)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a name or attribute; after a call only what follows it."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.insert(0, node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.insert(0, node.id)
    elif isinstance(node, ast.Call) and not parts:
        return dotted(node.func)
    return ".".join(parts) or None


def route(node: ast.AST) -> tuple[str | None, str | None]:
    """Verb and path of the first web decorator."""
    for decorator in node.decorator_list:
        name = dotted(decorator.func) if isinstance(decorator, ast.Call) else None
        verb = (name or "").rpartition(".")
        if not verb[1] or verb[2] not in ("get", "post", "put", "delete", "patch", "route"):
            continue
        first = decorator.args[0] if decorator.args else None
        path = first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else ""
        method = "GET" if verb[2] == "route" else verb[2].upper()
        for keyword in decorator.keywords:
            items = getattr(keyword.value, "elts", []) if keyword.arg == "methods" else []
            listed = [e.value for e in items if isinstance(e, ast.Constant)]
            method = listed[0] if listed else method
        return method, path
    return None, None


def unit(node: ast.AST, kind: str, parent: str | None, lines: list[str]) -> dict:
    start = node.lineno
    head = lines[start - 1 : start + 4]
    stop = next((i for i, line in enumerate(head) if ":" in line), len(head) - 1)
    text = ast.get_docstring(node, clean=False)
    verb, path = route(node) if kind != "class" else (None, None)
    return {
        "name": node.name, "chunk_type": kind, "parent_name": parent, "start_line": start, "end_line": node.end_lineno,
        "signature": "\n".join(head[: stop + 1]).strip() if kind != "class" else None,
        "docstring": text.strip() if text else None, "route_method": verb, "route_path": path,
    }


#: Nodes that hold no call.
LEAVES = (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.Name, ast.Constant, ast.alias)


def calls_inside(statement: ast.stmt) -> Iterator[ast.Call]:
    """Calls in the order of ``ast.walk``; leaves are not visited."""
    nodes: list[ast.AST] = [statement]
    for node in nodes:
        if isinstance(node, ast.Call):
            yield node
        for name in node._fields:
            value = getattr(node, name, None)
            if isinstance(value, list):
                nodes += [v for v in value if isinstance(v, ast.AST) and not isinstance(v, LEAVES)]
            elif isinstance(value, ast.AST) and not isinstance(value, LEAVES):
                nodes.append(value)


def call_sites(node: ast.AST, caller: str) -> list[dict]:
    """Calls in the body, nested functions included."""
    inside = (n for statement in node.body for n in calls_inside(statement))
    found = ((n, dotted(n.func)) for n in inside)
    return [
        {"caller": caller, "callee": name, "line": n.lineno, "call_type": "method" if isinstance(n.func, ast.Attribute) else "direct"}
        for n, name in found if name
    ]


def base_classes(node: ast.ClassDef) -> list[dict]:
    bases = [dotted(b.value if isinstance(b, ast.Subscript) else b) for b in node.bases]
    return [
        {"child_name": node.name, "child_qualified": node.name, "parent_name": b, "relation_type": "extends", "line_number": node.lineno}
        for b in bases if b and b != "object"
    ]


QUOTED = re.compile(r"""#.*|(\"{3}|'{3})|"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|[(\[{]|[)\]}]""")
OPENS = re.compile(r"(?:async\s+def|def|class|import|from)\b|@")
DECLARES = re.compile(r"\b(?:import|def|class)\b")
CONTINUES = re.compile(r"(?:elif|else|except|finally|case)\b|[)\]}#]")


def top_blocks(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, line after the last) of the top-level blocks of a text that may be broken.

    A block starts at a line without indentation, outside of brackets and long strings. What opens a definition starts one
    inside brackets too, since some bracket before it was never closed; a long string that never ends is taken as opened by
    mistake. Decorators belong to what follows, ``else`` and its like to what is before.
    """
    starts: list[int] = []
    depth, quote, opened, i = 0, "", 0, 0
    while i < len(lines):
        line = lines[i]
        first = line[:1]
        if not quote and first and not first.isspace():
            if depth and OPENS.match(line):
                depth = 0
            decorated = bool(starts) and lines[starts[-1]].startswith("@") and all(x[:1] in ("@", "#", "") or x[:1].isspace() for x in lines[starts[-1] : i])
            if not depth and not CONTINUES.match(line) and not decorated:
                starts.append(i)
        at = 0
        while at < len(line):
            if quote:
                end = line.find(quote, at)
                if end < 0:
                    break
                at, quote = end + 3, ""
                continue
            found = QUOTED.search(line, at)
            if not found:
                break
            at = found.end()
            if found.group(1):
                quote, opened = found.group(1), i
            elif found.group() in "([{":
                depth += 1
            elif found.group() in ")]}":
                depth = max(depth - 1, 0)
        i += 1
        if i == len(lines) and quote:
            i, quote, depth = opened + 1, "", 0
            starts = [s for s in starts if s <= opened]
    return list(zip(starts, [*starts[1:], len(lines)]))


def readable_nodes(lines: list[str]) -> list[ast.stmt]:
    """The statements of all top-level blocks that declare or import something and parse by themselves, at their own lines."""
    nodes: list[ast.stmt] = []
    for start, end in top_blocks(lines):
        block = "\n".join(lines[start:end])
        if not DECLARES.search(block):
            continue  # a line of prose is a block too, and most of such a file
        try:
            body = ast.parse(block).body
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
        for node in body:
            ast.increment_lineno(node, start)
        nodes += body
    return nodes


def parse(text: str, wanted: Sequence[str] = PARTS) -> dict:
    """Units, calls, bases and imports of one text, as far as ``wanted``, and the number of units. A text with a syntax error gives the error, and what its sound blocks hold."""
    result: dict = {"units": [], "calls": [], "bases": [], "imports": [], "error": None, "n_chunks": 0}
    try:
        nodes = ast.parse(text).body
    except SyntaxError as error:
        result["error"] = f"SyntaxError: {error}"
        nodes = readable_nodes(text.split("\n"))
    except (ValueError, RecursionError, MemoryError) as error:
        return result | {"error": f"{type(error).__name__}: {error}"}
    lines = text.split("\n")
    chunks, calls = "chunks" in wanted, "calls" in wanted

    def add(node: ast.AST, kind: str, parent: str | None) -> None:
        result["n_chunks"] += 1
        if chunks:
            result["units"].append(unit(node, kind, parent, lines))
        if calls and kind != "class":
            result["calls"] += call_sites(node, f"{parent}.{node.name}" if parent else node.name)

    for node in nodes:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            if chunks:
                result["imports"].append(ast.unparse(node))
        elif isinstance(node, FUNCTIONS):
            add(node, "function", None)
        elif isinstance(node, ast.ClassDef):
            add(node, "class", None)
            if "bases" in wanted:
                result["bases"] += base_classes(node)
            for member in node.body:
                if isinstance(member, FUNCTIONS):
                    add(member, "method", node.name)
    return result


def parse_python(files: DataFrame, wanted: Sequence[str] = PARTS) -> DataFrame:
    """One row per file (columns repo_name, file_path, content) with chunks, calls and bases, as far as ``wanted``, and an error, if any."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                parsed = [parse(t, wanted) for t in some.column("content").to_pylist()]
                found = [pa.array([p[name] for p in parsed], schema.field(name).type) for name in schema.names[3:]]
                own = some.columns if "chunks" in wanted else [*some.columns[:2], pa.nulls(some.num_rows, pa.string())]  # only chunks hold texts
                yield pa.RecordBatch.from_arrays([*own, *found], schema=schema)

    texts = files.select(*[F.col(c).cast("string").alias(c) for c in ("repo_name", "file_path", "content")])
    schema = to_arrow_schema(texts.sparkSession.createDataFrame([], PARSED).schema)
    parsed = texts.mapInArrow(read, PARSED)
    lines = F.split("content", "\n")

    def chunk(u):
        route_ = F.when(
            u["route_method"].isNotNull(),
            F.struct(u["route_method"].alias("method"), u["route_path"].alias("path"), F.lit(None).cast("string").alias("framework"), u["start_line"].alias("line"), F.lit(None).cast("boolean").alias("is_mount")),
        )
        meta = F.struct(
            route_.alias("route"), F.lit(None).cast("array<struct<name:string,type:string,injection_type:string>>").alias("dependencies"),
            F.lit(None).cast("array<struct<method:string,url:string>>").alias("outgoing_api_calls"),
            F.lit(None).cast("boolean").alias("is_react_component"), F.lit(None).cast("string").alias("props_interface"),
        ).cast(as_struct(METADATA))
        return F.struct(
            names.short_hash(F.col("repo_name"), F.col("file_path"), u["name"], u["chunk_type"], u["start_line"]).alias("id"),
            F.col("repo_name"), F.col("file_path"), u["start_line"].alias("start_line"), u["end_line"].alias("end_line"), u["chunk_type"].alias("chunk_type"),
            u["name"].alias("name"), F.array_join(F.slice(lines, u["start_line"], u["end_line"] - u["start_line"] + 1), "\n").alias("content"),
            u["signature"].alias("signature"), u["docstring"].alias("docstring"), u["parent_name"].alias("parent_name"),
            F.when(u["parent_name"].isNotNull(), "class").alias("parent_type"), F.lit("python").alias("language"), F.col("imports"),
            meta.alias("metadata"), F.lit(None).cast("string").alias("summary"),
        )

    chunks = F.transform("units", chunk) if "chunks" in wanted else F.lit(None).cast(f"array<{as_struct(CHUNK)}>")
    return parsed.select("repo_name", "file_path", chunks.alias("chunks"), "calls", "bases", "error", "n_chunks")
