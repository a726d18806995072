"""Java, TypeScript and JavaScript files to chunks, calls and base classes.

A lexer reads each file inside its row, in Arrow batches: declarations, calls, comments. What they mean (routes, injected
fields, components, ids) is columns. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codequarry.functions import names, regex as rx
from codequarry.schema import BASE_CLASS, CALL_SITE, CHUNK, METADATA, PARTS, as_struct
from codequarry.sources import brace_lexer

FILE = ["repo_name", "file_path"]
UNITS = as_struct(
    "i int, end int, kind string, name string, parent_name string, parent_type string, parent_line int, header string, signature string, annotations string, docstring string, body string, own string"
)
READ = f"repo_name string, file_path string, language string, content string, units array<{UNITS}>, calls array<{as_struct(CALL_SITE)}>"


def units(files: DataFrame, wanted: Sequence[str] = PARTS) -> DataFrame:
    """Each file with its declarations and calls, as far as ``wanted``; a file is read inside its row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # some files at a time: a file's declarations repeat its text once for every level of nesting
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                found = [brace_lexer.file_units(t, l, wanted) for t, l in zip(some.column("content").to_pylist(), some.column("language").to_pylist())]
                own = some.columns if "chunks" in wanted else [*some.columns[:3], pa.nulls(some.num_rows, pa.string())]  # only chunks read whole texts again
                yield pa.RecordBatch.from_arrays([*own, pa.array([u for u, _ in found], schema.field("units").type), pa.array([c for _, c in found], schema.field("calls").type)], schema=schema)

    texts = files.select(*[F.col(c).cast("string").alias(c) for c in (*FILE, "language", "content")])
    schema = to_arrow_schema(texts.sparkSession.createDataFrame([], READ).schema)
    return texts.mapInArrow(read, READ)


def _first(text: Column, regex: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, regex, group), F.lit(""))


def _mapping(annotations: Column) -> tuple[Column, Column]:
    """Verb and path of a Spring mapping annotation."""
    regex = r"@(Get|Post|Put|Delete|Request)Mapping(?:\(([^)]*)\))?"
    kind, arguments = _first(annotations, regex), F.regexp_extract(annotations, regex, 2)
    verb = F.when(kind == "Request", F.coalesce(_first(arguments, r"method\s*=\s*\{?\s*(?:RequestMethod\.)?(\w+)"), F.lit("GET"))).otherwise(F.upper(kind))
    return verb, F.regexp_extract(arguments, r'"([^"]*)"', 1)


def _nest(annotations: Column) -> tuple[Column, Column]:
    regex = r"@(Get|Post|Put|Delete|Patch|Options|Head|All)\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?[^)]*\)"
    kind = _first(annotations, regex)
    return F.when(kind == "All", "GET").otherwise(F.upper(kind)), F.regexp_extract(annotations, regex, 2)


def _joined_path(*parts: Column) -> Column:
    pieces = F.filter(F.split(F.concat_ws("/", *parts), "/"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(pieces, "/"))


def _handlers(whole: Column) -> Column:
    """Express registrations of a file: verb, path and the handler named last."""
    variable = r"(?:app|router|server|[A-Za-z_$][\w$]*(?:[Rr]outer|[Aa]pp|[Aa]pi))"
    regex = rf"\b({variable})\.(get|post|put|delete|patch|options|head|all)\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,(?:[^;{{}}]*?,)?\s*(\w+)\s*\)"
    found = F.regexp_extract_all(whole, F.lit(regex), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.upper(F.regexp_extract(m, regex, 2)).alias("method"), F.regexp_extract(m, regex, 3).alias("path"), F.regexp_extract(m, regex, 4).alias("handler")))


OUTGOING = r"([A-Za-z_$][\w$]*(?:\.[\w$]+)*)\s*(?:<[^<>()]*>)?\(\s*[\"'`]([^\"'`]+)[\"'`](?:\s*,\s*\{[^}]*?\bmethod\s*:\s*[\"'`](\w+)[\"'`])?"


def _outgoing(body: Column) -> Column:
    """HTTP calls of a function body with verb and address."""
    found = F.transform(F.regexp_extract_all(body, F.lit(OUTGOING), F.lit(0)), lambda m: F.struct(*[F.regexp_extract(m, OUTGOING, g).alias(str(g)) for g in (1, 2, 3)]))

    def verb(z: Column) -> Column:
        name, last = z["1"], F.lower(F.substring_index(z["1"], ".", -1))
        return F.when(name == "fetch", F.coalesce(F.upper(F.nullif(z["3"], F.lit(""))), F.lit("GET"))).when(
            F.contains(name, F.lit(".")) & last.isin("get", "post", "put", "delete", "patch"), F.upper(last)
        )

    calls = F.transform(found, lambda z: F.struct(verb(z).alias("method"), F.regexp_replace(z["2"], r"\$\{([^}]+)\}", r"{$1}").alias("url")))
    return F.filter(calls, lambda c: c["method"].isNotNull())


def _unless_empty(array: Column) -> Column:
    return rx.let(array, lambda a: F.when(F.size(a) > 0, a))


def parse_braces(files: DataFrame, wanted: Sequence[str] = PARTS) -> DataFrame:
    """One row per file (columns repo_name, file_path, content, language) with chunks, calls and bases, as far as ``wanted``. With
    dependencies and no chunks, chunks are the classes with their dependencies only."""
    detailed = units(files, wanted).withColumn("raw", F.split("content", "\n"))
    java = F.col("language") == "java"
    detailed = detailed.withColumn("handlers", F.when(~java, _handlers(F.col("content"))).otherwise(_handlers(F.lit("")))).withColumn(
        "imports", F.filter(F.transform("raw", lambda l: rx.strip(l)), lambda l: F.startswith(l, F.lit("import ")))
    )

    def chunk(u: Column) -> Column:
        def build(p: Column) -> Column:
            spring_verb, spring_path = _mapping(u["annotations"])
            nest_verb, nest_path = _nest(u["annotations"])
            base = F.when(p["annotations"].isNotNull(), _mapping(p["annotations"])[1])
            controller = _first(p["annotations"], r"@Controller\(\s*[\"'`]([^\"'`]*)[\"'`]")
            own_controller = F.regexp_extract(u["annotations"], r"@Controller\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?", 1)
            is_controller = ~java & u["annotations"].rlike(r"@Controller\(") & (u["kind"] == "class")
            handled = F.get(F.filter("handlers", lambda h: h["handler"] == u["name"]), F.lit(0))
            member = u["kind"].isin("method", "constructor")
            method = (
                F.when(java & member, spring_verb).when(~java & member, nest_verb).when(is_controller, F.lit("CONTROLLER"))
                .when(~java & (u["kind"] == "function"), handled["method"])
            )
            path = (
                F.when(java, _joined_path(base, spring_path)).when(~java & member, _joined_path(controller, nest_path)).when(is_controller, own_controller).otherwise(handled["path"])
            )
            framework = F.when(java, F.lit(None).cast("string")).when(member | is_controller, "nestjs").otherwise("express")
            route = rx.let(method, lambda m: F.when(m.isNotNull(), F.struct(m.alias("method"), path.alias("path"), framework.alias("framework"), (u["i"] + 1).alias("line"), F.lit(None).cast("boolean").alias("is_mount"))))
            function = ~java & u["kind"].isin("function", "method")
            jsx = rx.matches(u["own"], r"(return|=>)\s*\(?\s*<(>|[A-Za-z])")
            typed = F.get(F.col("raw"), u["i"]).rlike(r":\s*(React\.)?(FC|FunctionComponent)\b")
            react = function & u["name"].rlike("^[A-Z]") & (jsx | typed)
            props = F.coalesce(
                _first(F.get(F.col("raw"), u["i"]), r"(?:FC|FunctionComponent)<([^>]+)>"), _first(u["signature"], r"\(\s*(?:\{[^}]*\}|\w+)\s*\??:\s*([A-Za-z_]\w*)")
            )
            component = rx.let(react, lambda r: F.when(r, F.struct(F.lit(True).alias("is"), props.alias("props"))))
            dependencies = F.when(java & (u["kind"] == "class"), _unless_empty(_dependencies(u)))
            outgoing = F.when(function, _unless_empty(_outgoing(u["own"])))
            meta = rx.let(component, lambda c: F.struct(
                route.alias("route"), dependencies.alias("dependencies"), outgoing.alias("outgoing_api_calls"), c["is"].alias("is_react_component"), c["props"].alias("props_interface"),
            ).cast(as_struct(METADATA)))
            kind = F.when(u["kind"] == "alias", "class").otherwise(u["kind"])
            parent = F.when(member | u["kind"].isin("class", "interface"), u["parent_name"])
            return F.struct(
                names.short_hash(F.col("repo_name"), F.col("file_path"), u["name"], kind, u["i"] + 1).alias("id"),
                F.col("repo_name"), F.col("file_path"), (u["i"] + 1).cast("int").alias("start_line"), (u["end"] + 1).cast("int").alias("end_line"), kind.alias("chunk_type"),
                u["name"].alias("name"), u["body"].alias("content"), F.when(u["kind"].isin("function", "method", "constructor"), F.nullif(u["signature"], F.lit(""))).alias("signature"),
                u["docstring"].alias("docstring"), parent.alias("parent_name"), F.when(parent.isNotNull(), u["parent_type"]).alias("parent_type"), F.col("language"), F.col("imports"),
                meta.alias("metadata"), F.lit(None).cast("string").alias("summary"),
            )

        parent_unit = F.get(F.filter("units", lambda o: (o["i"] == u["parent_line"]) & (o["name"] == u["parent_name"])), F.lit(0))
        return rx.let(F.struct(parent_unit["annotations"].alias("annotations")), build)

    def bases(u: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(u["header"], r"<[^<>]*>", ""), r"<[^<>]*>", "")
        lists = [("extends", r"(?s)\bextends\s+(.*?)(?=\bimplements\b|$(?![\s\S]))"), ("implements", r"(?s)\bimplements\s+(.*)$")]

        def relation(kind: str, regex: str) -> Column:
            listed = F.filter(F.transform(F.split(F.regexp_extract(plain, regex, 1), ","), rx.strip), lambda n: n != "")
            return F.transform(listed, lambda n: F.struct(u["name"].alias("child_name"), u["name"].alias("child_qualified"), n.alias("parent_name"), F.lit(kind).alias("relation_type"), (u["i"] + 1).cast("int").alias("line_number")))

        return F.concat(*[relation(*l) for l in lists])

    types = F.filter("units", lambda u: u["kind"].isin("class", "interface"))
    def dependent(u: Column) -> Column:
        id_ = names.short_hash(F.col("repo_name"), F.col("file_path"), u["name"], u["kind"], u["i"] + 1)
        meta = F.struct(_unless_empty(_dependencies(u)).alias("dependencies"))
        return F.struct(id_.alias("id"), F.col("repo_name"), u["name"].alias("name"), meta.alias("metadata"))

    if "chunks" in wanted:
        chunks = F.transform("units", chunk)
    elif "dependencies" in wanted:
        chunks = F.transform(F.filter("units", lambda u: java & (u["kind"] == "class")), dependent)
    else:
        chunks = F.lit(None).cast(f"array<{as_struct(CHUNK)}>")
    found = F.flatten(F.transform(types, bases)) if "bases" in wanted else F.lit(None).cast(f"array<{as_struct(BASE_CLASS)}>")
    return detailed.select(
        *FILE, chunks.alias("chunks"), "calls",
        found.alias("bases"), F.lit(None).cast("string").alias("error"), F.size("units").alias("n_chunks"),
    )


STEREOTYPES = r"@(Component|Service|Repository|Controller|RestController|Configuration)\b"


def _dependencies(u: Column) -> Column:
    """Injected fields of a class, and the constructor parameters of a stereotyped one."""
    field = r"@(?:Autowired|Inject)\b\s*(?:(?:private|protected|public|final|static)\s+)*([\w.]+(?:<[^;=]*>)?)\s+(\w+)\s*[;=]"
    fields = F.transform(F.regexp_extract_all(u["own"], F.lit(field), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, field, 1).alias("0"), F.regexp_extract(m, field, 2).alias("1")))
    built = F.call_function("regexp_extract", u["own"], F.concat(F.lit(r"(?:public|protected|private|\n)\s+"), u["name"], F.lit(r"\s*\(([^)]*)\)\s*(?:throws[^{]*)?\{")), F.lit(1))
    parameter = r"(?:final\s+)?([\w.]+(?:<[^,)]*>)?)\s+(\w+)\s*(?:,|$)"
    listed = F.when(u["annotations"].rlike(STEREOTYPES), built).otherwise("")
    parameters = rx.let(listed, lambda text: F.arrays_zip(*[F.regexp_extract_all(text, F.lit(parameter), F.lit(g)) for g in (1, 2)]))

    def entry(kind: str):
        return lambda z: F.struct(z["1"].alias("name"), z["0"].alias("type"), F.lit(kind).alias("injection_type"))

    return F.concat(F.transform(fields, entry("field")), F.transform(parameters, entry("constructor")))
