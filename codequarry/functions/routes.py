"""Route paths as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import names

# one segment in any of the parameter notations
TEMPLATE, CURLY, COLON, ANGLE = r"\$\{([^}]+)\}", r"\{([^}]+)\}", r":([a-zA-Z_][a-zA-Z0-9_]*)", r"<([^>]+)>"
API_PREFIX = r"^/api(/v\d+)?(?=/|$|\?)"


def base_and_path(url: Column) -> tuple[Column, Column]:
    """Scheme, host and API prefix apart from the rest.

    The prefix ends at a segment boundary, so ``/apikeys`` keeps its name.
    """
    absolute = url.rlike("^https?://")
    host = F.regexp_extract(url, r"^(https?://[^/?#]*)", 1)
    rest = F.when(absolute, F.regexp_replace(F.regexp_replace(url, r"^https?://[^/?#]*", ""), r"[?#].*$", "")).otherwise(url)
    prefix = F.regexp_extract(rest, API_PREFIX.replace("^/api", "^(/api").replace("(?=", ")(?="), 1)
    remaining = F.substr(rest, F.length(prefix) + 1)
    base = F.concat(F.when(absolute, host).otherwise(""), prefix)
    return F.nullif(base, F.lit("")), F.when(remaining == "", "/").otherwise(remaining)


def query_names(path: Column) -> Column:
    """Names before ``=`` in the query string, in order, each once."""
    query = F.when(F.contains(path, F.lit("?")), F.regexp_extract(path, r"\?(.*)$", 1))
    names_found = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    return F.coalesce(F.array_distinct(F.filter(names_found, lambda n: n != "")), F.array().cast("array<string>"))


def segment(raw: Column) -> Column:
    """``{x:int}``, ``:x``, ``${x}`` and ``<x>`` become ``{x}``; a static segment is lower-cased."""

    def name(value: Column) -> Column:
        return F.trim(F.substring_index(value, ":", 1))

    def braces(value: Column) -> Column:
        return F.concat(F.lit("{"), name(value), F.lit("}"))

    def replaced(notation: str) -> Column:
        return F.regexp_replace(raw, notation, r"{$1}")

    return (
        F.when(raw.rlike(f"^{TEMPLATE}$"), braces(F.regexp_extract(raw, TEMPLATE, 1)))
        .when(raw.rlike(f"^{CURLY}$"), braces(F.regexp_extract(raw, CURLY, 1)))
        .when(raw.rlike(TEMPLATE), replaced(TEMPLATE))
        .when(raw.rlike(CURLY), raw)
        .when(raw.rlike(COLON), replaced(COLON))
        .when(raw.rlike(ANGLE), F.regexp_replace(raw, ANGLE, r"{$1}"))
        .otherwise(F.lower(raw))
    )


def segments(path: Column) -> Column:
    """Normalized segments of a path without its query."""
    plain = F.regexp_replace(F.substring_index(path, "?", 1), r"(?i)(?<=[{<][^}>/]{1,100}):(int|str|string|path|uuid|float)\b", "")
    return F.transform(F.filter(F.split(plain, "/"), lambda s: s != ""), segment)


def is_parameter(value: Column) -> Column:
    return F.startswith(value, F.lit("{")) & F.endswith(value, F.lit("}"))


def path_pattern(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def canonical(parts: Column) -> Column:
    """The pattern with every parameter written ``{}``."""
    return path_pattern(F.transform(parts, lambda s: F.when(is_parameter(s), "{}").otherwise(F.lower(s))))


def parameters(parts: Column) -> Column:
    """Path parameters with their 0-based positions."""
    indexed = F.transform(parts, lambda s, i: F.struct(s.alias("segment"), i.alias("position")))
    return F.transform(
        F.filter(indexed, lambda x: is_parameter(x["segment"])),
        lambda x: F.struct(
            F.regexp_replace(x["segment"], r"^\{|\}$", "").alias("name"),
            x["position"].alias("position"),
            F.lit("path").alias("source"),
            F.lit(None).cast("string").alias("type_hint"),
            F.lit(True).alias("required"),
        ),
    )


def static_segments(parts: Column) -> Column:
    indexed = F.transform(parts, lambda s, i: F.struct(i.alias("position"), s.alias("segment")))
    return F.filter(indexed, lambda x: ~is_parameter(x["segment"]))


def normalized(url: Column, method: Column, framework: Column | None = None) -> Column:
    """The whole normalized route as one struct."""
    url = F.trim(url)
    base, path = base_and_path(url)
    parts = segments(path)
    empty = url.isNull() | (url == "")
    return F.struct(
        F.upper(method).alias("method"),
        F.when(empty, "/").otherwise(path_pattern(parts)).alias("path_pattern"),
        F.when(empty, F.array().cast("array<string>")).otherwise(parts).alias("path_segments"),
        parameters(F.when(empty, F.array().cast("array<string>")).otherwise(parts)).alias("parameters"),
        base.alias("base_path"),
        query_names(path).alias("query_params"),
        (framework if framework is not None else F.lit(None).cast("string")).alias("framework"),
        F.when(empty, "/").otherwise(url).alias("original_path"),
    )


def same_structure(left: Column, right: Column) -> Column:
    """Equal static segments at equal positions, parameters elsewhere, whatever their names."""
    return canonical(left) == canonical(right)


def paths_match(left: Column, right: Column, strict: bool = False) -> Column:
    """Two segment arrays could serve one request; ``strict`` also compares parameter names."""

    def same(pair: Column) -> Column:
        a, b = pair["0"], pair["1"]
        both_static = ~is_parameter(a) & ~is_parameter(b)
        both_named = is_parameter(a) & is_parameter(b)
        result = F.when(both_static, F.lower(a) == F.lower(b))
        if strict:
            result = result.when(both_named, names.same_parameter_name(F.trim(F.translate(a, "{}", "")), F.trim(F.translate(b, "{}", ""))))
        return result.otherwise(True)

    pairs = F.zip_with(left, right, lambda a, b: F.struct(a.alias("0"), b.alias("1")))
    return (F.size(left) == F.size(right)) & F.forall(pairs, same)


def match_scores(call_segments: Column, endpoint_segments: Column, same_repo: Column, endpoint_language: Column) -> Column:
    """Partial scores and their weighted sum, for two routes that share method and canonical path.

    A shared canonical path means equal static segments and parameters at equal positions,
    so only the names and the context can differ.
    """
    call_names = F.transform(F.filter(call_segments, is_parameter), lambda s: F.translate(s, "{}", ""))
    endpoint_names = F.transform(F.filter(endpoint_segments, is_parameter), lambda s: F.translate(s, "{}", ""))
    equal = F.zip_with(call_names, endpoint_names, lambda a, b: F.when(names.same_parameter_name(a, b), 1).otherwise(0))
    hits = F.aggregate(equal, F.lit(0), lambda acc, x: acc + x)
    name_score = F.when(F.size(endpoint_names) == 0, 1.0).otherwise(hits / F.size(endpoint_names))
    context = F.least(
        F.lit(1.0),
        F.lit(0.5)
        + F.when(same_repo, 0.3).otherwise(0.0)
        + F.when(F.lower(endpoint_language).isin(*fixed.ROUTE_LANGUAGES), 0.2).otherwise(0.0),
    )
    weight = fixed.ROUTE_WEIGHTS
    total = F.lit(1.0) * weight["path"] + F.lit(1.0) * weight["position"] + name_score * weight["name"] + context * weight["context"]
    return F.struct(
        F.lit(1.0).alias("path_structure"),
        F.lit(1.0).alias("param_position"),
        name_score.alias("param_name"),
        context.alias("context"),
        total.alias("confidence"),
    )
