"""Columns over identifiers, paths and chunk texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import regex as rx


def qualified_name(parent: Column, name: Column) -> Column:
    """``parent.name``; an empty parent counts as none."""
    return F.concat_ws(".", F.nullif(parent, F.lit("")), name)


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 over the ``:``-joined parts."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16)


def words(name: Column) -> Column:
    """Lower-case words of a snake_case or camelCase identifier."""
    split = F.when(F.contains(name, F.lit("_")), F.split(name, "_")).otherwise(rx.find_all(name, fixed.CAMEL_WORD))
    return F.transform(F.filter(split, lambda w: w != ""), lambda w: F.lower(w))


def keywords(name: Column) -> Column:
    """Words that carry meaning: longer than one letter and no stop word."""
    stop = F.array(*[F.lit(w) for w in fixed.NAME_STOP_WORDS])
    return F.filter(words(name), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def purpose(chunk_type: Column, name: Column, parent: Column) -> Column:
    found = F.array_join(keywords(name), " ")
    readable = F.when(found == "", name).otherwise(found)
    parent = F.nullif(parent, F.lit(""))
    return (
        F.when(chunk_type == "function", F.concat(F.lit("Function that handles "), readable))
        .when(chunk_type == "method", F.concat(F.lit("Method for "), readable, F.coalesce(F.concat(F.lit(" in "), parent), F.lit(""))))
        .when(chunk_type == "class", F.concat(F.lit("Class representing "), readable))
        .when(chunk_type == "interface", F.concat(F.lit("Interface defining "), readable))
        .when(chunk_type == "constructor", F.concat(F.lit("Constructor for "), F.coalesce(parent, readable)))
        .when(chunk_type == "module", F.concat(F.lit("Module containing "), readable))
        .when(chunk_type == "property", F.concat(F.lit("Property "), readable, F.coalesce(F.concat(F.lit(" of "), parent), F.lit(""))))
        .when(chunk_type == "constant", F.concat(F.lit("Constant "), readable))
        .when(chunk_type == "import", F.concat(F.lit("Import statement for "), readable))
        .otherwise(F.concat(chunk_type, F.lit(" "), readable))
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """Base name without its last suffix (a leading dot is part of the name)."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def embedding_text(
    chunk_type: Column, name: Column, parent: Column, docstring: Column, signature: Column, summary: Column,
    file_path: Column, language: Column, content: Column, cut: bool = False,
) -> Column:
    """The text an embedding model reads for one chunk: the whole code, or with ``cut`` the first 1,500 and last 400 characters of code over 2,000."""

    def labelled(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), F.nullif(value, F.lit("")))

    code = content if not cut else F.when(
        F.length(content) > 2000,
        F.concat(F.substring(content, 1, 1500), F.lit("\n... (truncated) ...\n"), F.right(content, F.lit(400))),
    ).otherwise(content)
    return F.concat_ws(
        "\n",
        purpose(chunk_type, name, parent),
        F.when(docstring != "", F.concat(F.lit("Description: "), rx.strip(docstring))),
        labelled("Signature: ", signature),
        labelled("Summary: ", summary),
        labelled("Keywords: ", F.array_join(keywords(name), " ")),
        F.concat(F.lit("File: "), file_name(file_path)),
        F.concat(F.lit("Language: "), language),
        F.concat(F.lit("Code:\n"), code),
    )


def snake_case(name: Column) -> Column:
    split = F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2")
    split = F.regexp_replace(split, "([a-z0-9])([A-Z])", "$1_$2")
    return F.translate(F.lower(split), "-", "_")


def same_parameter_name(left: Column, right: Column) -> Column:
    """``userId`` equals ``user_id`` equals ``USERID``."""
    return (F.lower(left) == F.lower(right)) | (snake_case(left) == snake_case(right))


def module_name(path: Column) -> Column:
    """Dotted module of a file: below a source root, without package files, last three parts."""
    slashed = F.translate(path, "\\", "/")
    below = slashed
    for root in reversed(fixed.MODULE_ROOTS):
        position = F.instr(slashed, root)
        below = F.when(position > 0, F.substr(slashed, position + len(root))).otherwise(below)
    bare = F.regexp_replace(below, r"\.[^.]*$", "")
    parts = F.filter(F.split(bare, "/"), lambda p: ~p.isin("__init__", "index"))
    last = F.when(F.size(parts) > 3, F.slice(parts, -3, 3)).otherwise(parts)
    return F.when((path.isNull()) | (path == ""), F.lit("unknown")).otherwise(F.array_join(last, "."))


def node_id(name: Column) -> Column:
    """A name usable as a diagram node: separators become ``_``, angle brackets vanish."""
    plain = F.translate(name, "./- <>", "____")
    return F.when(plain.rlike(r"^\d"), F.concat(F.lit("_"), plain)).otherwise(plain)


def language_of(path: Column) -> Column:
    result = F.lit(None).cast("string")
    for extension, language in reversed(list(fixed.LANGUAGE_BY_EXTENSION.items())):
        result = F.when(F.endswith(path, F.lit(extension)), language).otherwise(result)
    return result


def redact(secret: Column) -> Column:
    return F.when(F.length(secret) <= 8, F.concat(F.substring(secret, 1, 2), F.lit("***"))).otherwise(
        F.concat(F.substring(secret, 1, 4), F.lit("..."), F.right(secret, F.lit(4)))
    )


def confidence_marker(score: Column, high: float = 0.7) -> Column:
    return F.when(score >= high, "high").when(score >= 0.5, "medium").otherwise("low")


def line_context(line: Column, position: Column, width: int = 80) -> Column:
    """A trimmed line, cut to ``width`` around the 0-based ``position`` of a match."""
    text = rx.strip(line)
    half = width // 2
    return (
        F.when(F.length(text) <= width, text)
        .when(position < half, F.concat(F.substring(text, 1, width - 3), F.lit("...")))
        .when(position > F.length(text) - half, F.concat(F.lit("..."), F.right(text, F.lit(width - 3))))
        .otherwise(F.concat(F.lit("..."), F.substr(text, position - half + 1, F.lit(2 * half)), F.lit("...")))
    )
