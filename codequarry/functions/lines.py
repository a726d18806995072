"""Regex matches with their positions, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codequarry.functions import regex as rx


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


PLACES = "array<struct<line:int,column:int,matched:string>>"


def located(text: Column, regex: str, flags: str = "") -> Column:
    """All matches in order: ``array<struct<line, column, matched>>``, both 0-based."""
    compiled = rx.pattern(regex, flags)
    none = F.array().cast(PLACES)
    zero = F.struct(F.lit(0).alias("line"), F.lit(0).alias("column"), none.alias("out"))

    def moved(line: Column, column: Column, piece: Column) -> tuple[Column, Column]:
        """Place after a piece of text."""
        breaks, tail = newlines(piece), F.length(F.substring_index(piece, "\n", -1))
        return (line + breaks).cast("int"), F.when(breaks > 0, tail).otherwise(column + tail).cast("int")

    def step(acc: Column, pair: Column) -> Column:
        def add(at: Column) -> Column:
            line, column = moved(at["line"], at["column"], pair["matched"])
            here = F.struct(at["line"].alias("line"), at["column"].alias("column"), pair["matched"].alias("matched"))
            return F.struct(line.alias("line"), column.alias("column"), F.concat(acc["out"], F.array(here)).alias("out"))

        line, column = moved(acc["line"], acc["column"], pair["gap"])
        return rx.let(F.struct(line.alias("line"), column.alias("column")), add)

    def walk(found: Column) -> Column:
        # the text after the last match has no partner and is left out
        gaps = F.slice(F.split(text, compiled), 1, F.size(found))
        pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("matched")))
        return F.when(F.size(found) == 0, none).otherwise(F.aggregate(pairs, zero, step, lambda acc: acc["out"]))

    return rx.let(F.regexp_extract_all(text, compiled, F.lit(0)), walk)
