"""Code metrics as columns over (code, language)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import regex as rx

C_STYLE = ["java", "typescript", "javascript"]


def _by_language(language: Column, python: Column, java: Column, typescript: Column) -> Column:
    return F.when(language == "java", java).when(language.isin("typescript", "javascript"), typescript).otherwise(python)


def cyclomatic(code: Column, language: Column) -> Column:
    """One plus the number of decision points; one statement may count under several patterns."""

    def total(patterns: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [rx.count(code, p) for p in patterns], F.lit(1))

    points = fixed.DECISION_POINTS
    return _by_language(language, total(points["python"]), total(points["java"]), total(points["typescript"]))


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(rx.lstrip(line))


def _is_code(line: Column) -> Column:
    return rx.let(rx.lstrip(line), lambda s: (s != "") & ~rx.any_prefix(s, ["#", "//", "/*", "*"]))


def cognitive(code: Column, language: Column) -> Column:
    """Struct of complexity, deepest nesting and the nesting penalties; nesting is indentation by four."""
    python = ~language.isin(*C_STYLE)

    def measure(line: Column, base: Column) -> Column:
        flow = F.when(python, rx.matches(line, r"^\s*(if|elif|for|while|except|with)\b")).otherwise(
            rx.matches(line, r"^\s*(if|else\s+if|for|while|catch|switch)\s*[\({]")
        )
        boolean = F.when(python, rx.matches(line, r"^\s*(and|or)\b").cast("int")).otherwise(
            F.regexp_count(line, F.lit(r"&&|\|\|"))
        )
        nesting = F.greatest(F.lit(0), F.floor((_indent(line) - base) / 4).cast("int"))
        return F.struct(nesting.alias("nesting"), flow.alias("flow"), boolean.alias("boolean"))

    def step(acc: Column, line: Column) -> Column:
        def add(m: Column) -> Column:
            penalty = F.when(m["flow"] & (m["nesting"] > 1), m["nesting"] - 1).otherwise(0)
            points = F.when(m["flow"], 1 + penalty).otherwise(m["boolean"])
            return F.struct(
                acc["base"].alias("base"),
                (acc["complexity"] + points).cast("int").alias("complexity"),
                F.greatest(acc["nesting_depth_max"], m["nesting"]).alias("nesting_depth_max"),
                (acc["nested_penalties"] + penalty).cast("int").alias("nested_penalties"),
            )

        return rx.let(measure(line, acc["base"]), add)

    def fold(lines: Column) -> Column:
        zero = F.struct(
            F.coalesce(_indent(F.get(lines, F.lit(0))), F.lit(0)).alias("base"),
            F.lit(0).alias("complexity"), F.lit(0).alias("nesting_depth_max"), F.lit(0).alias("nested_penalties"),
        )
        return F.aggregate(lines, zero, step, lambda acc: F.struct(
            acc["complexity"].alias("complexity"), acc["nesting_depth_max"].alias("nesting_depth_max"), acc["nested_penalties"].alias("nested_penalties")
        ))

    return rx.let(F.filter(F.split(code, "\n"), _is_code), fold)


def line_counts(code: Column, language: Column) -> Column:
    """Struct of total, source, comment and blank lines and the comment ratio.

    Each line is classified once; the fold then only tracks whether a block comment is open.
    """
    python = ~language.isin(*C_STYLE)
    double, single = '"""', "'''"

    def classify(s: Column) -> Column:
        quoted = python & (F.startswith(s, F.lit(double)) | F.startswith(s, F.lit(single)))
        closed_at_once = (F.regexp_count(s, F.lit(double)) >= 2) | (F.regexp_count(s, F.lit(single)) >= 2)
        return (
            F.when(s == "", "blank")
            .when(quoted, F.when(closed_at_once, "quoted once").otherwise("quoted"))
            .when(~python & F.contains(s, F.lit("*/")), "closes")
            .when(~python & F.contains(s, F.lit("/*")), "opens")
            .when(rx.any_prefix(s, ["#", "//"]), "comment")
            .otherwise("source")
        )

    def step(acc: Column, line: Column) -> Column:
        inside = acc["inside"]
        plain = ~inside & line.isin("blank", "comment", "source")
        after = (
            F.when(line == "quoted", ~inside).when(line == "quoted once", F.lit(False)).when(line == "closes", F.lit(False))
            .when(line == "opens", F.lit(True)).otherwise(inside)
        )
        return F.struct(
            after.alias("inside"),
            (acc["source"] + (plain & (line == "source")).cast("int")).alias("source"),
            (acc["blank"] + (plain & (line == "blank")).cast("int")).alias("blank"),
        )

    def finish(kinds: Column) -> Column:
        zero = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("source"), F.lit(0).alias("blank"))
        total = F.size(kinds)

        def result(acc: Column) -> Column:
            comment = total - acc["source"] - acc["blank"]
            return F.struct(
                total.alias("total_lines"),
                acc["source"].alias("source_lines"),
                comment.alias("comment_lines"),
                acc["blank"].alias("blank_lines"),
                F.when(acc["source"] > 0, F.bround(comment / acc["source"], 3)).otherwise(0.0).alias("comment_ratio"),
            )

        return F.aggregate(kinds, zero, step, result)

    return rx.let(F.transform(F.split(code, "\n"), lambda l: rx.let(rx.strip(l), classify)), finish)


def halstead(code: Column, language: Column) -> Column:
    """Struct of Halstead counts, volume, difficulty and effort (rounded to two digits)."""

    def tokens(patterns: list[str]) -> Column:
        return F.concat(*[rx.find_all(code, p) for p in patterns])

    operators = F.when(language.isin(*C_STYLE), tokens(fixed.HALSTEAD_OPERATORS["other"])).otherwise(
        tokens(fixed.HALSTEAD_OPERATORS["python"])
    )
    operands = tokens(fixed.HALSTEAD_OPERANDS)

    def figures(t: Column) -> Column:
        n1, n2, big_n1, big_n2 = t["n1"], t["n2"], t["big_n1"], t["big_n2"]
        volume = (big_n1 + big_n2) * F.log2((n1 + n2).cast("double"))
        difficulty = (n1 / 2) * (big_n2 / n2)
        return F.struct(
            n1.alias("distinct_operators"),
            n2.alias("distinct_operands"),
            big_n1.alias("total_operators"),
            big_n2.alias("total_operands"),
            (n1 + n2).alias("vocabulary"),
            (big_n1 + big_n2).alias("length"),
            F.bround(volume, 2).alias("volume"),
            F.bround(difficulty, 2).alias("difficulty"),
            F.bround(difficulty * volume, 2).alias("effort"),
        )

    def sizes(t: Column) -> Column:
        return F.struct(
            F.size(F.array_distinct(t["operators"])).alias("n1"),
            F.greatest(F.size(F.array_distinct(t["operands"])), F.lit(1)).alias("n2"),
            F.size(t["operators"]).alias("big_n1"),
            F.size(t["operands"]).alias("big_n2"),
        )

    counted = rx.let(F.struct(operators.alias("operators"), operands.alias("operands")), sizes)
    return rx.let(counted, figures)


def split_arguments(text: Column, openers: str = "[<(", closers: str = "]>)") -> Column:
    """Split at commas outside brackets; pieces are trimmed and empty ones dropped.

    Commas at depth zero are found by a running bracket depth over the characters.
    """
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("marked"))
    marked = F.aggregate(
        characters,
        zero,
        lambda acc, c: F.struct(
            (acc["depth"] + F.when(F.instr(F.lit(openers), c) > 0, 1).when(F.instr(F.lit(closers), c) > 0, -1).otherwise(0)).alias("depth"),
            F.concat(acc["marked"], F.when((c == ",") & (acc["depth"] == 0), F.lit("\u0001")).otherwise(c)).alias("marked"),
        ),
        lambda acc: acc["marked"],
    )
    return F.filter(F.transform(F.split(marked, "\u0001"), rx.strip), lambda p: p != "")


def parameter_count(code: Column, language: Column) -> Column:
    python = r"def\s+\w+\s*\(([^)]*)\)"
    other = r"\w\s*\(([^)]*)\)"  # the first parenthesis after a word, whatever modifiers precede it
    text = F.when(language == "python", F.regexp_extract(code, "(?U)" + python, 1)).otherwise(
        F.regexp_extract(code, "(?U)" + other, 1)
    )
    parts = split_arguments(text)
    counted = F.when(language == "python", F.filter(parts, lambda p: ~p.isin("self", "cls"))).otherwise(parts)
    return F.when(rx.strip(text) == "", 0).otherwise(F.size(counted))


def cyclomatic_rating(value: Column) -> Column:
    return F.when(value <= 5, "low").when(value <= 10, "moderate").when(value <= 20, "high").otherwise("very_high")


def cognitive_rating(value: Column) -> Column:
    return F.when(value <= 5, "low").when(value <= 15, "moderate").when(value <= 25, "high").otherwise("very_high")


def maintainability(volume: Column, complexity: Column, lines: Column) -> Column:
    return F.greatest(
        F.lit(0.0),
        (171 - 5.2 * F.ln(F.greatest(volume, F.lit(1.0))) - 0.23 * complexity - 16.2 * F.ln(F.greatest(lines, F.lit(1.0)))) * 100 / 171,
    )
