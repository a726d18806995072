"""Regular expressions and globs as Spark columns.

``pattern()`` asks the JVM for Unicode word classes and ``\\n``-only line ends,
so a pattern means on Spark what it means in most scripting languages.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def pattern(regex: str, flags: str = "") -> Column:
    """Literal regex with Unicode classes and Unix lines; ``flags`` such as ``i`` or ``m`` are added."""
    needs_unicode = any(token in regex for token in (r"\b", r"\w", r"\s", r"\W", r"\d"))
    needs_lines = "." in regex or "$" in regex or "^" in regex
    prefix = flags + ("U" if needs_unicode else "") + ("d" if needs_lines else "")
    return F.lit(f"(?{prefix}){regex}" if prefix else regex)


def count(text: Column, regex: str, flags: str = "") -> Column:
    return F.regexp_count(text, pattern(regex, flags))


def find_all(text: Column, regex: str, group: int = 0, flags: str = "") -> Column:
    return F.regexp_extract_all(text, pattern(regex, flags), F.lit(group))


def matches(text: Column, regex: str, flags: str = "") -> Column:
    return F.regexp_like(text, pattern(regex, flags))


def quote(text: str) -> str:
    """``text`` as a regex that matches it literally."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", text)


def glob_regex(glob: str) -> str:
    """A shell glob as an anchored Java regex (``*`` also crosses ``/``)."""
    translated = fnmatch.translate(glob)  # (?s:...)\Z
    return "^" + re.sub(r"\\[zZ]$", "$", translated).replace("(?>", "(?:").rstrip("$") + "$"


# every character that counts as white space at the ends of a text
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITE_SPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_contains(text: Column, words: list[str]) -> Column:
    result = F.lit(False)
    for word in words:
        result = result | F.contains(text, F.lit(word))
    return result


def any_prefix(text: Column, words: list[str]) -> Column:
    result = F.lit(False)
    for word in words:
        result = result | F.startswith(text, F.lit(word))
    return result


def any_suffix(text: Column, words: list[str]) -> Column:
    result = F.lit(False)
    for word in words:
        result = result | F.endswith(text, F.lit(word))
    return result
