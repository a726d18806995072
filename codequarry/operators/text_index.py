"""A word index: stored postings sorted by token, a small query language evaluated as joins on them, BM25 order.

A search reads the postings of the tokens it names: equality and prefix ranges reach the scan, and files are ranges of
tokens. What joins afterwards are rows with their positions, never texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codequarry.operators.symbols import tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
NEAR_BY_DEFAULT = 10
LEXEME = re.compile(r'\s*(?:("(?:[^"]|"")*"\*?)|(NEAR\s*\()|([():,])|([^\s():,"]+))')


@dataclass
class Phrase:
    """Words in a row; with ``prefix`` the last one may go on. ``column`` narrows it to one field."""

    words: list[str]
    prefix: bool = False
    column: str | None = None


@dataclass
class Near:
    phrases: list[Phrase]
    within: int


@dataclass
class Node:
    operator: str  # AND, OR, NOT
    parts: list


class Parser:
    """``a b`` and ``a AND b``, ``OR``, ``NOT`` (binds closest), brackets, ``"a phrase"``, ``pre*``, ``field:term``, ``NEAR(a b, n)``."""

    def __init__(self, query: str):
        self.items = [m.groups() for m in LEXEME.finditer(query) if any(m.groups())]
        self.at = 0

    def parse(self):
        node = self._either()
        if self.at < len(self.items):
            raise ValueError("the query has a bracket or a comma too many")
        return node

    def _sign(self) -> str | None:
        return next((x for x in self.items[self.at] if x), None) if self.at < len(self.items) else None

    def _take(self, wanted: str) -> bool:
        found = self._sign() == wanted
        self.at += found
        return found

    def _either(self):
        parts = [self._all()]
        while self._take("OR"):
            parts.append(self._all())
        return parts[0] if len(parts) == 1 else Node("OR", parts)

    def _all(self):
        parts = [self._without()]
        while self._sign() not in (None, ")", "OR", ","):
            self._take("AND")
            parts.append(self._without())
        return parts[0] if len(parts) == 1 else Node("AND", parts)

    def _without(self):
        node = self._one()
        while self._take("NOT"):
            node = Node("NOT", [node, self._one()])
        return node

    def _one(self, column: str | None = None):
        if self.at >= len(self.items):
            raise ValueError("the query ends where a term is expected")
        quoted, near, sign, word = self.items[self.at]
        self.at += 1
        if near:
            phrases, within = [], NEAR_BY_DEFAULT
            while not self._take(")"):
                if self._take(","):
                    within = int(self._sign() or 0)
                    self.at += 1
                else:
                    phrases.append(self._one(column))
            return Near(phrases, within)
        if sign == "(":
            node = self._either()
            if not self._take(")"):
                raise ValueError("a bracket is never closed")
            return node
        if sign:
            raise ValueError(f"{sign} stands where a term is expected")
        if word and self._take(":"):
            return self._one(word)
        text = quoted or word
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        return Phrase(words, text.endswith("*"), column)


@dataclass
class TextIndex:
    """``postings``: token, field, ``key``, positions; ``sizes``: ``key``, n (tokens of all fields)."""

    spark: SparkSession
    root: str
    key: str
    fields: list[str] = field(default_factory=list)

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/postings")

    @property
    def sizes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/sizes")

    @classmethod
    def build(cls, table: DataFrame, root: str, key: str, fields: list[str]) -> TextIndex:
        """Index the fields of a table with one row per key. A key's positions in a field are one posting per token."""
        index = cls(table.sparkSession, root.rstrip("/"), key, fields)
        each = table.select(key, *[F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")).alias(f) for f in fields])
        total = reduce(lambda a, b: a + b, [F.size(f) for f in fields])
        each.select(key, total.alias("n")).write.mode("overwrite").parquet(f"{index.root}/sizes")
        placed = reduce(DataFrame.unionByName, [each.select(key, F.lit(f).alias("field"), F.posexplode(f).alias("position", "token")) for f in fields])
        rows = placed.groupBy("token", "field", key).agg(F.sort_array(F.collect_list("position")).alias("positions"))
        # the key spreads a token that many rows hold over several files
        laid_out = rows.repartitionByRange("token", key).sortWithinPartitions("token", key)
        laid_out.write.mode("overwrite").option("parquet.bloom.filter.enabled#token", "true").parquet(f"{index.root}/postings")
        return index

    # ---- leaves -----------------------------------------------------------------------

    def _word(self, word: str, prefix: bool, column: str | None) -> DataFrame:
        rows = self.postings
        rows = rows.where((F.col("token") >= word) & (F.col("token") < word + "\U0010ffff")) if prefix else rows.where(F.col("token") == word)
        return rows if column is None else rows.where(F.col("field") == column)

    def _found(self, phrase: Phrase) -> DataFrame:
        """(key, field, positions) where a phrase begins."""
        if phrase.column is not None and phrase.column not in self.fields:
            raise ValueError(f"no such field: {phrase.column}")
        if not phrase.words:
            return self.postings.where("false").select(self.key, "field", "positions")
        parts = []
        for i, word in enumerate(phrase.words):
            rows = self._word(word, phrase.prefix and i == len(phrase.words) - 1, phrase.column)
            # tokens that begin alike each have their postings
            rows = rows.groupBy(self.key, "field").agg(F.flatten(F.collect_list("positions")).alias("positions"))
            parts.append(rows.select(self.key, "field", F.transform("positions", lambda p: p - i).alias(f"p{i}")))
        joined = reduce(lambda a, b: a.join(b, [self.key, "field"]), parts)
        starts = reduce(F.array_intersect, [F.col(f"p{i}") for i in range(len(parts))])
        return joined.select(self.key, "field", starts.alias("positions")).where(F.size("positions") > 0)

    def _near(self, near: Near) -> DataFrame:
        parts = [self._found(p).withColumnRenamed("positions", f"p{i}") for i, p in enumerate(near.phrases)]
        joined = reduce(lambda a, b: a.join(b, [self.key, "field"]), parts)

        def first(i: int) -> Column:
            """Whether all other phrases begin at or after phrase i and soon enough after its end."""
            def follows(x: Column) -> Column:
                reach = x + len(near.phrases[i].words) + near.within
                return reduce(lambda a, b: a & b, [F.exists(f"p{j}", lambda y: (y >= x) & (y <= reach)) for j in range(len(parts)) if j != i], F.lit(True))

            return F.exists(f"p{i}", follows)

        return joined.where(reduce(lambda a, b: a | b, [first(i) for i in range(len(parts))])).select(self.key).distinct()

    def _matching(self, node) -> DataFrame:
        if isinstance(node, Phrase):
            return self._found(node).select(self.key).distinct()
        if isinstance(node, Near):
            return self._near(node)
        parts = [self._matching(p) for p in node.parts]
        if node.operator == "OR":
            return reduce(DataFrame.union, parts).distinct()
        return reduce(lambda a, b: a.join(b, self.key, "left_anti" if node.operator == "NOT" else "left_semi"), parts)

    # ---- search -----------------------------------------------------------------------

    def search(self, query: str) -> DataFrame:
        """(key, score): rows that match, scored by BM25 over the phrases that the query asks for."""
        tree = Parser(query).parse()
        leaves = asked(tree)
        each = [
            self._found(p).groupBy(self.key).agg(F.sum(F.size("positions")).alias("f")).withColumn("leaf", F.lit(i)) for i, p in enumerate(leaves)
        ]
        counts = reduce(DataFrame.unionByName, each)
        totals = self.sizes.agg(F.count("*").alias("rows"), F.avg("n").alias("mean")).first()
        held = {r["leaf"]: r["n"] for r in counts.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row per phrase
        idf = F.lit(0.0)
        for i in range(len(leaves)):
            n = held.get(i, 0)
            idf = F.when(F.col("leaf") == i, max(math.log((totals["rows"] - n + 0.5) / (n + 0.5)), LEAST_IDF)).otherwise(idf)
        rows = counts.join(self._matching(tree), self.key, "left_semi").join(self.sizes, self.key)
        weight = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / F.lit(totals["mean"] or 1.0)))
        return rows.groupBy(self.key).agg(F.sum(idf * weight).alias("score"))


def asked(node) -> list[Phrase]:
    """The phrases of a query but for those it excludes."""
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return node.phrases
    parts = node.parts[:1] if node.operator == "NOT" else node.parts
    return [p for part in parts for p in asked(part)]


def indexed_search(table: DataFrame, index: TextIndex, query: str, limit: int | None = 50, **equal: str | None) -> DataFrame:
    """Rows of the indexed table with their score, best first (ties: by key)."""
    for column, value in equal.items():
        table = table if value is None else table.where(F.col(column) == value)
    found = table.join(index.search(query), index.key).orderBy(F.col("score").desc(), index.key)
    return found if limit is None else found.limit(limit)
