"""Spelling variants: words one edit apart, found as equal pairs of trie nodes.

A prefix is a node of the trie of all words, a suffix a node of the trie of all words reversed. Leaving out position i of
a word gives the pair (node of what is before i, node of what is after i). Two words that differ in one letter share the
pair that skips it; a word with one letter more shares, where it skips that letter, the pair that the shorter word has
between two positions. Letters come from a fixed alphabet, so a pair belongs to few words, however many words there are.

Nodes are numbered by 64-bit hashes of their paths, so no task needs a whole trie; a pair is 128 bits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm import packets as pk
from codequarry.llm.common import buckets_for
from codequarry.llm.words import powers
from codequarry.session import cut

FLUSH_WORDS = 200_000
FLUSH_PAIRS = 2_000_000
GAP, SKIP, LATER_SKIP = 0, 1, 2  # LATER_SKIP: the letter before is the same, so skipping it gives the same word again
_FORWARD = pk.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BACKWARD = pk.mix(np.arange(301, 557, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def runs_of(text: str, least: int) -> list[str]:
    """Maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of ``least`` code points or more, A-Z lower-cased."""
    return re.findall(rf"[a-zÀ-ÿ]{{{least},}}", text.encode().lower().decode())


def word_counts(docs: DataFrame, least: int, every: int) -> DataFrame:
    """(word, n) of all words, after one letter of every ``every``-th occurrence is left out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        crc = zlib.crc32
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                start = crc(f"{'' if doc_id is None else doc_id}:".encode())
                for run in runs_of(text.as_py() or "", least):
                    h = crc(run.encode(), start)
                    if h % every:
                        found[run] += 1
                    elif len(run) > least:
                        at = h % len(run)
                        found[run[:at] + run[at + 1 :]] += 1
                if len(found) > FLUSH_WORDS:
                    yield flush()
        if found:
            yield flush()

    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(counted, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def node_pairs(words: list[str]) -> tuple[np.ndarray, ...]:
    """(number of the word, forward node, backward node, kind) of every position skipped and every gap between positions."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    b = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    up, down = powers(len(b) + 1)
    total, back = np.zeros(len(b) + 1, dtype=np.uint64), np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_FORWARD[b] * down[:-1], out=total[1:])
    np.cumsum(_BACKWARD[b] * down[:-1], out=back[1:])

    def before(word: np.ndarray, at: np.ndarray) -> np.ndarray:
        return pk.mix((total[at] - total[begins[word]]) * up[begins[word]] + (at - begins[word]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def after(word: np.ndarray, at: np.ndarray) -> np.ndarray:
        return pk.mix((back[ends[word]] - back[at]) * up[at] + (ends[word] - at).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    skip = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(b))
    again = np.append(False, b[1:] == b[:-1]) & (at > begins[skip])
    gap = np.repeat(np.arange(len(words)), lengths + 1)
    between = np.arange(len(gap)) - gap
    return (
        np.concatenate([skip, gap]), np.concatenate([before(skip, at), before(gap, between)]), np.concatenate([after(skip, at + 1), after(gap, between)]),
        np.concatenate([np.where(again, LATER_SKIP, SKIP), np.full(len(gap), GAP)]).astype(np.uint8),
    )


def _pair_packets(words: DataFrame, parts: int) -> DataFrame:
    """Pairs of trie nodes with their words, by pair."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, texts = batch.column("id").to_numpy(), batch.column("n").to_numpy(), batch.column("word").to_pylist()
            cells = np.cumsum([2 * len(t) + 1 for t in texts]) // FLUSH_PAIRS
            for cell in np.unique(cells):
                own = np.flatnonzero(cells == cell)
                word, front, rear, kind = node_pairs([texts[i] for i in own])
                key = pk.mix(front + rear * np.uint64(0x9FB21C651E98DF25))
                order = np.argsort(key, kind="stable")
                key, front, word, kind = key[order], front[order], own[word[order]], kind[order]

                def payload(part: slice) -> bytes:
                    who, rank = np.unique(word[part], return_inverse=True)
                    return pk.pack(pk.steps(key[part]), front[part], rank.astype(np.uint32), ids[who], n[who], kind[part])

                yield pk.cut_parts(key, parts, payload)

    return words.mapInArrow(send, pk.SCHEMA)


NEAR = "id long, n_near long, best_n long, best_id long"


def _neighbours(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
    """What each word learns from the pairs of one part: how many near words, and the most frequent of them."""
    found = [pk.unpack(x) for x in payloads]
    payloads.clear()
    key = np.concatenate([np.cumsum(f[0]) for f in found])
    front = np.concatenate([f[1] for f in found])
    ids = np.concatenate([f[3][f[2]] for f in found])
    n = np.concatenate([f[4][f[2]] for f in found])
    kind = np.concatenate([f[5] for f in found])
    del found
    order = np.lexsort((ids, -n, front, key))
    key, front, ids, n, kind = key[order], front[order], ids[order], n[order], kind[order]
    group = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (front[1:] != front[:-1]))) - 1
    many = (np.bincount(group) > 1)[group]
    group, ids, n, kind = np.unique(group[many], return_inverse=True)[1], ids[many], n[many], kind[many]
    if not len(group):
        return
    groups = int(group[-1]) + 1
    found = []

    def told(to: np.ndarray, how_many: np.ndarray, best: np.ndarray) -> None:
        found.append((ids[to], how_many, n[best], ids[best]))

    def firsts(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the members each group has, and where its first one is."""
        size = np.bincount(group[members], minlength=groups)
        return size, np.append(members, 0)[np.minimum(np.cumsum(size) - size, len(members))]

    skips, firm, gaps = np.flatnonzero(kind != GAP), np.flatnonzero(kind == SKIP), np.flatnonzero(kind == GAP)
    size, first = firsts(skips)
    rank = np.arange(len(skips)) - (np.cumsum(size) - size)[group[skips]]
    to = skips[size[group[skips]] > 1]
    second = np.full(groups, 0)
    second[group[skips[rank == 1]]] = skips[rank == 1]
    told(to, size[group[to]] - 1, np.where(first[group[to]] == to, second[group[to]], first[group[to]]))
    size, first = firsts(firm)
    to = gaps[size[group[gaps]] > 0]
    told(to, size[group[to]], first[group[to]])
    size, first = firsts(gaps)
    to = firm[size[group[firm]] > 0]
    told(to, size[group[to]], first[group[to]])
    word, how_many, best_n, best = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((best, -best_n, word))
    word, how_many, best_n, best = word[order], how_many[order], best_n[order], best[order]
    new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(word[new]), pa.array(np.add.reduceat(how_many, new).astype(np.int64)), pa.array(best_n[new]), pa.array(best[new])], ["id", "n_near", "best_n", "best_id"],
    ) if len(word) else pa.RecordBatch.from_pylist([], pa.schema([(c, pa.int64()) for c in ("id", "n_near", "best_n", "best_id")]))


def variants(docs: DataFrame, least: int = 7, min_count: int = 2, ratio: int = 10, every: int = 31) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of Latin letters of whole texts (null: none), A-Z lower-cased; where ``every`` divides the crc32 of
    ``doc_id:run``, the letter it names is left out first. Words have ``least`` code points and ``min_count`` occurrences
    at least. Near words differ by one letter inserted, left out or replaced: n_near is their number. form is the near
    word of largest count (ties: the smallest by code points) if that is ``ratio`` times the word's own, else null; root
    follows forms to the last one. Repeated rows count as often as they occur; a null id counts as the empty string; other
    columns are ignored; an empty table gives no rows. Words of any length take part.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    parts = buckets_for(docs)
    counts = word_counts(docs, least, every).filter(F.col("n") >= min_count)
    # ranges of words in order, so that smaller numbers are smaller words
    words = cut(counts.repartitionByRange(parts, "word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id()))
    told = pk.exchanged(_pair_packets(words, parts), parts, _neighbours, NEAR)
    best = F.max(F.struct("best_n", (-F.col("best_id")).alias("order"))).alias("best")
    near = told.groupBy("id").agg(F.sum("n_near").alias("n_near"), best).select("id", "n_near", F.col("best.best_n").alias("best_n"), (-F.col("best.order")).alias("best_id"))
    is_form = F.col("best_n") >= F.col("n") * ratio
    table = cut(
        words.select("id", "n").join(near, "id", "left").select(
            "id", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_id")).alias("form_id"), F.when(is_form, F.col("best_n")).alias("form_n"),
        )
    )
    names = words.select(F.col("id").alias("of"), F.col("word").alias("name"))
    roots = followed(table.filter("form_id IS NOT NULL").select("id", F.col("form_id").alias("root_id")))
    forms = table.filter("form_id IS NOT NULL").select("id", "form_id").join(roots, "id")
    forms = forms.join(names, F.col("form_id") == F.col("of")).drop("of").withColumnRenamed("name", "form")
    forms = forms.join(names, F.col("root_id") == F.col("of")).select("id", "form", F.col("name").alias("root"))
    out = words.select("id", "word").join(table.select("id", "n", "n_near", "form_n"), "id").join(forms, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def followed(links: DataFrame) -> DataFrame:
    """(id, root_id) with links followed to their ends: each round doubles the steps taken. Links never close a circle."""
    while True:
        on = links.select(F.col("id").alias("via"), F.col("root_id").alias("end"))
        further = links.join(on, F.col("root_id") == F.col("via"), "left")
        links = cut(further.select("id", F.coalesce("end", "root_id").alias("root_id"), F.col("end").isNotNull().alias("moved")))
        if links.filter("moved").isEmpty():
            return links.select("id", "root_id")
