"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may differ from a passage in at most k = floor(n * error) word edits. Cut into k + 1 pieces, at
least one piece then occurs unchanged in the passage. Exact piece hits are found by hash on all words of all documents;
around each hit Myers' bit-parallel distance decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm import packets as pk, words
from codequarry.llm.common import id_and_text

#: Bytes of test items sent to the tasks at a time; a larger benchmark takes several passes over the documents.
BLOCK_BYTES = 32 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Everything in ASCII but letters and digits parts words.
_PARTS = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
_FACTOR = 0x9FB21C651E98DF25


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return words.hashed(data, _PARTS)


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros(max(len(hashes) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        total += hashes[k : k + len(total)] * np.uint64(pow(_FACTOR, k + 1, 1 << 64))
    return pk.mix(total)


class Items:
    """Test items of a block: their words, and pieces of each length by hash."""

    def __init__(self, items: list[tuple[int, str]], error_percent: int, min_words: int):
        self.ids, self.masks, self.lengths, self.budgets = [], [], [], []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            found, _ = _word_hashes((text or "").encode())
            n = len(found)
            if n < min_words:
                continue
            k = n * error_percent // 100
            width = n // (k + 1)
            masks: dict[int, int] = {}
            for i, w in enumerate(found.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
            number = len(self.ids)
            self.ids.append(item_id)
            self.masks.append(masks)
            self.lengths.append(n)
            self.budgets.append(k)
            rolled = _rolled(found, width).tolist()
            for j in range(k + 1):
                at = j * n // (k + 1)
                pieces.setdefault(width, []).append((rolled[at], number, at))
        self.pieces = {}
        for width, found in pieces.items():
            found.sort()
            keys, number, at = zip(*found)
            self.pieces[width] = np.array(keys, dtype=np.uint64), np.array(number), np.array(at)


def myers(masks: dict[int, int], length: int, text: list[int]) -> tuple[int, int]:
    """(smallest edit distance between the pattern and any part of the text, where the first such part ends)."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    pv, mv, score, best, end = full, 0, length, length, 0
    for i, word in enumerate(text, 1):
        eq = masks.get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, i
    return best, end


def _matches(hashes: np.ndarray, counts: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item number, distance, first word, end word) of the best passage for each text and item."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for width, (keys, number, at) in items.pieces.items():
        rolled = _rolled(hashes, width)
        low = np.searchsorted(keys, rolled)
        hit = np.flatnonzero((keys[np.minimum(low, len(keys) - 1)] == rolled))
        hit = hit[owner[hit] == owner[hit + width - 1]]
        for place, at_key in zip(hit.tolist(), low[hit].tolist()):
            doc = int(owner[place])
            while at_key < len(keys) and keys[at_key] == rolled[place]:
                item, k, n = int(number[at_key]), items.budgets[int(number[at_key])], items.lengths[int(number[at_key])]
                start = place - int(at[at_key])
                begin, end = max(int(first[doc]), start - k), min(int(first[doc] + counts[doc]), start + n + k)
                spans.setdefault((doc, item), []).append((begin, end))
                at_key += 1
    for (doc, item), found in spans.items():
        found.sort()
        merged: list[list[int]] = []
        for begin, end in found:
            if merged and begin <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([begin, end])
        masks, n = items.masks[item], items.lengths[item]
        best = None
        for begin, end in merged:
            text = hashes[begin:end].tolist()
            distance, stop = myers(masks, n, text)
            if distance <= items.budgets[item] and (best is None or distance < best[0]):
                back = {w: int(bin(m | 1 << n)[3:][::-1], 2) for w, m in masks.items()}  # the pattern read backwards
                _, length = myers(back, n, text[:stop][::-1])
                best = distance, begin + stop - length - int(first[doc]), begin + stop - int(first[doc])
        if best:
            yield doc, item, *best


def item_blocks(items: DataFrame, error_percent: int, min_words: int) -> Iterator[Items]:
    """The items in blocks of about BLOCK_BYTES, so that what tasks are sent stays bounded."""
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).head()[0]
    blocks = max(1, -(-2 * size // BLOCK_BYTES))
    numbered = plain.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        yield Items([(r["item_id"], r["text"]) for r in numbered.filter(F.col("block") == block).collect()], error_percent, min_words)


def leaks(docs: DataFrame, items: DataFrame, error_percent: int = 20, min_words: int = 8) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, distance (word edits), budget, start, end.

    Words are runs of letters and digits (anything beyond ASCII counts as a letter), A-Z lower-cased. Whole texts and whole
    items are read; the best passage counts, the first of equals, and ``start``/``end`` are its code points. An item with
    fewer than ``min_words`` words says too little to tell a leak from chance and matches nothing, so do null and empty
    items and texts. Repeated rows of items count once; repeated rows of documents give repeated rows; null ids stay null.
    Other columns are ignored. There is no shuffle; items are sent to tasks in blocks of bounded size.
    """
    base, spark, out = id_and_text(docs), docs.sparkSession, None
    schema = "doc_id long, item_id long, distance int, budget int, start long, end long"
    for block in item_blocks(items, error_percent, min_words):
        shared = spark.sparkContext.broadcast(block)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                texts, ids, rows = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), []
                for numbers, hashes, counts in words.grouped(texts, _PARTS):
                    for doc, item, distance, start, end in _matches(hashes, counts, items):
                        data = texts[numbers.start + doc].encode()
                        found = [m.span() for m in _WORD.finditer(data)]
                        a, b = found[start][0], found[end - 1][1]
                        from_char = len(data[:a].decode())
                        rows.append((ids[numbers.start + doc], items.ids[item], distance, items.budgets[item], from_char, from_char + len(data[a:b].decode())))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "distance", "budget", "start", "end"])

        found = base.mapInArrow(searched, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, error_percent: int = 20, min_words: int = 8) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no test item is found. Map-only, as ``leaks``."""
    spark = docs.sparkSession
    for block in item_blocks(items, error_percent, min_words):
        shared = spark.sparkContext.broadcast(block)

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                keep = np.ones(len(texts), dtype=bool)
                for numbers, hashes, counts in words.grouped(texts, _PARTS):
                    for doc, *_ in _matches(hashes, counts, items):
                        keep[numbers.start + doc] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs
