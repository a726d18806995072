"""Best-fit packing of token pieces by large-item matching.

Lengths are whole numbers up to the capacity, so a packing depends only on how many pieces have each length: a
histogram of at most ``capacity`` rows, whatever the corpus. The driver plans on that histogram in runs of equal bins,
and tasks look up the place of each piece from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codequarry.llm.caches import cache, claim
from codequarry.llm.common import id_and_text
from codequarry.llm.tokens import CACHED_CHARS, CACHED_UNITS, PLAIN, SIGNS, in_byte_batches, in_byte_letters, is_single, loaded
from codequarry.session import cut

WORD = re.compile(r"[^ \t-\r]+")
PART = re.compile(rf"{PLAIN}|[^ \t-\r]+")
#: length, first rank, pieces in each bin, bins, first bin, first offset
RUN_FIELDS = 6
_ENCODERS: dict[str, Words] = cache("packing")


class Words(dict):
    """Ids of words as bytes. A word not known is encoded when it is first asked for: texts meet the table once for each word.

    Short words are remembered: at most two generations of ``bound`` words, and those of one batch.
    """

    def __init__(self, tokenizer, bound: int = CACHED_UNITS):
        super().__init__()
        self.tokenizer, self.bound = tokenizer, bound
        self.tokenize = tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encoded(word)
        if len(word) <= CACHED_CHARS:
            self[word] = ids
        return ids

    def encoded(self, word: str) -> bytes:
        """A word of lower-case ASCII letters is one pre-token, and one sign behind it another; others are looked at part by part."""
        if word.isascii():
            if word.isalpha() and word.islower():
                return array("I", [t.id for t in self.tokenize(word)]).tobytes()
            stem, sign = word[:-1], word[-1]
            if sign in SIGNS and stem.isalpha() and stem.islower():
                if sign not in self.signs:
                    self.signs[sign] = self.by_parts(sign)
                return (self.get(stem) or array("I", [t.id for t in self.tokenize(stem)]).tobytes()) + self.signs[sign]
        return self.by_parts(word)

    def by_parts(self, word: str) -> bytes:
        if "\u0130" in word:  # its lower case ends in a mark, which joins signs behind it
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        ids: list[int] = []
        for p in PART.findall(word):
            # lower-case letters in normal form or signs alone are one pre-token: it goes straight to the merges
            if is_single(p) and p == p.lower() and (p.isascii() or is_normalized("NFC", p)):
                ids += [t.id for t in self.tokenize(in_byte_letters(p))]
            else:
                ids += self.tokenizer.encode(p, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def turn(self) -> None:
        """The older generation goes when the present one is full."""
        if len(self) > self.bound:
            self.older = dict(self)
            self.clear()


def encoder(name: str) -> Callable[[list[str]], list[list[bytes]]]:
    """Ids by words: the tokenizer drops white space, lower-cases and joins nothing across white space."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Words(loaded(name))
    known = _ENCODERS[name]

    def ids(texts: list[str]) -> list[list[bytes]]:
        known.turn()
        # lower case is the tokenizer's own; done first, it lets words meet. Special strings and final sigmas are left alone.
        lower = (t if "<|" in t or "\u03a3" in t else t.lower() for t in texts)
        return [list(map(known.__getitem__, t.split() if not any(c in t for c in "\x1c\x1d\x1e\x1f") else WORD.findall(t))) for t in lower]

    return ids


def pieces(docs: DataFrame, tokenizer: str, capacity: int, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): a document's ids, then the separator, cut where longer than the capacity."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        encode, end, width = encoder(tokenizer), np.array([separator], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            ids = iter(batch.column("doc_id").to_pylist())
            for texts in in_byte_batches(batch.column("text").to_pylist()):
                rows: list[tuple] = []
                for found in encode(texts):
                    doc_id, data = next(ids), b"".join(found) + end
                    for k, at in enumerate(range(0, len(data), width)):
                        part = data[at : at + width]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: 5 + with_ids])
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names[: 5 + with_ids])

    return id_and_text(docs).mapInArrow(cut_up, schema)


class Gaps:
    """Groups of bins by the room left: {gap: [(first bin, bins)]}."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.order: list[int] = []

    def put(self, gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in self.by:
                self.by[gap] = []
                insort(self.order, gap)
            self.by[gap].append((first, bins))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A group with the smallest gap of at least ``least``."""
        at = bisect_left(self.order, least)
        if at == len(self.order):
            return None
        gap = self.order[at]
        first, bins = self.by[gap].pop()
        if not self.by[gap]:
            del self.by[gap]
            self.order.pop(at)
        return gap, first, bins


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (see RUN_FIELDS) that place every piece of the histogram, and the number of bins.

    Pieces above a third of the capacity: the longest left pairs with the longest that fits beside it, at most two to a
    bin; no other pairing needs fewer bins for them. The others, from the longest down, go to the smallest gap that
    takes them, and open new bins where none does.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, ...]] = []
    gaps, bins = Gaps(), 0

    def place(length: int, each: int, count: int, first: int, offset: int) -> None:
        runs.append((length, used[length], each, count, first, offset))
        used[length] += each * count
        left[length] -= each * count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        at = bisect_left(large, capacity - longest + 1) - 1
        if at < 0:
            count = left[longest]
            place(longest, 1, count, bins, 0)
            gaps.put(capacity - longest, bins, count)
        elif large[at] == longest and left[longest] >= 2:
            count = left[longest] // 2
            place(longest, 2, count, bins, 0)
            gaps.put(capacity - 2 * longest, bins, count)
        elif large[at] == longest:
            if at == 0:
                count = 1
                place(longest, 1, 1, bins, 0)
                gaps.put(capacity - longest, bins, 1)
            else:
                count, partner = 1, large[at - 1]
                place(longest, 1, 1, bins, 0)
                place(partner, 1, 1, bins, longest)
                gaps.put(capacity - longest - partner, bins, 1)
        else:
            partner = large[at]
            count = min(left[longest], left[partner])
            place(longest, 1, count, bins, 0)
            place(partner, 1, count, bins, longest)
            gaps.put(capacity - longest - partner, bins, count)
        bins += count
        large = [n for n in large if left[n]]
    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            group = gaps.take(length)
            if group is None:
                each = capacity // length
                group = capacity, bins, -(-left[length] // each)
                bins += group[2]
            gap, first, count = group
            each = min(gap // length, left[length])
            full = min(count, left[length] // each)
            place(length, each, full, first, capacity - gap)
            gaps.put(gap - each * length, first, full)
            gaps.put(gap, first + full, count - full)
    return np.array(runs, dtype=np.int64).reshape(-1, RUN_FIELDS), bins


def ranked(cut_pieces: DataFrame, salts: int) -> DataFrame:
    """Each piece's rank among the pieces of its length, from 0, without one task for a frequent length."""
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("inside", inside).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("salt", "inside", "before")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian, four bytes each) if asked for.

    A document is its ids and then ``separator``; null and empty texts are the separator alone. Only documents longer
    than ``capacity`` are cut. Sequences fill without gaps from offset 0. Repeated rows are documents of their own;
    ties of length go by a hash of the id, then id and piece; null ids are packed too; other columns are ignored.
    """
    spark = docs.sparkSession
    table = cut(pieces(docs, tokenizer, capacity, separator, with_ids))
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs, _ = plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])
    plain = [f for f in table.columns]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        span = np.int64(1) << 50  # above any rank
        starts = runs[:, 0] * span + runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = runs[np.searchsorted(starts, length * span + rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f) for f in plain), pa.array(run[:, 4] + nth // run[:, 2]), pa.array(run[:, 5] + nth % run[:, 2] * length)],
                [*plain, "sequence_id", "offset"],
            )

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema) + ", sequence_id long, offset long"
    return ranked(table, salts).select(*plain, "rank").mapInArrow(placed, schema)
