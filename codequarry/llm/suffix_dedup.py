"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A suffix matters only through its first ``threshold`` bytes (its window). Digits are read in passes, and a suffix drops
out as soon as no other document shares its group. The first digit is a landmark: the smallest hashed gram inside the
window. Equal windows have equal landmarks at equal places, and neighbouring windows mostly share theirs, so one row
stands for a run of windows. Suffixes whose landmark another document has are sent on with their bytes; eight bytes at
a time then split the groups, and what is equal after the last pass are exactly the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm import packets as pk
from codequarry.llm.common import buckets_for, id_and_text
from codequarry.session import cut

PIECE = 60_000
FLUSH = 1_500_000
_BASE = 0xD6E8FEB86659FD93
_VALUE = pk.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_size(threshold: int) -> int:
    return max(1, threshold // 2 - 1)


def grams(b: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on."""
    h, width, out, done = _VALUE[b], 1, None, 0
    while True:
        if size & width:
            # bytes [0, done) are in ``out``; append this block after them
            out = h if out is None else out[: len(h) - done] * np.uint64(pow(_BASE, width, 1 << 64)) + h[done:]
            done += width
        if width * 2 > size:
            break
        h = h[: len(h) - width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    return pk.mix(out)


def landmarks(pieces: list[bytes], threshold: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one landmark, over pieces of at most 65,536 bytes in all: (piece, first window, last window,
    place of the landmark, its 48-bit hash), places counted in the piece."""
    size = gram_size(threshold)
    span = threshold - size + 1
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    b = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    counts = np.maximum(lengths - threshold + 1, 0)
    owner = np.repeat(np.arange(len(pieces)), counts)
    if not len(owner):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    s = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    h = grams(b, size)
    low = h & ~np.uint64(0xFFFF) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = span - step
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    v = low[s]
    new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.append(new[1:], len(v)) - 1
    piece = owner[new]
    at = begins[piece]
    # smallest hashes crowd near zero, so they are hashed once more before they deal rows to parts
    return piece, s[new] - at, s[last] - at, (v[new] & np.uint64(0xFFFF)).astype(np.int64) - at, pk.mix(v[new] >> np.uint64(16)) >> np.uint64(16)


def in_pieces(texts: list[tuple[int, bytes]], threshold: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of (document, offset, piece) of at most 65,536 bytes; every window of a text lies in exactly one piece."""
    owners, offsets, parts, size = [], [], [], 0
    for owner, text in texts:
        for at in range(0, len(text) - threshold + 1, PIECE):
            part = text[at : at + PIECE + threshold - 1]
            if size + len(part) > 65_536:
                yield owners, offsets, parts
                owners, offsets, parts, size = [], [], [], 0
            owners.append(owner)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, offsets, parts


def _bytes_of(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _first_digits(docs: DataFrame, threshold: int, parts: int) -> DataFrame:
    """Packets of (landmark, document) by landmark."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            marks, ids = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(marks, kind="stable")
            marks, ids = marks[order], ids[order]
            who, rank = np.unique(ids, return_inverse=True)
            rank = rank.astype(np.uint32)
            return pk.cut_parts(marks << np.uint64(16), parts, lambda part: pk.pack(pk.steps(marks[part]), rank[part], pk.steps(who)))

        for batch in batches:
            ids = np.array(batch.column("doc_id").to_pylist(), dtype=np.int64)
            for owners, _, group in in_pieces(list(enumerate(_bytes_of(batch))), threshold):
                piece, _, _, _, mark = landmarks(group, threshold)
                own, number = np.unique(owners, return_inverse=True)
                both = np.unique(number[piece].astype(np.uint64) << np.uint64(48) | mark)
                held.append((both & np.uint64((1 << 48) - 1), ids[own[(both >> np.uint64(48)).astype(np.int64)]]))
                count += len(both)
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    return docs.mapInArrow(send, pk.SCHEMA)


def _shared_digits(payloads: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    """Landmarks that two documents have, sent back to these documents."""
    marks, ids = [], []
    for data in payloads:
        m, rank, who = pk.unpack(data)
        marks.append(np.cumsum(m))
        ids.append(np.cumsum(who)[rank])
    marks, ids = np.concatenate(marks), np.concatenate(ids)
    order = np.argsort(marks, kind="stable")
    marks, ids = marks[order], ids[order]
    same = marks[1:] == marks[:-1]
    shared = np.append(same, False) | np.append(False, same)
    marks, ids = marks[shared], ids[shared]
    if len(marks):
        spread = pk.by_id(ids)
        order = np.lexsort((marks, spread))
        marks, ids, spread = marks[order], ids[order], spread[order]

        def payload(part: slice) -> bytes:
            own = ids[part]
            new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            return pk.pack(own[new], np.diff(np.append(new, len(own))).astype(np.uint32), marks[part])

        yield pk.cut_parts(spread, parts, payload)


def _text_packets(docs: DataFrame, parts: int) -> DataFrame:
    """The texts by document, compressed together."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = np.array(batch.column("doc_id").to_pylist(), dtype=np.int64), _bytes_of(batch)
            spread = pk.by_id(ids)
            order = np.argsort(spread, kind="stable")

            def payload(part: slice) -> bytes:
                own = [texts[i] for i in order[part]]
                return pk.pack(ids[order[part]], np.array([len(t) for t in own], dtype=np.int64), np.frombuffer(b"".join(own), dtype=np.uint8))

            if len(ids):
                yield pk.cut_parts(spread[order], parts, payload)

    return docs.mapInArrow(send, pk.SCHEMA)


def _texts_in(data: bytes) -> Iterator[tuple[int, bytes]]:
    ids, sizes, body = pk.unpack(data)
    raw, at = body.tobytes(), 0
    for name, n in zip(ids.tolist(), sizes.tolist()):
        yield name, raw[at : at + n]
        at += n


def _beside(texts: DataFrame, answers: DataFrame, parts: int, work, schema: str) -> DataFrame:
    """``work(payloads of answers, payloads of texts)`` by document part; the texts stream by, the answers are held."""
    both = answers.withColumn("kind", F.lit(0)).unionByName(texts.withColumn("kind", F.lit(1)))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def flowing() -> Iterator[bytes]:
            for batch in batches:
                kinds, data = batch.column("kind").to_pylist(), batch.column("payload")
                for i, kind in enumerate(kinds):
                    if kind:
                        yield data[i].as_py()
                    else:
                        held.append(data[i].as_py())

        yield from work(held, flowing())

    return both.repartitionById(parts, "part").sortWithinPartitions("kind").select("kind", "payload").mapInArrow(told, schema)


def _places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each range, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def _context_packets(held: list[bytes], texts: Iterator[bytes], threshold: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows whose landmark is shared, with the bytes they read: by landmark."""
    known = None
    rows: list[tuple] = []
    count = 0

    def flush() -> pa.RecordBatch:
        mark, ids, at, low, high, body = (np.concatenate(x) for x in zip(*rows))
        order = np.argsort(mark, kind="stable")
        who, rank = np.unique(ids, return_inverse=True)
        rank = rank.astype(np.uint32)
        sizes = high - low + threshold
        begins = np.cumsum(sizes) - sizes

        def payload(part: slice) -> bytes:
            o = order[part]
            return pk.pack(pk.steps(mark[o]), rank[o], pk.steps(who), at[o], low[o].astype(np.uint32), high[o].astype(np.uint32), body[_places(begins[o], sizes[o])])

        return pk.cut_parts(mark[order] << np.uint64(16), parts, payload)

    for data in texts:
        if known is None:  # all answers come before the first text
            ids, counts, marks = (np.concatenate(x) for x in zip(*map(pk.unpack, held))) if held else (np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint64))
            held.clear()
            owner = np.repeat(ids, counts)
            order = np.lexsort((marks, owner))
            owner, marks = owner[order], marks[order]
            names, starts, counts = np.unique(owner, return_index=True, return_counts=True)
            known = {name: (a, a + n) for name, a, n in zip(names.tolist(), starts.tolist(), counts.tolist())}
        wanted = [(name, text) for name, text in _texts_in(data) if name in known]
        for owners, offsets, group in in_pieces(wanted, threshold):
            piece, first, last, place, mark = landmarks(group, threshold)
            keep = np.zeros(len(mark), dtype=bool)
            edges = np.searchsorted(piece, np.arange(len(group) + 1))
            for i, name in enumerate(owners):
                own = marks[slice(*known[name])]
                found = mark[edges[i] : edges[i + 1]]
                keep[edges[i] : edges[i + 1]] = own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found
            piece, first, last, place, mark = (x[keep] for x in (piece, first, last, place, mark))
            if len(piece):
                sizes = np.array([len(g) for g in group], dtype=np.int64)
                read = _places((np.cumsum(sizes) - sizes)[piece] + first, last - first + threshold)
                body = np.frombuffer(b"".join(group), dtype=np.uint8)[read]
                rows.append((mark, np.array(owners, np.int64)[piece], place + np.array(offsets, np.int64)[piece], place - last, place - first, body))
                count += len(piece)
            if count >= FLUSH // 8:
                yield flush()
                rows, count = [], 0
    if count:
        yield flush()


def _rows_equal(rows: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A group number for each row of a matrix of digits: equal rows get equal numbers. Rows are sorted by a sum and
    compared as wholes, so a clash of sums can only part equal rows, never join different ones."""
    key = (rows * seeds).sum(axis=1, dtype=np.uint64)
    order = np.argsort(key, kind="stable")
    same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
    group = np.empty(len(rows), dtype=np.int64)
    group[order] = np.concatenate([[0], np.cumsum(~same)])
    return group


def smallest_holders(group: np.ndarray, digits: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each window the smallest document holding its like inside its group, by most-significant-digit passes;
    a window alone in its group leaves at once and keeps its own document."""
    least = owners.copy()
    alive = np.arange(len(group))
    for k in range(digits.shape[1]):
        order = np.lexsort((digits[alive, k], group))
        alive, group = alive[order], group[order]
        digit = digits[alive, k]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
        group = np.cumsum(new) - 1
        many = (np.bincount(group) > 1)[group]
        alive, group = alive[many], group[many]
        if not len(alive):
            return least
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    low = np.minimum.reduceat(owners[alive], starts)
    least[alive] = np.repeat(low, np.diff(np.append(starts, len(alive))))
    return least


def _in_digits(matrix: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 8-byte digits."""
    n, width = matrix.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = matrix
    return padded.view(">u8").astype(np.uint64)


def _removals(payloads: list[bytes], threshold: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Byte ranges that windows of smaller documents cover, sent to their documents."""
    reach = threshold - gram_size(threshold)
    columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for data in payloads:
        mark, rank, who, at, low, high, body = pk.unpack(data)
        low, high = low.astype(np.int64), high.astype(np.int64)
        matrix = np.zeros((len(rank), threshold + reach), dtype=np.uint8)
        matrix.reshape(-1)[_places(np.arange(len(rank)) * (threshold + reach) + reach - high, high - low + threshold)] = body
        for column, value in zip(columns, (np.cumsum(mark), np.cumsum(who)[rank], at, low, high, matrix)):
            column.append(value)
    payloads.clear()
    mark, ids, at, low, high, matrix = (np.concatenate(x) for x in columns)
    columns.clear()
    seeds = pk.mix(np.arange(1, -(-matrix.shape[1] // 8) + 4, dtype=np.uint64))
    shape = np.column_stack([_in_digits(matrix), mark, (low << 32 | high).astype(np.uint64)])
    context = _rows_equal(shape, seeds[: shape.shape[1]])
    order = np.lexsort((ids, context))
    first = order[np.flatnonzero(np.concatenate([[True], np.diff(context[order]) != 0]))]
    # the smallest document of each distinct context, by its number
    least, c_mark, c_low, c_high, c_matrix = ids[first], mark[first], low[first], high[first], matrix[first]
    marks, group, sizes = np.unique(c_mark, return_inverse=True, return_counts=True)
    several = np.flatnonzero(sizes[group] > 1)
    top, bottom = np.where(least[context] < ids, high, -1), np.where(least[context] < ids, low, threshold)
    if len(several):
        slot = np.full(len(least), -1, dtype=np.int64)
        slot[several] = np.arange(len(several))
        mine = slot[context]
        for r in range(reach + 1):
            here = several[(c_low[several] <= r) & (r <= c_high[several])]
            if len(here) < 2:
                continue
            found = smallest_holders(group[here], _in_digits(c_matrix[here, reach - r : reach - r + threshold]), least[here])
            holder = np.full(len(several), np.iinfo(np.int64).max)
            holder[slot[here]] = found
            hit = np.flatnonzero(mine >= 0)
            hit = hit[holder[mine[hit]] < ids[hit]]
            top[hit] = np.maximum(top[hit], r)
            bottom[hit] = np.minimum(bottom[hit], r)
    hit = np.flatnonzero(top >= 0)
    if len(hit):
        spread = pk.by_id(ids[hit])
        order = np.lexsort((at[hit], spread))
        hit, spread = hit[order], spread[order]

        def payload(part: slice) -> bytes:
            i = hit[part]
            own = ids[i]
            new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            return pk.pack(own[new], np.diff(np.append(new, len(own))).astype(np.uint32), at[i] - top[i], (top[i] - bottom[i]).astype(np.uint32))

        yield pk.cut_parts(spread, parts, payload)


def _rewritten(held: list[bytes], texts: Iterator[bytes], threshold: int) -> Iterator[pa.RecordBatch]:
    """The documents with their removed bytes counted and cut out."""
    spans = None
    for data in texts:
        if spans is None:
            spans = {}
            for answer in held:
                ids, counts, start, more = pk.unpack(answer)
                edges = np.cumsum(counts, dtype=np.int64)
                for name, a, b in zip(ids.tolist(), (edges - counts).tolist(), edges.tolist()):
                    spans.setdefault(name, []).append((start[a:b], start[a:b] + more[a:b].astype(np.int64) + threshold))
        rows = []
        for name, text in _texts_in(data):
            removed, pieces, at, runs = 0, [], 0, []
            if name in spans:
                starts, ends = (np.concatenate(x) for x in zip(*spans[name]))
                order = np.argsort(starts, kind="stable")
                starts, ends = starts[order], np.maximum.accumulate(ends[order])
                fresh = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
                runs = list(zip(starts[fresh].tolist(), ends[np.append(fresh[1:], len(ends)) - 1].tolist()))
            for a, b in runs:
                pieces.append(text[at:a])
                removed += b - a
                at = b
            pieces.append(text[at:])
            kept = b"".join(pieces)
            rows.append((name, len(text), removed, len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in runs]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"


def without_repeats(docs: DataFrame, threshold: int = 50) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left), spans (what was removed).

    Texts are UTF-8 bytes, null counting as empty. A byte goes if a string of ``threshold`` bytes covers it that also
    starts in a document with a smaller doc_id; strings are judged on the input and never cross documents. The result is
    exact: hashes only choose which windows are compared byte by byte. Kept bytes may cut a character. Rows with a null id
    are returned whole and are no source for others. A doc_id names one text: rows repeating both are treated alike.
    Other columns are ignored; an empty table gives no rows.
    """
    if threshold < 4:
        raise ValueError("the threshold must be at least 4 bytes")
    base = id_and_text(docs)
    known = base.filter("doc_id IS NOT NULL")
    parts = buckets_for(docs)
    back = pk.exchanged(_first_digits(known, threshold, parts), parts, lambda x: _shared_digits(x, parts), pk.SCHEMA)
    contexts = _beside(_text_packets(known, parts), back, parts, lambda held, texts: _context_packets(held, texts, threshold, parts), pk.SCHEMA)
    gone = cut(pk.exchanged(contexts, parts, lambda x: _removals(x, threshold, parts), pk.SCHEMA))
    out = _beside(_text_packets(known, parts), gone, parts, lambda held, texts: _rewritten(held, texts, threshold), OUT)
    nameless = base.filter("doc_id IS NULL").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "UTF-8").alias("kept"), F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias("spans"),
    )
    return out.unionByName(nameless)
