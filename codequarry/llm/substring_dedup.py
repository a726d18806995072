"""Removal of repeated word sequences with suffix automata of reference shards.

A window is ``threshold`` consecutive words. It counts through its landmark, the smallest hashed gram of words inside
it: equal windows have equal landmarks, so only windows whose landmark two documents have are looked at again. They go,
with their words, to the shard of their landmark. A shard builds a suffix automaton of its distinct stretches, each
state knowing the smallest document that holds it, and streams the stretches through it: where the longest match
reaches the threshold, the state of the last ``threshold`` words names the window's smallest holder.

The automaton of a shard is given to the one task that streams the shard's documents. Broadcast to all tasks, every
shard would meet every document, and the work would grow with the square of the corpus.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm import packets as pk
from codequarry.llm.common import SPACES, buckets_for, id_and_text
from codequarry.llm.words import grouped
from codequarry.session import shared_folder

GRAM = 8
RUN = 64  # windows of one stretch, so that an answer is one 64-bit mask
HOT = 4096  # documents that share a landmark before its windows are dealt out by their own words
FLUSH = 1_000_000
CHUNK = 30_000  # words in one automaton, unless a single landmark has more
_BASE = 0xD6E8FEB86659FD93
_NEXT = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """The suffix automaton of several word sequences; a state knows the smallest owner of its words."""

    def __init__(self) -> None:
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.size, self.least = [-1], [0], [1 << 63]
        self.last = 0

    def add(self, words: list[int], owner: int) -> None:
        steps, link, size, least = self.steps, self.link, self.size, self.least
        last = 0
        for word in words:
            there = steps[last].get(word)
            if there is not None and size[there] == size[last] + 1:
                last = there
            elif there is not None:
                last = self._split(last, there, word)
            else:
                new = len(size)
                steps.append({})
                size.append(size[last] + 1)
                least.append(1 << 63)
                link.append(0)
                at = last
                while at >= 0 and word not in steps[at]:
                    steps[at][word] = new
                    at = link[at]
                if at >= 0:
                    there = steps[at][word]
                    link[new] = there if size[there] == size[at] + 1 else self._split(at, there, word)
                last = new
            if owner < least[last]:
                least[last] = owner

    def _split(self, at: int, there: int, word: int) -> int:
        """A state of its own for the words that reach ``there`` through ``at``."""
        steps, link, size = self.steps, self.link, self.size
        clone = len(size)
        steps.append(dict(steps[there]))
        size.append(size[at] + 1)
        self.least.append(1 << 63)
        link.append(link[there])
        link[there] = clone
        while at >= 0 and steps[at].get(word) == there:
            steps[at][word] = clone
            at = link[at]
        return clone

    def settle(self) -> None:
        """Tell every state the smallest owner of the longer words that end like its own."""
        link, least = self.link, self.least
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = link[state]
            if least[state] < least[up]:
                least[up] = least[state]

    def holders(self, words: list[int], threshold: int) -> list[int]:
        """For each window of ``words`` its smallest owner (2**63 if there is none), by matching statistics: the length of
        the longest match that ends at each word, kept at ``threshold`` where it is longer."""
        steps, link, size, least = self.steps, self.link, self.size, self.least
        state = length = 0
        out = []
        for i, word in enumerate(words, 1):
            there = steps[state].get(word)
            while there is None and state:
                state = link[state]
                length = size[state]
                there = steps[state].get(word)
            if there is None:
                length = 0
            else:
                state = there
                length += 1
                if length > threshold:
                    length = threshold
                while size[link[state]] >= threshold:
                    state = link[state]
            if i >= threshold:
                out.append(least[state] if length >= threshold else 1 << 63)
        return out


def landmarks(hashes: np.ndarray, counts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, landmark) of every window of texts whose word hashes lie one after the other."""
    gram = min(GRAM, threshold)
    windows = np.maximum(counts - threshold + 1, 0)
    owner = np.repeat(np.arange(len(counts)), windows)
    if not len(owner):
        return owner, np.empty(0, np.uint64)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + (np.cumsum(counts) - counts)[owner]
    low = rolled(hashes, gram)
    span, step = threshold - gram + 1, 1
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
    # smallest hashes crowd near zero, so they are hashed once more before they deal rows to parts
    return owner, pk.mix(low[starts] + _NEXT) >> np.uint64(16)


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` values from each place on."""
    out, done, block, size = None, 0, values, 1
    while True:
        if width & size:
            out = block if out is None else out[: len(block) - done] * np.uint64(pow(_BASE, size, 1 << 64)) + block[done:]
            done += size
        if size * 2 > width:
            return pk.mix(out)
        block = block[: len(block) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + block[size:]
        size *= 2


def _marks_of(docs: DataFrame, threshold: int, parts: int) -> DataFrame:
    """Packets (landmark, part of the documents, how many of them) by landmark."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            mark, home = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((home, mark))
            mark, home = mark[order], home[order]
            new = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]) | (home[1:] != home[:-1])))
            n = np.diff(np.append(new, len(mark))).astype(np.uint32)
            mark, home = mark[new], home[new].astype(np.uint32)
            return pk.cut_parts(mark << np.uint64(16), parts, lambda part: pk.pack(pk.steps(mark[part]), home[part], n[part]))

        for batch in batches:
            homes = pk.part_of(pk.by_id(np.array(batch.column("doc_id").to_pylist(), dtype=np.int64)), parts)
            for which, hashes, counts in grouped(batch.column("text").to_pylist()):
                owner, mark = landmarks(hashes, counts, threshold)
                new = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1]))) if len(mark) else owner
                both = np.stack([owner[new].astype(np.uint64), mark[new]], axis=1)
                order = np.lexsort((both[:, 1], both[:, 0]))
                both = both[order]
                once = np.append(True, (both[1:] != both[:-1]).any(axis=1)) if len(both) else np.empty(0, bool)
                both = both[once]
                held.append((both[:, 1], homes[which.start + both[:, 0].astype(np.int64)]))
                size += len(both)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return docs.mapInArrow(send, pk.SCHEMA)


def _shared_marks(payloads: list[bytes], parts: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Landmarks of two documents or more, and whether they are hot, told to the parts of these documents."""
    found = [pk.unpack(x) for x in payloads]
    mark, home, n = np.concatenate([np.cumsum(m) for m, _, _ in found]), *(np.concatenate([f[k] for f in found]) for k in (1, 2))
    del found
    order = np.argsort(mark, kind="stable")
    mark, home, n = mark[order], home[order], n[order].astype(np.int64)
    new = np.flatnonzero(np.append(True, mark[1:] != mark[:-1]))
    docs = np.repeat(np.add.reduceat(n, new), np.diff(np.append(new, len(mark))))
    many = docs > 1
    mark, home, is_hot = mark[many], home[many].astype(np.int64), (docs[many] > hot).astype(np.uint8)
    order = np.lexsort((mark, home))
    mark, home, is_hot = mark[order], home[order], is_hot[order]
    once = np.append(True, (mark[1:] != mark[:-1]) | (home[1:] != home[:-1])) if len(mark) else np.empty(0, bool)
    mark, home, is_hot = mark[once], home[once], is_hot[once]
    edges = np.searchsorted(home, np.arange(parts + 1))
    found = [(p, pk.pack(pk.steps(mark[a:b]), is_hot[a:b])) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
    if found:
        yield pk.rows(found)


def _texts_of(docs: DataFrame, parts: int) -> DataFrame:
    """The texts by document, their words joined by single spaces, compressed together."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column("doc_id").to_pylist(), dtype=np.int64)
            if not len(ids):
                continue
            texts = [b" ".join(t.encode().split()) for t in batch.column("text").to_pylist()]
            spread = pk.by_id(ids)
            order = np.argsort(spread, kind="stable")

            def payload(part: slice) -> bytes:
                return packed_texts(ids[order[part]], [texts[i] for i in order[part]])

            yield pk.cut_parts(spread[order], parts, payload)

    return docs.mapInArrow(send, pk.SCHEMA)


def packed_texts(ids: np.ndarray, texts: list[bytes], *more: np.ndarray) -> bytes:
    return pk.pack(ids, np.array([len(t) for t in texts], dtype=np.int64), np.frombuffer(b"".join(texts), dtype=np.uint8), *more)


def unpacked_texts(data: bytes) -> tuple[list[int], list[bytes], list[np.ndarray]]:
    ids, sizes, body, *more = pk.unpack(data)
    raw, ends = body.tobytes(), np.cumsum(sizes)
    return ids.tolist(), [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())], more


def _equal_windows(ids: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Whether the windows at ``a`` and at ``b`` have the same words."""
    same = np.ones(len(a), dtype=bool)
    for j in range(threshold):
        same &= ids[a + j] == ids[b + j]
    return same


KINDS = "kind int, part int, payload binary"
STRETCHES, TEXTS, DONE = 0, 1, 2


def _kind(kind: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * batch.num_rows, pa.int32()), *batch.columns], ["kind", "part", "payload"])


def _done(ids: list[int], texts: list[bytes], with_text: bool) -> bytes:
    n = np.array([t.count(b" ") + 1 if t else 0 for t in texts], dtype=np.int64)
    sha = np.frombuffer(b"".join(hashlib.sha256(t).digest() for t in texts), dtype=np.uint8)
    return packed_texts(np.array(ids, dtype=np.int64), texts if with_text else [b""] * len(texts), n, sha)


def _stretches(held: list[bytes], texts: Iterator[bytes], threshold: int, parts: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """What a part of the documents sends: stretches of windows to look up, the texts they come from, finished texts.

    Of equal windows of different documents only those of the smallest document are sent; the others go at once."""
    found = [pk.unpack(x) for x in held]
    held.clear()
    known = np.concatenate([np.cumsum(m) for m, _ in found]) if found else np.empty(0, np.uint64)
    is_hot = np.concatenate([h for _, h in found]) if found else np.empty(0, np.uint8)
    order = np.argsort(known)
    known, is_hot = known[order], is_hot[order]
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    docs, bodies, numbers, marks, places, hots = [], [], [], [], [], []
    for data in texts:
        ids, own, _ = unpacked_texts(data)
        rest = np.ones(len(own), dtype=bool)
        for which, hashes, counts in grouped([t.decode() for t in own]):
            owner, mark = landmarks(hashes, counts, threshold)
            if not len(known) or not len(mark):
                continue
            at = np.minimum(np.searchsorted(known, mark), len(known) - 1)
            hit = np.flatnonzero(known[at] == mark)
            windows = np.maximum(counts - threshold + 1, 0)
            first = np.cumsum(windows) - windows
            for i, (a, b) in _ranges(owner[hit]):
                t = which.start + i
                rest[t] = False
                docs.append(ids[t])
                bodies.append(own[t])
                words = own[t].split(b" ")
                numbers.append(np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int32, count=len(words)))
                places.append(hit[a:b] - first[i])
                marks.append(mark[hit[a:b]])
                hots.append(is_hot[at[hit[a:b]]])
        left = np.flatnonzero(rest).tolist()
        if left:
            yield _kind(DONE, pk.rows([(0, _done([ids[i] for i in left], [own[i] for i in left], with_text))]))
    del vocabulary
    if not docs:
        return
    lengths = np.array([len(x) for x in numbers], dtype=np.int64)
    base = np.cumsum(lengths) - lengths
    flat = np.concatenate(numbers)
    counts = np.array([len(x) for x in places], dtype=np.int64)
    doc = np.repeat(np.arange(len(docs)), counts)
    place = np.concatenate(places)
    at = base[doc] + place
    mark, hot = np.concatenate(marks), np.concatenate(hots).astype(bool)
    names = np.array(docs, dtype=np.int64)
    whole = rolled(pk.mix(flat.astype(np.uint64) + _NEXT), threshold)[at]
    order = np.lexsort((names[doc], whole))
    pairs = np.flatnonzero(whole[order[1:]] == whole[order[:-1]])
    same = np.zeros(len(order), dtype=bool)
    for some in np.array_split(pairs, len(pairs) // 500_000 + 1):
        same[some + 1] = _equal_windows(flat, at[order[some]], at[order[some + 1]], threshold)
    heads = np.flatnonzero(~same)
    least = np.repeat(names[doc[order[heads]]], np.diff(np.append(heads, len(order))))
    gone = np.zeros(len(order), dtype=bool)
    gone[order] = least < names[doc[order]]
    del order, pairs, same, heads, least
    # texts and the windows that are gone already, for the last step
    for some in _slices(np.array([len(b) for b in bodies])):
        lost = np.flatnonzero(gone[slice(int(np.searchsorted(doc, some.start)), int(np.searchsorted(doc, some.stop)))]) + int(np.searchsorted(doc, some.start))
        more = np.arange(some.start, some.stop), np.bincount(doc[lost] - some.start, minlength=some.stop - some.start), pk.steps(at[lost] - base[some.start])
        part = int(pk.part_of(pk.by_id(names[:1]), parts)[0])
        yield _kind(TEXTS, pk.rows([(part, packed_texts(names[some], bodies[some], *(x.astype(np.int64) for x in more)))]))
    # stretches of windows that follow each other with one landmark; windows of hot landmarks go alone, by their words
    keep = np.flatnonzero(~gone)
    doc, place, at, mark, hot = doc[keep], place[keep], at[keep], mark[keep], hot[keep]
    if not len(doc):
        return
    exact = hot.nonzero()[0]
    if len(exact):
        mark = mark.copy()
        mark[exact] = _content_keys(bodies, doc[exact], place[exact], threshold)
    new = np.append(True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (mark[1:] != mark[:-1]) | hot[1:])
    begin = np.flatnonzero(new)
    nth = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
    begin = np.flatnonzero(new | (nth % RUN == 0))
    size = np.diff(np.append(begin, len(doc)))
    doc, place, mark = doc[begin], place[begin], mark[begin]
    home = int(pk.part_of(pk.by_id(names[:1]), parts)[0])
    order = np.argsort(mark, kind="stable")
    for some in np.array_split(order, len(order) // FLUSH + 1):
        cuts: list[bytes] = [b""] * len(some)
        by_doc = np.argsort(doc[some], kind="stable")
        for i, (a, b) in _ranges(doc[some][by_doc]):
            ends = _word_ends(bodies[i])
            for row in by_doc[a:b].tolist():
                p, k = int(place[some[row]]), int(size[some[row]])
                cuts[row] = bodies[i][ends[p - 1] + 1 if p else 0 : ends[p + k + threshold - 2]]
        d, p, k, m = doc[some], place[some], size[some].astype(np.uint8), mark[some]

        def payload(part: slice) -> bytes:
            who, rank = np.unique(d[part], return_inverse=True)
            own = cuts[part]
            return pk.pack(
                np.array([home], dtype=np.int64), pk.steps(m[part]), rank.astype(np.uint32), names[who], who, p[part].astype(np.uint32), k[part],
                np.array([len(c) for c in own], dtype=np.uint32), np.frombuffer(b"".join(own), dtype=np.uint8),
            )

        yield _kind(STRETCHES, pk.cut_parts(m << np.uint64(16), parts, payload))


def _ranges(sorted_values: np.ndarray) -> Iterator[tuple[int, tuple[int, int]]]:
    """(value, (first place, place after the last)) of each value."""
    if len(sorted_values):
        new = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
        yield from zip(sorted_values[new].tolist(), zip(new.tolist(), np.append(new[1:], len(sorted_values)).tolist()))


def _slices(sizes: np.ndarray, limit: int = 4 << 20) -> Iterator[slice]:
    """Slices of about equal sums."""
    cell = np.cumsum(sizes) // limit
    new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    yield from map(slice, new.tolist(), np.append(new[1:], len(sizes)).tolist())


def _word_ends(body: bytes) -> np.ndarray:
    return np.append(np.flatnonzero(np.frombuffer(body, dtype=np.uint8) == 32), len(body)).tolist()


def _content_keys(bodies: list[bytes], doc: np.ndarray, place: np.ndarray, threshold: int) -> np.ndarray:
    """48-bit keys of windows by their own words, the same in every task."""
    out = np.empty(len(doc), dtype=np.uint64)
    for i, (a, b) in _ranges(doc):
        hashes = np.concatenate([h for _, h, _ in grouped([bodies[i].decode()])])
        out[a:b] = rolled(hashes, threshold)[place[a:b]] >> np.uint64(16)
    return out


def _answers(payloads: list[bytes], threshold: int, parts: int) -> Iterator[pa.RecordBatch]:
    """For each stretch the windows (a mask) that a smaller document holds, told to the part it came from."""
    found = [pk.unpack(x) for x in payloads]
    payloads.clear()
    home = np.concatenate([np.full(len(f[1]), f[0][0]) for f in found])
    mark = np.concatenate([np.cumsum(f[1]) for f in found])
    name = np.concatenate([f[3][f[2]] for f in found])
    serial = np.concatenate([f[4][f[2]] for f in found])
    place, size, lengths = (np.concatenate([f[k] for f in found]) for k in (5, 6, 7))
    raw = b"".join(f[8].tobytes() for f in found)
    ends = np.cumsum(lengths, dtype=np.int64)
    begins = ends - lengths
    del found
    full = (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - size.astype(np.uint64)))
    mask = np.zeros(len(mark), dtype=np.uint64)
    order = np.lexsort((name, mark))
    waiting: list[tuple[list[int], list[bytes]]] = []
    held = 0

    def match() -> None:
        vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        automaton, streams = Automaton(), []
        for rows, bodies in waiting:
            for row, body in zip(rows, bodies):
                words = list(map(vocabulary.__getitem__, body.split(b" ")))
                automaton.add(words, int(name[row]))
                streams.append((row, words))
        automaton.settle()
        for row, words in streams:
            own, bits = int(name[row]), 0
            for k, holder in enumerate(automaton.holders(words, threshold)):
                if holder < own:
                    bits |= 1 << k
            mask[row] = bits

    for _, (a, b) in _ranges(mark[order]):
        if b - a < 2:
            continue
        rows = order[a:b].tolist()
        first: dict[bytes, int] = {}
        lasting, bodies = [], []
        for row in rows:
            body = raw[begins[row] : ends[row]]
            before = first.setdefault(body, int(name[row]))
            if before < name[row]:
                mask[row] = full[row]
            else:  # the smallest document of these words; the automaton knows whether a smaller one holds parts of them
                lasting.append(row)
                bodies.append(body)
        if len(first) > 1:
            waiting.append((lasting, bodies))
            held += sum(int(size[row]) + threshold - 1 for row in lasting)
            if held > CHUNK:
                match()
                waiting, held = [], 0
    if waiting:
        match()
    hit = np.flatnonzero(mask)
    if len(hit):
        order = hit[np.lexsort((place[hit], serial[hit], home[hit]))]
        out = [(p, pk.pack(serial[order[a:b]], place[order[a:b]], mask[order[a:b]])) for p, (a, b) in _ranges(home[order])]
        yield pk.rows(out)


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:long,end:long>>"
NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], NAMES)


def _rewritten(held: list[bytes], texts: Iterator[bytes], threshold: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Texts without the words that removed windows cover."""
    told: dict[int, list[int]] = {}
    for data in held:
        serials, places, masks = (x.tolist() for x in pk.unpack(data))
        for serial, place, bits in zip(serials, places, masks):
            own = told.setdefault(serial, [])
            own.extend(place + k for k in range(bits.bit_length()) if bits >> k & 1)
    for data in texts:
        ids, bodies, (serials, counts, lost) = unpacked_texts(data)
        lost = np.cumsum(lost)
        ends = np.cumsum(counts)
        rows, base = [], 0
        for doc_id, body, serial, a, b in zip(ids, bodies, serials.tolist(), (ends - counts).tolist(), ends.tolist()):
            words = body.split(b" ")
            starts = np.concatenate([lost[a:b] - base, np.array(told.get(serial, []), dtype=np.int64)])
            cover = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + threshold, minlength=len(words) + 1)
            base += len(words)
            gone = np.cumsum(cover[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
            kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
            spans = [{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
            rows.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None, spans))
        yield _batch(rows)


def _finished(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("payload"):
            ids, texts, (n, sha) = unpacked_texts(data.as_py())
            digests = sha.tobytes().hex()
            yield _batch([(i, k, 0, digests[64 * j : 64 * j + 64], t.decode() if with_text else None, []) for j, (i, t, k) in enumerate(zip(ids, texts, n.tolist()))])


def without_repeats(docs: DataFrame, threshold: int = 50, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept (words left, joined by one space; null unless
    ``with_text``), spans (ranges of removed words, counted from 0).

    Words are runs without ASCII white space, unchanged; null and empty texts have none. A word goes if a window of
    ``threshold`` words covers it that also starts in a document with a smaller doc_id; windows are judged on the input and
    never cross documents. Words are compared as bytes; hashes only choose which windows meet. Rows with a null id are
    returned whole and are no source for others. Rows repeating an id are one document when windows are compared, and each
    is returned by itself. Other columns are ignored; an empty table gives no rows. Landmarks of more than ``hot``
    documents are looked up window by window.
    """
    if threshold < 2:
        raise ValueError("the threshold must be at least 2 words")
    spark = docs.sparkSession
    base = id_and_text(docs)
    known = base.filter("doc_id IS NOT NULL")
    parts = buckets_for(docs)
    shared = pk.exchanged(_marks_of(known, threshold, parts), parts, lambda x: _shared_marks(x, parts, hot), pk.SCHEMA)
    folder = shared_folder(spark, f"cuts-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}")
    work = pk.beside(_texts_of(known, parts), shared, parts, lambda h, t: _stretches(h, t, threshold, parts, with_text), KINDS)
    work.write.partitionBy("kind").parquet(folder)
    table = spark.read.schema(KINDS).parquet(folder)
    answers = pk.exchanged(table.filter(F.col("kind") == STRETCHES).select("part", "payload"), parts, lambda x: _answers(x, threshold, parts), pk.SCHEMA)
    changed = pk.beside(table.filter(F.col("kind") == TEXTS), answers, parts, lambda h, t: _rewritten(h, t, threshold, with_text), OUT)
    finished = table.filter(F.col("kind") == DONE).select("payload").mapInArrow(lambda b: _finished(b, with_text), OUT)
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    nameless = base.filter("doc_id IS NULL").select(
        "doc_id", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"),
        (F.array_join(words, " ") if with_text else F.lit(None).cast("string")).alias("kept"), F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias("spans"),
    )
    return changed.unionByName(finished).unionByName(nameless)
