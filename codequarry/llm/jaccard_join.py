"""Similarity join on word n-grams: T-occurrence search with short lists merged and long lists probed.

A document of n shingles needs T = ceil(p * n) of them in common with any partner. Of its inverted lists the T - 1
longest are set aside, so a partner occurs in at least one of the n - T + 1 short ones: these are merged to find
candidates, and the long ones are only probed, by binary search, for candidates (DivideSkip with L = T - 1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codequarry.llm import packets as pk, words
from codequarry.llm.common import buckets_for, id_and_text
from codequarry.llm.components import components
from codequarry.session import cut

FLUSH = 1_500_000
BLOCK = 1024
#: Counts of a set's shingles by hash, for a bound on overlaps; 255 stands for any larger count.
CELLS = 128


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle), distinct and sorted: ``width`` words each, or the whole text where it has fewer."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    total = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(width):
        factor = np.uint64(pow(0x9FB21C651E98DF25, k + 1, 1 << 64))
        total[: len(hashes) - k] += hashes[k:] * factor if k else hashes * factor
    whole = np.flatnonzero(counts[owner] - (np.arange(len(hashes)) - first[owner]) >= width)
    found, owners = total[whole], owner[whole]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        short = np.array([sum((int(hashes[first[i] + k]) * pow(0x9FB21C651E98DF25, k + 1, 1 << 64) for k in range(counts[i])), start=int(counts[i])) % (1 << 64) for i in few], dtype=np.uint64)
        found, owners = np.concatenate([found, short]), np.concatenate([owners, few])
    found = pk.mix(found)
    order = np.lexsort((found, owners))
    found, owners = found[order], owners[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owners[1:] != owners[:-1])
    return owners[new], found[new]


def sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, borders of each document's shingles, text numbers, shingles) for groups of documents."""
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for numbers, hashes, counts in words.grouped(texts):
            owners, found = shingles(hashes, counts, width)
            yield ids[numbers.start : numbers.stop], np.searchsorted(owners, np.arange(len(counts) + 1)), owners, found


def set_classes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, digest): the size of each document's set and a 128-bit digest of it; null for an empty set."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, edges, _, found in sets_of(batches, width):
            marks = [hashlib.blake2b(found[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(edges).astype(np.int64)), pa.array(marks, pa.binary())], ["doc_id", "n", "digest"])

    return docs.mapInArrow(digests, "doc_id long, n long, digest binary")


def _sent(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """Packets of (shingle, document, size) by shingle. Within a task one document stands for all with its set."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ids: list[int] = []
        sizes: list[int] = []
        count = 0

        for names, edges, owners, found in sets_of(batches, width):
            keep = np.zeros(len(names), dtype=bool)
            for i, name in enumerate(names):
                own = found[edges[i] : edges[i + 1]]
                if name is None or not len(own):
                    continue
                mark = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if mark not in seen:
                    seen.add(mark)
                    keep[i] = True
            number = np.cumsum(keep) - 1 + len(ids)
            taken = keep[owners]
            held.append((found[taken] >> np.uint64(16), number[owners[taken]]))
            ids += [n for n, k in zip(names, keep) if k]
            sizes += [int(s) for s, k in zip(np.diff(edges), keep) if k]
            count += len(held[-1][0])
            if count >= FLUSH:
                yield _by_shingle(held, ids, sizes, parts)
                held, ids, sizes, count = [], [], [], 0
        if count:
            yield _by_shingle(held, ids, sizes, parts)

    return docs.mapInArrow(send, pk.SCHEMA)


def _by_shingle(held: list[tuple[np.ndarray, np.ndarray]], ids: list[int], sizes: list[int], parts: int) -> pa.RecordBatch:
    """Packets of 48-bit shingle hashes, each with the rank of its document among those named in the packet."""
    hashes, owners = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(hashes, kind="stable")
    hashes, owners, who, size = hashes[order], owners[order].astype(np.uint32), np.array(ids, np.int64), np.array(sizes, np.uint32)
    by_id = np.argsort(who, kind="stable")
    rank = np.empty(len(who), np.uint32)
    rank[by_id] = np.arange(len(who), dtype=np.uint32)
    who, size = who[by_id], size[by_id]
    return pk.cut_parts(hashes << np.uint64(16), parts, lambda part: pk.pack(pk.steps(hashes[part]), rank[owners[part]], pk.steps(who), size))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(pk.unpack(data)[0])


def _sent_again(sets: DataFrame, parts: int) -> DataFrame:
    """The same packets from stored sets (rep, n, hashes)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_unpacked(h) for h in batch.column("hashes").to_pylist()]
            if own:
                owners = np.repeat(np.arange(len(own)), [len(x) for x in own])
                yield _by_shingle([(np.concatenate(own), owners)], batch.column("rep").to_pylist(), batch.column("n").to_pylist(), parts)

    return sets.mapInArrow(send, pk.SCHEMA)


def _shared(payloads: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    """Shingles of a part that two documents have, sent back to the documents with their document frequency."""
    hashes, owners, sizes = [], [], []
    for data in payloads:
        h, rank, who, size = pk.unpack(data)
        hashes.append(np.cumsum(h))
        owners.append(np.cumsum(who)[rank])
        sizes.append(size[rank])
    hashes, owners, sizes = np.concatenate(hashes), np.concatenate(owners), np.concatenate(sizes)
    # a row that several tasks read is sent by each of them, and counts once
    order = np.lexsort((owners, hashes))
    order = order[np.append(True, (np.diff(hashes[order]) != 0) | (np.diff(owners[order]) != 0))]
    hashes, owners, sizes = hashes[order], owners[order], sizes[order]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    counts = np.diff(np.append(starts, len(hashes)))
    df = np.repeat(counts, counts).astype(np.uint32)
    shared = df > 1
    hashes, owners, sizes, df = hashes[shared], owners[shared], sizes[shared], df[shared]
    if len(hashes):
        spread = pk.by_id(owners)
        order = np.lexsort((hashes, spread))
        hashes, owners, sizes, df, spread = (x[order] for x in (hashes, owners, sizes, df, spread))

        def payload(part: slice) -> bytes:
            own = owners[part]
            new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            return pk.pack(own[new], np.diff(np.append(new, len(own))).astype(np.uint32), sizes[part][new], hashes[part], df[part])

        yield pk.cut_parts(spread, parts, payload)


def _candidates(payloads: list[bytes], per_cent: int) -> Iterator[pa.RecordBatch]:
    """Documents that share enough shingles for any partner: their shared shingles, sorted, and the short lists among them."""
    found: dict[int, list] = {}
    for data in payloads:
        who, counts, size, hashes, df = pk.unpack(data)
        ends = np.cumsum(counts, dtype=np.int64)
        for name, n, a, b in zip(who.tolist(), size.tolist(), (ends - counts).tolist(), ends.tolist()):
            found.setdefault(name, [n]).append((hashes[a:b], df[a:b]))
    columns: list[list] = [[], [], [], [], [], []]
    for name, (n, *chunks) in found.items():
        hashes, df = (np.concatenate(x) for x in zip(*chunks))
        need = -(-per_cent * n // 100)
        short = len(hashes) - need + 1  # the n - m shingles that nobody shares are the shortest lists
        if short < 1:
            continue
        order = np.lexsort((hashes, df))[:short]
        cells = np.minimum(np.bincount((hashes % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8)
        for column, value in zip(columns, (name, n, len(hashes), pk.pack(pk.steps(np.sort(hashes))), hashes[order].view(np.int64), cells.tobytes())):
            column.append(value)
    if columns[0]:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()))],
            ["rep", "n", "shared", "hashes", "short", "cells"],
        )


def possible(a: str, b: str, per_cent: int) -> Column:
    """Whether two documents can reach the similarity, from their sizes and how many of their shingles anyone shares."""
    least = F.least(F.col(f"{a}.shared"), F.col(f"{b}.shared"))
    return (100 + per_cent) * least >= per_cent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the bound: b's lists are probed for each shingle of a."""

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("ha", "hb"))
            sizes = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) * per_cent
            common = np.zeros(len(sizes), dtype=np.int64)
            for i in range(len(sizes)):
                x, y = _unpacked(left[i]), _unpacked(right[i])
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                common[i] = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
            ok = pa.array((100 + per_cent) * common >= sizes)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    # only sets that some pair names are moved, to their pairs
    one = pairs.join(sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha")), "a")
    other = pairs.join(sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb")), "b")
    return one.join(other, ["a", "b"]).select("a", "b", "na", "nb", "ha", "hb").mapInArrow(probed, "a long, b long")


def _across(short: DataFrame, sets: DataFrame, labels: DataFrame, per_cent: int) -> DataFrame:
    """Pairs from one short list that different components hold and whose sizes allow a link. A long list is dealt out
    by pairs of blocks, so no task sees more than two blocks at once."""
    held = short.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    lists = held.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    dealt = held.join(lists, "key").join(sets.select("rep", "cells"), "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    spread = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "comp", "n", "shared", "cells")

    def crossed(batch: pa.Table) -> pa.Table:
        own, i, j = (batch.column(c).to_numpy() for c in ("own", "i", "j"))
        rep, comp, n, shared = (batch.column(c).to_numpy() for c in ("rep", "comp", "n", "shared"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS)
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x in left:
            fit = right[(comp[right] != comp[x]) & ((100 + per_cent) * np.minimum(shared[right], shared[x]) >= per_cent * (n[right] + n[x]))]
            if i[0] == j[0]:
                fit = fit[rep[fit] > rep[x]]
            # shingles in common can't exceed, cell by cell, what either set has
            least = np.minimum(cells[fit], cells[x])
            most = np.where((least == 255).any(axis=1), np.minimum(shared[fit], shared[x]), least.sum(axis=1, dtype=np.int64))
            fit = fit[(100 + per_cent) * most >= per_cent * (n[fit] + n[x])]
            out_a.append(np.minimum(rep[fit], rep[x]))
            out_b.append(np.maximum(rep[fit], rep[x]))
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return cells.groupBy("key", "i", "j").applyInArrow(crossed, "a long, b long").distinct()


def similar_groups(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Sets are distinct shingles of ``width`` words (fewer words: the whole sequence), hashed to 64 bits. Documents link
    when intersection * 100 >= ``per_cent`` * union; component_id is the smallest doc_id that links reach. Null, empty
    and blank texts link with nothing; equal sets collapse into one class by a 128-bit digest first; rows with a null
    id, or repeating an id, are kept and a null id links with nothing. Other columns are ignored.

    1. One shuffle of all shingles finds those that two documents share; only these go back to their documents, and a
       document stays a candidate only if it shares as many as any partner needs. Candidates do the same once more, one
       for each set.
    2. Each short list pairs its members with its smallest member; verified pairs give components.
    3. Members of different components in one list are verified as well if their sizes, and the counts of their shingles
       by hash, allow enough overlap. Pairs inside a
       component can't change the result and are never made.
    """
    base = id_and_text(docs)
    parts = buckets_for(docs)
    classes = cut(set_classes(base, width))
    reps = cut(classes.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    named = cut(classes.join(reps, "digest", "left"))
    sent = _sent(base, width, parts)
    back = pk.exchanged(sent, parts, lambda found: _shared(found, parts), pk.SCHEMA)
    shape = "rep long, n long, shared long, hashes binary, short array<long>, cells binary"
    first = cut(pk.exchanged(back, parts, lambda found: _candidates(found, per_cent), shape).select(F.col("rep").alias("doc_id"), "n", "hashes"))
    # copies that met in different tasks become one set, and sharing is counted anew among what is left
    of = named.filter("rep IS NOT NULL").select("doc_id", "rep").distinct()
    chosen = cut(first.select("doc_id").distinct().join(of, "doc_id").groupBy("rep").agg(F.min("doc_id").alias("doc_id")))
    again = pk.exchanged(_sent_again(first.join(chosen, "doc_id"), parts), parts, lambda found: _shared(found, parts), pk.SCHEMA)
    sets = cut(pk.exchanged(again, parts, lambda found: _candidates(found, per_cent), shape))
    short = cut(sets.select("rep", "n", "shared", F.explode("short").alias("key")))
    hubs = short.groupBy("key").agg(F.min(F.struct("rep", "n", "shared")).alias("hub"), F.count("*").alias("size")).filter("size > 1").select("key", "hub")
    near = short.withColumn("me", F.struct("rep", "n", "shared")).join(hubs, "key").filter(F.col("me.rep") != F.col("hub.rep")).filter(possible("me", "hub", per_cent))
    stars = cut(near.select(F.col("hub.rep").alias("a"), F.col("me.rep").alias("b")).distinct())
    links = cut(verified(stars, sets, per_cent))
    labels = components(links).select(F.col("id").alias("rep"), F.col("component").alias("comp"))
    across = _across(short, sets, labels, per_cent).join(stars, ["a", "b"], "left_anti")
    more = verified(cut(across), sets, per_cent)
    final = components(links.unionByName(more)).withColumnRenamed("id", "rep")
    out = named.join(final, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
