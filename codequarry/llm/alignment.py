"""Alignment of two tokenizers by the bytes their tokens cover, as an Arrow pipeline.

Both tokenizers end a token wherever a space follows something that is not white space, so a text is a row of units and
its numbers are sums over them. A batch aligns its distinct units once: token lists are flattened with their parent
indices, token sizes become ends by segmented cumulative sums, and an Acero outer join on (unit, end) keys merges the
ends of both sides. An end that both have closes a group; each end stands for one link, that of the tokens over the
bytes before it. Pair counts of a batch are a ``Table.group_by``, and Spark adds them up.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from codequarry.llm import caches, packets as pk
from codequarry.llm.common import buckets_for
from codequarry.llm.tokens import byte_letters
from codequarry.session import cut

CHUNK_BYTES = 4 << 20
ENCODED = 8192  # units encoded at once, since their ids are Python numbers first
UNIT = re.compile(r"(?<=\S)(?= )")
#: A pickled tokenizer would forget how it treats special strings, so each process loads its own.
_SIDES: dict[str, Side] = caches.Local()


class Side:
    """One tokenizer: ids of units, and the bytes of each id. Units begin with a space."""

    def __init__(self, name: str):
        import public_tokenizers

        path = str(public_tokenizers.path(name) if not os.path.isabs(name) else name)
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            # the model adds the first space itself
            self.encode = lambda units: model.encode([u[1:] for u in units], num_threads=1)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            tokens = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda units: [e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            vocabulary = json.loads(tokenizer.to_str())["model"]["vocab"]
            value = {letter: byte for byte, letter in enumerate(byte_letters())}
            tokens = [b""] * (max(vocabulary.values()) + 1)
            for token, i in vocabulary.items():
                tokens[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.bytes = pa.array(tokens, pa.binary())
        self.sizes = pc.cast(pc.binary_length(self.bytes), pa.int64())


def side(name: str) -> Side:
    if name not in _SIDES:
        _SIDES[name] = Side(name)
    return _SIDES[name]


def units_of(text: str) -> list[str]:
    """Parts of space + text, each with the white space before it."""
    if "  " not in text and text[-1:] != " " and text.isascii() and not any(c in text for c in "\n\t\r\v\f\x1c\x1d\x1e\x1f"):
        return [" " + w for w in text.split(" ")]
    return UNIT.split(" " + text)


class Aligned:
    """The alignment of a list of units (CSR: links of unit i lie from ``link_ends[i - 1]`` to ``link_ends[i]``)."""

    def __init__(self, units: list[str], first: Side, second: Side):
        raw = pa.array([u.encode() for u in units], pa.binary())
        sizes = pc.cast(pc.binary_length(raw), pa.int64())
        self.good = np.ones(len(units), dtype=bool)
        flat, parents, ends = [], [], []
        for one in (first, second):
            lists = pa.concat_arrays([pa.array(one.encode(units[at : at + ENCODED]), pa.list_(pa.int32())) for at in range(0, max(len(units), 1), ENCODED)])
            ids, parent = pc.list_flatten(lists), pc.cast(pc.list_parent_indices(lists), pa.int64())
            self._check(raw, pc.take(one.bytes, ids), lists)
            # ends inside the unit: the running sum less what the units before it sum up to
            running = pc.cumulative_sum(pc.take(one.sizes, ids)) if len(ids) else pa.array([], pa.int64())
            totals = np.bincount(parent.to_numpy(), weights=pc.take(one.sizes, ids).to_numpy(), minlength=len(units)).astype(np.int64) if len(ids) else np.zeros(len(units), np.int64)
            before = pc.take(pa.array(np.cumsum(totals) - totals), parent)
            flat.append(ids)
            parents.append(parent)
            ends.append(pc.subtract(running, before))
        sound = pa.array(self.good)
        tables = []
        for ids, parent, end, name in zip(flat, parents, ends, "ab"):
            keep = pc.take(sound, parent)
            key = pc.add(pc.shift_left(parent, pa.scalar(32, pa.int64())), end)
            tables.append(pa.table({"key": key.filter(keep), name: ids.filter(keep)}))
        a, b = (t.append_column(f"{n}_at", pa.array(np.arange(t.num_rows))) for t, n in zip(tables, "ab"))
        both = a.join(b, keys="key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
        shared = pc.and_(pc.is_valid(both["a_at"]), pc.is_valid(both["b_at"])).combine_chunks()
        closing = both.filter(shared)
        # a token covers all ends up to its own: fill backwards
        self.a = pc.fill_null_backward(both["a"]).to_numpy()
        self.b = pc.fill_null_backward(both["b"]).to_numpy()
        unit = pc.shift_right(both["key"], pa.scalar(32, pa.int64())).to_numpy()
        self.n_links = np.bincount(unit, minlength=len(units))
        self.link_unit, self.link_ends = unit, np.cumsum(self.n_links)
        groups = pc.shift_right(closing["key"], pa.scalar(32, pa.int64())).to_numpy()
        self.n_groups = np.bincount(groups, minlength=len(units))
        self.n_a, self.n_b = (np.bincount(t["key"].to_numpy() >> 32, minlength=len(units)) for t in tables)
        written = [
            pc.binary_join(_lists(np.append(0, closing[f"{n}_at"].to_numpy() + 1), pc.cast(t[n].combine_chunks(), pa.string())), ",") for t, n in zip(tables, "ab")
        ]
        per_group = pc.binary_join_element_wise(*written, "|")
        self.text = pc.binary_join(_lists(np.append(0, np.cumsum(self.n_groups)), per_group), ";").to_pylist()

    def _check(self, raw: pa.Array, tokens: pa.Array, lists: pa.Array) -> None:
        """Units whose tokens do not give back their bytes are not good."""
        joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, tokens), b"")
        self.good &= pc.equal(joined, raw).to_numpy(zero_copy_only=False)


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


CHUNKS = "chunk string, docs binary, a array<int>, b array<int>, n array<long>"


def _chunk(name: str, rows: list[tuple[int | None, str]], first: Side, second: Side) -> pa.RecordBatch:
    """The documents of a chunk as units, its units as links, and its pairs of ids with their partial counts."""
    number: dict[str, int] = defaultdict(count().__next__)
    own = [np.fromiter(map(number.__getitem__, units), dtype=np.int64, count=len(units)) for units in (units_of(t) if t else [] for _, t in rows)]
    aligned = Aligned(list(number), first, second)
    if not aligned.good.all():
        # such a text is aligned as a whole: if it does not come back either, it has no tokens
        doubtful = [i for i, u in enumerate(own) if not aligned.good[u].all()]
        fresh = {i: number[" " + rows[i][1]] for i in doubtful}
        aligned = Aligned(list(number), first, second)
        for i, unit in fresh.items():
            own[i] = np.array([unit] if aligned.good[unit] else [], dtype=np.int64)
    sizes = np.array([len(u) for u in own], dtype=np.int64)
    flat = np.concatenate(own) if own else np.empty(0, np.int64)
    ends = np.cumsum(sizes)

    def per_doc(values: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values[flat], dtype=np.int64))
        return total[ends] - total[ends - sizes]

    digests = [hashlib.sha256(";".join([aligned.text[i] for i in u.tolist()]).encode()).digest() if len(u) else bytes(32) for u in own]
    pair = pc.dictionary_encode(pa.array(aligned.a.astype(np.int64) << 32 | aligned.b))
    times = np.bincount(flat, minlength=len(number))
    links = pa.table({"pair": pair.indices, "n": pa.array(times[aligned.link_unit])})
    counts = links.group_by("pair", use_threads=False).aggregate([("n", "sum")]).sort_by("pair")
    ids, null = np.array([0 if d is None else d for d, _ in rows], dtype=np.int64), np.array([d is None for d, _ in rows], dtype=np.uint8)
    docs = pk.pack(
        ids, null, *(per_doc(x) for x in (aligned.n_a, aligned.n_b, aligned.n_groups, aligned.n_links)), np.frombuffer(b"".join(digests), dtype=np.uint8),
        sizes, flat.astype(np.uint32), aligned.n_links.astype(np.uint32), pair.indices.to_numpy().astype(np.uint32),
    )
    pairs = pair.dictionary.to_numpy()
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([docs], pa.binary()), pa.array([pairs >> 32], pa.list_(pa.int32())), pa.array([pairs & 0xFFFFFFFF], pa.list_(pa.int32())), pa.array([counts["n_sum"].to_numpy()], pa.list_(pa.int64()))],
        ["chunk", "docs", "a", "b", "n"],
    )


def _chunks(docs: DataFrame, first: str, second: str) -> DataFrame:
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, task, number = (side(first), side(second)), TaskContext.get().partitionId(), count()
        rows: list[tuple[int | None, str]] = []
        size = 0
        for doc_id, text in chain.from_iterable(zip(b.column("doc_id").to_pylist(), b.column("text")) for b in batches):
            text = text.as_py() or ""
            rows.append((doc_id, text))
            size += len(text) + 64
            if size > CHUNK_BYTES:
                yield _chunk(f"{task}-{next(number)}", rows, *sides)
                rows, size = [], 0
                pa.default_memory_pool().release_unused()
        if rows:
            yield _chunk(f"{task}-{next(number)}", rows, *sides)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(aligned, CHUNKS)


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, told in zip(batch.column("docs"), batch.column("told")):
            ids, null, n_a, n_b, n_groups, n_links, sha, sizes, flat, per_unit, pair = pk.unpack(data.as_py())
            told = told.values if told.is_valid else pa.array([], pa.struct([("at", pa.int32()), ("n", pa.int64()), ("best", pa.bool_())]))
            at, n, best = (told.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            values = np.zeros((2, len(at) + 1), dtype=np.int64)
            values[0, at], values[1, at] = best, n
            ends, edges = np.cumsum(sizes), np.cumsum(per_unit, dtype=np.int64)
            sums = []
            for value in values:
                run = np.append(0, np.cumsum(value[pair]))
                unit = run[edges] - run[edges - per_unit]
                run = np.append(0, np.cumsum(unit[flat] if len(flat) else unit[:0]))
                sums.append(run[ends] - run[ends - sizes])
            digest = sha.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, mask=null.astype(bool)), *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links, *sums)),
                    pa.array([digest[64 * i : 64 * i + 64] if n else "" for i, n in enumerate(n_a.tolist())]),
                ],
                [c.split()[0] for c in OUT.split(", ")],
            )


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(a, b, n, best): links of each pair of ids in the corpus, and whether no other first id is linked more often with b."""
    each = chunks.select(F.explode(F.arrays_zip("a", "b", "n")).alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.n").alias("n"))
    counts = cut(each)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    ``first`` encodes space + text, ``second`` the text, to which it adds the space; special strings are plain text. Texts
    that are null or empty, or that the joined token bytes do not give back, have no tokens: zeros and ''. Tokens of both
    sides whose bytes overlap are linked; bytes where both end tokens part groups. A pair's count is the number of its
    links in all texts; n_best counts the links whose pair has the largest count of its second id (ties included),
    count_sum adds up the counts of all links. Repeated rows and null ids are rows like others; other columns are ignored;
    an empty table gives no rows.
    """
    chunks = cut(_chunks(docs, first, second))
    wanted = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b")).alias("at", "x")).select("chunk", "at", "x.a", "x.b")
    told = wanted.join(pair_counts(chunks), ["a", "b"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "best")).alias("told"))
    return chunks.select("chunk", "docs").join(told, "chunk", "left").select("docs", "told").mapInArrow(_summed, OUT)
