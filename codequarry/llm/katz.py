"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

The texts are read once and stored as packets of some megabytes. A packet sends its distinct words, later its distinct
n-grams, with their training counts, to parts by word or context; there counts are added up, and each packet gets back the
counts of what it sent, in the order it was sent, with a number for each word and the sums of each context. Probabilities
follow from these answers token by token, from the unigrams up. Once words have numbers, small for frequent words, the
packets are stored again as such, and n-grams travel as sorted numbers. All orders but the first send along what the
probability of the shorter history follows from, for n-grams of training texts: the weights need it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from codequarry.llm import packets as pk, words
from codequarry.llm.common import buckets_for, id_and_text
from codequarry.session import cut, drop_cut

#: Bytes of text in a packet, whose tokens a task holds as arrays.
PACKET_BYTES = 4 << 20
SCHEMA = "part long, payload binary"
#: Counts up to this one are discounted.
CUTOFF = 5
END, BEGIN = np.uint64(0x5E3D00000000000D), np.uint64(0xB6E91000000000B1)
#: A context with more than this share of a part's mean tokens is dealt out by n-gram.
HOT_SHARE = 0.125
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Packets that are no answers: for hot contexts, for counts of counts, for a stored model.
HOT, COUNTS, MODEL = -1, -2, -3


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is kept from training; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def discounts(n: np.ndarray) -> np.ndarray:
    """What stays of counts 1 to CUTOFF, from the numbers of types seen 1 to CUTOFF+1 times. Where Good-Turing's ratios
    leave (0, 1), as on tiny corpora, half a count is taken instead."""
    r = np.arange(1, CUTOFF + 1, dtype=np.float64)
    n = n.astype(np.float64)
    if (n > 0).all():
        common = (CUTOFF + 1) * n[CUTOFF] / n[0]
        d = ((r + 1) * n[1:] / n[:-1] / r - common) / (1 - common) if common != 1 else np.zeros(CUTOFF)
        if ((d > 0) & (d < 1)).all():
            return d
    return (r - 0.5) / r


class Tokens:
    """The texts of a packet as hashed tokens, an end after each text."""

    def __init__(self, texts: Iterable[bytes | tuple]):
        """From (ids, flags, sizes in bytes, bytes of the texts), packed or not; flags: 1 held out, 2 null id."""
        ids, flags, hashes, counts = [], [], [], []
        for data in texts:
            own, flag, sizes, body = data if isinstance(data, tuple) else pk.unpack(data)
            raw, at, found = body.tobytes(), 0, []
            for n in sizes.tolist():
                found.append(raw[at : at + n].decode())
                at += n
            for _, some, count in words.grouped(found):
                hashes.append(np.insert(some, np.cumsum(count), END))
                counts.append(count + 1)
            ids.append(own)
            flags.append(flag)
        none = np.empty(0, np.int64)
        vocabulary, index = np.unique(np.concatenate(hashes or [none.astype(np.uint64)]), return_inverse=True)
        self._hold(np.concatenate(ids or [none]), np.concatenate(flags or [none.astype(np.uint8)]), np.concatenate(counts or [none]), vocabulary, index)

    def _hold(self, ids: np.ndarray, flags: np.ndarray, counts: np.ndarray, vocabulary: np.ndarray, index: np.ndarray) -> None:
        self.ids, self.flags, self.counts, self.vocabulary, self.index = ids, flags, counts, vocabulary, index.astype(np.int64)
        self.words = self.grams = vocabulary[index]
        self.first = np.cumsum(counts) - counts
        self.at = np.arange(len(index)) - np.repeat(self.first, counts)
        self.train = np.repeat((flags & 1) == 0, counts)
        self.order = 1

    @classmethod
    def load(cls, data: bytes) -> Tokens:
        """From a packet in which words are places in a vocabulary of hashes or, with their training counts, of numbers."""
        tokens = cls(())
        ids, flags, counts, index, vocabulary, *word_counts = pk.unpack(data)
        if word_counts:
            tokens.numbers, tokens.word_counts = np.cumsum(vocabulary, dtype=np.uint32), word_counts[0].astype(np.int64)
            vocabulary = pk.mix(tokens.numbers.astype(np.uint64))
        tokens._hold(ids, flags, counts, vocabulary, index)
        return tokens

    def stored(self) -> bytes:
        """A packet in which words are places in a vocabulary of hashes, the frequent ones first."""
        order = np.argsort(-np.bincount(self.index, minlength=len(self.vocabulary)), kind="stable")
        return self._stored(order, self.vocabulary[order])

    def _stored(self, order: np.ndarray, *vocabulary: np.ndarray) -> bytes:
        place = np.empty(len(order), np.uint16 if len(order) < 1 << 16 else np.uint32)
        place[order] = np.arange(len(order))
        return pk.pack(self.ids, self.flags, self.counts, place[self.index], *vocabulary)

    def asked(self, me: int, parts: int) -> pa.RecordBatch:
        """The words with their training counts, by word."""
        order = np.argsort(self.vocabulary)
        hashes, counts = self.vocabulary[order], np.bincount(self.index, weights=self.train, minlength=len(order)).astype(np.uint32)[order]
        edges = pk.borders(hashes, parts)
        cuts = [(p, slice(edges[p], edges[p + 1])) for p in range(parts) if edges[p] < edges[p + 1]]
        return pk.rows([(p, pk.pack(np.array([me, p]), pk.steps(hashes[c]), counts[c])) for p, c in cuts])

    def numbered(self, answers: list[bytes]) -> bytes:
        """A packet in which words are places in a vocabulary of numbers, the answers to what was asked."""
        order = np.argsort(self.vocabulary)
        _, numbers, counts = (np.concatenate(x) for x in zip(*sorted(map(pk.unpack, answers), key=lambda a: int(a[0][1]))))
        by_number = np.argsort(numbers)
        return self._stored(order[by_number], pk.steps(numbers[by_number]), counts[by_number])

    def step(self) -> np.ndarray:
        """The contexts of the next order; ``grams`` move on to it."""
        context = np.empty_like(self.grams)
        context[1:] = self.grams[:-1]
        context[self.first] = BEGIN
        self.grams = pk.mix(context * np.uint64(0x9FB21C651E98DF25) + self.words)
        self.order += 1
        return context

    def histories(self, tokens: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
        """The words before some tokens, as many as the order has, the farthest first; 0 stands for what is before a text."""
        return [np.where(self.at[tokens] >= back, numbers[self.index[np.maximum(tokens - back, 0)]], 0) for back in range(self.order - 1, 0, -1)]


class Request:
    """The distinct n-grams of a packet in the order they are sent, by place of their counts.

    An n-gram whose context training has never seen is not sent: it has no count, and its context leaves the shorter
    history as it is. N-grams go to the part of their context, those of a hot context to their own parts. In a part they are sorted
    by their words, the last one of the context first, so that n-grams of a context are a run, and so are the contexts
    that share their shorter one.
    """

    def __init__(self, tokens: Tokens, context: np.ndarray, context_count: np.ndarray, hot_from: float, parts: int):
        hot = (context_count > hot_from) | (context == BEGIN)
        sent = np.flatnonzero((context_count > 0) | hot)
        keys = [tokens.index[sent] + 1, *tokens.histories(sent, np.arange(1, len(tokens.vocabulary) + 1))]
        bits = int(len(tokens.vocabulary) + 1).bit_length()
        if bits * len(keys) < 64:
            sent = sent[np.argsort(sum(k.astype(np.uint64) << np.uint64(bits * i) for i, k in enumerate(keys)))]
        else:
            sent = sent[np.lexsort(keys)]
        g = tokens.grams[sent]
        new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)
        which, one = np.cumsum(new) - 1, sent[new]
        part = pk.part_of(np.where(hot[one], g[new], pk.mix(context[one])), parts)
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of = np.full(len(context), len(order), np.int64)  # token -> n-gram, or the place after the last
        self.of[sent] = place[which]
        self.one = one[order]  # n-gram -> one of its tokens
        self.hot, self.context = hot[self.one], context[self.one]
        self.counts = np.bincount(self.of[sent], weights=tokens.train[sent], minlength=len(order)).astype(np.uint32)
        self.edges = np.searchsorted(part[order], np.arange(parts + 1))
        opens = np.concatenate([[True], self.context[1:] != self.context[:-1]]) if len(order) else np.empty(0, bool)
        opens[self.edges[:-1][self.edges[:-1] < len(order)]] = True
        self.runs = np.flatnonzero(opens)

    def packets(self, tokens: Tokens, count: np.ndarray, whole: np.ndarray, me: int, parts: int) -> pa.RecordBatch:
        """``count`` and ``whole`` are those of the tokens with their shorter histories."""
        found, run_edges = [], np.searchsorted(self.runs, self.edges)
        lengths, last = np.diff(np.append(self.runs, len(self.one))).astype(np.uint32), tokens.numbers[tokens.index[self.one]]
        first = self.one[self.runs]
        histories = [h.astype(np.uint32) for h in tokens.histories(first, tokens.numbers)]
        count, whole = count[self.one].astype(np.uint32), whole[first].astype(np.uint32)
        for p in range(parts):
            part, run = slice(self.edges[p], self.edges[p + 1]), slice(run_edges[p], run_edges[p + 1])
            if part.start == part.stop:
                continue
            hot = self.hot[self.runs[run]]
            contexts, code = np.unique(self.context[self.runs[run]][hot], return_inverse=True)
            codes = np.zeros(len(hot), np.uint32)
            codes[hot] = code + 1
            *far, near = (h[run] for h in histories)
            shorter = whole[run][_changes([*far[1:], near] if far else [], len(near))]
            own = self.counts[part]
            found.append((p, pk.pack(np.array([me, p]), lengths[run], codes, contexts, last[part], own, count[part][own > 0], shorter, pk.steps(near), *far)))
        return pk.rows(found)

    def answered(self, answers: list[list[np.ndarray]], hot_sums: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The counts of the n-grams and, for each, the sums of its context: CUTOFF numbers of n-grams, what tokens are divided by,
        shorter probabilities. Where a context has no n-gram without count here, only the second is told. Zeros follow, for the
        n-grams that are not sent."""
        counts, sums = np.zeros(len(self.one) + 1, np.int64), np.zeros((len(self.one) + 1, CUTOFF + 2))
        if answers:
            _, count, whole, *own = (np.concatenate(x) for x in zip(*sorted(answers, key=lambda a: int(a[0][1]))))
            counts[:-1] = count
            of_run = np.zeros((len(self.runs), CUTOFF + 2))
            plain = np.flatnonzero(~self.hot[self.runs])
            of_run[plain, CUTOFF] = whole
            told = plain[np.add.reduceat(count == 0, self.runs, dtype=np.int64)[plain] > 0]
            for i, x in zip([*range(CUTOFF), CUTOFF + 1], own):
                of_run[told, i] = x
            sums[:-1] = np.repeat(of_run, np.diff(np.append(self.runs, len(self.one))), axis=0)
        hot = np.flatnonzero(self.hot)
        if len(hot):
            sums[hot] = hot_sums[1][np.searchsorted(hot_sums[0], self.context[hot])]
        return counts, sums


def _changes(history: list[np.ndarray], n: int) -> np.ndarray:
    """Which of ``n`` contexts begin another shorter one."""
    out = np.zeros(n, bool)
    out[:1] = True
    for h in history:
        out[1:] |= h[1:] != h[:-1]
    return out


def _rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())], ["part", "payload"])


def _stored(docs: DataFrame) -> DataFrame:
    """Packets of tokens, each with a number of its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number, size = TaskContext.get().partitionId() << 32, 0

        def packet() -> pa.RecordBatch:
            return _rows([(number, Tokens(held).stored())])

        for batch in batches:
            ids = np.array(batch.column("doc_id").fill_null(0).to_pylist(), dtype=np.int64)
            flags = np.array(batch.column("flags").to_pylist(), dtype=np.uint8)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            at = 0
            while at < len(ids):
                # documents until the packet is full, one at least
                end = at + 1 + int(np.searchsorted(np.cumsum(sizes[at:]), PACKET_BYTES - size))
                own = slice(at, end)
                held.append((ids[own], flags[own], sizes[own], np.frombuffer(b"".join(texts[own]), dtype=np.uint8)))
                size, at = size + int(sizes[own].sum()), end
                if size >= PACKET_BYTES:
                    yield packet()
                    held, number, size = [], number + 1, 0
        if held:
            yield packet()

    return docs.mapInArrow(read, SCHEMA)


def _word_counts(stored: DataFrame, gram_parts: int) -> DataFrame:
    """Packets of words with their training counts, by word."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for me, data in zip(batch.column("part").to_pylist(), batch.column("payload")):
                yield Tokens.load(data.as_py()).asked(me, gram_parts)

    return stored.mapInArrow(send, pk.SCHEMA)


def _by_packet(stored: DataFrame, answers: DataFrame, tasks: int, work: Callable[[int, list[bytes], bytes], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work(number, answers, packet)`` for each packet of tokens."""
    both = answers.withColumn("late", F.lit(0)).unionByName(stored.withColumn("late", F.lit(1)))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for part, late, data in zip(batch.column("part").to_pylist(), batch.column("late").to_pylist(), batch.column("payload")):
                if late:
                    own, held = held, []
                    yield from work(part, own, data.as_py())
                else:
                    held.append(data.as_py())

    return both.repartition(tasks, "part").sortWithinPartitions("part", "late").mapInArrow(told, schema)


def _counts_of_counts(counts: np.ndarray) -> bytes:
    small = np.bincount(np.minimum(counts, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]
    return pk.pack(np.append(small, [counts.sum(), np.count_nonzero(counts)]).astype(np.int64))


def _unigrams(payloads: list[bytes], keep: bool, parts: int) -> Iterator[pa.RecordBatch]:
    """Words added up and numbered, frequent ones first; each packet gets numbers and counts of its words."""
    senders, hashes, counts = [], [], []
    for data in payloads:
        head, w, c = pk.unpack(data)
        senders.append((int(head[0]), int(head[1]), len(w)))
        hashes.append(np.cumsum(w))
        counts.append(c)
    known, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(counts), minlength=len(known)).astype(np.int64)
    numbers = np.empty(len(known), np.uint32)
    numbers[np.argsort(-total, kind="stable")] = np.arange(len(known)) * parts + senders[0][1] + 1
    found = [(COUNTS, _counts_of_counts(total))]
    if keep:
        found.append((MODEL, pk.pack(known, numbers, total)))
    start = 0
    for me, p, n in senders:
        own = which[start : start + n]
        found.append((me, pk.pack(np.array([1, p]), numbers[own], total[own].astype(np.uint32))))
        start += n
    yield _rows(found)


def _key(history: list[np.ndarray]) -> np.ndarray:
    """A context as one number: two words fit into it, longer ones are hashed."""
    key = history[0].astype(np.uint64)
    for i, x in enumerate(history[1:], 2):
        key = (key << np.uint64(32)) | x if i == 2 else pk.mix(key * np.uint64(0x9FB21C651E98DF25) + x)
    return key


def _totals(payloads: list[bytes], keep: bool, order_of: int, kept: np.ndarray) -> Iterator[pa.RecordBatch]:
    """N-grams of an order added up by context; each packet gets the counts of its n-grams and, in the order of their
    contexts, what tokens are divided by. For contexts with n-grams that no training text has it also gets the sums that the weight
    needs: n-grams seen 1 to CUTOFF times, their shorter probabilities. ``kept`` is what the shorter order keeps of counts."""
    columns: list[list] = [[], [], [], [], [], []]
    senders = []
    for data in payloads:
        head, lengths, code, contexts, last, count, lower_count, shorter, near, *far = pk.unpack(data)
        near = np.cumsum(near, dtype=np.uint32)
        history = [*far, near]
        whole = np.repeat(np.maximum(shorter[np.cumsum(_changes(history[1:], len(near))) - 1], 1), lengths)
        lower = np.zeros(len(last))
        lower[count > 0] = kept[np.minimum(lower_count, CUTOFF + 1) - 1] * lower_count / whole[count > 0]
        senders.append((int(head[0]), int(head[1]), len(last), len(lengths)))
        hot = np.append(contexts, np.uint64(0))[code.astype(np.int64) - 1]
        for column, x in zip(columns, (_key(history), lengths, np.where(code > 0, hot, np.uint64(0)), last, count, lower)):
            column.append(x)
    key, lengths, hot, last, count, lower = (np.concatenate(x) for x in columns)
    contexts, one, of_run = np.unique(key, return_index=True, return_inverse=True)
    hot = hot[one]  # a context is hot for all who send it
    gram = (np.repeat(of_run, lengths).astype(np.uint64) << np.uint64(32)) | last
    order = np.argsort(gram)
    g = gram[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    at = np.flatnonzero(new)
    total = np.add.reduceat(count[order].astype(np.int64), at)
    which = np.empty(len(g), np.int64)
    which[order] = np.cumsum(new) - 1
    k = (g[at] >> np.uint64(32)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))  # n-gram where each context begins
    small = [np.add.reduceat((total == r).astype(np.int64), begins) for r in range(1, CUTOFF + 1)]
    tokens = np.add.reduceat(total, begins)
    # those who saw an n-gram in training agree on its shorter probability, others sent none
    shorter = np.add.reduceat(np.maximum.reduceat(lower[order], at), begins)
    whole = _whole(small, tokens).astype(np.uint32)
    found = [(COUNTS, _counts_of_counts(total))]
    if keep:
        seen = total > 0
        found.append((MODEL, pk.pack(contexts[k[seen]], g[at][seen] & np.uint64(0xFFFFFFFF), total[seen])))
    is_hot = hot > 0
    if is_hot.any():
        found.append((HOT, pk.pack(hot[is_hot], *(s[is_hot] for s in (*small, tokens, shorter)))))
    first = np.cumsum(lengths, dtype=np.int64) - lengths
    start = run = 0
    for me, p, n, runs in senders:
        own, mine = total[which[start : start + n]], of_run[run : run + runs]
        plain = ~is_hot[mine]
        told = mine[plain & (np.add.reduceat(own == 0, first[run : run + runs] - start, dtype=np.int64) > 0)]
        found.append((me, pk.pack(np.array([order_of, p]), own.astype(np.uint32), whole[mine[plain]], *(s[told].astype(np.uint32) for s in small), shorter[told])))
        start, run = start + n, run + runs
    yield _rows(found)


def _whole(small: Sequence[np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """What the tokens of a context are divided by. One that only has counts above the cutoff gets one more token."""
    return tokens + (sum(small) == 0)


class Level:
    """What holds for a whole order: numbers of n-grams seen 1 to CUTOFF+1 times, tokens, n-grams; sums of hot contexts."""

    def __init__(self, numbers: list[int], hot: list[tuple]):
        self.numbers, self.tokens, self.types = np.array(numbers[:-2]), numbers[-2], numbers[-1]
        self.kept = np.append(discounts(self.numbers), 1.0)
        rows = sorted((np.uint64(int(h[0]) % (1 << 64)), *h[1:]) for h in hot)
        sums = np.array([r[1:] for r in rows], np.float64).reshape(-1, CUTOFF + 2)
        sums[:, CUTOFF] = _whole(sums[:, :CUTOFF].T, sums[:, CUTOFF])
        self.hot = np.array([r[0] for r in rows], np.uint64), sums

    def discounted(self, counts: np.ndarray, small: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a seen n-gram, what its context leaves to unseen ones). A context that only has counts above the
        cutoff leaves what one more token would take."""
        r = np.arange(1, CUTOFF + 1)
        left, whole = small @ (r * (1 - self.kept[:CUTOFF])), np.maximum(whole, 1)
        return self.kept[np.clip(counts, 1, CUTOFF + 1) - 1] * counts / whole, np.where(left > 0, left, 1.0) / whole


def probabilities(tokens: Tokens, answers: list[bytes], levels: list[Level], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(training count of each word; of each n-gram of the last order its count, what its context divides by, its probability), by
    recursion from unigrams up."""
    by_order: dict[int, list] = {}
    for data in answers:
        head, *rest = pk.unpack(data)
        by_order.setdefault(int(head[0]), []).append([head, *rest])
    word_counts = tokens.word_counts[tokens.index]
    first = levels[0]
    numbers = first.numbers[:CUTOFF]
    whole = np.full(len(word_counts), _whole(numbers, first.tokens))
    seen, left = first.discounted(word_counts, numbers.reshape(1, -1), whole[:1])
    p, count = np.where(word_counts > 0, seen, left), word_counts
    for m, level in enumerate(levels[1:], 2):
        request = _request(tokens, count, levels, parts)
        gram_counts, sums = request.answered(by_order.get(m, []), level.hot)
        counts, sums = gram_counts[request.of], sums[request.of]
        seen, left = level.discounted(counts, sums[:, :CUTOFF], sums[:, CUTOFF])
        back = np.where(sums[:, CUTOFF] > 0, left / np.maximum(1 - sums[:, CUTOFF + 1], 1e-15), 1.0) * p
        p, count, whole = np.where(counts > 0, seen, back), counts, sums[:, CUTOFF]
    return word_counts, count, whole, p


def _request(tokens: Tokens, count: np.ndarray, levels: list[Level], parts: int) -> Request:
    context = tokens.step()
    before = np.zeros(len(count), np.int64)
    before[1:] = count[:-1]
    return Request(tokens, context, before, HOT_SHARE * levels[0].tokens / parts, parts)


def _asked(me: int, held: list[bytes], stored: bytes, levels: list[Level], parts: int) -> Iterator[pa.RecordBatch]:
    tokens = Tokens.load(stored)
    _, count, whole, _ = probabilities(tokens, held, levels, parts)
    yield _request(tokens, count, levels, parts).packets(tokens, count, whole, me, parts)


def _scored(held: list[bytes], stored: bytes, levels: list[Level], parts: int) -> Iterator[pa.RecordBatch]:
    tokens = Tokens.load(stored)
    counts, _, _, p = probabilities(tokens, held, levels, parts)
    n, v = levels[0].tokens, levels[0].types
    base = np.add.reduceat(np.log10((counts + 1) / (n + v + 1)), tokens.first)
    score, known = np.add.reduceat(np.log10(p), tokens.first), np.add.reduceat((counts > 0).astype(np.int64), tokens.first)
    ids = pa.array(tokens.ids, mask=tokens.flags & 2 > 0)
    yield pa.RecordBatch.from_arrays(
        [ids, pa.array(tokens.flags & 1 > 0), pa.array(tokens.counts), pa.array(known), pa.array(np.full(len(base), n, np.int64)), pa.array(base), pa.array(score)],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def _level(table: DataFrame) -> Level:
    """One row of sums, and a row for each hot context, of which there are at most 1 / HOT_SHARE for each part."""
    width, sums = CUTOFF + 3, CUTOFF + 2

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([pk.unpack(x)[0] for x in batch.column("payload").to_pylist()], dtype=np.int64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(width)], [f"n{i}" for i in range(width)])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("payload").to_pylist():
                key, *own = pk.unpack(x)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(o.astype(np.float64)) for o in own)], ["key", *(f"s{i}" for i in range(sums))])

    counted = table.filter(F.col("part") == COUNTS).select("payload").mapInArrow(numbers, ", ".join(f"n{i} long" for i in range(width)))
    row = counted.agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(width))).head()
    hot = table.filter(F.col("part") == HOT).select("payload").mapInArrow(contexts, "key long, " + ", ".join(f"s{i} double" for i in range(sums)))
    return Level(list(row), [tuple(r) for r in hot.groupBy("key").agg(*(F.sum(f"s{i}") for i in range(sums))).collect()])


def katz_scores(docs: DataFrame, order: int = 2, folds: int = 7, fold: int = 2, model_path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on documents with crc32(doc_id as text) % ``folds`` <> ``fold`` and scores all, whole. Words are runs without
    ASCII white space, A-Z lower-cased, and every text ends in one end token, so null and empty texts are one token.
    ``score`` is the log10 probability of the text: counts up to 5 keep what Good-Turing leaves them, and what a context
    frees is spread over unseen words in proportion to their shorter history, so that each context sums to one over the
    known words and one unknown word. ``base_score`` is the add-one unigram baseline. Repeated rows count as often as they
    occur; a null id trains; other columns are ignored; an empty table gives no rows. An empty training set makes every
    word unknown. With ``model_path`` the n-grams of all orders (context, n-gram, count) are stored there as packets.

    A packet of documents (``PACKET_BYTES``, or one longer text) is held in memory at a time.
    """
    gram_parts = buckets_for(docs)
    flags = F.when(held_out(F.col("doc_id"), folds, fold), 1).otherwise(0) + F.when(F.col("doc_id").isNull(), 2).otherwise(0)
    base = id_and_text(docs).withColumn("flags", flags)
    keep = model_path is not None
    hashed = cut(_stored(base))
    words_seen = cut(pk.exchanged(_word_counts(hashed, gram_parts), gram_parts, lambda x: _unigrams(x, keep, gram_parts), SCHEMA), drop_shuffles=True)
    levels, tables = [_level(words_seen)], []
    numbered = lambda me, held, own: iter([_rows([(me, Tokens.load(own).numbered(held))])])
    stored = cut(_by_packet(hashed, words_seen.filter(F.col("part") >= 0), gram_parts, numbered, SCHEMA), drop_shuffles=True)
    if keep:
        _model(words_seen, f"{model_path}/order=1")
    drop_cut(hashed)
    drop_cut(words_seen)

    def by_packet(work: Callable, schema: str) -> DataFrame:
        answers = [table.filter(F.col("part") >= 0) for table in tables]
        return _by_packet(stored, reduce(DataFrame.unionByName, answers, stored.limit(0)), gram_parts, work, schema)

    for m in range(2, order + 1):
        asked = by_packet(lambda me, held, own, known=tuple(levels): _asked(me, held, own, list(known), gram_parts), pk.SCHEMA)
        totals = lambda x, m=m, kept=levels[-1].kept: _totals(x, keep, m, kept)
        tables.append(cut(pk.exchanged(asked, gram_parts, totals, SCHEMA), drop_shuffles=True))
        levels.append(_level(tables[-1]))
        if keep:
            _model(tables[-1], f"{model_path}/order={m}")
    return by_packet(lambda me, held, own: _scored(held, own, levels, gram_parts), OUT)


def _model(table: DataFrame, path: str) -> None:
    table.filter(F.col("part") == MODEL).select("payload").write.parquet(path)
