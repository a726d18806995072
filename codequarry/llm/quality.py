"""Quality classifier by co-training a text view and a page-metadata view.

Each view is a small logistic model. Over some rounds each gives the other the unlabelled documents it is most sure of;
then both are calibrated on labelled documents that neither was trained on, and combined. Training sees a bounded sample of
the labelled documents and, in each round, all unlabelled ones; scoring reads all documents and is map-only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from codequarry.llm import packets as pk, words
from codequarry.llm.caches import claim
from codequarry.llm.common import id_and_text
from codequarry.session import cut

#: Words and beginnings of words are hashed to so many slots each; a beginning has so many bytes.
SLOTS, BEGINNING = 1 << 19, 5
GROUP_BYTES = 1 << 19
#: A slot counts once this many training documents hold it.
LEAST_DOCS = 4
BORDERS = (4.0, 8.0, 16.0)
#: Weights of slots are found on other folds than the documents they describe.
FOLDS = 4
#: Candidates for pseudo-labels are ranked in so many shares first.
SHARES = 64
#: Metadata categories are hashed to so many columns.
CATEGORIES = 64
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_SIGN = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
#: Signs that lay out tables, shout, decorate, or end sentences.
SIGN_KINDS = (b"|", b"!", b"#$%&*=~^+", b".,;:?")
_GAPS = _SPACE | _SIGN | (np.arange(256) < 32)


def slots_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots of the words, then of their beginnings; where each word starts; whether it repeats one of the two before it)."""
    whole, starts = words.hashed(data, _GAPS)
    begin, _ = words.hashed(data, _GAPS, BEGINNING)
    again = np.zeros(len(whole), dtype=bool)
    again[1:] |= whole[1:] == whole[:-1]
    again[2:] |= whole[2:] == whole[:-2]
    return np.concatenate([whole >> np.uint64(46), (begin >> np.uint64(46)) + np.uint64(SLOTS // 2)]).astype(np.int64), starts, again


def text_features(slots: np.ndarray, counts: np.ndarray, weights: list[np.ndarray], owners: np.ndarray, total: np.ndarray) -> np.ndarray:
    """For each text, of ``total`` slots, and each table of weights: the mean, the largest, and how many lie beyond each border;
    before them the size, since a long text reaches borders by chance. Slots without weight may be left out."""
    n, total = len(total), np.maximum(total, 1)
    columns = [np.log1p(total)]
    runs = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))  # slots of a text lie together, in one or two runs
    for table in weights:
        w = table[slots]
        most = np.zeros(n)
        if len(w):
            np.maximum.at(most, owners[runs], np.maximum.reduceat(w, runs))
        columns += [np.bincount(owners, w * counts, n) / total, most]
        columns += [np.log1p(np.bincount(owners, counts * (w >= border), n)) for border in BORDERS]
    return np.column_stack(columns)


def layout(b: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What a crawler's page record says of a text without reading its words: size, lines, words and kinds of signs."""
    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask))
        return (sums[begins + sizes] - sums[begins]).astype(np.float64)

    space = _SPACE[b]
    starts = np.append(~space[:1], space[:-1] & ~space[1:]) if len(b) else space
    n, lines, words = np.maximum(sizes, 1), share(b == 10) + 1, np.maximum(share(starts), 1)
    repeated = share(np.append(np.zeros(min(len(b), 1), bool), b[1:] == b[:-1])) / n
    kinds = [np.log1p(share(np.isin(b, list(signs)))) - np.log1p(words) for signs in SIGN_KINDS]
    return np.column_stack([*kinds, np.log1p(sizes), np.log1p(lines), np.log1p(sizes / lines), sizes / words, share(_UPPER[b]) / n, share(_DIGIT[b]) / n, share(_SIGN[b]) / n, share(_SIGN[b]) / words, repeated])


def categories(values: list[list]) -> np.ndarray:
    out = np.zeros((len(values[0]), CATEGORIES))
    for column, own in enumerate(values):
        for i, value in enumerate(own):
            h = pk.mix(np.array([sum((column * 31 + 7) * 257**k + c for k, c in enumerate(str(value).encode()[:64])) % (1 << 64)], dtype=np.uint64))
            out[i, int(h[0] >> np.uint64(58))] = 1.0
    return out


class Logistic:
    """Logistic regression on standardised columns, by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])
        weight = np.ones(len(y)) if weight is None else weight
        penalty = np.full(a.shape[1], ridge)
        penalty[-1] = 1e-6
        self.beta = np.zeros(a.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ self.beta, -30, 30)))
            gradient = a.T @ (weight * (y - p)) - penalty * self.beta
            hessian = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            self.beta += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))]) @ self.beta


def slot_weights(good: np.ndarray, bad: np.ndarray, a: int, b: int) -> np.ndarray:
    """How surely a slot speaks for bad documents: the difference of its shares in standard errors."""
    p = (good + bad + 0.5) / (a + b + 1)
    z = (bad / max(b, 1) - good / max(a, 1)) / np.sqrt(p * (1 - np.minimum(p, 0.999)) * (1 / max(a, 1) + 1 / max(b, 1)))
    return np.where(good + bad >= LEAST_DOCS, np.clip(z, -30, 30), 0.0).astype(np.float32)


class TextView:
    """Which words speak for which kind of bad document, and a logistic model on what a text has of them."""

    def __init__(self, sample: "Sample", rows: np.ndarray, y: np.ndarray):
        fold = np.arange(len(rows)) % FOLDS
        # documents that the other view called bad have no kind and count in neither table
        group = np.where(y == 1, 0, np.where(sample.kind[rows] > 0, sample.kind[rows], -1))
        held = np.array([[sample.held(rows[(fold == k) & (group == g)]) for g in range(3)] for k in range(FOLDS)])
        sizes = np.array([[((fold == k) & (group == g)).sum() for g in range(3)] for k in range(FOLDS)])
        x = np.empty((len(rows), sample.width))
        for k in range(FOLDS):
            x[fold == k] = sample.text(self._tables(held.sum(axis=0) - held[k], sizes.sum(axis=0) - sizes[k]), rows[fold == k])
        self.tables = self._tables(held.sum(axis=0), sizes.sum(axis=0))
        self.model = Logistic(x, y)

    @staticmethod
    def _tables(held: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """One table for each known kind, from how many good, toxic and low documents hold each slot, and how many there are."""
        return [slot_weights(held[0].astype(np.float64), held[kind].astype(np.float64), int(sizes[0]), int(sizes[kind])) for kind in (1, 2)]


class Sample:
    """Documents in training as counts of slots, text and metadata columns; ``kind``: 1 toxic, 2 of low quality, 0 neither or unknown."""

    width = 2 * (2 + len(BORDERS)) + 2

    def __init__(self, rows: list, kind: np.ndarray):
        self.x, self.again, self.total = np.empty((0, 0)), np.empty((0, 1)), np.empty(0)
        self.packed: list[bytes] = []  # a tenth of the driver's memory that arrays would take
        self.kind = np.empty(0, np.int64)
        self.place: dict[int, int] = {}
        self.add(rows, kind)

    def add(self, rows: list, kind: np.ndarray) -> None:
        if not rows:
            return
        for r in rows:
            self.place[r["doc_id"]] = len(self.packed)
            self.packed.append(bytes(r["slots"]))
        x = np.array([np.frombuffer(r["meta"], np.float64) for r in rows])
        self.x = np.concatenate([self.x, x]) if len(self.x) else x
        self.again = np.concatenate([self.again, np.array([[r["again"]] for r in rows], dtype=np.float64)])
        self.total = np.append(self.total, [self.slots(i)[1].sum(dtype=np.float64) for i in range(len(self.total), len(self.packed))])
        self.kind = np.append(self.kind, kind)

    def slots(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots in order, their counts) of a document."""
        slots, counts = pk.unpack(self.packed[i])
        return np.cumsum(slots), counts

    def held(self, which: np.ndarray) -> np.ndarray:
        """How many of the documents hold each slot."""
        out = np.zeros(SLOTS, dtype=np.int32)
        for i in which:
            out[self.slots(i)[0]] += 1
        return out

    def text(self, tables: list[np.ndarray], which: np.ndarray) -> np.ndarray:
        """Text columns of the documents at the places ``which``, some at a time."""
        out = [np.empty((0, self.width))]
        for at in range(0, len(which), 200):
            own = which[at : at + 200]
            found = [self.slots(i) for i in own]
            owners = np.repeat(np.arange(len(own)), [len(slots) for slots, _ in found])
            slots, counts = np.concatenate([slots for slots, _ in found]), np.concatenate([counts for _, counts in found]).astype(np.float64)
            out.append(np.column_stack([text_features(slots, counts, tables, owners, self.total[own]), self.again[own]]))
        return np.concatenate(out)


class Model:
    """Two calibrated views and their combination."""

    def __init__(self, sample: Sample, y: np.ndarray, rounds: int, most_sure: Callable, features: Callable):
        """``sample``: the labelled documents, ``y``: 1 good, 0 bad. ``most_sure(text view, metadata view, given)``: (view, label,
        doc_id) of the unlabelled documents that each view is most sure of and the other has not been given; ``features(ids)``: rows for the sample."""
        labelled = np.arange(len(y))
        held = labelled[labelled % 3 == 2]  # for calibration alone
        base = np.setdiff1d(labelled, held)
        self.given: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view has received
        self.agreed = []
        for k in range(rounds + 1):
            rows = [np.append(base, np.array([sample.place[i] for i in g], dtype=np.int64)) for g in self.given]
            self.text = TextView(sample, rows[0], np.append(y[base], list(self.given[0].values())))
            self.meta = Logistic(sample.x[rows[1]], np.append(y[base], list(self.given[1].values())))
            if k == rounds:
                break
            found = most_sure(self.text, self.meta, self.given)
            for view, label, doc_id in found:
                self.given[1 - view].setdefault(doc_id, float(label))
            new = sorted({doc_id for *_, doc_id in found} - sample.place.keys())
            if new:
                sample.add(features(new), np.zeros(len(new), dtype=np.int64))
            self.agreed.append((len(self.given[0]), len(self.given[1])))
            if not found:
                break
        logits = np.column_stack([self.text.model.logit(sample.text(self.text.tables, held)), self.meta.logit(sample.x[held])])
        self.calibrated = [Logistic(logits[:, i : i + 1], y[held], ridge=0.1) for i in (0, 1)]
        self.combined = Logistic(np.column_stack([c.logit(logits[:, i : i + 1]) for i, c in enumerate(self.calibrated)]), y[held], ridge=0.1)

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """(text view, metadata view, both) as calibrated probabilities of a good document."""
        views = [self.calibrated[0].logit(self.text.model.logit(text)[:, None]), self.calibrated[1].logit(self.meta.logit(meta)[:, None])]
        return 1 / (1 + np.exp(-np.clip(np.column_stack([*views, self.combined.logit(np.column_stack(views))]), -40, 40)))


def _prepared(docs: DataFrame) -> DataFrame:
    """Id, text, language and source; null where a table lacks them."""
    meta = (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *(c.alias(n) for c, n in zip(meta, ("meta_lang", "meta_source"))))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[bytes], np.ndarray]]:
    """(rows, texts as bytes, metadata columns) for groups of bounded size."""
    texts = batch.column("text").cast(pa.binary())
    lang, source = (batch.column(f"meta_{c}").to_pylist() for c in ("lang", "source"))
    at, lengths = 0, pc.binary_length(texts).to_pylist()
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + lengths[end] < GROUP_BYTES):
            size += lengths[end]
            end += 1
        own = texts.slice(at, end - at).to_pylist()
        sizes = np.array([len(t) for t in own], dtype=np.int64)
        b = np.frombuffer(b"".join(own), dtype=np.uint8)
        yield slice(at, end), own, np.column_stack([layout(b, np.cumsum(sizes) - sizes, sizes), categories([lang[at:end], source[at:end]])])
        at = end


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts, meta in _groups(batch):
            packed, repeats = [], []
            for t in texts:
                slots, _, again = slots_of(t)
                packed.append(pk.pack(*(lambda s, c: (pk.steps(s), c))(*np.unique(slots, return_counts=True))))
                repeats.append(float(again.mean()) if len(again) else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(rows.start, rows.stop - rows.start), pa.array(packed, pa.binary()), pa.array(repeats), pa.array([m.tobytes() for m in meta], pa.binary())],
                ["doc_id", "slots", "again", "meta"],
            )


def _features_of(docs: DataFrame, ids: list[int]) -> list:
    """A row of features for each of some documents, by id."""
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))
    rows = _prepared(docs).join(wanted, "doc_id", "left_semi").mapInArrow(_features, "doc_id long, slots binary, again double, meta binary").collect()
    return sorted({r["doc_id"]: r for r in rows}.values(), key=lambda r: r["doc_id"])


def _most_sure(docs: DataFrame, own: DataFrame, text: TextView, meta: Logistic, given: list[dict[int, float]], confident: float, give: int) -> list[tuple[int, int, int]]:
    """(view, label, doc_id): of all documents without a label, the ``give`` that a view is most sure of, for each view and label.

    Every document is scored, map-only; what joins and ranks afterwards is ids and logits.
    """
    shared = docs.sparkSession.sparkContext.broadcast((text.tables, text.model, meta, [np.array(sorted(g), dtype=np.int64) for g in given]))

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        tables, text_model, meta_model, known = shared.value
        for batch in batches:
            ids = np.array(batch.column("doc_id").to_pylist(), dtype=np.int64)
            logits_of = [np.empty((0, 2)), *(np.column_stack([text_model.logit(x), meta_model.logit(m)]) for x, m in _views_of(batch, tables))]
            for view, logits in enumerate(np.concatenate(logits_of).T):
                for label, own_logits in ((1, logits), (0, -logits)):
                    which = np.flatnonzero((1 / (1 + np.exp(-np.clip(own_logits, -40, 40))) >= confident) & ~np.isin(ids, known[1 - view]))
                    if len(which):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(which), view, np.int32)), pa.array(np.full(len(which), label, np.int32)), pa.array(ids[which]), pa.array(own_logits[which])],
                            ["view", "label", "doc_id", "sure"],
                        )

    scored = _prepared(docs.filter("doc_id IS NOT NULL")).mapInArrow(sure, "view int, label int, doc_id long, sure double")
    pool = scored.join(own.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id", "view", "label").agg(F.max("sure").alias("sure"))
    # the surest of each share first, so that no task ranks all documents of a view and label; then four short lists
    order = Window.partitionBy("view", "label", "share").orderBy(F.desc("sure"), "doc_id")
    shares = pool.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= give)
    shares = cut(shares.select("view", "label", "doc_id", "sure"))
    best = [r for view in (0, 1) for label in (1, 0) for r in shares.filter((F.col("view") == view) & (F.col("label") == label)).orderBy(F.desc("sure"), "doc_id").limit(give).collect()]
    shared.unpersist()
    return [(r["view"], r["label"], r["doc_id"]) for r in best]


def train(docs: DataFrame, labels: DataFrame, labelled: int = 12_000, rounds: int = 3, confident: float = 0.98, give: int = 200) -> Model | None:
    """A model from at most ``labelled`` labelled documents, chosen by a hash of their ids, and all documents without a label:
    in each round every one of them is scored, and the ``give`` surest of each view and label are taken.

    Good is quality 1 and not toxic. Of several labels of a document the worst counts; labels with nulls and labels of
    documents that are not there are left out. Without both good and bad documents there is no model (None).
    """
    own = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") != 0, 2).when(F.col("quality") != 1, 1).otherwise(0)).alias("kind"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    chosen = own.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    picked = {r["doc_id"]: r["kind"] for r in chosen.collect()}  # bounded by ``labelled``
    if len({k == 0 for k in picked.values()}) < 2:
        return None
    rows = _features_of(docs, list(picked))
    kind = np.array([picked[r["doc_id"]] for r in rows])
    y = np.where(kind == 0, 1.0, 0.0)
    third = np.arange(len(y)) % 3 == 2
    if len(np.unique(y[~third])) < 2 or len(np.unique(y[third])) < 2:
        return None
    sample = Sample(rows, np.select([kind == 2, kind == 1], [1, 2], 0))
    del rows
    return Model(sample, y, rounds, lambda text, meta, given: _most_sure(docs, own, text, meta, given, confident, give), lambda new: _features_of(docs, new))


def _views_of(batch: pa.RecordBatch, tables: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text columns, metadata columns) for groups of bounded size."""
    for _, texts, meta in _groups(batch):
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        slots, starts, again = slots_of(b" ".join(texts)) if len(texts) > 1 else slots_of(texts[0])
        owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
        first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else again
        again &= ~first
        again[1:] &= ~(first[:-1] & (owner[1:] == owner[:-1])) | (slots[1 : len(owner)] == slots[: max(len(owner) - 1, 0)])
        repeats = np.bincount(owner, again, len(texts)) / np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        total = 2.0 * np.bincount(owner, minlength=len(texts))
        text = text_features(slots, np.ones(len(slots)), tables, np.concatenate([owner, owner]), total)
        yield np.column_stack([text, repeats]), meta


def _scores_of(batch: pa.RecordBatch, model: Model) -> np.ndarray:
    return np.concatenate([np.empty((0, 3)), *(model.score(text, meta) for text, meta in _views_of(batch, model.text.tables))])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **training) -> DataFrame:
    """One row per input row: doc_id, text_score, meta_score, score (probability of a good document), kept.

    Every whole text is scored, null counting as empty; ``kept`` is score >= ``threshold``. The text view reads hashed
    words and their beginnings; the metadata view reads size, layout, language and source (absent columns count as null). Repeated rows
    score alike, null ids are scored too. Without a model (see ``train``) scores are null and everything is kept.
    """
    model = train(docs, labels, **training)
    schema = "doc_id long, text_score double, meta_score double, score double"
    if model is None:
        none = F.lit(None).cast("double")
        return id_and_text(docs).select("doc_id", none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            found = _scores_of(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[:, i]) for i in range(3))], ["doc_id", "text_score", "meta_score", "score"])

    return _prepared(docs).mapInArrow(scored, schema).withColumn("kept", F.col("score") >= threshold)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **training) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier keeps. Map-only after training."""
    model = train(docs, labels, **training)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c if c in docs.columns else None for c in ("lang", "source")]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            nothing = pa.nulls(batch.num_rows, pa.string())
            meta = [nothing if c is None else batch.column(c).cast(pa.string()) for c in names]
            view = pa.RecordBatch.from_arrays([pc.fill_null(batch.column("text"), ""), *meta], ["text", "meta_lang", "meta_source"])
            yield batch.filter(pa.array(_scores_of(view, shared.value)[:, 2] >= threshold))

    return docs.mapInArrow(kept, docs.schema)
