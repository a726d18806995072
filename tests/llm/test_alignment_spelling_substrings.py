"""Alignment, spelling variants and repeated word sequences against plain versions."""

import random

import numpy as np
import pytest

import brute
from codequarry.llm import alignment, caches, quality, spelling, substring_dedup, tokens

SCHEMA = "doc_id long, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_word_sequences(spark, seed):
    rng = random.Random(seed)
    vocabulary, size = [(2, 20), (5, 3), (60, 7)][seed]
    docs = []
    for i in range(120):
        w = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 80))]
        if docs and rng.random() < 0.5:
            source = docs[rng.randrange(len(docs))][1].split()
            at = rng.randint(0, len(source))
            w[len(w) // 2 : len(w) // 2] = source[at : at + rng.randint(1, 60)]
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    docs += [(500, None), (501, ""), (5, docs[5][1]), (7, "something else " * 30), (None, docs[3][1]), (502, "é\x85ü " * 90), (503, "é\x85ü\t" * 40)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    for hot in (substring_dedup.HOT, 2):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept, [(s.start, s.end) for s in r.spans]) for r in substring_dedup.without_repeats(df, size, hot=hot).collect()]
        assert sorted(got, key=str) == brute.repeated_words(docs, size)
    assert {r.kept for r in substring_dedup.without_repeats(df, size, with_text=False).collect() if r.doc_id is not None} == {None}


@pytest.mark.parametrize("seed", range(5))
def test_automaton_knows_the_smallest_owner(seed):
    rng = random.Random(seed)
    texts = [(rng.randint(0, 9), [rng.randrange(3) for _ in range(rng.randint(1, 40))]) for _ in range(8)]
    automaton = substring_dedup.Automaton()
    for owner, words in texts:
        automaton.add(words, owner)
    automaton.settle()
    for query in [w for _, w in texts] + [[rng.randrange(4) for _ in range(60)]]:
        want = []
        for i in range(len(query) - 4):
            window = query[i : i + 5]
            want.append(min((o for o, w in texts if any(w[j : j + 5] == window for j in range(len(w)))), default=1 << 63))
        assert automaton.holders(query, 5) == want


def test_a_passage_of_many_documents_is_sent_once_by_each_part():
    """Rows of a hot passage do not grow with its documents, only with the parts that hold them."""
    from codequarry.llm import packets as pk

    passage = " ".join(f"p{i}" for i in range(60))
    owner, marks = substring_dedup.landmarks(*(lambda h, n: (h, n))(*list(substring_dedup.grouped([passage]))[0][1:]), 50)
    known = pk.pack(pk.steps(np.unique(marks)), np.zeros(len(np.unique(marks)), np.uint8))
    sent = []
    for n in (10, 400):
        texts = substring_dedup.packed_texts(np.arange(n), [passage.encode()] * n)
        found = [b for b in substring_dedup._stretches([known], iter([texts]), 50, 1, False) if b.column("kind")[0].as_py() == substring_dedup.STRETCHES]
        sent.append(sum(len(pk.unpack(p.as_py())[1]) for b in found for p in b.column("payload")))
    assert sent[0] == sent[1] > 0


def test_spelling_variants(spark):
    rng = random.Random(1)
    letters = "abÀéÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaabbbb", "aaabbbb"]
    docs = []
    for i in range(300):
        own = []
        for _ in range(40):
            w = base[min(int(rng.expovariate(0.15)), len(base) - 1)]
            if rng.random() < 0.15:
                j, k = rng.randrange(len(w)), rng.random()
                w = w[:j] + (rng.choice(letters) if k < 0.6 else "") + w[j + (k > 0.3) :]
            own.append(rng.choice([w, w.upper() if w.isascii() else w]))
        docs.append((i, rng.choice([" ", "1", ". "]).join(own)))
    docs += [(None, "aaaaaaaa bbbbbbbbb"), (900, None), (901, ""), (902, "ü" * 20_000), (902, "ü" * 20_000)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = rows(spelling.variants(df))
    assert got == brute.spellings(docs, 7, 2, 10, 31) and any(r[1] and r[2] != r[1] for r in got)
    assert rows(spelling.variants(df, least=8, min_count=3, ratio=4, every=3)) == brute.spellings(docs, 8, 3, 4, 3)


def test_alignment(spark):
    rng = random.Random(2)
    alphabet = "aB é.,'’<|>_\n\t  ́\x1c1²Σ!#　日\x00▁Ã"
    odd = [
        None, "", "  a  b\n\n c\t d ", "don't. we'll,x", "<|endoftext|> a <|endoftext|>b.</s><s><unk>", "a  b   c", "<0x41> a", "日本語、テスト。", " " * 300, "a" * 900, "word " * 150, " ", "\n", "x▁y", "a\x00b c", "İ ﬁ Ａ",
    ]
    odd += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    odd += [" ".join(rng.choice(["hello", "world's", "unbelievable", "straße", "naïveté", "x1y2"]) for _ in range(30)) for _ in range(40)]
    docs = [*enumerate(odd), (None, "hello world"), (3, "again hello")]
    a, b = alignment.side("byte_bpe_50k.json"), alignment.side("piece_bpe_32k.model")
    whole = [lambda t, s=s: [(i, s.bytes[i].as_py()) for i in s.encode([" " + t])[0]] for s in (a, b)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    assert rows(alignment.alignments(df)) == brute.aligned(docs, *whole)


def test_alignment_of_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 300)
    docs = [(i, "one two three " * (i % 5) + f"number{i}") for i in range(40)]
    a, b = alignment.side("byte_bpe_50k.json"), alignment.side("piece_bpe_32k.model")
    whole = [lambda t, s=s: [(i, s.bytes[i].as_py()) for i in s.encode([" " + t])[0]] for s in (a, b)]
    chunks = [alignment._chunk(str(k), docs[k * 10 : k * 10 + 10], a, b) for k in range(4)]
    assert sum(len(c.column("n")[0]) for c in chunks) > 40
    assert rows(alignment.alignments(spark.createDataFrame(docs, SCHEMA).repartition(2))) == brute.aligned(docs, *whole)


def test_token_count_rows(spark):
    texts = [None, "", "plain words", "  odd\n\tspace ", "x" * 700, "wörter, über " * 300, "<|endoftext|> a"]
    encode = tokens.loaded("byte_bpe_50k.json").encode
    want = [(i, len((t or "").encode()), n := len(encode(t or "", add_special_tokens=False).ids), n > 40) for i, t in enumerate(texts)]
    assert rows(tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), SCHEMA), limit=40)) == want


def test_caches_of_other_operators_are_dropped():
    own, other = caches.cache("one of the tests"), caches.cache("another of the tests")
    own["a"], other["b"] = 1, 2
    caches.claim("one of the tests")
    assert own == {"a": 1} and other == {}


def test_good_documents_keep_columns_of_any_name(spark):
    bad, good = "BUY NOW ### !!! $$$ " * 20, "the quiet river runs along the old town and its gardens " * 8
    docs = [(i, (bad if i % 4 == 0 else good) + f"w{i}", None, "s", i, "view", "lang") for i in range(240)] + [(900, None, "en", None, None, "view", None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, __view_0 string, meta_lang string"
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int")
    kept = quality.good_documents(spark.createDataFrame(docs, names), labels).collect()
    by_id = {d[0]: d for d in docs}
    assert all(tuple(r) == by_id[r.doc_id] for r in kept) and {r.doc_id for r in kept if r.doc_id < 900} == {i for i in range(240) if i % 4}
