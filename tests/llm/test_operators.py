"""Corpus operators against plain versions."""

import glob
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from codequarry.llm import decontamination, exact_dedup, html_text, jaccard_join, katz, line_dedup, packing, quality, queries, suffix_dedup, tokens
from codequarry.session import SHUFFLE_CLEANUP, shared_folder

SCHEMA = "doc_id long, text string"


def frame(spark, docs, parts=3):
    return spark.createDataFrame(docs, SCHEMA).repartition(parts)


def prose(rng, n, vocab=40):
    return " ".join(f"w{min(int(rng.expovariate(0.1)), vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    alphabet = "aB é.,'’<|>_\n\t  ́\x1c1²Σ!#"
    odd = [
        "", "  a  b\n\n c\t d ", "don't. we'll,x", "<|endoftext|> a <|endoftext|>b.<|endoftext|>", "a  b   c", "é, Éa. x́", "ΣΑΣ, σας.", "İstanbul. IİI",
        "12,000.5 ½² a1b2", "<|STARTOFTEXT|> <|startoftext|>a", "x\x1c\x1dy z\x1f", "K Å Ω.", "日本語、テスト。", "\t\ta\n\n\nb", " " * 5000, "a" * 20000, "word " * 3000,
    ]
    return odd + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(2000)]


def test_token_counts_equal_whole_encodings(odd_texts):
    want = [len(e) for e in tokens.loaded("byte_bpe_50k.json").encode_batch(odd_texts, add_special_tokens=False)]
    assert tokens.counter("byte_bpe_50k.json")(odd_texts) == want
    sentences = [t for t in odd_texts[:40]]
    assert tokens.counter("piece_bpe_32k.model")(sentences) == [len(x) for x in tokens.loaded("piece_bpe_32k.model").encode(sentences)]


def test_word_ids_equal_whole_encodings(odd_texts):
    got = [b"".join(x) for x in packing.encoder("word_bpe_49k.json")(odd_texts)]
    assert got == [np.array(e.ids, dtype="<u4").tobytes() for e in tokens.loaded("word_bpe_49k.json").encode_batch(odd_texts, add_special_tokens=False)]


def test_encoder_forgets_beyond_its_bound():
    encoder = tokens.Encoder(lambda units: [u.upper() for u in units], str.split, bound=2)
    for text in ("a b c", "c d e", "a a", "f" * 100):
        assert encoder([text]) == [[u.upper() for u in text.split()]]
    assert len(encoder.known) <= 6 and "f" * 100 not in encoder.known


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 100, 2048])
    histogram = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
    runs, bins = packing.plan(histogram, capacity)
    placed, content = {}, {}
    for length, rank, each, count, first, offset in runs.tolist():
        for nth in range(each * count):
            assert placed.setdefault((length, rank + nth), True) and (length, rank + nth) not in content
            content[length, rank + nth] = (first + nth // each, offset + nth % each * length)
    assert len(content) == sum(histogram.values()) and all((n, k) in content for n, c in histogram.items() for k in range(c))
    by_bin = {}
    for (length, _), (where, offset) in content.items():
        by_bin.setdefault(where, []).append((offset, length))
    assert sorted(by_bin) == list(range(bins))
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    gaps: list[int] = []  # first fit decreasing
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        at = next((i for i, gap in enumerate(gaps) if gap >= length), None)
        if at is None:
            gaps.append(capacity - length)
        else:
            gaps[at] -= length
    assert bins <= len(gaps) + max(1, len(gaps) // 50)


def test_pack(spark):
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.randint(0, 300))) for i in range(60)] + [(70, None), (71, ""), (72, prose(rng, 3000)), (72, "again"), (None, "x")]
    rows = packing.pack(frame(spark, docs), capacity=128, with_ids=True).collect()
    own = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length <= 128
        own.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in own.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 128
    whole = tokens.loaded("word_bpe_49k.json").encode(docs[62][1], add_special_tokens=False).ids + [0]
    pieces = sorted((r for r in rows if r.doc_id == 72 and (r.piece or r.length == 128)), key=lambda r: r.piece)
    assert np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist() == whole
    assert all(p.length == 128 for p in pieces[:-1]) and [p.start for p in pieces] == [128 * i for i in range(len(pieces))]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    rng = random.Random(6)
    docs = [(i, rng.choice(["a b", "a  b", "a\n\tb", " a b", "", None, "c" * (i % 3), "ß", "x" * 5000])) for i in range(200)]
    hashed = (lambda c: F.length(c) % 2) if weak else exact_dedup.content_hash
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(frame(spark, docs), hashed).collect()}
    assert got == brute.exact(docs)
    assert {r.doc_id for r in exact_dedup.deduplicated(frame(spark, docs)).collect()} == {k for k, _ in got.values()}


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(spark, batches):
    rng = random.Random(7)
    pool = [prose(rng, rng.randint(1, 6)) for _ in range(25)]
    docs = [(i * 7 % 101, "\n".join(rng.choice(["", " \t"]) + rng.choice([str.upper, str])(rng.choice(pool)) for _ in range(rng.randint(0, 9)))) for i in range(101)] + [(500, None), (501, "\n\n")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.deduplicate_lines(frame(spark, docs), 8, 5, batches).collect()}
    assert got == brute.lines(docs, 8, 5)


def test_line_runs_are_merged_by_level(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for ids in ([9, 8], [7, 6], [5], [4], [3]):
        runs.add(spark.createDataFrame([(i, bytes([k])) for i in ids for k in range(i % 3 + 1)], "doc_id long, key binary"))
    assert all(len(level) < 2 for level in runs.levels)
    assert {bytes(r.key): r.last_id for r in runs.settled().collect()} == {b"\0": 9, b"\1": 8, b"\2": 8} or {bytes(r.key)[0] for r in runs.settled().collect()} == {0, 1}


@pytest.mark.parametrize(("size", "alphabet", "n"), [(6, "ab", 60), (10, "abc", 150), (50, "ab ", 60), (8, "aé", 30)])
def test_repeated_strings(spark, size, alphabet, n):
    rng = random.Random(size)
    docs = [(i * 3 + 1, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))).encode()) for i in range(n)]
    for k in range(n // 3):
        source = rng.choice(docs)[1].decode()
        at = rng.randint(0, len(source))
        docs.append((1000 + k, (source[at : at + 90] + "xyz" + rng.choice(docs)[1].decode()[:70]).encode()))
    docs += [(5000, b"ab" * 1000 + b"c" * 70_000), (5001, b"ba" * 1000 + b"c" * 1000), (5002, b"")]
    found = suffix_dedup.without_repeats(spark.createDataFrame([(i, b.decode()) for i, b in docs], SCHEMA).repartition(4), size).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute.repeats(docs, size)
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed


@pytest.mark.parametrize(("width", "per_cent"), [(4, 85), (5, 80), (1, 50)])
def test_similar_groups(spark, width, per_cent):
    rng = random.Random(width)
    docs = [(i, prose(rng, rng.randint(0, 60), 400)) for i in range(40)]
    for k in range(150):
        w = brute.words(docs[rng.randrange(len(docs))][1])
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 9)}"
        docs.append((1000 - k, " ".join(w).upper()))
    docs += [(2000, None), (2001, " \n"), (2002, "one two"), (2003, "ONE\ttwo"), (2004, "two one")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(frame(spark, docs), width, per_cent).collect()}
    assert got == brute.similar(docs, width, per_cent)


def test_long_lists_are_dealt_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(60), rng.randint(0, 3)):
            w[k] = f"v{rng.randint(0, 5)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(frame(spark, docs), 2, 90).collect()}
    assert got == brute.similar(docs, 2, 90)


def test_rows_repeated_in_several_tasks_count_once():
    hashes = np.arange(1, 101, dtype=np.uint64)
    row = jaccard_join._by_shingle([(hashes, np.zeros(100, np.int64))], [5], [100], 1).column("payload").to_pylist()
    assert sum(batch.num_rows for batch in jaccard_join._shared(row + row, 1)) == 0  # one document shares nothing with itself


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(spark, order, tmp_path):
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randint(0, 60), 60)) for i in range(150)] + [(900, None), (901, ""), (902, " \n\t "), (903, "é Ä x\x0by"), (904, "zz " * 400)]
    for own in (docs, docs[:3], [(3, "a a a")], [(i, "x " * 13) for i in range(10)]):
        got = sorted(tuple(r) for r in katz.katz_scores(frame(spark, own), order, model_path=str(tmp_path / f"m{len(own)}")).collect())
        want = sorted(brute.katz(own, order, katz.discounts))
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
        assert spark.read.parquet(str(tmp_path / f"m{len(own)}")).count() > 0


def test_katz_query_scores_trigrams(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.randint(0, 60), 60)) for i in range(80)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.op2_katz_backoff(spark, str(tmp_path)).collect())
    assert np.allclose([g[6] for g in got], [w[6] for w in sorted(brute.katz(docs, 3, katz.discounts))], rtol=1e-9)


def test_katz_sends_no_unseen_contexts():
    tokens = katz.Tokens(iter([katz.pk.pack(np.array([7]), np.array([1], np.uint8), np.array([7]), np.frombuffer(b"a b c d", dtype=np.uint8))]))
    context = tokens.step()
    request = katz.Request(tokens, context, np.array([0, 3, 0, 0, 2]), 100.0, 2)
    assert len(request.one) == 3 and request.of.tolist().count(3) == 2  # the first word, "b" after a seen "a", the end
    counts, sums = request.answered([], (np.array([katz.BEGIN]), np.ones((1, 7))))
    assert counts[request.of].tolist() == [0] * 5 and not sums[3].any()


def test_katz_leaves_small_tables(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(f"word{int(rng.paretovariate(0.6)) % 20000}" for _ in range(400))) for i in range(200)]
    cuts = shared_folder(spark, f"cuts-{spark.sparkContext.applicationId}").removeprefix("file:")
    before = set(glob.glob(f"{cuts}/*/*.parquet"))
    katz.katz_scores(frame(spark, docs), 3)
    left = sum(os.path.getsize(f) for f in set(glob.glob(f"{cuts}/*/*.parquet")) - before)
    assert left < 0.45 * sum(len(t) for _, t in docs), left
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"


def test_katz_beats_the_baseline_on_held_out_texts(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(x for _ in range(30) for x in rng.choice([("a", "b"), ("c", "d"), ("e", "f")]))) for i in range(120)]
    r = katz.katz_scores(frame(spark, docs)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert r[0] > 0.75 * r[1]


def test_leaks(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 90)))) for i in range(40)] + [(50, None), (51, "")]
    docs = []
    for j in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        if j % 2:
            p = brute.letters(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(p) // 4))):
                if p:
                    at = rng.randrange(len(p))
                    p[at : at + rng.randint(0, 1)] = rng.choice([[], ["zz"], ["é", "q"]])
            w = w + p + w[:5]
        docs.append((j, ", ".join(w).upper() if j % 3 else "\n".join(w)))
    docs.append((500, None))
    tests = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.leaks(frame(spark, docs), tests, 20, 8).collect()
    want = brute.leaks(docs, items, 20, 8)
    assert {(r.doc_id, r.item_id): r.distance for r in rows} == want and len(rows) == len(want) > 20
    texts, goals = dict(docs), dict(items)
    for r in rows:
        # the reported passage itself is as near as reported
        assert brute.leaks([(0, texts[r.doc_id][r.start : r.end])], [(0, goals[r.item_id])], 100, 1)[0, 0] == r.distance
    kept = {r.doc_id for r in decontamination.without_leaks(frame(spark, docs), tests, 20, 8).collect()}
    assert kept == {name for name, _ in docs} - {name for name, _ in want}


def test_benchmarks_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)
    items = [(i, " ".join(f"t{i}x{k}" for k in range(12))) for i in range(9)]
    docs = [(i, "before " + text + " after") for i, text in items] + [(99, "clean " * 30)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), tests).collect()} == {(i, i) for i, _ in items}
    assert [r.doc_id for r in decontamination.without_leaks(frame(spark, docs), tests).collect()] == [99]


P = "<p>" + "A long paragraph with many words of text in it. " * 4 + "</p>"
T = ("A long paragraph with many words of text in it. " * 4).strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain &amp; text", "plain & text"),
        ("<p>only &lt;b&gt; text<p>two\n\n lines &nbsp; x", "only <b> text\n\ntwo lines x"),
        (f'<body><header><h1>Site</h1></header><div id="sidebar"><p>x side</p></div><div class="content"><h2>T</h2>{P}<p>short.</p>{P}</div><div class="comments"><p>{"nice post " * 30}</p></div></body>', f"T\n\n{T}\n\nshort.\n\n{T}"),
        (f'<div class="ad">buy<article><h1>T &amp; U</h1>{P}<ul><li>a</li><li>b</li></ul><form>name<input></form><section id="comments"><article class="comment"><p>{"hi there " * 40}</p></article></section></article>', f"T & U\n\n{T}\n\na\n\nb"),
        (f"<main><nav>m</nav><article><header><h1>H</h1><span>By me</span></header>{P}</article><aside>rel</aside></main>", f"H\n\n{T}"),
        (f'<script>var t="</p>";</script><style>p{{}}</style><!-- no --><article><p><b>one<br>two{P}</article><footer>&copy; x</footer>', f"one two\n\n{T}"),
        (f"<article>{P}<script>never closed", T),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def labelled_corpus(rng, n):
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice(["good"] * 4 + ["toxic", "junk"])
        w = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(20, 200))]
        if kind == "toxic":
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grokl", "blarf", "snid"]))
        text = " ".join(w) if kind != "junk" else " ".join(x.upper() + "!!" for x in w)
        docs.append((i, text, rng.choice(["en", None]), "s1"))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels, lambda text: "!!" not in text and not any(b in text for b in ("grokl", "blarf", "snid"))


def test_quality(spark):
    docs, labels, is_good = labelled_corpus(random.Random(8), 1500)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4)
    tags = spark.createDataFrame([*labels, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.quality_scores(df, tags).collect()}
    right = [rows[i].kept == is_good(text) for i, text, *_ in docs if i % 2 == 0]
    assert len(rows) == len(docs) and sum(right) >= 0.97 * len(right)
    kept = quality.good_documents(df.withColumn("kept", F.lit("mine")), tags)
    assert kept.columns == [*df.columns, "kept"] and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}
    model = quality.train(df, tags, rounds=2)
    assert len(model.agreed) == 2 and model.agreed[1] >= model.agreed[0]


def test_quality_takes_pseudo_labels_from_all_documents(spark):
    docs, labels, _ = labelled_corpus(random.Random(9), 400)
    first = spark.range(10_000, 16_000).orderBy(F.xxhash64("id"), "id").select("id").collect()
    last = {r.id for r in first[5000:]}  # junk stands beyond any bounded sample by hash; the others tell nothing
    docs += [(r.id, "SHOUT!! " * 150 if r.id in last else "w1", "en", "s1") for r in first]
    tags = spark.createDataFrame([(i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4)
    model = quality.train(df, tags, rounds=2, give=300)
    taken = [{i for i, label in g.items() if label == 0 and i in last} for g in model.given]
    assert max(map(len, taken)) >= 500  # each round gives 300 that were not given before
    assert not {i for i, *_ in labels} & (set(model.given[0]) | set(model.given[1]))


def test_quality_without_two_classes_keeps_all(spark):
    df = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.kept for r in quality.quality_scores(df, none).collect()] == [True, True]
    assert quality.good_documents(df, none.limit(0)).count() == 2


def test_words_are_encoded_as_the_whole_text():
    """A capital I with a dot is a letter whose lower case ends in a mark; words are encoded at their first lookup and remembered twice over."""
    tokenizer = tokens.loaded("word_bpe_49k.json")
    texts = ["Σ İ( İ.x", "İ\"Σ <| İ;", "one. one, ONE one! one.. o.n (one) été. " + "x" * 100 + ".", "", "a<|endoftext|>. b"]
    known = packing.Words(tokenizer, bound=2)
    for _ in range(3):
        known.turn()
        for text in texts:
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(b"".join(map(known.__getitem__, text.split())), "<u4").tolist() == want
            assert np.frombuffer(b"".join(packing.encoder("word_bpe_49k.json")([text])[0]), "<u4").tolist() == want
    assert known.older and "x" * 100 + "." not in known
