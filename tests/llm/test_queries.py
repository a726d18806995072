"""Registered corpus queries against SQL, awkward tables, and the pipeline."""

import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from codequarry.llm import (
    alignment, decontamination, exact_dedup, html_text, jaccard_join, katz, line_dedup, packing, quality, queries, spelling, substring_dedup, suffix_dedup, tokens,
)

SF = "/root/testdata/sf0.001"
supplied = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are not here")


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in ("documents", "pages", "labels", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@supplied
@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_same_rows_as_sql(spark, engine, name):
    query, sql = queries.QUERIES[name]
    found = engine.execute(sql)
    names = sorted(c[0] for c in found.description)
    order = [[c[0] for c in found.description].index(n) for n in names]
    result = query(spark, SF)
    assert sorted(result.columns) == names
    assert sorted(tuple(r) for r in result.select(*names).collect()) == sorted(tuple(r[i] for i in order) for r in found.fetchall())


@supplied
def test_queries_and_their_columns(spark):
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    columns = {n: set(q(spark, SF).columns) for n, (q, _) in queries.QUERIES.items() if n.split("_")[0] in ("op1", "op2", "op5", "op7", "op11", "op12", "op13")}
    assert columns["op1_token_counts"] == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    assert columns["op2_katz_backoff"] == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    assert columns["op5_html_extraction"] == {"page_id", "url", "text", "n_chars"}
    assert columns["op11_cross_tokenizer_alignment"] == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    assert columns["op12_spelling_variants"] == {"word", "form", "root", "n", "n_near", "form_n"}
    assert columns["op13_substring_dedup"] == {"doc_id", "n_words", "n_removed", "kept_sha256"}
    assert columns["op7_suffix_dedup"] == {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}


LABELS = "doc_id long, quality int, toxic int"
OPERATORS = {
    "tokens": (lambda d, s: tokens.token_counts(d), True),
    "katz": (lambda d, s: katz.katz_scores(d), True),
    "leaks": (lambda d, s: decontamination.leaks(d, s.createDataFrame([(1, "a b c d e f g h"), (None, None)], "item_id long, text string")), False),
    "exact": (lambda d, s: exact_dedup.exact_groups(d), True),
    "lines": (lambda d, s: line_dedup.deduplicate_lines(d, 3, 2), True),
    "suffixes": (lambda d, s: suffix_dedup.without_repeats(d, 10), True),
    "quality": (lambda d, s: quality.quality_scores(d, s.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], LABELS)), True),
    "jaccard": (lambda d, s: jaccard_join.similar_groups(d), True),
    "packing": (lambda d, s: packing.pack(d), None),
    "alignment": (lambda d, s: alignment.alignments(d), True),
    "substrings": (lambda d, s: substring_dedup.without_repeats(d, 10), True),
}
CLASHES = "hash body part payload key docs last_id line_no batch keep_id n rep digest short hashes comp length rank salt piece kind flags meta_lang y block __body"


def awkward(spark):
    rng = random.Random(9)
    copy = "one two three four five six seven eight nine ten " * 3
    rows = [
        (1, copy, "en", "s", 1), (2, copy, None, None, None), (2, copy, None, None, None), (3, None, None, "s", None), (4, "", "", "", 0), (None, copy, "en", None, 5), (None, None, None, None, None),
        (5, "\n\n \t\n", "en", "s", 3), (6, " ".join(f"t{rng.randint(0, 500)}" for _ in range(60_000)), "en", "s", 1), (7, "ü" * 150_000, "de", "s", 1), (-8, "a b c d e f g h", "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES.split():
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3), len(rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(spark, name):
    operator, per_row = OPERATORS[name]
    df, n = awkward(spark)
    rows = operator(df, spark).collect()
    if per_row is not None:
        assert len(rows) == (n if per_row else 1)
    else:
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, None, 5, 6, 7, -8}
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert operator(nothing, spark).collect() == []
    two_nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert len(operator(two_nulls, spark).collect()) == (0 if name == "leaks" else 2)


def test_awkward_tables_of_words(spark):
    df, _ = awkward(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in spelling.variants(df, least=3).collect()), key=str) == brute.spellings(docs, 3, 2, 10, 31) != []
    assert spelling.variants(spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")).collect() == []


def test_awkward_pages(spark):
    rows = [(1, "u", None), (None, None, ""), (2, None, "<p>x" * 3000), (2, None, "<p>x" * 3000), (3, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("n_chars", F.lit(1))
    found = html_text.page_texts(df).collect()
    assert len(found) == 5 and {r.page_id: r.n_chars for r in found}[3] == 4
    assert html_text.page_texts(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = str(tmp_path_factory.mktemp("corpus"))
    footer = "This very line stands below each page of the site, word by word."
    docs, labels = [], []
    items = [(i, " ".join(f"q{rng.randint(0, 400)}" for _ in range(20))) for i in range(5)]
    for i in range(400):
        w = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(30, 120))]
        if i % 10 == 3:
            w = docs[rng.randrange(len(docs))][1].split("\n")[0].split()
        if i % 25 == 7:
            w[10:10] = items[i % 5][1].split()
        bad = i % 8 == 1
        docs.append((i, ("\n".join([" ".join(w), footer]) if i % 3 else " ".join(w)) if not bad else " ".join(x.upper() + "###" for x in w), "en", "s", 7))
        if i % 2:
            labels.append((i, int(not bad), 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_pipeline_stages_against_plain_versions(spark, small_corpus, tmp_path):
    folder, docs, items = small_corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    df, state = spark.read.parquet(f"{folder}/documents.parquet"), {i: t for i, t, *_ in docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, folder)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = list(state.items())
        if name == "quality_classifier":
            kept = {r.doc_id for r in out.collect()}
            assert kept == {i for i, t in rows if "###" not in t}
            state = {i: t for i, t in rows if i in kept}
        elif name == "line_dedup":
            state = {i: x[0] for i, x in brute.lines(rows, 40, 5).items()}
        elif name == "ngram_jaccard_join":
            state = {i: state[i] for i, (_, c) in brute.similar(rows, 5, 80).items() if c == i}
        elif name == "benchmark_decontamination":
            gone = {d for d, _ in brute.leaks(rows, items, 20, 8)}
            assert gone
            state = {i: t for i, t in rows if i not in gone}
        if name != "best_fit_packing":
            found = out.collect()
            assert out.columns == corpus_pipeline.COLUMNS and {r.doc_id: r.text for r in found} == state and len(found) == len(state) < len(docs) + 1
            if k:
                assert all(r.n_chars == len(r.text) for r in found)
        else:
            ids = packing.encoder("word_bpe_49k.json")
            want = {i: zlib.crc32(b"".join(ids([t])[0]) + bytes(4)) for i, t in state.items()}
            assert {r.doc_id: r.ids_crc32 for r in out.collect()} == want
        df = out
    total = corpus_pipeline.run(spark, folder)
    assert sorted(total.select("doc_id", "ids_crc32").collect()) == sorted(df.select("doc_id", "ids_crc32").collect())


def test_pipeline_of_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
