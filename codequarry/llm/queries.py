"""The registered queries of the corpus operators and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codequarry.llm import alignment, decontamination, exact_dedup, html_text, jaccard_join, katz, line_dedup, packing, quality, spelling, substring_dedup, suffix_dedup, tokens
from codequarry.llm.common import documents, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), "byte_bpe_50k.json", 512)


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(documents(spark, sf_dir), order=3)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicate_lines(documents(spark, sf_dir), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
doomed AS (SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.doc_id, line, line_no, last_id IS NOT NULL AND last_id <> keyed.doc_id AS gone FROM keyed LEFT JOIN doomed USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir), 50).drop("kept", "spans")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(documents(spark, sf_dir), width=4, per_cent=85)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 185 * k >= 85 * (x.n + y.n)),
reach AS (SELECT a AS id, a AS via FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.via),
comp AS (SELECT id, min(via) AS c FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id
FROM w LEFT JOIN sizes ON sizes.doc_id = w.doc_id LEFT JOIN comp ON comp.id = w.doc_id
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), "word_bpe_49k.json", 2048)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(documents(spark, sf_dir), "byte_bpe_50k.json", "piece_bpe_32k.model")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(documents(spark, sf_dir), 50, with_text=False).drop("kept", "spans")


#: name: (query, SQL or None)
QUERIES = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_katz_backoff": (op2_katz_backoff, None),
    "op3_benchmark_decontamination": (op3_benchmark_decontamination, None),
    "op4_exact_dedup": (op4_exact_dedup, OP4_SQL),
    "op5_html_extraction": (op5_html_extraction, None),
    "op6_line_dedup": (op6_line_dedup, OP6_SQL),
    "op7_suffix_dedup": (op7_suffix_dedup, None),
    "op8_quality_classifier": (op8_quality_classifier, None),
    "op9_ngram_jaccard_join": (op9_ngram_jaccard_join, OP9_SQL),
    "op10_best_fit_packing": (op10_best_fit_packing, None),
    "op11_cross_tokenizer_alignment": (op11_cross_tokenizer_alignment, None),
    "op12_spelling_variants": (op12_spelling_variants, None),
    "op13_substring_dedup": (op13_substring_dedup, None),
}
