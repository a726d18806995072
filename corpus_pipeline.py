"""A training corpus in stages, each applying one corpus operator to everything its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codequarry.llm import decontamination, jaccard_join, line_dedup, packing, quality
from codequarry.llm.common import documents, table
from codequarry.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not reject."""
    return quality.good_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of 40 code points or more that five or more of them hold, but for the largest id; n_chars follows the text."""
    kept = line_dedup.deduplicate_lines(docs, min_chars=40, min_docs=5)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 on five-word shingles join, the one with the smallest id; a null id links with nothing."""
    groups = jaccard_join.similar_groups(docs, width=5, per_cent=80)
    gone = groups.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of ``benchmark`` is found within a fifth of its words."""
    return decontamination.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left and their places in sequences of 2048 tokens."""
    return packing.pack(docs, "word_bpe_49k.json", 2048)


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
