"""A training-data pipeline over `documents`: five stages, each one operator of kinetrail.llm on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. Rows
that a stage keeps go on unchanged, except that line dedup replaces text and n_chars. A document whose lines all go stays
with an empty text. The last stage returns the ids and the text that they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.llm import decontamination, line_dedup, ngram_join, quality_rules, sentencepiece_codec
from kinetrail.llm.components import written
from kinetrail.llm.queries import table, vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def rare_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(docs)
    changed = F.col("__lines.n_dropped") > 0
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("__lines")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary("piece_bpe_32k.model"), decoded="decoded")
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", rare_lines),
    ("ngram_join", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("sentencepiece", token_ids),
]

#: SQL cannot express the tokenizer's stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
