"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``.  All but the last return the columns of ``documents``; extra
columns of any name are carried up to the last.  Null ids are ids like others; no stage drops a row
for one.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, decontaminate, neardup, pii, quality
from tracewright.llm.common import drop_written, materialize, read_table
from tracewright.llm.queries import word_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts have too few words, so they go too.  Repeated rows are judged alike."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one whose id names the class.

    Repeated rows of one id and text are one document.  Null and empty texts are copies of each other.
    Where all ids of a class are null its rows are told apart by their texts alone.
    """
    named = neardup.classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = named.select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi").dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, repeated rows together; null and empty texts hold none."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text.  Null texts stay null, repeated rows stay."""
    found = pii.detect(docs, base_col="__base_spans", spans_col="__spans")
    text = pii.redact(F.col("text"), F.col("__spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to; of null and empty texts none.  Repeated rows stay."""
    return bpe.encode_decode(docs, word_bpe())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", encoding),
]
#: SQL can't express the trained and hashed stages; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
            drop_written(spark, keep=1)  # what the stage wrote for itself, and its own input
    return docs
