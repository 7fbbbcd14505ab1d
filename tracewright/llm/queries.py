"""The registered queries of this subpackage: thin functions of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, chat, decontaminate, html, lengths, neardup, ordinal, pii, quality, substring
from tracewright.llm.common import lowest_hashes, read_table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT -7L AS conv_id, k AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(k, role)")
    return chat.digests(chat.read_back(chat.expand(rows.unionByName(odd))))


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(read_table(spark, sf_dir, "documents"), word_bpe())
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read_table(spark, sf_dir, "documents"))


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.context_limits(lengths.histogram(read_table(spark, sf_dir, "documents"), word_bpe()))


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 neither toxic nor of quality, 2 of quality."""
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    graded = labels.select(F.col("doc_id"), grade.alias("grade")).where("grade IS NOT NULL")
    sample = lowest_hashes(graded, "doc_id", ordinal.SAMPLE, "grade")
    model = ordinal.fit(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), F.col("grade"), 3)
    return ordinal.score(documents, model, tail=2).withColumnRenamed("selected", "kept")


QUERIES = {
    "op1_quality_divergence": op1_quality_divergence,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_pii_boosting": op3_pii_boosting,
    "op4_html_blocks": op4_html_blocks,
    "op5_bpe_tree": op5_bpe_tree,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_latent_decontamination": op7_latent_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_ordinal_quality": op10_ordinal_quality,
}
ORACLES = {"op2_chat_formatting": chat.ORACLE, "op8_substring_dedup": substring.ORACLE}
