"""Token counts: an exact histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.bpe import encode_decode
from tracewright.llm.common import materialize

STEP = 1024


def histogram(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length.

    Null and empty texts have length 0; every row counts, repeated ones too.  The counts are
    summed within a task before they are shuffled, so no length is a hot key.
    """
    coded = encode_decode(df, tokenizer_path, id_col, text_col, want=("n_tokens",))
    return coded.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(hist: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: what suffix sums over the histogram answer.

    n_tokens, n_docs: the histogram.  docs_over, tokens_over: documents longer than the limit and
    all their tokens.  truncated_total: tokens left when each document is cut at the limit.
    total_tokens, total_docs: of all documents.  share_within: part of the documents that fit
    whole, so the quantile q is the least limit with share_within >= q.  Between two lengths
    truncated_total is linear in the limit (slope docs_over), so the rows answer every limit.
    An empty table gives no rows.

    Suffix sums run within blocks of STEP lengths; totals of the later blocks are added, and
    only those totals (longest length / STEP rows) are summed in one task.  The histogram is
    written first, so that the documents are encoded once.
    """
    h = materialize(hist, "lengths").withColumn("block", F.expr(f"n_tokens div {STEP}"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after, everything = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = blocks.select(
        F.col("block").alias("b"),
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(everything).alias("total_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    own = h.select(
        "block",
        "n_tokens",
        "n_docs",
        F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("d"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0)).alias("t"),
    )
    joined = own.join(sums, F.col("block") == F.col("b"))
    docs_over, tokens_over = F.col("d") + F.col("later_docs"), F.col("t") + F.col("later_tokens")
    return joined.select(
        "n_tokens",
        "n_docs",
        docs_over.alias("docs_over"),
        tokens_over.alias("tokens_over"),
        (F.col("total_tokens") - tokens_over + docs_over * F.col("n_tokens")).alias("truncated_total"),
        "total_docs",
        "total_tokens",
        (1 - docs_over / F.col("total_docs")).alias("share_within"),
    )


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The least length that holds at least the share ``q`` of the documents whole: one row."""
    return limits.where(F.col("share_within") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """Tokens left when each document is cut at any ``limit``: one row (0 for an empty table)."""
    short = F.when(F.col("n_tokens") <= limit, F.col("n_docs") * F.col("n_tokens")).otherwise(F.col("n_docs") * limit)
    return limits.agg(F.coalesce(F.sum(short), F.lit(0)).alias("truncated_total"))
