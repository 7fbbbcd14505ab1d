"""The same filters and two detectors over a stream of timeline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.times import parse_time
from tracewright.operators.filters import FilterConfig, apply_filters
from tracewright.plans.hunt import MAX_GAP, MIN_USERS


def timed(stream: DataFrame, late: str = "10 minutes", config: FilterConfig | None = None) -> DataFrame:
    """Filtered rows with event_time as a watermarked timestamp."""
    kept = apply_filters(stream, config) if config else stream
    return kept.withColumn("event_time", parse_time(F.col("time_created")).cast("timestamp")).where("event_time IS NOT NULL").withWatermark("event_time", late)


def rotation(edges: DataFrame, window: str = "1 hour") -> DataFrame:
    """Origins with MIN_USERS or more users in a window; the state holds one set of users a window
    and origin, dropped once the watermark passes."""
    got = edges.groupBy(F.window("time", window), "origin").agg(F.size(F.collect_set("rel_type")).alias("n"))
    return got.where(F.col("n") >= MIN_USERS).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "origin", "n")


def chains(first: DataFrame, second: DataFrame, gap: int = MAX_GAP) -> DataFrame:
    """Stream-stream interval join: hops through one host by different users within ``gap`` seconds.

    Keys are the host and the time in steps of ``gap``; a first hop stands under its own step and the next,
    so each pair meets once and a row is compared with those of its host and step, not with all of its host.
    """
    step = lambda c: F.floor(F.unix_seconds(c) / max(gap, 1))
    a = first.select(F.col("origin").alias("a"), F.col("destination").alias("b"), F.col("rel_type").alias("u1"), F.col("time").alias("t1"))
    a = a.select("*", F.explode(F.array(step(F.col("t1")), step(F.col("t1")) + 1)).alias("s1"))
    b = second.select(F.col("origin").alias("b2"), F.col("destination").alias("c"), F.col("rel_type").alias("u2"), F.col("time").alias("t2"))
    b = b.select("*", step(F.col("t2")).alias("s2"))
    close = (F.col("b") == F.col("b2")) & (F.col("s1") == F.col("s2")) & (F.col("t2") > F.col("t1")) & (F.col("t2") <= F.col("t1") + F.make_dt_interval(secs=F.lit(gap)))
    return a.join(b, close).where("u1 <> u2 AND a <> c").drop("s1", "s2")
