"""Union, dedup, window and order of timelines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.times import parse_time
from tracewright.schema import TIMELINE


def merge(frames: list[DataFrame], start: datetime | None = None, end: datetime | None = None, strict: bool = False) -> DataFrame:
    """Union without repeats of whole rows, inside the window (both ends included).

    Adds event_time; rows whose time does not parse are dropped.  Order it with ``ordered``.
    """
    out = frames[0].select(*TIMELINE)
    for f in frames[1:]:
        out = out.unionByName(f.select(*TIMELINE))
    out = out.withColumn("event_time", parse_time(F.col("time_created"), strict)).where("event_time IS NOT NULL")
    if start:
        out = out.where(F.col("event_time") >= F.lit(start))
    if end:
        out = out.where(F.col("event_time") <= F.lit(end))
    return out.dropDuplicates(list(TIMELINE))


def load_window(df: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The rows inside the window (both ends included) and those whose time does not parse: a graph load keeps these."""
    time = parse_time(F.col("time_created"))
    out = df
    if start:
        out = out.where(F.coalesce(time >= F.lit(start), F.lit(True)))
    if end:
        out = out.where(F.coalesce(time <= F.lit(end), F.lit(True)))
    return out


def with_fallback(windows: DataFrame | None, linux: DataFrame | None) -> DataFrame | None:
    """Both timelines as one, or the one there is."""
    found = [x for x in (windows, linux) if x is not None]
    return merge(found) if len(found) > 1 else (found or [None])[0]


def ordered(df: DataFrame, by: str = "event_time", ordinal: str | None = None) -> DataFrame:
    """All rows by time, then by order of ingest if it is given and by all columns, so that equal times have a fixed order."""
    return df.orderBy(by, *([ordinal] if ordinal else []), *TIMELINE)


def dedup(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One row for each time, destination, id, type, user and address: the one of the shortest file name."""
    keys = ["time_created", "dst_computer", "event_id", "event_type", "target_user_name", "src_ip"]
    rest = [ordinal] if ordinal else [c for c in TIMELINE if c not in keys]
    w = W.partitionBy(*keys).orderBy(F.length("log_filename"), *rest)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def bucketed_interval_join(left: DataFrame, right: DataFrame, key: tuple[str, str], times: tuple[str, str], seconds: int) -> DataFrame:
    """Pairs of equal key with 0 < right time - left time <= seconds, compared to the microsecond.

    Both sides are put into buckets of ``seconds``; a left row meets its own bucket and the next,
    so a hot key is spread over its buckets instead of meeting all its rows.
    """
    a, b = F.col(times[0]), F.col(times[1])
    slot = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / (seconds * 1_000_000))
    left = left.withColumn("__slot", F.explode(F.array(slot(a), slot(a) + 1)))
    right = right.withColumn("__rslot", slot(b))
    close = (b > a) & (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp")) <= seconds * 1_000_000)
    return left.join(right, (F.col(key[0]) == F.col(key[1])) & (F.col("__slot") == F.col("__rslot")) & close).drop("__slot", "__rslot")
