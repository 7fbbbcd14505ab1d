"""Column lists and schemas of the fixed row shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

# The timeline header and its legacy form.
TIMELINE = (
    "time_created", "dst_computer", "event_type", "event_id", "logon_type", "target_user_name", "target_domain_name",
    "src_computer", "src_ip", "subject_user_name", "subject_domain_name", "logon_id", "detail", "log_filename",
)
LEGACY = (
    "time_created", "dst_computer", "event_id", "subject_user_name", "subject_domain_name", "target_user_name",
    "target_domain_name", "logon_type", "src_computer", "src_ip", "process", "log_filename",
)
EDGE = (
    "origin", "destination", "rel_type", "time", "logon_type", "src_computer", "src_ip", "target_user_name",
    "target_domain_name", "subject_user_name", "subject_domain_name", "count",
)

TIMELINE_SCHEMA = StructType([StructField(c, StringType()) for c in TIMELINE])
LEGACY_SCHEMA = StructType([StructField(c, StringType()) for c in LEGACY])
EDGE_SCHEMA = StructType(
    [StructField(c, TimestampNTZType() if c == "time" else LongType() if c == "count" else StringType()) for c in EDGE]
)


def as_timeline(df: DataFrame, **columns) -> DataFrame:
    """The 14 string columns; those not given are empty, nulls become empty."""
    return df.select(*[F.coalesce(columns[c].cast("string"), F.lit("")).alias(c) if c in columns else F.lit("").alias(c) for c in TIMELINE])


def legacy_to_timeline(df: DataFrame) -> DataFrame:
    """Legacy 12-column rows as timeline rows: no event type or logon id; process becomes the detail."""
    known = {c: F.col(c) for c in LEGACY if c != "process"}
    return as_timeline(df, detail=F.col("process"), **known)
