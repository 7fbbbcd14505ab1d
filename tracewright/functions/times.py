"""Time columns: the four string shapes of a timeline, window bounds, vendor epochs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_zone(text: Column) -> Column:
    """The time without its zone: a trailing Z or +hh:mm goes, nothing is shifted."""
    return F.regexp_replace(text, r"(?:Z+|[+-]\d{2}:?\d{2}| UTC)$", "")


def parse_time(text: Column, strict: bool = False) -> Column:
    """A zone-less timestamp, or null.

    Accepts ISO with a zone (shifted to UTC), ISO without one, and 'date time' with or without
    a fraction and ' UTC'.  ``strict`` accepts only the zoned ISO shapes that a merge knows.
    """
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+Z|(\.\d+)?\+00:00)$"
    if not strict:
        shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2}| UTC)?$"
    stamp = F.regexp_replace(strip_zone(text), "T", " ").try_cast("timestamp_ntz")
    zone = r"([+-])(\d{2}):?(\d{2})$"
    minutes = F.regexp_extract(text, zone, 2).try_cast("int") * 60 + F.regexp_extract(text, zone, 3).try_cast("int")
    offset = F.when(text.rlike(r":\d{2}(\.\d+)?[+-]\d{2}:?\d{2}$"), F.when(F.regexp_extract(text, zone, 1) == "-", -minutes).otherwise(minutes))
    shifted = stamp - F.make_dt_interval(mins=F.coalesce(offset, F.lit(0)))
    return F.when(text.rlike(shape), shifted)


def parse_bound(text: str) -> datetime:
    """A command-line bound: the first 19 characters, read as UTC; an offset is ignored."""
    return datetime.strptime(text.strip()[:19].replace("T", " "), "%Y-%m-%d %H:%M:%S")


def valid_bound(text: str) -> bool:
    """Whether a command-line bound can be read; only its first 19 characters count."""
    try:
        parse_bound(text)
    except ValueError:
        return False
    return True


def iso(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def filetime(ticks: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A Windows FILETIME (100 ns since 1601) as text; empty where it is not positive or out of range."""
    seconds = F.floor(ticks.try_cast("long") / 10_000_000) - 11_644_473_600
    ok = (ticks.try_cast("long") > 0) & (seconds < 253_402_300_800)
    return F.when(ok, F.date_format(F.timestamp_seconds(seconds), pattern)).otherwise("")


def hive_time(ticks: Column) -> Column:
    return F.when(filetime(ticks) != "", F.concat(filetime(ticks, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).otherwise("")


def audit_time(line: Column) -> Column:
    """The epoch of an audit record, cut to seconds."""
    secs = F.regexp_extract(line, r"msg=audit\((\d+)", 1)
    return F.when(secs != "", F.concat(F.date_format(F.timestamp_seconds(secs.try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))


def syslog_time(line: Column, year: Column) -> Column:
    """'Mon dd HH:MM:SS' with a year from elsewhere."""
    head = F.regexp_extract(line, r"^([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2})", 0)
    stamp = F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), F.regexp_replace(head, " +", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    return F.when(stamp.isNotNull(), F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))


def vendor_time(value: Column) -> Column:
    """Epoch milliseconds or '... UTC' text as ISO with six digits; anything else unchanged."""
    ms = value.try_cast("long")
    text = F.regexp_replace(value, " UTC$", "").try_cast("timestamp_ntz")
    return F.when(ms.isNotNull(), iso(F.timestamp_millis(ms))).when(value.endswith("UTC") & text.isNotNull(), iso(text)).otherwise(value)


def gap_seconds(start: Column, end: Column, default: int = 300) -> Column:
    """Whole seconds from start to end, cut; ``default`` where either is missing."""
    return F.coalesce(F.timestamp_diff("SECOND", start, end), F.lit(default))
