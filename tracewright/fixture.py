"""A timeline derived from the driver's ``events`` table, and the same as SQL for the oracle."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.times import iso
from tracewright.schema import TIMELINE
from tracewright.sources import images

CUTOFF = "2024-01-20 00:00:00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def image(k: int) -> bytes:
    """A small disk image of one of seven kinds."""
    disk = bytearray(16 * images.SECTOR)
    boot = {0: (8, b"\xebR\x90NTFS    "), 1: (8, b"\xebX\x90-FVE-FS-"), 2: (8, bytes(1080) + b"\x53\xef"), 5: (0, b"\xebR\x90NTFS    ")}.get(k)
    if boot:
        at, raw = boot[0] * images.SECTOR, boot[1]
        disk[at : at + len(raw)] = raw
    if k < 5:
        disk[510:512] = b"\x55\xaa"
        kind = {0: 0x07, 1: 0x07, 2: 0x83, 3: 0xEE, 4: 0xEE}[k]
        struct.pack_into("<B3xB3xII", disk, 446, 0, kind, 8, 8)
        if kind == 0xEE:
            types = [images.BASIC_DATA, "C12A7328-F81F-11D2-BA4B-00A0C93EC93B"] if k == 3 else [images.LVM]
            struct.pack_into("<8s64xQII", disk, images.SECTOR, b"EFI PART", 2, 4, 128)
            for n, x in enumerate(types):
                struct.pack_into("<16s16xQQ", disk, 2 * images.SECTOR + 128 * n, uuid.UUID(x).bytes_le, 8 + n, 9 + n)
    return bytes(disk)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 14 columns and ``ordinal`` (order of ingest)."""
    e = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k, u, kind, value = F.col("k"), F.col("user_id"), F.col("event_type"), F.col("value")
    host = lambda n: F.concat(F.lit("H"), F.lpad((n % 100).cast("string"), 3, "0"))
    dst = host(k)
    columns = {
        "time_created": iso(F.col("ts")),
        "dst_computer": dst,
        "event_type": F.when(kind == "error", "FAILED_LOGON").when(kind == "signup", "LOGOFF").when(kind == "view", "CONNECT").otherwise("SUCCESSFUL_LOGON"),
        "event_id": F.when(kind == "error", "4625").when(kind == "signup", "4634").when(kind == "view", "5140").when((kind == "click") & (k % 10 == 1), "4778").otherwise("4624"),
        "logon_type": F.when(value < 0.2, "9").when(value < 10, "2").when(value < 20, "5").when(value < 60, "3").otherwise("10"),
        "target_user_name": F.when(u % 10 == 0, F.concat(host(u), F.lit("$"))).otherwise(F.concat(F.upper(kind), F.lit("_"), (u % 3).cast("string"))),
        "src_computer": F.when(k % 7 == 0, "").when(k % 11 == 0, "MSTSC").when(k % 17 == 0, "LOCAL").when(k % 19 == 0, dst).otherwise(host(u)),
        "src_ip": F.when((k % 5 == 0) | (k % 14 == 0), "-").when(k % 13 == 0, "127.0.0.1").when((k % 17 == 0) | (k % 19 == 0), "").otherwise(F.concat_ws(".", F.lit("10"), (u % 4).cast("string"), F.lit("0"), (u % 100).cast("string"))),
        "log_filename": F.lit("events"),
    }
    return e.select(*[columns.get(c, F.lit("")).alias(c) for c in TIMELINE], F.col("event_id").alias("ordinal"))


SQL = """
base AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
), tl AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS time_created, 'H' || lpad(CAST(k % 100 AS VARCHAR), 3, '0') AS dst_computer,
    CASE event_type WHEN 'error' THEN 'FAILED_LOGON' WHEN 'signup' THEN 'LOGOFF' WHEN 'view' THEN 'CONNECT' ELSE 'SUCCESSFUL_LOGON' END AS event_type,
    CASE WHEN event_type = 'error' THEN '4625' WHEN event_type = 'signup' THEN '4634' WHEN event_type = 'view' THEN '5140'
      WHEN event_type = 'click' AND k % 10 = 1 THEN '4778' ELSE '4624' END AS event_id,
    CASE WHEN value < 0.2 THEN '9' WHEN value < 10 THEN '2' WHEN value < 20 THEN '5' WHEN value < 60 THEN '3' ELSE '10' END AS logon_type,
    CASE WHEN user_id % 10 = 0 THEN 'H' || lpad(CAST(user_id % 100 AS VARCHAR), 3, '0') || '$' ELSE upper(event_type) || '_' || (user_id % 3) END AS target_user_name,
    '' AS target_domain_name,
    CASE WHEN k % 7 = 0 THEN '' WHEN k % 11 = 0 THEN 'MSTSC' WHEN k % 17 = 0 THEN 'LOCAL' WHEN k % 19 = 0 THEN 'H' || lpad(CAST(k % 100 AS VARCHAR), 3, '0')
      ELSE 'H' || lpad(CAST(user_id % 100 AS VARCHAR), 3, '0') END AS src_computer,
    CASE WHEN k % 5 = 0 OR k % 14 = 0 THEN '-' WHEN k % 13 = 0 THEN '127.0.0.1' WHEN k % 17 = 0 OR k % 19 = 0 THEN ''
      ELSE '10.' || (user_id % 4) || '.0.' || (user_id % 100) END AS src_ip,
    '' AS subject_user_name, '' AS subject_domain_name, '' AS logon_id, '' AS detail, 'events' AS log_filename,
    event_id AS ordinal, ts, user_id, value
  FROM base
)"""
