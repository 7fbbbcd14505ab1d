"""Files in, files out: discovery, nested archives, timeline CSV, triage kinds, tasks and mount points."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.scalars import tag_text
from tracewright.functions.times import hive_time
from tracewright.sources.custom_rules import quoted_fields
from tracewright.schema import LEGACY, TIMELINE, TIMELINE_SCHEMA, as_timeline, legacy_to_timeline

# Names of evidence files, system accounts.
LINUX_NAMES = r"(?:^|/)(?:(?:utmp|wtmp|btmp|lastlog)$|(?:secure|messages|audit\.log|auth\.log)[^/]*$|[^/]*\.journal~?$)"
ACCESS_LOGGING_DEPTH, ACCESS_LOGGING = 5, r"(?i)/(?:Current|SystemIdentity|\{[^/]*\})\.mdb$|(?i)/Sum/[^/]*\.mdb$"
SYSTEM_ACCOUNTS = ("system", "local service", "network service", "nt authority\\system", "s-1-5-18", "s-1-5-19", "s-1-5-20")


def discover(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Distinct paths below a folder that match a pattern; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path").where(F.col("path").rlike(pattern)).distinct()


def access_logging_files(spark: SparkSession, path: str) -> DataFrame:
    """Distinct paths of access-logging databases at most ACCESS_LOGGING_DEPTH folders below a folder."""
    root = path.rstrip("/").rsplit(":", 1)[-1].lstrip("/")
    found = discover(spark, path, ACCESS_LOGGING)
    below = F.regexp_extract("path", re.escape(root) + "/(.*)$", 1)
    return found.where(F.size(F.split(below, "/")) <= ACCESS_LOGGING_DEPTH + 1)


def expand_archives(files: DataFrame, wanted: str, passwords: tuple[bytes, ...] = ()) -> DataFrame:
    """(path, content) of the wanted members of archives, nested ones too; the path is the chain of
    names joined with ' -> '.  Members that cannot be opened are left out."""

    def members(data: bytes, chain: str) -> Iterator[tuple[str, bytes]]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            return
        for info in archive.infolist():
            if info.is_dir():
                continue
            for password in (None, *passwords):
                try:
                    content = archive.read(info, pwd=password)
                except (RuntimeError, zipfile.BadZipFile, NotImplementedError, zipfile.zlib.error):
                    continue
                name = f"{chain} -> {info.filename}"
                if info.filename.lower().endswith(".zip"):
                    yield from members(content, name)
                elif pattern.search(info.filename):
                    yield name, content
                break

    pattern = re.compile(wanted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for name, data in members(bytes(content), path):
                    yield pd.DataFrame({"path": [name], "content": [data]})

    return files.select("path", "content").mapInPandas(run, "path string, content binary")


def triage_kind(entries: DataFrame) -> DataFrame:
    """(archive, kind) from the entry names (archive, entry) of each archive: which collector made it."""
    low = F.lower("entry")
    flags = entries.groupBy("archive").agg(
        F.bool_or(low.rlike(r"(^|/)(console/)?kape\.cli|_kape\.cli|copylog\.csv")).alias("kape"),
        F.bool_or(low.rlike(r"(^|/)(client_info|collection_context|uploads)\.json")).alias("velociraptor"),
        (F.count_if(low.rlike(r"forensicdata|cortex|payload.*\.log")) >= 2).alias("cortex"),
        (F.count_if(low.endswith(".evtx")) >= 5).alias("logs"),
    )
    return flags.select("archive", F.when(F.col("velociraptor"), "velociraptor").when(F.col("kape"), "kape").when(F.col("cortex"), "cortex").when(F.col("logs"), "archive").otherwise("").alias("kind"))


def collector_kind(path: Column) -> Column:
    """The collector that a path alone tells of, else empty: X_YYYYMMDD-HHMMSS_user (with Extracted_ before it or not), or a folder named Velociraptor."""
    stem = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*?)(?:\.[^./]*)?$", 1)
    named = stem.rlike(r"^(?:Extracted_)?[A-Za-z]_[0-9]{8}-[0-9]{6}_.")
    return F.when(named | F.contains(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), F.lit("/velociraptor/")), "velociraptor").otherwise("")


def triage_hostname(path: Column, kind: Column) -> Column:
    """The host in the name of a collector's archive, else null; each kind has its own form of name."""
    stem = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*?)(?:\.[^./]*)?$", 1)
    forms = {"cortex": r"^offline_collector_output_(.*?)_[0-9]{4}-", "velociraptor": "^Collection-(.*?)-[0-9]", "kape": "^([^_]+)_[0-9]{4}"}
    out = F.lit(None).cast("string")
    for name, form in forms.items():
        out = F.when((kind == name) & stem.rlike(form), F.regexp_extract(stem, form, 1)).otherwise(out)
    return out


def with_triage(paths: DataFrame, kinds: DataFrame) -> DataFrame:
    """Paths (``path``) with the kind and host of their outermost archive and the label that a report shows.

    ``kinds``: (archive, kind), as ``triage_kind`` gives them by archive path.
    """
    outer = F.element_at(F.split("path", " -> "), 1)
    known = kinds.select(F.col("archive").alias("__archive"), F.col("kind").alias("__kind"))
    joined = paths.withColumn("__outer", outer).join(known, F.col("__outer") == F.col("__archive"), "left")
    kind = F.coalesce(F.nullif("__kind", F.lit("")), collector_kind(F.col("__outer")))
    rows = joined.withColumn("kind", kind).withColumn("host", triage_hostname(F.col("__outer"), F.col("kind")))
    return rows.withColumn("label", source_label(F.col("path"), F.col("kind"))).drop("__outer", "__archive", "__kind")


def parse_summary(rows: DataFrame, rejected: int = 0) -> DataFrame:
    """files, rows, first, last, rejected: one row about a parsed timeline; times compared as text."""
    return rows.agg(F.count_distinct("log_filename").alias("files"), F.count(F.lit(1)).alias("rows"), F.min("time_created").alias("first"), F.max("time_created").alias("last"), F.lit(rejected).alias("rejected"))


def clean_path(text: str) -> str:
    """A path as typed: without quotes around it, white space and a separator at its end."""
    path = text.strip().strip("\"'").strip()
    return path.rstrip("/\\") or path


def source_label(path: Column, kind: Column) -> Column:
    image = F.lower(path).rlike(r"\.(e01|vmdk|dd|raw|img|001)\b")
    return F.when(image, "[IMAGE]").when(kind != "", "[TRIAGE]").when(path.contains(" -> ") | F.lower(path).endswith(".zip"), "[ARCHIVE]").otherwise("[FOLDER]")


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Timeline CSV files with the header of either shape; files with another header and rows of
    another width are left out.  Quoted fields may hold commas and quotes."""
    text = spark.read.text(path).withColumn("__file", F.col("_metadata.file_path"))
    heads = {",".join(TIMELINE): 14, ",".join(LEGACY): 12}
    width = F.when(F.col("value") == list(heads)[0], 14).when(F.col("value") == list(heads)[1], 12)
    shapes = text.select(F.col("__file").alias("__f"), width.alias("__width")).where("__width IS NOT NULL").groupBy("__f").agg(F.max("__width").alias("__width"))
    rows = text.where(~F.col("value").isin(*heads)).join(shapes, F.col("__file") == F.col("__f")).select("value", "__width", F.size(split_csv(F.col("value"))).alias("n"))
    rows = rows.where("n = __width")
    fields = split_csv(F.col("value"))
    new = rows.where("__width = 14").select(*[fields[k].alias(c) for k, c in enumerate(TIMELINE)])
    old = rows.where("__width = 12").select(*[fields[k].alias(c) for k, c in enumerate(LEGACY)])
    return new.unionByName(legacy_to_timeline(old))


def split_csv(line: Column) -> Column:
    """Fields of a CSV line; quoted ones may hold commas, and doubled quotes stand for one."""
    return F.transform(quoted_fields(line), lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def write_timeline(df: DataFrame, path: str, single: bool = True, skip_empty: bool = False) -> None:
    """Sorted CSV with the header; an empty timeline writes the header alone, or nothing."""
    if skip_empty and df.isEmpty():
        return
    out = df.select(*TIMELINE).orderBy(*TIMELINE)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMELINE_SCHEMA).option("header", "true").option("escape", '"').csv(path).na.fill("")


def tasks(files: DataFrame, hostname: str = "") -> DataFrame:
    """Scheduled-task XML files (path, content): those registered remotely, by people, with a date."""
    raw = F.col("content")
    head = F.hex(F.substring(raw, 1, 2))
    text = F.when(head.isin("FFFE", "FEFF"), F.decode(raw, "UTF-16")).otherwise(F.decode(raw, "UTF-8"))
    rows = files.select("path", text.alias("x"))
    author, date = tag_text(F.col("x"), "Author"), tag_text(F.col("x"), "Date")
    rows = rows.select("path", author.alias("author"), date.alias("date"), tag_text(F.col("x"), "URI").alias("uri"), tag_text(F.col("x"), "Command").alias("command"), tag_text(F.col("x"), "UserId").alias("user"))
    host, name = F.substring_index("author", "\\", 1), F.substring_index("author", "\\", -1)
    remote = F.col("author").contains("\\") & (F.lower(host) != F.lit(hostname.lower())) & ~F.lower("author").isin(*SYSTEM_ACCOUNTS) & ~F.lower(name).isin(*SYSTEM_ACCOUNTS)
    time = F.when(F.col("date").rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.col("date")).otherwise(F.concat("date", F.lit("Z")))
    return as_timeline(
        rows.where((F.col("date") != "") & remote), time_created=time, dst_computer=F.lit(hostname), event_type=F.lit("CONNECT"), event_id=F.lit("SCHTASK"), target_user_name=F.col("user"),
        src_computer=host, subject_user_name=name, subject_domain_name=host, detail=F.concat_ws(" ", "uri", "command"), log_filename=F.element_at(F.split("path", "/"), -1),
    )


def mount_points(rows: DataFrame, hostname: str = "") -> DataFrame:
    """Hive rows (user, key, last_write): keys ##SERVER#SHARE with a time are connections to SERVER."""
    kept = rows.where(F.col("key").startswith("##") & (F.col("last_write").try_cast("long") > 0))
    path = F.translate("key", "#", "\\")
    server = F.regexp_extract(path, r"^\\\\([^\\]+)", 1)
    is_ip = server.rlike(r"^[0-9.]*\.[0-9.]*$")
    return as_timeline(
        kept, time_created=hive_time(F.col("last_write")), dst_computer=server, event_type=F.lit("CONNECT"), event_id=F.lit("MountPoints2"), target_user_name=F.col("user"), src_computer=F.lit(hostname),
        detail=F.concat(path, F.when(is_ip, F.lit(" (address)")).otherwise("")), log_filename=F.lit("NTUSER.DAT"),
    )


def by_source(df: DataFrame) -> DataFrame:
    """Rows by source file, with the shadow-copy index in its name."""
    from tracewright.functions.scalars import vss_index

    return df.groupBy(F.regexp_replace("log_filename", r"_vss_\d+", "").alias("source"), vss_index(F.col("log_filename")).alias("vss")).agg(F.count(F.lit(1)).alias("n"))
