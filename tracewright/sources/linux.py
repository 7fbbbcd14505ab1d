"""Linux evidence: syslog, audit, login records and journal entries as timeline rows."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import net
from tracewright.functions.times import audit_time, syslog_time
from tracewright.schema import as_timeline

# Message patterns, record layout and types, archive passwords are given by the caller.
ACCEPTED = r"Accepted (?:password|publickey|keyboard-interactive/pam) for (\S+) from (\S+)"
FAILED = r"Failed password for (\S+) from (\S+)"
XINETD = r"START: \S+ .*from=(?:::ffff:)?(\S+)"
PAM = r"authentication failure;.*rhost=(\S+)(?:.* user=(\S+))?"
RECORD = struct.Struct("<hxxi32s4s32s256shhiii4I20x")
KINDS = {7: "LOGIN", 8: "LOGOUT", 2: "BOOT_TIME"}
ROWS = 10_000  # of a batch that a decoder gives


def _rows(df: DataFrame, time: Column, host: Column, kind: Column, tag: Column, user: Column, remote: Column, note: Column, file: Column) -> DataFrame:
    is_ip = net.valid(remote)
    return as_timeline(
        df, time_created=time, dst_computer=host, event_type=kind, event_id=tag, target_user_name=user, log_filename=file, detail=note,
        src_ip=F.when(is_ip, remote).otherwise(""), src_computer=F.when(is_ip, "").otherwise(remote),
    )


def syslog(df: DataFrame, line_col: str = "line", year: Column | int = 1970, file: Column | str = "", hostname: Column | str = "", pam: bool = True) -> DataFrame:
    """RFC 3164 lines, else RFC 5424; xinetd before success before failure before PAM (``pam``: for
    secure and auth.log only).  Rows whose remote is no address are left out."""
    line, name = F.col(line_col), F.lit(file) if isinstance(file, str) else file
    own = F.lit(hostname) if isinstance(hostname, str) else hostname
    old = line.rlike(r"^[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2} ")
    new = r"^<\d+>\d* (\S+) (\S+) \S+ \S+ - - (.*)$"
    time = F.when(old, syslog_time(line, F.lit(year) if isinstance(year, int) else year)).otherwise(F.regexp_extract(line, new, 1))
    host = F.when(old, F.regexp_extract(line, r"^\S+ +\d+ \S+ (\S+)", 1)).otherwise(F.regexp_extract(line, new, 2))
    text = F.when(old, line).otherwise(F.regexp_extract(line, new, 3))
    staged = df.select("*", time.alias("__t"), host.alias("__h"), text.alias("__x"))
    x = F.col("__x")
    kinds = [(XINETD, "XINETD", "CONNECT", 0, 1), (ACCEPTED, "SSH_SUCCESS", "SUCCESSFUL_LOGON", 1, 2), (FAILED, "SSH_FAILED", "FAILED_LOGON", 1, 2)]
    kinds += [(PAM, "PAM_FAILED", "FAILED_LOGON", 2, 1)] if pam else []
    tag = kind = user = remote = F.lit(None).cast("string")
    for pattern, t, k, u, r in reversed(kinds):
        hit = x.rlike(pattern)
        tag, kind = F.when(hit, t).otherwise(tag), F.when(hit, k).otherwise(kind)
        user = F.when(hit, F.regexp_extract(x, pattern, u) if u else F.lit("")).otherwise(user)
        remote = F.when(hit, F.regexp_extract(x, pattern, r)).otherwise(remote)
    staged = staged.select("*", tag.alias("__tag"), kind.alias("__kind"), user.alias("__u"), remote.alias("__r")).where("__tag IS NOT NULL AND __t <> ''")
    staged = staged.where(net.valid(F.col("__r")))
    return _rows(staged, F.col("__t"), F.when(own != "", own).otherwise(F.col("__h")), F.col("__kind"), F.col("__tag"), F.col("__u"), F.col("__r"), F.lit(""), name)


def audit(df: DataFrame, line_col: str = "line", hostname: str = "", file: str = "audit.log") -> DataFrame:
    """USER_LOGIN and USER_AUTH records; the user is acct, else AUID, else UID."""
    line = F.col(line_col)
    field = lambda n: F.nullif(F.regexp_extract(line, rf'(?:^|[\s\'"]){n}="?([^"\s\']+)', 1), F.lit(""))
    rows = df.where(line.rlike("type=USER_(LOGIN|AUTH)")).select(
        "*", audit_time(line).alias("__t"), F.coalesce(field("acct"), field("AUID"), field("auid"), field("UID"), field("uid"), F.lit("")).alias("__u"), F.coalesce(field("addr"), F.lit("")).alias("__r"), field("res").alias("__res")
    )
    rows = rows.where(F.col("__t").isNotNull() & net.valid(F.col("__r")))
    good = F.col("__res") == "success"
    kind, tag = F.when(good, "SUCCESSFUL_LOGON").otherwise("FAILED_LOGON"), F.regexp_extract(line, "type=(USER_(?:LOGIN|AUTH))", 1)
    return _rows(rows, F.col("__t"), F.lit(hostname), kind, tag, F.col("__u"), F.col("__r"), F.lit(""), F.lit(file))


def login_records(content: bytes | memoryview) -> Iterator[tuple[str, str, str, str, str]]:
    """(time, user, remote, line, kind) of the 384-byte login records that count."""
    for at in range(0, len(content) - RECORD.size + 1, RECORD.size):
        kind, _, line, _, user, host, _, _, _, sec, _, a, b, c, d = RECORD.unpack_from(content, at)
        if kind not in KINDS:
            continue
        text = lambda x: x.split(b"\0")[0].decode("utf-8", "replace")
        remote = text(host)
        if not remote and a:
            raw = struct.pack("<4I", a, b, c, d)
            remote = str(ipaddress.ip_address(raw[:4] if not (b or c or d) else raw))
        yield datetime.fromtimestamp(sec, UTC).isoformat(), text(user), remote, text(line), KINDS[kind]


def login_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of all files as rows (t, u, r, l, k, f), ROWS at a time, however many files they come from."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(6)], names=list("turlkf"))

    rows: list[tuple] = []
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            name = path.rsplit("/", 1)[-1]
            for r in login_records(memoryview(content.as_buffer() or b"")):
                rows.append((*r, name))
                if len(rows) == ROWS:
                    yield made(rows)
                    rows = []
    yield made(rows)


def utmp(files: DataFrame, hostname: str = "") -> DataFrame:
    """Files as the binaryFile source reads them (path, content).  Records of a file named btmp are
    failed logins and need no address; others do."""
    rows = files.select("path", "content").mapInArrow(login_rows, "t string, u string, r string, l string, k string, f string")
    failed = F.col("f") == "btmp"
    rows = rows.where(failed | net.valid(F.col("r")))
    kind = F.when(failed, "FAILED_LOGON").when(F.col("k") == "LOGIN", "SUCCESSFUL_LOGON").when(F.col("k") == "LOGOUT", "LOGOFF").otherwise("CONNECT")
    tag = F.when(failed, "FAILED_LOGIN").otherwise(F.col("k"))
    return _rows(rows, F.col("t"), F.lit(hostname), kind, tag, F.col("u"), F.col("r"), F.col("l"), F.col("f"))


def journal(df: DataFrame, json_col: str = "value", file: str = "journal") -> DataFrame:
    """Journal entries exported as JSON lines: sshd messages."""
    get = lambda p: F.coalesce(F.get_json_object(json_col, p), F.lit(""))
    ours = (get("$._COMM") == "sshd") | (get("$.SYSLOG_IDENTIFIER") == "sshd")
    stamp = F.timestamp_seconds(F.floor(get("$.__REALTIME_TIMESTAMP").try_cast("long") / 1_000_000))
    rows = df.where(ours).select(
        F.concat(F.lit("<0>1 "), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00 "), F.coalesce(F.nullif(get("$._HOSTNAME"), F.lit("")), F.lit("-")), F.lit(" sshd 0 - - "), get("$.MESSAGE")).alias("line")
    )
    return syslog(rows, file=file, pam=False)


def infer_year(candidates: DataFrame) -> DataFrame:
    """(root, year): of the evidence rows (root, priority, year) the best of each root."""
    return candidates.where("year IS NOT NULL").groupBy("root").agg(F.min_by("year", "priority").alias("year"))


def infer_hostname(candidates: DataFrame) -> DataFrame:
    """(root, hostname): likewise from (root, priority, hostname)."""
    return candidates.where("hostname <> ''").groupBy("root").agg(F.min_by("hostname", "priority").alias("hostname"))
