"""Registered queries of the sources: records in the sources' own formats are made from ``events`` and read back.

Each oracle says the same rows in SQL over ``events``, without the formats between.
"""

from __future__ import annotations

import uuid
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright import fixture, schema
from tracewright.functions.scalars import vss_index
from tracewright.functions.times import vendor_time
from tracewright.operators import filters, timeline
from tracewright.operators.order import numbered, shared_dir
from tracewright.sources import custom_rules, edr, evtx, files, hive, images, linux, ual, windows
from tracewright.streaming import timelines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
T14 = ", ".join(schema.TIMELINE)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def timeline_sql(source: str, **columns: str) -> str:
    """The 14 columns, empty where not given."""
    return "SELECT " + ", ".join(f"{columns.get(c, repr(''))} AS {c}" for c in schema.TIMELINE) + f" FROM {source}"


def ev(spark, d) -> DataFrame:
    return fixture.events(spark, d)


def text(*parts) -> Column:
    """Parts as one string: strings as they are, columns cast."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pick(n: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (n % len(values) + 1).cast("int"))


def pick_sql(n: str, values: list[str]) -> str:
    return "[" + ", ".join(values) + f"][CAST({n} % {len(values)} AS INT) + 1]"


def quoted(values: list[str]) -> list[str]:
    return ["'" + v + "'" for v in values]


def event_no() -> Column:
    return F.col("event_id")


def user_no() -> Column:
    return F.col("user_id")


# -- Windows event records -------------------------------------------------------------------------
def event_xml(provider: Column, number: Column, data: list[tuple[str, Column]], user_data: Column, computer: Column, time: Column) -> Column:
    items = [text(f'<Data Name="{k}">', v, "</Data>") for k, v in data]
    return text(
        '<Event><System><Provider Name="', provider, '"/><EventID Qualifiers="0">', number, '</EventID><TimeCreated SystemTime="', time, '"/><Computer>', computer,
        '</Computer><Security UserID="S-1-5-21"/></System><EventData>', *items, "</EventData><UserData>", user_data, "</UserData></Event>",
    )


IDS = ["4624", "4625", "4634", "4647", "4648", "4768", "4769", "4770", "4771", "4776", "4778", "4779", "5140", "1102"]
STATUS = ["0x0", "0x6", "0xC0000234"]

def _security_data() -> list[tuple[str, Column]]:
    return [
        ("TargetUserName", text("a&amp;b", user_no())), ("TargetDomainName", F.lit("CORP")), ("SubjectUserName", text("s", user_no() % 7)), ("SubjectDomainName", F.lit("DOM")),
        ("LogonType", F.when(event_no() % 2 == 0, "10").otherwise("")), ("WorkstationName", text("WS", user_no() % 50)), ("IpAddress", pick(event_no(), [text("::ffff:10.0.0.", user_no() % 200), text("fe80::", user_no()), text("10.1.0.", user_no() % 200)])),
        ("Status", pick(event_no(), STATUS)), ("SubStatus", F.lit("0xC000006A")), ("ProcessName", F.lit("C:\\p.exe")), ("TargetLogonId", text("0x", event_no())), ("ShareName", F.lit("\\\\*\\C$")),
        ("RelativeTargetName", F.when(event_no() % 4 == 0, "x").otherwise("")), ("TargetDomainName", F.lit("LAST")),
    ]


_ID = pick_sql("event_id", quoted(IDS))
_SECURITY = timeline_sql(
    f"(SELECT *, {_ID} AS id, {pick_sql('event_id', quoted(STATUS))} AS status FROM events) WHERE id <> '1102' AND event_id % 17 <> 0",
    time_created="strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')",
    dst_computer="'SRV' || user_id % 9 || '.corp'",
    event_type="CASE WHEN id IN ('4624', '4648', '4778') THEN 'SUCCESSFUL_LOGON' WHEN id IN ('4625', '4771') THEN 'FAILED_LOGON' WHEN id IN ('4634', '4647', '4779') THEN 'LOGOFF'"
    " WHEN id = '5140' THEN 'CONNECT' WHEN status = '0x0' THEN 'SUCCESSFUL_LOGON' ELSE 'FAILED_LOGON' END",
    event_id="id",
    logon_type="CASE WHEN event_id % 2 = 0 THEN '10' WHEN id IN ('4768', '4769', '4770', '4771', '4776', '5140', '4648') THEN '3' ELSE '' END",
    target_user_name="'a&b' || user_id",
    target_domain_name="'LAST'",
    src_computer="'WS' || user_id % 50",
    src_ip="CASE event_id % 3 WHEN 0 THEN '10.0.0.' || user_id % 200 WHEN 1 THEN '' ELSE '10.1.0.' || user_id % 200 END",
    subject_user_name="'s' || user_id % 7",
    subject_domain_name="'DOM'",
    logon_id="'0x' || event_id",
    detail="CASE WHEN id IN ('4625', '4771', '4776') THEN 'Wrong password (0xC000006A)' WHEN id = '5140' THEN CASE WHEN event_id % 4 = 0 THEN '\\\\*\\C$\\x' ELSE '\\\\*\\C$' END ELSE 'C:\\p.exe' END",
    log_filename="'Security.evtx'",
)


def _time() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


@query(_SECURITY)
def source_security_xml(spark, d):
    provider = F.when(event_no() % 17 == 0, "Other-Provider").otherwise(windows.P + "Security-Auditing")
    xml = event_xml(provider, pick(event_no(), IDS), _security_data(), F.lit(""), text("SRV", user_no() % 9, ".corp"), _time())
    return windows.to_timeline(windows.from_xml(ev(spark, d).select(xml.alias("xml"))), "Security.evtx")


@query(_SECURITY)
def source_winlogbeat(spark, d):
    """The same records as NDJSON, between lines that are no events."""
    data = F.struct(*[F.when(v != "", v).alias(k) if k == "LogonType" else F.regexp_replace(v, "&amp;", "&").alias(k) for k, v in dict(_security_data()).items()])
    provider = F.when(event_no() % 17 == 0, "Other-Provider").otherwise(windows.P + "Security-Auditing")
    winlog = F.struct(provider.alias("provider_name"), pick(event_no(), IDS).cast("int").alias("event_id"), data.alias("event_data"))
    line = F.to_json(F.struct(_time().alias("@timestamp"), F.struct(text("SRV", user_no() % 9, ".corp").alias("name")).alias("host"), F.struct(F.lit("winlogbeat").alias("type")).alias("agent"), F.struct(F.lit("x").alias("kind")).alias("event"), winlog.alias("winlog")))
    odd = F.when(event_no() % 5 == 0, F.regexp_replace(line, '"event_id":[0-9]+', '"event_id":"none"')).when(event_no() % 5 == 1, "no json").otherwise("{}")
    lines = ev(spark, d).select(F.explode(F.array(line, odd)).alias("value"))
    return windows.to_timeline(windows.from_winlogbeat(lines), "Security.evtx")


@query("SELECT count(*) > 0 AS winlogbeat FROM events")
def source_winlogbeat_sniff(spark, d):
    line = F.to_json(F.struct(_time().alias("@timestamp"), F.struct(F.lit("winlogbeat").alias("type")).alias("agent"), F.struct(event_no().alias("n")).alias("event"), F.struct(event_no().alias("event_id")).alias("winlog")))
    return windows.is_winlogbeat(ev(spark, d).select(F.explode(F.array(F.lit("no json"), line)).alias("value"))).agg((F.count(F.lit(1)) > 0).alias("winlogbeat"))


_ADDRESS = "'10.2.0.' || user_id % 200"
_CHANNELS = timeline_sql(
    "(SELECT *, event_id % 10 AS c, event_id // 10 % 2 = 0 AS even FROM events) WHERE c < 9 AND (c <> 6 OR even) AND (c <> 7 OR user_id % 5 > 1)",
    time_created="strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')",
    dst_computer="CASE c WHEN 1 THEN 'FS' || user_id WHEN 2 THEN 'T' || user_id WHEN 6 THEN 'R' || user_id || '.corp' ELSE 'SRV.corp' END",
    event_type="CASE c WHEN 0 THEN 'FAILED_LOGON' WHEN 1 THEN CASE WHEN even THEN 'FAILED_LOGON' ELSE 'CONNECT' END WHEN 3 THEN 'SUCCESSFUL_LOGON' WHEN 4 THEN CASE WHEN even THEN 'SUCCESSFUL_LOGON' ELSE 'LOGOFF' END"
    " WHEN 8 THEN 'FAILED_LOGON' ELSE 'CONNECT' END",
    event_id="CASE c WHEN 0 THEN '551' WHEN 1 THEN CASE WHEN even THEN '31001' ELSE '30803' END WHEN 2 THEN CASE WHEN even THEN '1024' ELSE '1102' END WHEN 3 THEN '1149' WHEN 4 THEN CASE WHEN even THEN '21' ELSE '24' END"
    " WHEN 5 THEN '131' WHEN 6 THEN '6' WHEN 7 THEN '5858' ELSE '1009' END",
    logon_type="CASE WHEN c IN (2, 3, 4, 5) THEN '10' ELSE '3' END",
    target_user_name="CASE c WHEN 2 THEN 'S-1-5-21' WHEN 5 THEN '' WHEN 6 THEN '' ELSE 'u' || user_id END",
    target_domain_name="CASE WHEN c IN (3, 4, 7) THEN 'CORP' ELSE '' END",
    src_computer=f"CASE WHEN c IN (0, 8) THEN 'CL' || user_id WHEN c IN (1, 2, 6) THEN 'SRV.corp' WHEN c = 7 THEN 'OTHER' || user_id WHEN c = 5 THEN {_ADDRESS} ELSE '' END",
    src_ip=f"CASE WHEN c IN (3, 4, 5) THEN {_ADDRESS} ELSE '' END",
    detail="CASE WHEN c IN (0, 1, 8) THEN '\\\\FS\\s' WHEN c = 7 THEN 'Exec' ELSE '' END",
    log_filename="'x.evtx'",
)


@query(_CHANNELS)
def source_channels_xml(spark, d):
    """One record of each other channel in turn, local WinRM and WMI ones among them, and one of an unknown provider."""
    even, user, address, c = (event_no() / 10).cast("long") % 2 == 0, text("u", user_no()), text("10.2.0.", user_no() % 200), event_no() % 10
    two = lambda a, b: F.when(even, a).otherwise(b)
    providers = ["SMBServer", "SMBClient", "TerminalServices-ClientActiveXCore", "TerminalServices-RemoteConnectionManager", "TerminalServices-LocalSessionManager", "RemoteDesktopServices-RdpCoreTS", "WinRM", "WMI-Activity", "SMBServer", "Nothing"]
    numbers = [F.lit("551"), two("31001", "30803"), two("1024", "1102"), F.lit("1149"), two("21", "24"), F.lit("131"), F.lit("6"), F.lit("5858"), F.lit("1009"), F.lit("1")]
    data = [
        ("UserName", F.when(c == 1, user).otherwise("")), ("ServerName", text("FS", user_no())), ("ShareName", F.when(c == 1, "\\\\FS\\s").otherwise("")), ("Value", text("T", user_no())),
        ("ClientIP", text(address, ":50000")), ("connection", two(text("http://R", user_no(), ".corp:5985/wsman"), F.when(user_no() % 2 == 0, "localhost/wsman").otherwise("http://srv:5985/wsman"))),
    ]
    smb = text("<EventData><ClientName>CL", user_no(), "</ClientName><UserName>", user, "</UserName><ShareName>\\\\FS\\s</ShareName></EventData>")
    manager = text("<EventXML><Param1>", user, "</Param1><Param2>CORP</Param2><Param3>", address, "</Param3></EventXML>")
    session = text("<EventXML><User>CORP\\", user, "</User><Address>", address, "</Address></EventXML>")
    client = F.when(user_no() % 5 == 0, "srv").otherwise(text("OTHER", user_no()))
    account = F.when(user_no() % 5 == 1, "NT AUTHORITY\\SYSTEM").otherwise(text("CORP\\", user))
    wmi = text("<Operation_ClientFailure><ClientMachine>", client, "</ClientMachine><User>", account, "</User><Operation>Exec</Operation></Operation_ClientFailure>")
    none = F.lit("")
    xml = event_xml(F.concat(F.lit(windows.P), pick(c, providers)), pick(c, numbers), data, pick(c, [smb, none, none, manager, session, none, none, wmi, smb, none]), F.lit("SRV.corp"), _time())
    return windows.to_timeline(windows.from_xml(ev(spark, d).select(xml.alias("xml"))), "x.evtx")


# -- Linux -----------------------------------------------------------------------------------------
_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')"
_SYSLOG = timeline_sql(
    "(SELECT *, event_id % 7 AS c FROM events) WHERE c < 6",
    time_created=f"CASE WHEN c = 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE {_STAMP} END",
    dst_computer="'web' || user_id % 3",
    event_type="CASE WHEN c = 1 THEN 'FAILED_LOGON' WHEN c = 3 THEN 'CONNECT' WHEN c = 5 THEN 'FAILED_LOGON' ELSE 'SUCCESSFUL_LOGON' END",
    event_id="CASE WHEN c = 1 THEN 'SSH_FAILED' WHEN c = 3 THEN 'XINETD' WHEN c = 5 THEN 'PAM_FAILED' ELSE 'SSH_SUCCESS' END",
    target_user_name="CASE WHEN c = 3 THEN '' ELSE 'u' || user_id END",
    src_ip="CASE WHEN c = 2 THEN '2001:db8::' || user_id % 100 ELSE '10.3.0.' || user_id % 200 END",
    log_filename="'auth.log'",
)


@query(_SYSLOG)
def source_syslog(spark, d):
    """Both line formats, every message kind, and each time a line whose remote is no address."""
    ip, host, user, c = text("10.3.0.", user_no() % 200), text("web", user_no() % 3), text("u", user_no()), event_no() % 7
    head = F.concat(F.date_format("ts", "MMM "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "), F.date_format("ts", " HH:mm:ss "), host, F.lit(" sshd[1]: "))
    kinds = [
        text(head, "Accepted publickey for ", user, " from ", ip, " port 22 ssh2"), text(head, "Failed password for ", user, " from ", ip, " port 22 ssh2"), text(head, "Accepted password for ", user, " from 2001:db8::", user_no() % 100, " port 22"),
        text(head, "START: telnet pid=1 from=::ffff:", ip), text("<34>1 ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), " ", host, " sshd 1 - - Accepted password for ", user, " from ", ip, " port 22"),
        text(head, "pam_unix(sshd:auth): authentication failure; logname= uid=0 rhost=", ip, "  user=", user), text(head, "Connection closed by ", ip),
    ]
    noise = text(head, "Failed password for invalid user ", user, " from ", ip, " port 22")
    lines = ev(spark, d).select(F.explode(F.array(pick(c, kinds), noise)).alias("line"))
    return linux.syslog(lines, year=2024, file="auth.log")


_AUDIT = timeline_sql(
    "events WHERE event_id % 4 < 2 AND event_id % 3 < 2",
    time_created=_STAMP,
    dst_computer="'web'",
    event_type="CASE WHEN user_id % 2 = 0 THEN 'SUCCESSFUL_LOGON' ELSE 'FAILED_LOGON' END",
    event_id="CASE WHEN event_id % 4 = 0 THEN 'USER_LOGIN' ELSE 'USER_AUTH' END",
    target_user_name="CASE event_id % 3 WHEN 0 THEN 'acct' || user_id ELSE 'au' || user_id END",
    src_ip="'10.4.0.' || user_id % 200",
    log_filename="'audit.log'",
)


@query(_AUDIT)
def source_audit(spark, d):
    kind = pick(event_no(), ["USER_LOGIN", "USER_AUTH", "SYSCALL", "USER_END"])
    who = F.when(event_no() % 3 == 0, text('acct="acct', user_no(), '" AUID="x"')).otherwise(text('AUID="au', user_no(), '" UID="root"'))
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    line = text("type=", kind, " msg=audit(", secs, ".123:", event_no(), "): pid=1 uid=0 ", who, " addr=", F.when(event_no() % 3 == 2, "?").otherwise(text("10.4.0.", user_no() % 200)), " res=", F.when(user_no() % 2 == 0, "success").otherwise("failed"))
    return linux.audit(ev(spark, d).select(line.alias("line")), hostname="web")


_UTMP = timeline_sql(
    "(SELECT *, event_id % 6 AS c, user_id % 2 = 0 AS bad FROM events) WHERE bad OR c < 3",
    time_created=_STAMP,
    dst_computer="'web'",
    event_type="CASE WHEN bad THEN 'FAILED_LOGON' WHEN c = 0 THEN 'SUCCESSFUL_LOGON' WHEN c = 1 THEN 'LOGOFF' ELSE 'CONNECT' END",
    event_id="CASE WHEN bad THEN 'FAILED_LOGIN' WHEN c = 0 THEN 'LOGIN' WHEN c = 1 THEN 'LOGOUT' ELSE 'BOOT_TIME' END",
    target_user_name="'u' || user_id",
    src_computer="''",
    src_ip="CASE WHEN c >= 3 THEN '' WHEN event_id % 4 = 0 THEN '10.5.0.' || user_id % 200 ELSE '10.6.' || user_id % 100 || '.7' END",
    detail="'pts/0'",
    log_filename="CASE WHEN bad THEN 'btmp' ELSE 'wtmp' END",
)


def _field(value: Column, size: int) -> Column:
    raw = F.encode(value, "UTF-8")
    return F.unhex(F.rpad(F.hex(raw), 2 * size, "0"))


def _int(value: Column) -> Column:
    """Four bytes, least first."""
    h = F.lpad(F.hex(value.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


@query(_UTMP)
def source_login_records(spark, d):
    """Binary records, address as text or as number; records without one count in btmp only."""
    c = event_no() % 6
    kind = _int(pick(c, ["7", "8", "2", "7", "7", "7"]).cast("long"))
    host = F.when((c < 3) & (event_no() % 4 == 0), text("10.5.0.", user_no() % 200)).otherwise("")
    address = F.when((c < 3) & (event_no() % 4 != 0), F.lit(10) + 6 * 256 + (user_no() % 100) * 65536 + 7 * 16777216).otherwise(0)
    zero = _int(F.lit(0))
    record = F.concat(kind, zero, _field(F.lit("pts/0"), 32), zero, _field(text("u", user_no()), 32), _field(host, 256), zero, zero, _int(F.unix_timestamp(F.col("ts").cast("timestamp"))), zero, _int(address), zero, zero, zero, _field(F.lit(""), 20))
    made = ev(spark, d).select(F.when(user_no() % 2 == 0, "file:/log/btmp").otherwise("file:/log/wtmp").alias("path"), record.alias("content"))
    other = ev(spark, d).select(F.lit("file:/log/wtmp").alias("path"), F.concat(_int(F.lit(9)), F.unhex(F.repeat(F.lit("00"), 380))).alias("content"))
    return linux.utmp(made.unionByName(other), "web")


@query(
    timeline_sql(
        "events WHERE event_id % 3 < 2 AND event_id % 4 <> 3", time_created=_STAMP, dst_computer="'web' || user_id % 3", event_type="CASE WHEN event_id % 4 = 0 THEN 'FAILED_LOGON' ELSE 'SUCCESSFUL_LOGON' END",
        event_id="CASE WHEN event_id % 4 = 0 THEN 'SSH_FAILED' ELSE 'SSH_SUCCESS' END", target_user_name="'u' || user_id", src_ip="'10.7.0.' || user_id % 200", log_filename="'journal'",
    )
)
def source_journal(spark, d):
    message = pick(event_no(), [text("Failed password for u", user_no(), " from 10.7.0.", user_no() % 200, " port 2"), text("Accepted password for u", user_no(), " from 10.7.0.", user_no() % 200, " port 2"), text("Accepted publickey for u", user_no(), " from 10.7.0.", user_no() % 200), F.lit("Server listening")])
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    entry = F.struct(F.when(event_no() % 3 == 0, "sshd").otherwise("x").alias("_COMM"), F.when(event_no() % 3 == 1, "sshd").otherwise("y").alias("SYSLOG_IDENTIFIER"), text("web", user_no() % 3).alias("_HOSTNAME"), micros.alias("__REALTIME_TIMESTAMP"), message.alias("MESSAGE"))
    return linux.journal(ev(spark, d).select(F.to_json(entry).alias("value")))


@query("SELECT user_id % 50 AS root, 2000 + min(event_id % 9 * 10) AS year, 'h' || min(event_id % 9) AS hostname FROM events WHERE event_id % 9 > 1 GROUP BY 1")
def source_year_and_hostname(spark, d):
    rows = ev(spark, d).select((user_no() % 50).alias("root"), (event_no() % 9).alias("priority"), F.when(event_no() % 9 > 1, 2000 + event_no() % 9 * 10).alias("year"), F.when(event_no() % 9 > 1, text("h", event_no() % 9)).otherwise("").alias("hostname"))
    return linux.infer_year(rows).join(linux.infer_hostname(rows), "root")


# -- files -----------------------------------------------------------------------------------------
@query(
    timeline_sql(
        "(SELECT *, event_id % 6 AS c FROM events) WHERE c < 3", time_created="strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE c WHEN 1 THEN '+02:00' ELSE 'Z' END", dst_computer="'SRV'", event_type="'CONNECT'", event_id="'SCHTASK'",
        target_user_name="'run' || user_id", src_computer="'PC' || user_id", subject_user_name="'eve'", subject_domain_name="'PC' || user_id", detail="'\\t' || event_id || ' cmd.exe'", log_filename="'task' || event_id",
    )
)
def source_tasks(spark, d):
    """UTF-16 and UTF-8 files; local, system and undated ones are left out."""
    c, when = event_no() % 6, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    date = pick(c, [when, text(when, "+02:00"), text(when, "Z"), when, when, F.lit("")])
    author = pick(c, [text("PC", user_no(), "\\eve"), text("PC", user_no(), "\\eve"), text("PC", user_no(), "\\eve"), F.lit("srv\\eve"), F.lit("NT AUTHORITY\\SYSTEM"), text("PC", user_no(), "\\eve")])
    xml = text('<?xml version="1.0"?><Task><RegistrationInfo><Date>', date, "</Date><Author>", author, "</Author><URI>\\t", event_no(), "</URI></RegistrationInfo><Command> cmd.exe </Command><UserId>run", user_no(), "</UserId></Task>")
    content = F.when(event_no() % 2 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(xml, "UTF-16LE"))).otherwise(F.encode(xml, "UTF-8"))
    return files.tasks(ev(spark, d).select(text("file:/Tasks/task", event_no()).alias("path"), content.alias("content")), "SRV")


@query(
    timeline_sql(
        "events WHERE event_id % 3 = 0", time_created=_STAMP, dst_computer="CASE WHEN user_id % 2 = 0 THEN 'FS' || user_id ELSE '10.0.0.' || user_id % 200 END", event_type="'CONNECT'", event_id="'MountPoints2'", target_user_name="'u' || user_id",
        src_computer="'PC'", detail="CASE WHEN user_id % 2 = 0 THEN '\\\\FS' || user_id || '\\share' ELSE '\\\\10.0.0.' || user_id % 200 || '\\share (address)' END", log_filename="'NTUSER.DAT'",
    )
)
def source_mount_points(spark, d):
    server = F.when(user_no() % 2 == 0, text("FS", user_no())).otherwise(text("10.0.0.", user_no() % 200))
    ticks = (F.unix_timestamp(F.col("ts").cast("timestamp")) + 11_644_473_600) * 10_000_000
    rows = ev(spark, d).select(text("u", user_no()).alias("user"), F.when(event_no() % 3 == 1, "C").otherwise(text("##", server, "#share")).alias("key"), F.when(event_no() % 3 == 2, "0").otherwise(ticks.cast("string")).alias("last_write"))
    return files.mount_points(rows, "PC")


_ROLES = [("{A}", "File Server", "UAL_FILE_SERVER", "3"), ("{B}", "Remote Access", "UAL_REMOTE_ACCESS", "10"), ("{C}", "Active Directory Domain Services", "UAL_ACTIVE_DIRECTORY_DOMAIN_SERVICES", "3"), ("{D}", "Web Server", "UAL_WEB_SERVER", "")]


@query(
    timeline_sql(
        f"(SELECT *, {pick_sql('user_id', quoted([r[1] for r in _ROLES] + ['{E}']))} AS role, {pick_sql('user_id', quoted([r[2] for r in _ROLES] + ['UAL__E_']))} AS tag, {pick_sql('user_id', quoted([r[3] for r in _ROLES] + ['']))} AS kind FROM events)"
        " WHERE event_id % 5 < 3",
        time_created="strftime(ts, '%Y-%m-%d %H:%M:%S')", dst_computer="'SRV'", event_type="'SUCCESSFUL_LOGON'", event_id="tag", logon_type="kind", target_user_name="'u' || user_id", target_domain_name="'CORP'",
        src_ip="CASE event_id % 5 WHEN 0 THEN '10.0.0.' || user_id % 100 WHEN 1 THEN '::1' ELSE '192.168.0.' || user_id % 100 END", detail="role", log_filename="'UAL'",
    )
)
def source_access_logging(spark, d):
    """Addresses as hex bytes of both families, roles by guid in any case, rows without a user or a date."""
    byte = F.lpad(F.hex(user_no() % 100), 2, "0")
    address = pick(event_no() % 5, [F.concat(F.lit("0A 00 00 "), byte), text("00 " * 15, "01"), F.concat(F.lit("00 " * 10 + "FF FF C0 A8 00 "), byte), byte, byte])
    ticks = ((F.unix_timestamp(F.col("ts").cast("timestamp")) + 11_644_473_600) * 10_000_000).cast("string")
    rows = ev(spark, d).select(
        F.when(event_no() % 5 == 3, "").otherwise(text("CORP\\u", user_no())).alias("user"), address.alias("address"), F.when(event_no() % 5 == 4, "0").otherwise(F.when(event_no() % 2 == 0, ticks).otherwise("0")).alias("insert_date"),
        F.when(event_no() % 5 == 4, "0").otherwise(ticks).alias("last_access"), pick(user_no(), ["{a}", "{b}", "{c}", "{d}", "{E}"]).alias("role_guid"),
    )
    return ual.events(rows, spark.createDataFrame([r[:2] for r in _ROLES], "guid string, name string"), "SRV")


@query(f"WITH {fixture.SQL} SELECT {', '.join('CASE WHEN ordinal % 3 = 0 THEN ' + chr(39) + 'a, ' + chr(34) + 'b' + chr(34) + chr(39) + ' ELSE ' + chr(39) * 2 + ' END AS detail' if c == 'detail' else c for c in schema.TIMELINE)} FROM tl")
def sink_timeline_csv(spark, d):
    """Written as CSV and read again, quoted commas and quotes included."""
    rows = fixture.timeline(spark, d)
    detail = F.when(F.col("ordinal") % 3 == 0, 'a, "b"').otherwise("")
    path = f"{shared_dir(spark)}/timeline-{uuid.uuid4().hex}"
    files.write_timeline(rows.withColumn("detail", detail), path, single=False)
    return files.read_timeline(spark, path)


@query(f"WITH {fixture.SQL} SELECT {T14} FROM (SELECT * REPLACE ('' AS event_type, '' AS logon_id) FROM tl)")
def source_legacy_csv(spark, d):
    """The 12-column shape as text lines with its header, rows of another width and a file of another header between."""
    rows = fixture.timeline(spark, d).withColumnRenamed("detail", "process")
    lines = rows.select(F.concat_ws(",", *schema.LEGACY).alias("value"))
    odd = rows.where("ordinal % 10 = 0").select(F.lit("too,few").alias("value"))
    root = f"{shared_dir(spark)}/legacy-{uuid.uuid4().hex}"
    head = spark.createDataFrame([(",".join(schema.LEGACY),)], "value string")
    lines.unionByName(odd).withColumn("k", F.lit(1)).unionByName(head.withColumn("k", F.lit(0))).coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{root}/good")
    lines.write.text(f"{root}/other")
    return files.read_timeline(spark, f"{root}/*")


_KINDS = {0: "uploads.json", 1: "x_KAPE.cli", 2: "payload_1.log", 3: "Logs/a.evtx", 4: "readme.txt"}


@query(
    """SELECT 'a' || user_id % 40 || '.zip' AS archive, CASE WHEN max(CASE WHEN k = 0 THEN 1 ELSE 0 END) = 1 THEN 'velociraptor' WHEN max(CASE WHEN k = 1 THEN 1 ELSE 0 END) = 1 THEN 'kape'
      WHEN count(*) FILTER (WHERE k = 2) >= 2 THEN 'cortex' WHEN count(*) FILTER (WHERE k = 3) >= 5 THEN 'archive' ELSE '' END AS kind FROM (SELECT *, greatest(user_id % 5, event_id % 5) AS k FROM events) GROUP BY 1"""
)
def source_triage_kind(spark, d):
    k = F.greatest(user_no() % 5, event_no() % 5)
    entry = F.element_at(F.array(*[F.lit(v) for v in _KINDS.values()]), (k + 1).cast("int"))
    return files.triage_kind(ev(spark, d).select(text("a", user_no() % 40, ".zip").alias("archive"), entry.alias("entry")))


@query(
    """SELECT event_id AS ordinal, CASE event_id % 5 WHEN 0 THEN '[IMAGE]' WHEN 1 THEN '[TRIAGE]' WHEN 2 THEN '[ARCHIVE]' WHEN 3 THEN '[ARCHIVE]' ELSE '[FOLDER]' END AS label,
      CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS INT) ELSE -1 END AS vss FROM events"""
)
def source_labels(spark, d):
    path = pick(event_no(), ["/e/disk.E01", "/e/h.zip", "/e/h.zip -> a.evtx", "/e/h.ZIP", "/e/logs/a.evtx"])
    name = F.when(event_no() % 2 == 0, text("Security_vss_", user_no(), ".evtx")).otherwise("Security.evtx")
    return ev(spark, d).select(event_no().alias("ordinal"), files.source_label(path, F.when(event_no() % 5 == 1, "kape").otherwise("")).alias("label"), F.coalesce(vss_index(name), F.lit(-1)).alias("vss"))


@query(f"WITH {fixture.SQL} SELECT CASE WHEN ordinal % 2 = 0 THEN 'Security.evtx' ELSE 'System.evtx' END AS source, CASE WHEN ordinal % 3 > 0 THEN CAST(ordinal % 3 AS INT) ELSE -1 END AS vss, count(*) AS n FROM tl GROUP BY 1, 2")
def source_breakdown(spark, d):
    o = F.col("ordinal")
    name = F.concat(F.when(o % 2 == 0, "Security").otherwise("System"), F.when(o % 3 > 0, text("_vss_", o % 3)).otherwise(""), F.lit(".evtx"))
    return files.by_source(fixture.timeline(spark, d).withColumn("log_filename", name)).withColumn("vss", F.coalesce("vss", F.lit(-1)))


# -- EDR -------------------------------------------------------------------------------------------
_MS = "strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || '000Z'"
_FORENSIC_IDS = ["4624", "4625", "4634", "4648", "4776", "9999"]


def _forensics(spark, d) -> DataFrame:
    return ev(spark, d).select(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string").alias("Timestamp"), F.lit("SRV").alias("dst_host"), pick(event_no(), _FORENSIC_IDS).alias("event_id"), F.lit("s").alias("subject_name"), F.lit("SD").alias("subject_domain"),
        text("u", user_no()).alias("target_user"), F.lit("CORP").alias("target_domain"), F.lit("3").alias("lt"), F.when(user_no() % 4 == 0, "SRV").otherwise(text("WS", user_no())).alias("source_host"), text("::ffff:10.8.0.", user_no() % 200).alias("srcip"),
        F.when(event_no() % 6 == 1, "0xC0000064").otherwise("a,b").alias("process"), F.when(event_no() % 7 == 0, "Application").otherwise("Security").alias("source"), F.when(event_no() % 11 == 0, "-").otherwise("text").alias("message"),
    )


_FORENSICS = timeline_sql(
    f"(SELECT *, {pick_sql('event_id', quoted(_FORENSIC_IDS))} AS id FROM events) WHERE id <> '9999' AND user_id % 4 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0",
    time_created=_MS, dst_computer="'SRV'", event_type="CASE WHEN id = '4625' THEN 'FAILED_LOGON' WHEN id = '4634' THEN 'LOGOFF' ELSE 'SUCCESSFUL_LOGON' END", event_id="id", logon_type="'3'", target_user_name="'u' || user_id",
    target_domain_name="'CORP'", src_computer="'WS' || user_id", src_ip="'10.8.0.' || user_id % 200", subject_user_name="'s'", subject_domain_name="'SD'",
    detail="CASE WHEN id = '4625' THEN 'User does not exist (0xC0000064)' ELSE 'a;b' END", log_filename="'xdr_forensics'",
)


@query(_FORENSICS)
def edr_forensics(spark, d):
    return edr.forensics(edr.forensic_filter(_forensics(spark, d)))


def _network(spark, d) -> DataFrame:
    return ev(spark, d).select(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string").alias("_time"), text("AG", user_no() % 5).alias("agent_hostname"), pick(user_no(), ["10.0.0.1", "10.0.0.2", "", "::"]).alias("action_local_ip"),
        pick(event_no(), ["3389", "50000", "22"]).alias("action_local_port"), pick(event_no(), ["10.9.0.1", "127.0.0.1", "10.0.0.1", "fe80::1", "10.9.0.2"]).alias("action_remote_ip"), pick(event_no(), ["50001", "8080", "445", "80"]).alias("action_remote_port"),
        F.lit("CORP\\u").alias("actor_primary_username"), F.lit("x").alias("actor_process_command_line"),
    )


_PUSHED = f"""SELECT 'AG' || user_id % 5 AS agent, {pick_sql('user_id', quoted(['10.0.0.1', '10.0.0.2', '', '::']))} AS a, {pick_sql('event_id', quoted(['3389', '50000', '22']))} AS p,
  {pick_sql('event_id', quoted(['10.9.0.1', '127.0.0.1', '10.0.0.1', 'fe80::1', '10.9.0.2']))} AS b, {pick_sql('event_id', quoted(['50001', '8080', '445', '80']))} AS q, {_MS} AS t FROM events"""
_PUSHED = f"(SELECT * FROM ({_PUSHED}) WHERE (p IN ('3389', '22') OR q = '445') AND a NOT IN ('', '::') AND b NOT IN ('127.0.0.1', 'fe80::1') AND a <> b)"


@query(
    timeline_sql(
        _PUSHED, time_created="t", dst_computer="CASE WHEN p IN ('3389', '22') THEN agent ELSE b END", event_type="'CONNECT'", event_id="'xdr_network'", logon_type="CASE p WHEN '3389' THEN '10' WHEN '22' THEN 'SSH' ELSE '3' END", target_user_name="'u'", target_domain_name="'CORP'",
        src_computer="CASE WHEN p IN ('3389', '22') THEN '' ELSE agent END", src_ip="CASE WHEN p IN ('3389', '22') THEN b ELSE a END", detail="'x'", log_filename="'xdr'",
    )
)
def edr_network_filtered(spark, d):
    return edr.network(edr.push_down(_network(spark, d), ignore_local=True))


@query(f"SELECT time_created, row_number() OVER (ORDER BY time_created) AS place FROM (SELECT strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || '000Z' AS time_created FROM events WHERE event_id % 50 > 0 UNION ALL SELECT '' FROM events WHERE event_id % 50 = 0)")
def edr_ordered(spark, d):
    """By time in milliseconds; records without a readable time come first."""
    rows = ev(spark, d).select(F.when(event_no() % 50 == 0, "").otherwise(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string")).alias("_time"))
    return numbered(rows, *edr.ordered(rows)).select(vendor_time(F.col("_time")).alias("time_created"), "place")


@query(f"WITH {fixture.SQL} SELECT (SELECT count(DISTINCT h) FROM (SELECT dst_computer AS h FROM tl UNION ALL SELECT src_computer FROM tl) WHERE h <> '') AS hosts, (SELECT count(DISTINCT event_id) FROM tl) AS event_ids")
def edr_distinct_seen(spark, d):
    return edr.distinct_seen(fixture.timeline(spark, d))


# -- rules -----------------------------------------------------------------------------------------
_RULES = [
    {"prefilter": {"contains_all": ["fw", "user"]}, "parsers": [
        {"name": "sub", "match": {"contains": "CSV"}, "extract": {"csv": {"delimiter": ",", "quote": '"', "columns": {1: "body", 2: "host"}}},
         "sub_extract": {"field": "body", "strip_before": "msg: ", "keyvalue": {"pair_sep": ";", "kv_sep": "="}},
         "map": {"target_user_name": "${user}", "ip_address": "${ip}", "computer": "${host}", "detail": "${__source_file}:${__line_number}", "filename": "${nofile}"}},
        {"name": "re", "match": {"regex": r"logged (in|on)$"}, "extract": {"regex": r"user (?P<user>\w+) at (?P<ip>[\d.]+)"}, "map": {"target_user_name": "${user}", "ip_address": "${ip}", "event_type": "SUCCESSFUL_LOGON", "filename": "own"}},
    ]},
]


def _log(spark, d) -> DataFrame:
    csv = text('fw CSV,"x, user msg: user=""u', user_no(), '"";ip=\'10.0.1.', user_no() % 200, "'\", H", user_no())
    line = pick(event_no(), [csv, text("fw user u", user_no(), " at 10.0.2.", user_no() % 200, " logged in"), text("fw user u", user_no(), " somewhere logged on"), text("user u", user_no(), " at 10.0.2.1 logged in"), text("fw user u", user_no(), " logged off")])
    return ev(spark, d).select(line.alias("line"), event_no().alias("k"), text("f", event_no() % 3, ".log").alias("file"))


@query(
    """SELECT event_id AS k, CASE WHEN event_id % 5 = 0 THEN 'sub' ELSE 're' END AS parser, 'u' || user_id AS target_user_name, CASE WHEN event_id % 5 = 0 THEN '10.0.1.' || user_id % 200 ELSE '10.0.2.' || user_id % 200 END AS src_ip,
      CASE WHEN event_id % 5 = 0 THEN 'H' || user_id ELSE '' END AS dst_computer, CASE WHEN event_id % 5 = 0 THEN 'f' || event_id % 3 || '.log:' || event_id ELSE '' END AS detail,
      CASE WHEN event_id % 5 = 0 THEN 'f' || event_id % 3 || '.log' ELSE 'own' END AS log_filename FROM events WHERE event_id % 5 < 2"""
)
def custom_sub_extract(spark, d):
    got = custom_rules.parse(_log(spark, d), custom_rules.load(_RULES), carry=["k"], file_col="file", number_col="k")
    return got.select("k", "parser", "target_user_name", "src_ip", "dst_computer", "detail", "log_filename")


@query("SELECT CASE WHEN event_id % 5 = 0 THEN 'sub' ELSE 're' END AS parser, count(*) AS n FROM events WHERE event_id % 5 < 2 GROUP BY 1")
def custom_hits(spark, d):
    return custom_rules.hits(custom_rules.parse(_log(spark, d), custom_rules.load(_RULES)))


@query("SELECT least(20, count(*) FILTER (WHERE event_id % 5 >= 2)) AS n, count(*) FILTER (WHERE event_id % 5 < 2 AND false) AS taken FROM events")
def custom_rejected(spark, d):
    """The report shows 20 of the lines that no parser takes; which ones is open, so they are counted."""
    got = custom_rules.rejected(_log(spark, d), custom_rules.load(_RULES), limit=20)
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") % 5 < 2).alias("taken"))


# -- filters ---------------------------------------------------------------------------------------
@query(f"WITH {fixture.SQL} SELECT count(*) AS summed, 0 AS kept FROM tl")
def filter_dry_run(spark, d):
    """A dry run reports every row and keeps none."""
    config = filters.FilterConfig.parse(True, " error_*, ,*$", "*07*", "10.2.0.0/16,10.1.0.5", dry_run=True)
    rows = fixture.timeline(spark, d)
    kept = filters.apply_filters(rows, config).agg(F.count(F.lit(1)).cast("int").alias("kept"))
    return filters.filter_summary(rows, config).agg(F.sum("n").alias("summed")).crossJoin(F.broadcast(kept))  # one row each


@query(f"WITH {fixture.SQL} SELECT ordinal FROM tl WHERE (ordinal % 10 = 0) OR ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def load_time_window(spark, d):
    """A load keeps rows whose time cannot be read."""
    rows = fixture.timeline(spark, d).withColumn("time_created", F.when(F.col("ordinal") % 10 == 0, "unknown").otherwise(F.col("time_created")))
    return timeline.load_window(rows, datetime(2024, 1, 10), datetime(2024, 1, 12, 12)).select("ordinal")


# -- binary event logs -----------------------------------------------------------------------------
def event_logs(spark, d) -> DataFrame:
    """(path, content): binary logs made of the security records, one for each partition of ``events``."""
    data = F.array(*[F.struct(F.lit(k).alias("k"), F.regexp_replace(v, "&amp;", "&").alias("v")) for k, v in _security_data()])
    provider = F.when(event_no() % 17 == 0, "Other-Provider").otherwise(windows.P + "Security-Auditing")
    ticks = (F.unix_micros(F.col("ts").cast("timestamp")) + 11_644_473_600_000_000) * 10
    rows = ev(spark, d).select(event_no().alias("n"), ticks.alias("ticks"), provider.alias("provider"), pick(event_no(), IDS).cast("int").alias("id"), text("SRV", user_no() % 9, ".corp").alias("computer"), data.alias("data"))

    def run(frames):
        for frame in frames:
            items = ((r.n, r.ticks, r.provider, r.id, r.computer, [(x["k"], x["v"]) for x in r.data]) for r in frame.itertuples())
            yield pd.DataFrame({"path": [f"file:/logs/{frame['n'].iloc[0]}.evtx"], "content": [evtx.log_file(evtx.encode(items))]})

    return rows.mapInPandas(run, "path string, content binary")


@query(_SECURITY)
def source_evtx(spark, d):
    """Binary logs decoded to XML records and mapped."""
    return windows.to_timeline(windows.from_xml(evtx.records(evtx.chunks(event_logs(spark, d)))), "Security.evtx")


@query("SELECT count(*) AS records, count(*) AS stray, true AS whole FROM events")
def carve_chunks(spark, d):
    """Chunks between other bytes, one more with an error, and records outside any chunk."""
    logs = event_logs(spark, d)

    def shuffle(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                found = [c for _, c in evtx.carved(bytes(content))]
                raw = bytes(512) + b"".join(bytes(1024) + c for c in found)
                loose = b"".join(c[512 : evtx.u32(c, 48)] for c in found)
                yield pd.DataFrame({"path": [path], "content": [raw + bytes(512) + loose + bytes(100)]})

    disk = logs.mapInPandas(shuffle, "path string, content binary")
    found = evtx.chunks(disk)
    decoded = evtx.records(found).agg(F.count(F.lit(1)).alias("records"))
    stray = evtx.orphan_counts(disk).agg(F.sum("n").alias("stray"))
    whole = found.agg(F.bool_and("whole").alias("whole"))
    return decoded.crossJoin(F.broadcast(stray)).crossJoin(F.broadcast(whole))  # one row each


# -- disk images -----------------------------------------------------------------------------------
def _images(spark, d) -> DataFrame:
    return ev(spark, d).select(text("i", event_no()).alias("path"), pick(event_no(), [F.lit(fixture.image(k)) for k in range(7)]).alias("content"))


@query(
    """SELECT 'i' || event_id AS path, ['ntfs', 'bitlocker', 'ext', 'ntfs', 'lvm', 'ntfs', ''][CAST(event_id % 7 AS INT) + 1] AS kind, CAST(CASE WHEN event_id % 7 < 5 THEN 4096 ELSE 0 END AS BIGINT) AS "offset",
      ['NTFS', 'NTFS', 'Linux', 'Basic Data, EFI System', 'Linux LVM', '', ''][CAST(event_id % 7 AS INT) + 1] AS description FROM events"""
)
def image_partitions(spark, d):
    return images.partitions(_images(spark, d))


@query("SELECT CASE event_id % 7 WHEN 1 THEN 'encrypted volume' ELSE 'no partition table' END AS reason, count(*) AS n FROM events WHERE event_id % 7 IN (1, 6) GROUP BY 1")
def image_skip_reasons(spark, d):
    return images.skip_reasons(images.partitions(_images(spark, d)))


@query("SELECT 'd' || event_id || '/a.vmdk' AS path, 20480 AS size, 'E' || event_id AS near, 'U' || user_id AS far FROM events WHERE event_id % 20 = 0")
def image_virtual_disks(spark, d):
    """Sparse, streamed and flat disks, and a descriptor over extents of each type; one event of twenty makes one."""

    def run(frames):
        for frame in frames:
            rows = []
            for n, u in zip(frame["n"], frame["u"], strict=True):
                disk = bytearray(20480)
                disk[4096 : 4096 + len(f"E{n}")], disk[16896 : 16896 + len(f"U{u}")] = f"E{n}".encode(), f"U{u}".encode()
                disk, kind = bytes(disk), n // 20 % 4
                if kind == 3:
                    text = '# Disk DescriptorFile\nRW 8 ZERO\nRW 16 SPARSE "b.vmdk"\nRW 16 FLAT "c-flat.vmdk" 1\n'
                    rows += [(f"d{n}/a.vmdk", text.encode()), (f"d{n}/b.vmdk", images.write_sparse(disk[4096:12288])), (f"d{n}/c-flat.vmdk", bytes(512) + disk[12288:])]
                else:
                    rows.append((f"d{n}/a.vmdk", disk if kind == 0 else images.write_sparse(disk, compressed=kind == 2)))
            yield pd.DataFrame(rows, columns=["path", "content"])

    made = ev(spark, d).where(event_no() % 20 == 0).select(event_no().alias("n"), user_no().alias("u")).mapInPandas(run, "path string, content binary")
    piece = lambda at: F.regexp_extract(F.decode(F.substring("content", at + 1, 40), "ISO-8859-1"), "^([A-Z0-9]*)", 1)
    return images.virtual_disks(made).select("path", F.length("content").alias("size"), piece(4096).alias("near"), piece(16896).alias("far"))


@query(
    """SELECT event_id AS ordinal, ['velociraptor', 'velociraptor', 'kape', 'cortex', '', 'velociraptor'][CAST(event_id % 6 AS INT) + 1] AS kind,
      CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'PC-h' || user_id WHEN 2 THEN 'PC' || user_id WHEN 3 THEN 'PC_' || user_id ELSE '' END AS host, CASE WHEN event_id % 6 = 4 THEN '[ARCHIVE]' ELSE '[TRIAGE]' END AS label FROM events"""
)
def source_triage_join(spark, d):
    """Event logs inside archives with the kind, host and label of the outermost one."""
    archive = pick(event_no(), [text("/e/C_20240101-101010_u", user_no(), ".zip"), text("/e/Collection-PC-h", user_no(), "-2024-01-01T00_00.zip"), text("/e/PC", user_no(), "_20240101.zip"), text("/e/offline_collector_output_PC_", user_no(), "_2024-01-01_10-10-10.zip"), text("/e/x", user_no(), ".zip"), text("/e/Velociraptor/x", user_no(), ".zip")])
    rows = ev(spark, d).select(event_no().alias("ordinal"), F.concat(archive, F.lit(" -> in.zip -> a.evtx")).alias("path"), archive.alias("archive"))
    kinds = rows.select("archive", F.when(F.col("ordinal") % 6 == 2, "kape").when(F.col("ordinal") % 6 == 3, "cortex").when(F.col("ordinal") % 6 == 1, "velociraptor").otherwise("").alias("kind")).distinct()
    return files.with_triage(rows.select("ordinal", "path"), kinds).select("ordinal", "kind", F.coalesce("host", F.lit("")).alias("host"), "label")


@query(f"WITH {fixture.SQL} SELECT count(DISTINCT ordinal % 3) AS files, count(*) AS rows, min(time_created) AS first, max(time_created) AS last, 0 AS rejected FROM tl")
def parse_summary(spark, d):
    return files.parse_summary(fixture.timeline(spark, d).withColumn("log_filename", text("f", F.col("ordinal") % 3)))


@query("SELECT event_id AS ordinal, CASE WHEN event_id % 2 = 0 THEN 'disk.E01/vss_1/Security.evtx' ELSE '/logs/a.evtx' END AS log_filename FROM events")
def image_log_filename(spark, d):
    path = F.when(event_no() % 2 == 0, "C:\\tmp\\extracted\\disk.E01\\vss_1\\Security.evtx").otherwise("/logs/a.evtx")
    return ev(spark, d).select(event_no().alias("ordinal"), images.image_filename(path, "extracted").alias("log_filename"))


# -- discovery, archives, hives --------------------------------------------------------------------
@query(
    timeline_sql(
        "events WHERE event_id % 3 = 0", time_created=_STAMP, dst_computer="'FS' || event_id", event_type="'CONNECT'", event_id="'MountPoints2'", target_user_name="'u' || user_id % 50", src_computer="'PC'",
        detail="'\\\\FS' || event_id || '\\share'", log_filename="'NTUSER.DAT'",
    )
)
def source_hives(spark, d):
    """One hive a user, with keys that are no shares between."""
    ticks = (F.unix_timestamp(F.col("ts").cast("timestamp")) + 11_644_473_600) * 10_000_000
    rows = ev(spark, d).select((user_no() % 50).alias("user"), F.when(event_no() % 3 == 1, "C").when(event_no() % 3 == 2, "##é#x").otherwise(text("##FS", event_no(), "#share")).alias("key"), F.when(event_no() % 3 == 2, 0).otherwise(ticks).alias("ticks"))

    def run(key, frame):
        return pd.DataFrame({"path": [f"file:/Users/u{key[0]}/NTUSER.DAT"], "content": [hive.write(list(zip(frame["key"], frame["ticks"], strict=True)))]})

    made = rows.groupBy("user").applyInPandas(run, "path string, content binary")
    return files.mount_points(hive.keys(made), "PC")


@query("SELECT 'a' || user_id % 50 || '.zip -> in.zip -> var/log/auth.log' AS path, count(*) AS lines FROM events GROUP BY 1 UNION ALL SELECT DISTINCT 'a' || user_id % 50 || '.zip -> secure', 1 FROM events")
def source_archives(spark, d):
    """Members of archives inside archives, beside others that are not wanted and a file that is no archive."""

    def run(key, frame):
        import io
        import zipfile

        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            z.writestr("var/log/auth.log", "\n".join(map(str, frame["n"])))
            z.writestr("var/log/other.txt", "x")
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("in.zip", inner.getvalue())
            z.writestr("secure", "y")
            z.writestr("bad.zip", b"none")
        return pd.DataFrame({"path": [f"a{key[0]}.zip", "no.zip"], "content": [outer.getvalue(), b"no"]})

    made = ev(spark, d).select((user_no() % 50).alias("user"), event_no().alias("n")).groupBy("user").applyInPandas(run, "path string, content binary")
    return files.expand_archives(made, files.LINUX_NAMES).select("path", F.size(F.split(F.decode("content", "UTF-8"), "\n")).cast("long").alias("lines"))


@query("SELECT DISTINCT 'h' || user_id % 5 || '/' || ['auth.log', 'wtmp', 'secure-1'][CAST(event_id % 4 AS INT) + 1] AS path FROM events WHERE event_id % 4 < 3")
def source_discover(spark, d):
    """Names of evidence files below a folder, each once, other files left out.  Spark names its files itself, so folders carry the names."""
    names = ev(spark, d).select(F.lit("x").alias("value"), text("h", user_no() % 5, "/", pick(event_no(), ["auth.log", "wtmp", "secure-1", "readme.md"])).alias("name")).distinct()
    root = f"{shared_dir(spark)}/found-{uuid.uuid4().hex}"
    names.write.partitionBy("name").text(root)
    found = files.discover(spark, root, "[.]txt$").select(F.url_decode(F.regexp_extract("path", "name=([^/]*)/", 1)).alias("path")).distinct()
    return found.where(F.col("path").rlike(files.LINUX_NAMES))


# -- streams ---------------------------------------------------------------------------------------
def _stream(spark, d) -> DataFrame:
    """``events`` as a stream of edges (origin, destination, rel_type, time)."""
    made = spark.readStream.schema(ev(spark, d).schema).parquet(f"{d}/events.parque[t]")  # a pattern: a stream takes no single file
    return made.select(text("H", user_no() % 20).alias("origin"), text("H", event_no() % 20).alias("destination"), F.upper("event_type").alias("rel_type"), F.col("ts").cast("timestamp").alias("time")).withWatermark("time", "10 minutes")


STATE_ROWS = 200_000  # of a partition, about; the state is in memory


def _run(stream: DataFrame, complete: bool = False, held: int | None = None) -> DataFrame:
    """All that a stream gives for what there is now, through a table in the shared folder.

    A partition of state writes its files at every step, however little it holds, so where the rows ``held``
    are known there are as many partitions as they need, but not fewer than cores nor more than the session's.
    """
    spark = stream.sparkSession
    key = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(key)
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/state")
    if complete:
        out = out.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{root}/out"))
    else:
        out = out.outputMode("append").format("parquet").option("path", f"{root}/out")
    if held is not None:
        spark.conf.set(key, str(min(int(usual), max(spark.sparkContext.defaultParallelism, held // STATE_ROWS + 1))))
    try:
        run = out.start()
    finally:
        spark.conf.set(key, usual)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("SELECT date_trunc('hour', ts) AS start, 'H' || user_id % 20 AS origin, CAST(count(DISTINCT event_type) AS INT) AS n FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) >= 3")
def stream_rotation(spark, d):
    got = _run(timelines.rotation(_stream(spark, d)), complete=True)
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "origin", "n")


_STREAMED = "(SELECT 'H' || user_id % 20 AS o, 'H' || event_id % 20 AS d, upper(event_type) AS u, ts FROM events)"


@query(f"SELECT x.o AS a, x.d AS b, y.d AS c, x.u AS u1, y.u AS u2, x.ts AS t1, y.ts AS t2 FROM {_STREAMED} x JOIN {_STREAMED} y ON x.d = y.o AND y.ts > x.ts AND y.ts <= x.ts + INTERVAL 300 SECOND WHERE x.u <> y.u AND x.o <> y.d")
def stream_chains(spark, d):
    got = _run(timelines.chains(_stream(spark, d), _stream(spark, d)), held=3 * ev(spark, d).count())  # first hops stand twice
    return got.select("a", "b", "c", "u1", "u2", F.col("t1").cast("timestamp_ntz").alias("t1"), F.col("t2").cast("timestamp_ntz").alias("t2"))


@query(f"WITH {fixture.SQL} SELECT dst_computer, ts AS event_time FROM tl WHERE NOT (lower(target_user_name) LIKE 'error!_%' ESCAPE '!')")
def stream_filtered(spark, d):
    """The timeline's rows as a stream through the filters, with their event time."""
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    fixture.timeline(spark, d).select(*schema.TIMELINE).write.parquet(path)
    rows = spark.readStream.schema(schema.TIMELINE_SCHEMA).parquet(path)
    got = _run(timelines.timed(rows, config=filters.FilterConfig(users=["error_*"])))
    return got.select("dst_computer", F.col("event_time").cast("timestamp_ntz").alias("event_time"))
