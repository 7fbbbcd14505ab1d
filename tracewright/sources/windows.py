"""Windows event records, as XML text or Winlogbeat JSON, as timeline rows.

Both forms become the same record columns, so one mapper serves them: ev_time, computer,
provider, event_id, security_user, data (map of named values), body (text of UserData).
Records are dispatched by their own provider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import classify, detail, domain_of, infer_logon_type, short_host, strip_mapped, tag_text, user_of, winrm_host
from tracewright.schema import as_timeline
from tracewright.sources.custom_rules import last_wins

# Providers and the event ids kept of each.
P = "Microsoft-Windows-"
CHANNELS = {
    "security": (P + "Security-Auditing", ("4624", "4625", "4634", "4647", "4648", "4768", "4769", "4770", "4771", "4776", "4778", "4779", "5140")),
    "smb_server": (P + "SMBServer", ("1009", "551")),
    "smb_client": (P + "SMBClient", ("31001", "30803", "30804", "30805", "30806", "30807", "30808")),
    "rdp_client": (P + "TerminalServices-ClientActiveXCore", ("1024", "1102")),
    "rdp_manager": (P + "TerminalServices-RemoteConnectionManager", ("1149",)),
    "rdp_session": (P + "TerminalServices-LocalSessionManager", ("21", "22", "24", "25")),
    "rdp_core": (P + "RemoteDesktopServices-RdpCoreTS", ("131",)),
    "winrm": (P + "WinRM", ("6",)),
    "wmi": (P + "WMI-Activity", ("5858",)),
}
SERVICE_ACCOUNTS = ("system", "local service", "network service")
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _decoded(text: Column) -> Column:
    for name, mark in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def _last_wins(keys: Column, values: Column) -> Column:
    return last_wins(F.transform(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda p, k: F.struct(p["key"].alias("key"), k.alias("k"), p["value"].alias("value"))))


def from_xml(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    xml = F.col(xml_col)
    pick = lambda p: _decoded(F.regexp_extract(xml, p, 1))
    item = r"(?s)<Data Name=[\"']([^\"']*)[\"']\s*(?:/>|>([^<]*)</Data>)"
    keys, values = F.regexp_extract_all(xml, F.lit(item), F.lit(1)), F.regexp_extract_all(xml, F.lit(item), F.lit(2))
    return df.select(
        "*",
        pick(r"TimeCreated[^>]*SystemTime=[\"']([^\"']*)").alias("ev_time"),
        pick(r"<Computer>([^<]*)").alias("computer"),
        pick(r"<Provider[^>]*Name=[\"']([^\"']*)").alias("provider"),
        pick(r"<EventID[^>]*>(\d+)<").alias("event_id"),
        pick(r"<Security[^>]*UserID=[\"']([^\"']*)").alias("security_user"),
        _last_wins(keys, F.transform(values, _decoded)).alias("data"),
        F.regexp_extract(xml, r"(?s)<UserData>(.*)</UserData>", 1).alias("body"),
    )


def from_winlogbeat(df: DataFrame, json_col: str = "value") -> DataFrame:
    """NDJSON lines; those whose winlog.event_id is no integer are left out."""
    js = F.col(json_col)
    get = lambda p: F.coalesce(F.get_json_object(js, p), F.lit(""))
    data = F.coalesce(F.from_json(F.get_json_object(js, "$.winlog.event_data"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    user_data = F.coalesce(F.from_json(F.get_json_object(js, "$.winlog.user_data"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    body = F.array_join(F.transform(F.map_entries(user_data), lambda e: F.concat(F.lit("<"), e["key"], F.lit(">"), F.coalesce(e["value"], F.lit("")), F.lit("</"), e["key"], F.lit(">"))), "")
    got = df.select(
        "*", get("$['@timestamp']").alias("ev_time"), get("$.host.name").alias("computer"), get("$.winlog.provider_name").alias("provider"), get("$.winlog.event_id").alias("event_id"),
        get("$.winlog.user.identifier").alias("security_user"), data.alias("data"), body.alias("body"),
    )
    return got.where(F.get_json_object(js, "$.winlog.event_id").rlike(r"^\d+$"))


def is_winlogbeat(df: DataFrame, json_col: str = "value") -> DataFrame:
    """One row if some line has the marks of the format."""
    has = lambda p: F.get_json_object(json_col, p).isNotNull()
    return df.where((F.get_json_object(json_col, "$.agent.type") == "winlogbeat") & has("$.winlog") & has("$.event") & has("$['@timestamp']")).limit(1)


def to_timeline(records: DataFrame, filename: Column | str = "") -> DataFrame:
    """Kept records of all channels as timeline rows."""
    file = F.lit(filename) if isinstance(filename, str) else filename
    d = lambda *names: F.coalesce(*[F.try_element_at("data", F.lit(n)) for n in names], F.lit(""))
    b = lambda *tags: F.coalesce(*[F.nullif(_decoded(tag_text(F.col("body"), t)), F.lit("")) for t in tags], F.lit(""))
    both = lambda *names: F.coalesce(F.nullif(d(*names), F.lit("")), b(*names))
    of = {k: (F.col("provider") == p) & F.col("event_id").isin(*ids) for k, (p, ids) in CHANNELS.items()}
    kept = F.lit(False)
    for c in of.values():
        kept = kept | c
    rows = records.where(kept)
    computer, kind = F.col("computer"), F.col("event_id")
    host = winrm_host(d("connection"))
    client, param = b("ClientMachine"), both("Param1", "User")
    share = both("ShareName")
    columns = {
        "time_created": F.col("ev_time"),
        "dst_computer": F.when(of["smb_client"], both("ServerName")).when(of["rdp_client"], d("Value")).when(of["winrm"], host).otherwise(computer),
        "event_type": F.when(of["smb_client"], F.when(kind == "31001", "FAILED_LOGON").otherwise("CONNECT")).when(of["rdp_client"] | of["rdp_core"] | of["winrm"] | of["wmi"], "CONNECT").otherwise(classify(kind, d("Status"))),
        "event_id": kind,
        "logon_type": F.when(of["security"], infer_logon_type(kind, d("LogonType"))).when(of["rdp_client"] | of["rdp_manager"] | of["rdp_session"] | of["rdp_core"], "10").otherwise("3"),
        "target_user_name": F.when(of["security"], d("TargetUserName")).when(of["rdp_client"], F.col("security_user")).when(of["rdp_manager"] | of["rdp_session"], user_of(param)).when(of["wmi"], user_of(b("User"))).otherwise(both("UserName")),
        "target_domain_name": F.when(of["security"], d("TargetDomainName")).when(of["rdp_manager"], both("Param2")).when(of["rdp_session"], domain_of(param)).when(of["wmi"], domain_of(b("User"))).otherwise(""),
        "src_computer": F.when(of["security"], d("WorkstationName", "Workstation")).when(of["smb_server"], both("ClientName")).when(of["smb_client"] | of["rdp_client"] | of["winrm"], computer).when(of["wmi"], client).when(of["rdp_core"], F.regexp_replace(d("ClientIP"), r":\d+$", "")).otherwise(""),
        "src_ip": strip_mapped(F.when(of["security"], d("IpAddress")).when(of["rdp_manager"], both("Param3")).when(of["rdp_session"], both("Address")).when(of["rdp_core"], F.regexp_replace(d("ClientIP"), r":\d+$", "")).otherwise("")),
        "subject_user_name": F.when(of["security"], d("SubjectUserName")).otherwise(""),
        "subject_domain_name": F.when(of["security"], d("SubjectDomainName")).otherwise(""),
        "logon_id": F.when(of["security"], d("TargetLogonId")).otherwise(""),
        "detail": F.when(of["security"], detail(kind, d("ProcessName"), d("SubStatus", "Status"), d("ShareName"), d("RelativeTargetName"))).when(of["smb_client"] | of["smb_server"], share).when(of["wmi"], b("Operation")).otherwise(""),
        "log_filename": file,
    }
    local = F.lower(host).isin("", "localhost", "127.0.0.1", "::1") | (F.lower(short_host(host)) == F.lower(short_host(computer)))
    remote = (client != "") & (F.lower(short_host(client)) != F.lower(short_host(computer))) & ~F.lower(user_of(b("User"))).isin(*SERVICE_ACCOUNTS)
    complete = (F.col("ev_time") != "") & (computer != "")
    return as_timeline(rows.where(F.when(of["winrm"], ~local).when(of["wmi"], remote).when(of["rdp_manager"], complete).otherwise(True)), **columns)


def read_winlogbeat(spark, path: str) -> DataFrame:
    """All NDJSON files of a folder, not of its sub-folders."""
    lines = spark.read.option("recursiveFileLookup", "false").text(path).withColumn("__file", F.col("_metadata.file_name"))
    return to_timeline(from_winlogbeat(lines), F.col("__file"))
