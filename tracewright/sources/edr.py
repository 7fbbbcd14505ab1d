"""EDR rows (network and forensics records, offline NDJSON or any DataFrame) as timeline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import net
from tracewright.functions.scalars import classify, port_bucket, port_logon_type, strip_mapped, substatus
from tracewright.functions.times import vendor_time
from tracewright.schema import TIMELINE, as_timeline
from tracewright.sources.windows import CHANNELS

# Ports that make the local side the server; ports asked for by default; id lists.
SERVICE_PORTS = (22, 135, 139, 445, 1433, 3306, 3389, 5900, 5985, 5986)
DEFAULT_PORTS = (22, 445, 3389, 5985, 5986)
FORENSIC_IDS = tuple(sorted({i for _, ids in CHANNELS.values() for i in ids}))
FORENSIC_LOGS = (
    "Security", "Microsoft-Windows-TerminalServices-LocalSessionManager/Operational", "Microsoft-Windows-SMBServer/Security", "Microsoft-Windows-SmbClient/Security",
    "Microsoft-Windows-TerminalServices-RDPClient/Operational", "Microsoft-Windows-TerminalServices-RemoteConnectionManager/Operational",
    "Microsoft-Windows-RemoteDesktopServices-RdpCoreTS/Operational", "Microsoft-Windows-WinRM/Operational", "Microsoft-Windows-WMI-Activity/Operational",
)
NOWHERE = ("", "-", "local", "127.0.0.1", "::1", "localhost")
NETWORK_FIELDS = (
    "_time", "agent_hostname", "action_local_ip", "action_local_port", "action_remote_ip", "action_remote_port",
    "actor_primary_username", "actor_process_command_line",
)


def _carried(df: DataFrame, columns: dict, carry: list[str]) -> DataFrame:
    full = {c: F.coalesce(columns[c].cast("string"), F.lit("")) if c in columns else F.lit("") for c in TIMELINE}
    return df.select(*[v.alias(k) for k, v in full.items()], *carry)


def network(df: DataFrame, carry: list[str] | None = None, filename: str = "xdr") -> DataFrame:
    """A connection to a service port of the agent points at the agent, any other one away from it."""
    local, remote = F.col("action_local_port"), F.col("action_remote_port")
    into = local.try_cast("int").isin(*SERVICE_PORTS)
    user = F.coalesce("actor_primary_username", F.lit(""))
    columns = {
        "time_created": vendor_time(F.col("_time").cast("string")),
        "dst_computer": F.when(into, F.col("agent_hostname")).otherwise(F.col("action_remote_ip")),
        "event_type": F.lit("CONNECT"),
        "event_id": F.lit("xdr_network"),
        "logon_type": F.coalesce(port_logon_type(local), port_logon_type(remote), F.lit("")),
        "target_user_name": F.when(user.contains("\\"), F.substring_index(user, "\\", -1)).otherwise(user),
        "target_domain_name": F.when(user.contains("\\"), F.substring_index(user, "\\", 1)).otherwise(""),
        "src_computer": F.when(into, "").otherwise(F.col("agent_hostname")),
        "src_ip": strip_mapped(F.when(into, F.col("action_remote_ip")).otherwise(F.col("action_local_ip"))),
        "detail": F.replace(F.coalesce("actor_process_command_line", F.lit("")), F.lit(","), F.lit(";")),
        "log_filename": F.lit(filename),
    }
    return _carried(df, columns, carry or [])


def forensics(df: DataFrame, filename: str = "xdr_forensics") -> DataFrame:
    columns = {
        "time_created": vendor_time(F.col("Timestamp").cast("string")), "dst_computer": F.col("dst_host"), "event_type": classify(F.col("event_id"), F.lit("0x0")),
        "event_id": F.col("event_id"), "logon_type": F.col("lt"), "target_user_name": F.col("target_user"), "target_domain_name": F.col("target_domain"),
        "src_computer": F.col("source_host"), "src_ip": strip_mapped(F.coalesce("srcip", F.lit(""))), "subject_user_name": F.col("subject_name"), "subject_domain_name": F.col("subject_domain"),
        "detail": F.when(F.col("event_id") == "4625", substatus(F.coalesce("process", F.lit("")))).otherwise(F.replace(F.coalesce("process", F.lit("")), F.lit(","), F.lit(";"))), "log_filename": F.lit(filename),
    }
    return as_timeline(df, **columns)


def forensic_filter(df: DataFrame) -> DataFrame:
    """The row filters of a forensics query: known ids and logs, a message that says something, a
    destination and a source that are no local names, and no host that reaches itself.

    ``source`` and ``message`` are looked at where the rows have them.
    """
    out = df.where(F.col("event_id").cast("string").isin(*FORENSIC_IDS))
    if "source" in df.columns:
        out = out.where(F.lower("source").isin(*[x.lower() for x in FORENSIC_LOGS]))
    if "message" in df.columns:
        out = out.where(~F.coalesce("message", F.lit("")).isin("::", "", "-"))
    says = lambda c: ~F.lower(F.coalesce(c, F.lit(""))).isin(*NOWHERE)
    itself = lambda c: F.lower(F.coalesce(c, F.lit(""))) == F.lower("dst_host")
    return out.where((says("source_host") | says("srcip")) & says("dst_host") & ~itself("source_host") & ~itself("srcip"))


def ordered(df: DataFrame, time_col: str = "_time") -> list:
    """The order of records: by time in milliseconds, unreadable times as 0, then by all columns."""
    return [F.coalesce(F.col(time_col).try_cast("long"), F.lit(0)), *df.columns]


def push_down(df: DataFrame, ports: tuple[int, ...] = DEFAULT_PORTS, ips: list[str] | None = None, ignore_local: bool = False) -> DataFrame:
    """The row filters a network query sends to its source."""
    local, remote = F.col("action_local_ip"), F.col("action_remote_ip")
    out = df.where(F.col("action_local_port").try_cast("int").isin(*ports) | F.col("action_remote_port").try_cast("int").isin(*ports))
    out = out.where(~F.coalesce(remote, F.lit("")).isin("", "::") & ~F.coalesce(local, F.lit("")).isin("", "::"))
    if ips:
        out = out.where(net.in_list(local, ips) | net.in_list(remote, ips))
    return out.where(~net.loopback_like(remote) & (local != remote)) if ignore_local else out


def read_network(spark, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in NETWORK_FIELDS)).json(path)


def by_port(df: DataFrame) -> DataFrame:
    port = F.coalesce(F.when(port_bucket(F.col("action_local_port")) != "OTHER", F.col("action_local_port")), F.col("action_remote_port"))
    return df.groupBy(port_bucket(port).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def distinct_seen(rows: DataFrame) -> DataFrame:
    """Distinct hosts (either side) and event ids of timeline rows."""
    hosts = F.explode(F.array("dst_computer", "src_computer")).alias("h")
    names = rows.select(hosts).where("h <> ''").agg(F.count_distinct("h").alias("hosts"))
    return names.join(F.broadcast(rows.agg(F.count_distinct("event_id").alias("event_ids"))))


def halves(start, end, floor_seconds: int = 300):
    """A time window as two, or as itself where it is shorter than twice the floor."""
    if (end - start).total_seconds() < 2 * floor_seconds:
        return [(start, end)]
    middle = start + (end - start) / 2
    return [(start, middle), (middle, end)]
