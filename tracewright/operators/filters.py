"""Noise filters with exclusive attribution: one drop_reason column decides every row."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import net
from tracewright.functions.scalars import LOCAL


def local_reason(
    dst: Column, src_computer: Column, src_ip: Column, logon_type: Column
) -> Column:
    """Why a row is local noise, or null.  Noise needs both the address and the host to say nothing."""
    low_ip, low_host = F.lower(src_ip), F.lower(src_computer)
    named_loop = low_ip.isin("local", "localhost")
    return net.bound(net.loopback_like(src_ip), lambda loop: _local_reason(dst, src_ip, logon_type, low_ip, low_host, named_loop, loop))


def _local_reason(dst, src_ip, logon_type, low_ip, low_host, named_loop, loop) -> Column:
    ip_noise = low_ip.isin("", "-") | named_loop | loop | ~net.valid(src_ip)
    itself = (low_host == F.lower(dst)) & (dst != "")
    host_noise = low_host.isin("", "-", "local", "mstsc", "default_value") | itself
    reason = (
        F.when(loop | named_loop, "loopback_ip")
        .when(low_host == "local", "literal_local")
        .when(logon_type == "5", "service_logon")
        .when(logon_type == "2", "interactive_logon")
        .when(itself, "self_reference")
        .otherwise("both_noise")
    )
    return F.when(ip_noise & host_noise, reason)


def glob(text: Column, patterns: list[str]) -> Column:
    """Case-insensitive globs: stars count at the ends only; an empty text or pattern never matches."""
    out, low = F.lit(False), F.lower(text)
    for p in patterns:
        p = p.strip().lower()
        if not p:
            continue
        head, tail, core = p.startswith("*"), p.endswith("*") and len(p) > 1, p
        core = core[1:] if head else core
        core = core[:-1] if tail else core
        if head and not core:
            one = F.lit(True)
        elif head and tail:
            one = low.contains(core)
        elif head:
            one = low.endswith(core)
        elif tail:
            one = low.startswith(core)
        else:
            one = low == core
        out = out | one
    return out & (text != "")


def read_list(text: str | None) -> list[str]:
    """A comma list; @file reads a file, one entry a line, with # comments."""
    out: list[str] = []
    for part in (text or "").split(","):
        part = part.strip()
        if part.startswith("@"):
            lines = Path(part[1:]).read_text(encoding="utf-8").splitlines()
            out += [y for x in lines if (y := x.partition("#")[0].strip())]
        elif part:
            out.append(part)
    return out


@dataclass
class FilterConfig:
    ignore_local: bool = False
    users: list[str] = field(default_factory=list)
    hosts: list[str] = field(default_factory=list)
    ips: list[str] = field(default_factory=list)
    dry_run: bool = False

    @classmethod
    def parse(cls, ignore_local: bool = False, users: str = "", hosts: str = "", ips: str = "", dry_run: bool = False) -> FilterConfig:
        return cls(ignore_local, read_list(users), read_list(hosts), read_list(ips), dry_run)

    def reason(self) -> Column:
        """First match of: local noise, users, hosts, addresses; null where the row stays."""
        local = local_reason(F.col("dst_computer"), F.col("src_computer"), F.col("src_ip"), F.col("logon_type"))
        steps = [local] if self.ignore_local else []
        if self.users:
            steps.append(F.when(glob(F.col("subject_user_name"), self.users) | glob(F.col("target_user_name"), self.users), "excluded_user"))
        if self.hosts:
            steps.append(F.when(glob(F.col("dst_computer"), self.hosts) | glob(F.col("src_computer"), self.hosts), "excluded_host"))
        if self.ips:
            steps.append(F.when(net.in_list(F.col("src_ip"), self.ips), "excluded_ip"))
        return F.coalesce(*steps, F.lit(None).cast("string"))


def with_reason(df: DataFrame, config: FilterConfig) -> DataFrame:
    return df.withColumn("drop_reason", config.reason())


def apply_filters(df: DataFrame, config: FilterConfig) -> DataFrame:
    """The rows that stay; none in a dry run."""
    kept = with_reason(df, config).where("drop_reason IS NULL").drop("drop_reason")
    return kept.where(F.lit(False)) if config.dry_run else kept


def filter_summary(df: DataFrame, config: FilterConfig) -> DataFrame:
    """Rows by reason; kept rows count under 'kept', also in a dry run."""
    return with_reason(df, config).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


def loader_noise(dst: Column, src_computer: Column, src_ip: Column) -> Column:
    """Rows a graph load drops: both sources local, or the destination is its own source."""
    return (src_computer.isin(*LOCAL) & src_ip.isin(*LOCAL)) | (dst == src_computer) | (dst == src_ip)
