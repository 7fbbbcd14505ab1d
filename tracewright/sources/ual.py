"""User-access-logging rows as timeline rows: up to two events a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import domain_of, hex_ip, role_logon_type, user_of
from tracewright.functions.times import filetime
from tracewright.sources.edr import _carried


def events(clients: DataFrame, roles: DataFrame, hostname: str, carry: list[str] | None = None, filename: str = "UAL") -> DataFrame:
    """clients: user, address (hex bytes), insert_date, last_access (FILETIME), role_guid; roles: guid,
    name.  One event for the first and, where it differs, one for the last access; rows without a
    user or any date give none; an unknown role keeps its guid as name."""
    names = roles.select(F.lower("guid").alias("__guid"), F.col("name").alias("__role"))
    rows = clients.join(names, F.lower("role_guid") == F.col("__guid"), "left").withColumn("__role", F.coalesce("__role", "role_guid"))
    times = F.array_distinct(F.filter(F.array(filetime(F.col("insert_date")), filetime(F.col("last_access"))), lambda t: t != ""))
    rows = rows.where("user <> ''").withColumn("__time", F.explode(times))
    columns = {
        "time_created": F.col("__time"), "dst_computer": F.lit(hostname), "event_type": F.lit("SUCCESSFUL_LOGON"), "event_id": F.concat(F.lit("UAL_"), F.upper(F.regexp_replace("__role", "[^A-Za-z0-9]+", "_"))),
        "logon_type": role_logon_type(F.col("__role")), "target_user_name": user_of(F.col("user")), "target_domain_name": domain_of(F.col("user")), "src_ip": hex_ip(F.col("address")),
        "detail": F.col("__role"), "log_filename": F.lit(filename),
    }
    return _carried(rows, columns, carry or [])
