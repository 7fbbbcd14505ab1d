"""The published hunting queries over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.plans.algorithms import cut


def _between(start: str, end: str) -> Column:
    return F.col("time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def _machine() -> Column:
    return F.col("target_user_name").endswith("$")


def all_edges(edges: DataFrame) -> DataFrame:
    return edges


def in_range(edges: DataFrame, start: str, end: str) -> DataFrame:
    return edges.where(_between(start, end)).orderBy("time")


def human(edges: DataFrame, start: str, end: str) -> DataFrame:
    return in_range(edges.where(~_machine() & (F.col("target_user_name") != "NO_USER")), start, end)


def of_type(edges: DataFrame, start: str, end: str, logon_type: str) -> DataFrame:
    return in_range(edges.where(~_machine() & (F.col("logon_type") == logon_type)), start, end)


def with_prefix(edges: DataFrame, start: str, end: str, prefix: str = "SVC") -> DataFrame:
    return in_range(edges.where(F.col("target_user_name").startswith(prefix) | F.col("subject_user_name").startswith(prefix)), start, end)


def entities(edges: DataFrame, start: str, end: str, hosts: list[str], users: list[str], ips: list[str], types: list[str]) -> DataFrame:
    some = F.col("origin").isin(hosts) | F.col("destination").isin(hosts) | F.col("target_user_name").isin(users) | F.col("subject_user_name").isin(users) | F.col("src_ip").isin(ips)
    return human(edges.where(some & F.col("logon_type").isin(types)), start, end)


def by_user(edges: DataFrame, user: str) -> DataFrame:
    return edges.where(F.col("target_user_name") == user).orderBy("time")


def most_connected(edges: DataFrame, n: int = 10) -> DataFrame:
    counts = edges.groupBy(F.col("destination").alias("target")).agg(F.count(F.lit(1)).alias("connections"))
    return counts.orderBy(F.desc("connections"), "target").limit(n)


def temporal_paths(edges: DataFrame, start: str, end: str, hops: int | None = None, limit: int = 5) -> DataFrame:
    """Paths whose hops come one after another in time, shortest first: path, hops, last.

    One join a hop, from the start's own edges, until ``limit`` paths are found, ``hops`` are made or
    nothing can reach the end any more.  Ties go by the time of the last hop and the path.  Shorter
    paths come first, so the search ends with the hop that completes the limit.  Of the paths to a
    node only those are carried on that ``limit`` others do not beat in time and order at once:
    whatever such a path goes on to, the others go on to as well, and come before it.
    """
    steps = cut(edges.select(F.col("origin").alias("o"), F.col("destination").alias("d"), F.col("time").alias("t")).distinct())
    latest = _latest(steps, end)
    front = steps.where(F.col("o") == start).select(F.concat_ws(">", "o", "d").alias("path"), F.col("d").alias("at"), F.col("t").alias("last"))
    out, k = None, 1
    while True:
        front = cut(front)
        found = front.where(F.col("at") == end).select("path", F.lit(k).alias("hops"), "last").orderBy("last", "path").limit(limit)
        out = found if out is None else out.unionByName(found)
        if k == hops or out.count() >= limit:
            break
        alive = cut(_least(front.join(latest, "at").where("last < latest").select("path", "at", "last"), limit))
        if alive.isEmpty():
            break
        front = alive.join(steps, (F.col("at") == F.col("o")) & (F.col("t") > F.col("last"))).select(F.concat_ws(">", "path", "d").alias("path"), F.col("d").alias("at"), F.col("t").alias("last"))
        k += 1
    return out.orderBy("hops", "last", "path").limit(limit)


def _latest(steps: DataFrame, end: str) -> DataFrame:
    """at, latest: when one must leave each node at the latest to come to the end, by rounds to a fixed point."""
    latest, before = cut(steps.where(F.col("d") == end).groupBy(F.col("o").alias("at")).agg(F.max("t").alias("latest"))), None
    while before is None or not latest.exceptAll(before).isEmpty():
        before = latest
        more = steps.join(latest.withColumnRenamed("at", "n"), (F.col("d") == F.col("n")) & (F.col("t") < F.col("latest"))).select(F.col("o").alias("at"), F.col("t").alias("latest"))
        latest = cut(latest.unionByName(more).groupBy("at").agg(F.max("latest").alias("latest")))
    return latest


def _least(front: DataFrame, limit: int) -> DataFrame:
    """The paths to each node that fewer than ``limit`` others beat: not later, and not after in order."""
    w = W.partitionBy("at", "last").orderBy("path")
    front = front.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")

    def keep(rows):
        best, kept = [], []
        rows = rows.sort_values(["last", "path"], kind="stable")
        for k, path in enumerate(rows["path"]):
            if len(best) < limit or path < best[-1]:
                best = sorted([*best, path])[:limit]
                kept.append(k)
        return rows.iloc[kept]

    return front.groupBy("at").applyInPandas(keep, front.schema)
