"""From a timeline to a host graph: normalise, resolve addresses, build and rewrite edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import LOCAL, clean_host, clean_user, ip_like, rel_type, upper_name
from tracewright.functions.times import parse_time
from tracewright.operators.filters import loader_noise
from tracewright.schema import EDGE, TIMELINE


def normalise(df: DataFrame, parity: bool = True) -> DataFrame:
    """Upper-case rows with reduced host columns, and event_time (null where it does not parse)."""
    extra = [c for c in df.columns if c not in TIMELINE]
    up = df.select(*[c if c == "time_created" else upper_name(F.col(c)).alias(c) for c in TIMELINE], *extra)
    hosts = ("dst_computer", "src_computer", "src_ip")
    cols = [clean_host(F.col(c), parity).alias(c) if c in hosts else F.col(c) for c in TIMELINE]
    # through a generator, so that filters on the result use it instead of computing it again for each mention
    return up.select(F.inline(F.array(F.struct(*cols, *extra, parse_time(F.col("time_created")).alias("event_time")))))


def usable(df: DataFrame) -> DataFrame:
    """Normalised rows without those a load drops as noise."""
    return df.where(~loader_noise(F.col("dst_computer"), F.col("src_computer"), F.col("src_ip")))


def evidence(rows: DataFrame) -> DataFrame:
    """(ip, host, weight): how strongly rows say that an address is a host."""
    comp, ip, user = F.col("src_computer"), F.col("src_ip"), F.col("target_user_name")
    real_ip, machine = ~ip.isin(*LOCAL), F.regexp_replace(user, r"\$$", "")
    named = ~comp.isin(*LOCAL) & real_ip & (comp != ip)
    hint = comp.isin(*LOCAL) & real_ip & user.endswith("$") & (F.length(user) > 1) & ~ip_like(machine) & ~machine.contains(".")
    weight = F.when(named, F.when(F.col("event_id").isin("4778", "4779"), 1000).otherwise(1)).when(hint, 100)
    seen = rows.select(ip.alias("ip"), F.when(named, comp).otherwise(machine).alias("host"), weight.alias("w")).where("w IS NOT NULL")
    return seen.groupBy("ip", "host").agg(F.sum("w").cast("long").alias("weight"))


def best_host(weights: DataFrame) -> DataFrame:
    """(ip, host): the heaviest host of each address, the least name where they tie."""
    top = F.min(F.struct((-F.col("weight")).alias("w"), F.col("host")))
    return weights.groupBy("ip").agg(top.alias("t")).select("ip", F.col("t.host").alias("host"))


def resolve(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Rows with origin and destination after address resolution, without self-loops and sources
    that stay unknown.  The map holds a row an address; Spark broadcasts it where it is small
    and shuffles it otherwise."""
    comp, ip = F.col("src_computer"), F.col("src_ip")
    by_src = best.select(F.col("ip").alias("__a"), F.col("host").alias("__src"))
    by_dst = best.select(F.col("ip").alias("__b"), F.col("host").alias("__dst"))
    joined = rows.join(by_src, ip == F.col("__a"), "left").join(by_dst, F.col("dst_computer") == F.col("__b"), "left")
    unknown = comp.isin(*LOCAL) | (ip_like(comp) & (comp == ip))
    raw = F.when(~ip.isin(*LOCAL), ip)
    origin = F.when(unknown, F.coalesce(F.col("__src"), raw)).otherwise(comp)
    target = F.when(ip_like(F.col("dst_computer")), F.coalesce("__dst", "dst_computer")).otherwise(F.col("dst_computer"))
    out = joined.withColumns({"origin": origin, "destination": target}).drop("__a", "__b", "__src", "__dst")
    return out.where(F.col("origin").isNotNull() & (F.lower("origin") != F.lower("destination")))


def edges(df: DataFrame, parity: bool = True) -> DataFrame:
    """Ungrouped edges of a timeline: one row per event that links two hosts."""
    rows = usable(normalise(df, parity))
    out = resolve(rows, best_host(evidence(rows)))
    return out.select(
        "origin",
        "destination",
        rel_type(F.col("target_user_name")).alias("rel_type"),
        F.col("event_time").alias("time"),
        "logon_type",
        "src_computer",
        "src_ip",
        F.when(F.trim("target_user_name") == "", "NO_USER").otherwise(clean_user(F.col("target_user_name"))).alias("target_user_name"),
        "target_domain_name",
        "subject_user_name",
        "subject_domain_name",
        F.lit(1).cast("long").alias("count"),
        *[c for c in ("ordinal",) if c in df.columns],
    )


def grouped_edges(df: DataFrame, parity: bool = True, by_origin: bool = False) -> DataFrame:
    """One edge for each destination, user and logon type: earliest time, count and the fields of
    the first row in order of ingest (``ordinal``)."""
    rows = usable(normalise(df, parity))
    best = best_host(evidence(rows))
    user = clean_user(F.col("target_user_name"))
    keys = ["dst_computer", "user", "logon_type"] + ["src_computer"] * by_origin
    first = F.min_by(F.struct("src_computer", "src_ip", "target_domain_name", "subject_user_name", "subject_domain_name"), "ordinal")
    some = rows.withColumn("user", user).groupBy(*keys).agg(F.min("event_time").alias("event_time"), F.count(F.lit(1)).alias("count"), first.alias("f"))
    flat = some.select(
        "dst_computer", "logon_type", F.col("user").alias("target_user_name"), "event_time", "count", "f.src_computer", "f.src_ip", "f.target_domain_name", "f.subject_user_name", "f.subject_domain_name"
    )
    return resolve(flat, best).select(
        "origin", "destination", rel_type(F.col("target_user_name")).alias("rel_type"), F.col("event_time").alias("time"), "logon_type",
        "src_computer", "src_ip", "target_user_name", "target_domain_name", "subject_user_name", "subject_domain_name", "count",
    ).dropDuplicates()


def merge_nodes(edges: DataFrame, old: str, new: str) -> DataFrame:
    """All edges of node ``old`` moved to ``new``; edges that become loops go."""
    swap = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c))
    return edges.withColumns({"origin": swap("origin"), "destination": swap("destination")}).where("origin <> destination")


def merge_counts(edges: DataFrame, old: str) -> DataFrame:
    """Edges of a node by relation type, as a merge reports them."""
    mine = edges.where((F.col("origin") == old) | (F.col("destination") == old))
    return mine.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("origin").alias("name")).union(edges.select("destination")).distinct()


def mode_probe(edges: DataFrame) -> DataFrame:
    """(mode, tuples, repeated): Ungrouped if some (source, target, user, type) has two times."""
    tuples = edges.groupBy("origin", "destination", "rel_type", "logon_type").agg((F.min("time") < F.max("time")).alias("twice"))
    got = tuples.agg(F.count(F.lit(1)).alias("tuples"), F.count_if("twice").alias("repeated"))
    return got.select(F.when(F.col("tuples") == 0, "Empty").when(F.col("repeated") > 0, "Ungrouped").otherwise("Grouped").alias("mode"), "tuples", "repeated")


def statements(edges: DataFrame, grouped: bool = False) -> DataFrame:
    """(statement, parameters): one graph statement for each edge, parameters as JSON.

    Hosts are merged by name.  An ungrouped edge is created; a grouped one is merged by its logon type
    and the user it is named after, and takes the other properties.  Run them with ``send``.
    """
    own = [c for c in EDGE if c not in ("origin", "destination", "rel_type")]
    hosts = "MERGE (a:host {name: $origin}) MERGE (b:host {name: $destination}) "
    kind = F.concat(F.lit("`"), F.replace(F.col("rel_type"), F.lit("`"), F.lit("``")), F.lit("`"))
    tail = "{logon_type: $logon_type}]->(b) SET r += $properties" if grouped else "]->(b) SET r = $properties"
    verb = "MERGE (a)-[r:" if grouped else "CREATE (a)-[r:"
    time = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time")
    properties = F.struct(*[time if c == "time" else F.col(c) for c in own]).alias("properties")
    keys = ["origin", "destination", *["logon_type"] * grouped]
    return edges.select(F.concat(F.lit(hosts + verb), kind, F.lit(" " * grouped + tail)).alias("statement"), F.to_json(F.struct(*keys, properties)).alias("parameters"))


def send(edges: DataFrame, connect, grouped: bool = False) -> None:
    """Run the statements from the executors.  ``connect`` opens a session there: an object with ``run(statement, parameters)`` and ``close()``."""
    import json

    def partition(rows) -> None:
        session = connect()
        try:
            for r in rows:
                session.run(r.statement, json.loads(r.parameters))
        finally:
            session.close()

    statements(edges, grouped).foreachPartition(partition)


def export(edges: DataFrame, path: str) -> None:
    """Hosts and edges as tables below a folder, edges by relation type: the form for a bulk import."""
    nodes(edges).write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")


def load_summary(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows, edges, hosts, users, repeated (edges that a grouped load would fold): one row."""
    named = nodes(edges).agg(F.count(F.lit(1)).alias("hosts"))
    got = edges.groupBy("origin", "destination", "rel_type", "logon_type").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    users = edges.agg(F.count_distinct("rel_type").alias("users"))
    read = rows.agg(F.count(F.lit(1)).alias("rows"))
    return read.crossJoin(F.broadcast(got)).crossJoin(F.broadcast(named)).crossJoin(F.broadcast(users))  # one row each


def mode_note(mode: str) -> str:
    """What a report says of a grouped graph; nothing of others."""
    return "" if mode != "Grouped" else "The graph holds one edge for each user and type: detectors that need every event (chain-motif, cred-rotation) are left out and counts are those of groups."
