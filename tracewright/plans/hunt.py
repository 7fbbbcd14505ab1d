"""Baseline-against-window detectors over ungrouped edges, and the ranked report.

Every detector returns detector, host, time_window, score, summary.  The baseline is what lies
strictly before the cutoff; rows without a host are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.scalars import csv_escape
from tracewright.functions.times import gap_seconds
from tracewright.operators.order import numbered
from tracewright.operators.timeline import bucketed_interval_join
from tracewright.plans import algorithms

FINDING = ("detector", "host", "time_window", "score", "summary")
# Thresholds of the detectors.
RARE_SHARE, MIN_USERS, MAX_GAP, SPIKE = 0.005, 3, 300, 0.0001
DETECTORS = ("novel-edge", "community-bridge", "rare-logon-type", "pagerank-spike", "betweenness-spike", "chain-motif", "cred-rotation")
UNGROUPED_ONLY = ("chain-motif", "cred-rotation")


def baseline(edges: DataFrame, cutoff: str) -> DataFrame:
    return edges.where(F.col("time") < F.lit(cutoff).cast("timestamp_ntz"))


def window(edges: DataFrame, cutoff: str) -> DataFrame:
    return edges.where(F.col("time") >= F.lit(cutoff).cast("timestamp_ntz"))


def split_counts(edges: DataFrame, cutoff: str) -> DataFrame:
    before = F.col("time") < F.lit(cutoff).cast("timestamp_ntz")
    return edges.agg(F.count_if(before).alias("baseline_edges"), F.count_if(~before).alias("window_edges"))


def _sorted(c: str):
    return F.array_join(F.sort_array(F.collect_set(c)), ",")


def pairs(base: DataFrame) -> DataFrame:
    return base.groupBy("origin", "destination").agg(_sorted("rel_type").alias("users"), _sorted("logon_type").alias("logon_types"), F.count(F.lit(1)).alias("n"))


def hosts(base: DataFrame) -> DataFrame:
    into = base.groupBy(F.col("destination").alias("host")).agg(_sorted("rel_type").alias("users"), _sorted("origin").alias("sources"), _sorted("logon_type").alias("logon_types"))
    out = base.groupBy(F.col("origin").alias("h")).agg(_sorted("destination").alias("destinations"))
    both = into.join(out, F.col("host") == F.col("h"), "full")
    return both.select(F.coalesce("host", "h").alias("host"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("users", "sources", "logon_types", "destinations")])


def users(base: DataFrame) -> DataFrame:
    return base.groupBy("rel_type").agg(_sorted("destination").alias("hosts"), _sorted("logon_type").alias("logon_types"))


def logon_types(base: DataFrame) -> DataFrame:
    counts = base.groupBy("logon_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("logon_type", "n", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))


def _known(win: DataFrame, base: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``flag``: the keys do not occur in the baseline."""
    seen = base.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__seen", F.lit(True))
    cond = [F.col(k) == F.col(f"__{k}") for k in keys]
    return win.join(seen, cond, "left").withColumn(flag, F.col("__seen").isNull()).drop("__seen", *[f"__{k}" for k in keys])


def _finding(df: DataFrame, name: str, host, when, score, summary) -> DataFrame:
    return df.select(F.lit(name).alias("detector"), host.alias("host"), when.alias("time_window"), score.cast("double").alias("score"), summary.alias("summary"))


def _text(stamp):
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def novel_edge(edges: DataFrame, cutoff: str) -> DataFrame:
    win, base = window(edges, cutoff), baseline(edges, cutoff)
    win = _known(win, base, ["origin", "destination"], "new_pair")
    win = _known(win, base, ["destination", "rel_type"], "new_user")
    win = _known(win, base, ["destination", "logon_type"], "new_type")
    n = sum(F.col(c).cast("int") for c in ("new_pair", "new_user", "new_type"))
    why = F.array_join(F.array_compact(F.array(*[F.when(F.col(c), F.lit(t)) for c, t in (("new_pair", "pair"), ("new_user", "user at host"), ("new_type", "type at host"))])), "; ")
    text = F.concat(F.col("origin"), F.lit(" -> "), F.col("destination"), F.lit(" by "), F.col("rel_type"), F.lit(" type "), F.col("logon_type"), F.lit(", new: "), why)
    return _finding(win.where((n > 0) & (F.col("origin") != "") & (F.col("destination") != "")), "novel-edge", F.col("destination"), _text(F.col("time")), F.round(n / 3, 6), text)


def rare_logon_type(edges: DataFrame, cutoff: str) -> DataFrame:
    """Nothing where the baseline is empty: the counts are joined to the one-row total."""
    types = baseline(edges, cutoff).groupBy("logon_type").agg(F.count(F.lit(1)).alias("n"))
    total = types.agg(F.sum("n").alias("total")).where("total > 0")
    win = window(edges, cutoff).join(F.broadcast(total)).join(types.withColumnRenamed("logon_type", "t"), F.col("logon_type") == F.col("t"), "left")
    share = F.coalesce("n", F.lit(0)) / F.col("total")
    win = win.withColumn("share", share).where((F.col("share") < RARE_SHARE) & (F.col("origin") != "") & (F.col("destination") != ""))
    text = F.concat(F.lit("type "), F.col("logon_type"), F.lit(" from "), F.col("origin"), F.lit(" by "), F.col("rel_type"))
    return _finding(win, "rare-logon-type", F.col("destination"), _text(F.col("time")), F.round(1 - F.least(F.col("share") / RARE_SHARE, F.lit(1.0)), 6), text)


def chain_motif(edges: DataFrame, cutoff: str) -> DataFrame:
    """Two hops through a host within MAX_GAP seconds by different users."""
    win, base = window(edges, cutoff), baseline(edges, cutoff)
    win = _known(win, base, ["origin", "destination"], "novel")
    r1 = win.select(F.col("origin").alias("a"), F.col("destination").alias("b"), F.col("rel_type").alias("u1"), F.col("time").alias("t1"), F.col("novel").alias("n1"))
    r2 = win.select(F.col("origin").alias("b2"), F.col("destination").alias("c"), F.col("rel_type").alias("u2"), F.col("time").alias("t2"), F.col("novel").alias("n2"))
    both = bucketed_interval_join(r1, r2, ("b", "b2"), ("t1", "t2"), MAX_GAP).where("u1 <> u2 AND a <> c AND a <> '' AND b <> '' AND c <> ''")
    gap = gap_seconds(F.col("t1"), F.col("t2"), MAX_GAP)
    score = F.least(F.lit(1.0), 1 - F.least(gap / (2 * MAX_GAP), F.lit(0.5)) + 0.1 * (F.col("n1").cast("int") + F.col("n2").cast("int")))
    text = F.concat(F.col("a"), F.lit(" -"), F.col("u1"), F.lit("-> "), F.col("b"), F.lit(" -"), F.col("u2"), F.lit("-> "), F.col("c"), F.lit(" in "), gap.cast("string"), F.lit("s"))
    return _finding(both, "chain-motif", F.col("b"), F.concat(_text(F.col("t1")), F.lit(" .. "), _text(F.col("t2"))), F.round(score, 6), text)


def cred_rotation(edges: DataFrame, cutoff: str) -> DataFrame:
    got = window(edges, cutoff).where("origin <> ''").groupBy("origin").agg(
        F.count_distinct("rel_type").alias("n"), F.min("time").alias("a"), F.max("time").alias("b"), F.count_distinct("destination").alias("d")
    )
    got = got.where(F.col("n") >= MIN_USERS)
    score = 0.5 + 0.5 * (F.least(F.col("n"), F.lit(10)) - MIN_USERS) / (10 - MIN_USERS)
    text = F.concat(F.col("n").cast("string"), F.lit(" users to "), F.col("d").cast("string"), F.lit(" hosts"))
    return _finding(got, "cred-rotation", F.col("origin"), F.concat(_text(F.col("a")), F.lit(" .. "), _text(F.col("b"))), F.round(score, 6), text)


def _spike(into: DataFrame, cutoff: str, measure: DataFrame, column: str, name: str) -> DataFrame:
    """``into``: (destination, base, win), in-edges before and since the cutoff."""
    into = into.where("win > 0 AND destination <> ''")
    ratio = F.col("win") / (F.col("base") + F.col("win"))
    got = into.join(measure, F.col("destination") == F.col("host")).select("destination", "base", "win", F.round(F.col(column) * ratio, 6).alias("s"))
    text = F.concat(F.col("win").cast("string"), F.lit(" of "), (F.col("base") + F.col("win")).cast("string"), F.lit(" in-edges since the cutoff"))
    return _finding(got.where(F.col("s") >= SPIKE), name, F.col("destination"), F.lit(f"from {cutoff}"), F.col("s"), text)


def _links(edges: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs with their edges, and the in-edges of each destination; the edges are read once."""
    before = F.col("time") < F.lit(cutoff).cast("timestamp_ntz")
    counts = F.count(F.lit(1)).alias("w"), F.count_if(before).alias("base"), F.count_if(~before).alias("win")
    links = algorithms.cut(edges.groupBy("origin", "destination").agg(*counts))
    return links, links.groupBy("destination").agg(F.sum("base").alias("base"), F.sum("win").alias("win"))


def pagerank_spike(edges: DataFrame, cutoff: str) -> DataFrame:
    links, into = _links(edges, cutoff)
    return _spike(into, cutoff, algorithms.pagerank_of_links(links.select("origin", "destination", "w")), "rank", "pagerank-spike")


def betweenness_spike(edges: DataFrame, cutoff: str) -> DataFrame:
    links, into = _links(edges, cutoff)
    return _spike(into, cutoff, algorithms.betweenness(links), "betweenness", "betweenness-spike")


def community_bridge(edges: DataFrame, cutoff: str) -> DataFrame:
    """Window edges into a community that the origin never reached before the cutoff."""
    com = algorithms.communities(edges)
    a, b = com.select(F.col("host").alias("ha"), F.col("community").alias("ca")), com.select(F.col("host").alias("hb"), F.col("community").alias("cb"))
    win = window(edges, cutoff).join(a, F.col("origin") == F.col("ha")).join(b, F.col("destination") == F.col("hb")).where("ca <> cb AND destination <> ''")
    touched = baseline(edges, cutoff).join(b, F.col("destination") == F.col("hb")).select(F.col("origin").alias("o"), F.col("cb").alias("c")).distinct()
    new = win.join(touched, (F.col("origin") == F.col("o")) & (F.col("cb") == F.col("c")), "left_anti")
    text = F.concat(F.col("origin"), F.lit(" -> "), F.col("destination"), F.lit(" across communities by "), F.col("rel_type"))
    return _finding(new, "community-bridge", F.col("destination"), _text(F.col("time")), F.lit(0.7), text)


RUN = {
    "novel-edge": novel_edge, "community-bridge": community_bridge, "rare-logon-type": rare_logon_type, "pagerank-spike": pagerank_spike,
    "betweenness-spike": betweenness_spike, "chain-motif": chain_motif, "cred-rotation": cred_rotation,
}


def run_all(edges: DataFrame, cutoff: str, only: list[str] | None = None, skip: list[str] | None = None, grouped: bool = False) -> DataFrame:
    """Findings of the enabled detectors, in the fixed order.  The edges are written once and read by all."""
    out, edges = None, algorithms.cut(edges)
    for k, name in enumerate(DETECTORS):
        if (only and name not in only) or name in (skip or []) or (grouped and name in UNGROUPED_ONLY):
            continue
        one = RUN[name](edges, cutoff).withColumn("detector_ordinal", F.lit(k))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no detector is enabled")
    return out


def ranked(findings: DataFrame, top: int | None = None) -> DataFrame:
    """Findings with their rank by score (long, from 1); ties by detector, host, time and text."""
    order = [F.desc("score"), "detector_ordinal", "host", "time_window", "summary"]
    if top:
        findings = findings.orderBy(*order).limit(top)
    return numbered(findings, *order, name="rank").select("rank", *FINDING)


def snippet(host: Column, time_window: Column) -> Column:
    """A graph query that shows a finding: the edges of its host, inside its time where it has one."""
    name = F.replace(host, F.lit("'"), F.lit("\\'"))
    start = F.regexp_extract(time_window, r"^(\d{4}-\d\d-\d\dT[0-9:.]+)", 1)
    end = F.regexp_extract(time_window, r"(\d{4}-\d\d-\d\dT[0-9:.]+)$", 1)
    when = F.when(start != "", F.concat(F.lit(" AND r.time >= '"), start, F.lit("' AND r.time <= '"), end, F.lit("'"))).otherwise("")
    return F.concat(F.lit("MATCH (a)-[r]->(b) WHERE (a.name = '"), name, F.lit("' OR b.name = '"), name, F.lit("')"), when, F.lit(" RETURN a, r, b"))


#: Fixed value: the header of a findings file.
FINDINGS_HEADER = "rank,score,detector,host,time_window,summary,cypher_snippet"


def csv_lines(found: DataFrame) -> DataFrame:
    """(rank, value): ranked findings as lines of a CSV file."""
    parts = [F.col("rank").cast("string"), F.format_string("%.4f", F.col("score")), F.col("detector"), *[csv_escape(F.col(c)) for c in ("host", "time_window", "summary")]]
    return found.select("rank", F.concat_ws(",", *parts, csv_escape(snippet(F.col("host"), F.col("time_window")))).alias("value"))


def write_findings(found: DataFrame, path: str) -> None:
    """Ranked findings as text files with the header, in order of rank; one file, as it is a report."""
    head = found.sparkSession.createDataFrame([(0, FINDINGS_HEADER)], "rank long, value string")
    csv_lines(found).unionByName(head).orderBy("rank").select("value").coalesce(1).write.mode("overwrite").text(path)
