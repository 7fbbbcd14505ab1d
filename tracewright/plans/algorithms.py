"""Graph measures: PageRank, betweenness, communities.

PageRank is iterated DataFrame aggregation with the lineage cut by ``checkpoint()``.  Exact
betweenness and Louvain need the whole adjacency in a task, so both refuse graphs over
``MAX_PAIRS`` distinct pairs, a stated bound; betweenness then spreads the sources over tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.order import cut

MAX_PAIRS = 2_000_000


def link_counts(edges: DataFrame) -> DataFrame:
    """(origin, destination, w): distinct pairs and their edges."""
    return edges.groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("w"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(host, rank) after a fixed number of rounds over the multigraph; ranks sum to about 1.

    Ranks of hosts without outgoing edges are spread over all hosts.  The edges are read once.
    """
    return pagerank_of_links(cut(link_counts(edges)), rounds, damping, every)


def pagerank_of_links(links: DataFrame, rounds: int = 10, damping: float = 0.85, every: int = 5) -> DataFrame:
    """The same over distinct pairs with their number of edges ``w``."""
    out = links.groupBy(F.col("origin").alias("o")).agg(F.sum("w").alias("out"))
    shares = links.join(out, F.col("origin") == F.col("o")).select("origin", "destination", (F.col("w") / F.col("out")).alias("p"))
    hosts = links.select(F.col("origin").alias("host")).union(links.select("destination")).distinct()
    hosts = hosts.join(out, F.col("host") == F.col("o"), "left").select("host", F.col("o").isNull().alias("sink"))
    shares, hosts = cut(shares), cut(hosts)
    n = hosts.count()
    if not n:
        return hosts.select("host", F.lit(0.0).alias("rank"))
    ranks = hosts.select("host", "sink", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        got = shares.join(ranks, F.col("origin") == F.col("host")).groupBy(F.col("destination").alias("d")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        step = hosts.join(got, F.col("host") == F.col("d"), "left").crossJoin(F.broadcast(lost))  # one row
        ranks = step.select("host", "sink", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if (k + 1) % every == 0:
            ranks = cut(ranks)
    return ranks.select("host", "rank")


def _pairs(edges: DataFrame) -> pd.DataFrame:
    pairs = link_counts(edges).limit(MAX_PAIRS + 1).toPandas()
    if len(pairs) > MAX_PAIRS:
        raise ValueError(f"over {MAX_PAIRS} distinct pairs: aggregate hosts first")
    return pairs


def betweenness(edges: DataFrame) -> DataFrame:
    """(host, betweenness): exact, directed, unweighted, normalised by (n - 1)(n - 2)."""
    spark = edges.sparkSession
    pairs = _pairs(edges)
    near: dict[str, list[str]] = {}
    for o, d in zip(pairs["origin"], pairs["destination"], strict=True):
        near.setdefault(o, []).append(d)
    names = sorted(set(pairs["origin"]) | set(pairs["destination"]))
    n = len(names)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    held = spark.sparkContext.broadcast({k: sorted(v) for k, v in near.items()})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adjacency, total = held.value, {}
        for frame in frames:
            for s in frame["host"]:
                for v, x in dependencies(adjacency, s).items():
                    total[v] = total.get(v, 0.0) + x
        yield pd.DataFrame({"host": list(total), "part": [float(x) for x in total.values()]}, columns=["host", "part"])

    sources = spark.createDataFrame([(x,) for x in names], "host string")
    parts = sources.repartition(max(1, min(n // 16 + 1, 1000)), "host").mapInPandas(run, "host string, part double").groupBy("host").agg(F.sum("part").alias("part"))
    return sources.join(parts.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left").select("host", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def dependencies(near: dict[str, list[str]], source: str) -> dict[str, float]:
    """Share of shortest paths from ``source`` through each other vertex, summed over targets."""
    distance, paths, before, order = {source: 0}, {source: 1.0}, {}, []
    todo = deque([source])
    while todo:
        v = todo.popleft()
        order.append(v)
        for w in near.get(v, ()):
            if w not in distance:
                distance[w] = distance[v] + 1
                todo.append(w)
            if distance[w] == distance[v] + 1:
                paths[w] = paths.get(w, 0.0) + paths[v]
                before.setdefault(w, []).append(v)
    share = dict.fromkeys(order, 0.0)
    for w in reversed(order):
        for v in before.get(w, ()):
            share[v] += paths[v] / paths[w] * (1 + share[w])
    share.pop(source)
    return share


def communities(edges: DataFrame) -> DataFrame:
    """(host, community): Louvain modularity over the undirected weighted pairs, hosts in name
    order so that the result is fixed; a community is named by its least host."""
    pairs = _pairs(edges)
    weights: dict[str, dict[str, float]] = {}
    for o, d, w in zip(pairs["origin"], pairs["destination"], pairs["w"], strict=True):
        for a, b in ((o, d), (d, o)):
            weights.setdefault(a, {})[b] = weights.setdefault(a, {}).get(b, 0.0) + float(w)
    return edges.sparkSession.createDataFrame(sorted(louvain(weights).items()), "host string, community string")


def louvain(weights: dict[str, dict[str, float]]) -> dict[str, str]:
    member = {v: v for v in weights}
    graph = weights
    while True:
        moved = _local_moves(graph)
        if all(k == v for k, v in moved.items()):
            break
        member = {v: moved[c] for v, c in member.items()}
        merged: dict[str, dict[str, float]] = {}
        for a, row in graph.items():
            for b, w in row.items():
                merged.setdefault(moved[a], {})
                merged[moved[a]][moved[b]] = merged[moved[a]].get(moved[b], 0.0) + w
        if len(merged) == len(graph):
            break
        graph = merged
    least: dict[str, str] = {}
    for v, c in member.items():
        least[c] = min(v, least.get(c, v))
    return {v: least[c] for v, c in member.items()}


def _local_moves(graph: dict[str, dict[str, float]]) -> dict[str, str]:
    degree = {v: sum(row.values()) for v, row in graph.items()}
    total = sum(degree.values()) or 1.0
    home, inside, changed = {v: v for v in graph}, dict(degree), True
    while changed:
        changed = False
        for v in sorted(graph):
            links: dict[str, float] = {}
            for w, x in graph[v].items():
                if w != v:
                    links[home[w]] = links.get(home[w], 0.0) + x
            own = home[v]
            inside[own] -= degree[v]
            best, best_gain = own, links.get(own, 0.0) - inside[own] * degree[v] / total
            for c in sorted(links):
                gain = links[c] - inside[c] * degree[v] / total
                if gain > best_gain + 1e-12:
                    best, best_gain = c, gain
            inside[best] += degree[v]
            if best != own:
                home[v], changed = best, True
    return home
