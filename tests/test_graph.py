import random

from tracewright import fixture
from tracewright.operators import filters, timeline
from tracewright.plans import algorithms, graph, hunting
from tracewright.streaming import timelines

DIR = "/root/testdata/sf0.001"


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "origin string, destination string")


def test_closed_forms(spark):
    path = edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    got = {r.host: r.betweenness for r in algorithms.betweenness(path).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"a": 0, "b": round(2 / 6, 6), "c": round(2 / 6, 6), "d": 0}
    star = edges(spark, [(x, "hub") for x in "abcde"])
    ranks = {r.host: r.rank for r in algorithms.pagerank(star, rounds=40).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks["hub"] > 3 * ranks["a"]
    cliques = [(a, b) for part in ("abcd", "wxyz") for a in part for b in part if a < b] + [("d", "w")]
    com = {r.host: r.community for r in algorithms.communities(edges(spark, cliques)).collect()}
    assert {com[x] for x in "abcd"} == {"a"} and {com[x] for x in "wxyz"} == {"w"}


def test_properties(spark):
    tl = fixture.timeline(spark, DIR)
    config = filters.FilterConfig(True, ["*$"], ["h01*"], ["10.1.0.0/16"])
    counts = {r.drop_reason: r.n for r in filters.filter_summary(tl, config).collect()}
    assert sum(counts.values()) == tl.count() and counts["kept"] == filters.apply_filters(tl, config).count()
    assert filters.apply_filters(tl, filters.FilterConfig(True, dry_run=True)).count() == 0
    once = timeline.merge([tl])
    assert timeline.merge([once, once]).count() == once.count()
    ungrouped, grouped = graph.edges(tl), graph.grouped_edges(tl)
    assert grouped.agg({"count": "sum"}).first()[0] <= graph.usable(graph.normalise(tl)).count()
    moved = graph.merge_nodes(ungrouped, "H001", "H002")
    assert moved.where("origin = 'H001' OR destination = 'H001'").count() == 0
    assert ungrouped.where("origin = destination").count() == 0


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("ab"), rng.randrange(0, 4000)) for k in range(120)]
    df = spark.createDataFrame(rows, "n int, k string, s int").selectExpr("n", "k", "timestamp_seconds(s) as t")
    left, right = df.toDF("n1", "k1", "t1"), df.toDF("n2", "k2", "t2")
    got = {(r.n1, r.n2) for r in timeline.bucketed_interval_join(left, right, ("k1", "k2"), ("t1", "t2"), 300).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and 0 < b[2] - a[2] <= 300}


def test_streams(spark, tmp_path):
    graph.edges(fixture.timeline(spark, DIR)).selectExpr("origin", "destination", "rel_type", "cast(time as timestamp) as time").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("origin string, destination string, rel_type string, time timestamp").parquet(str(tmp_path / "e")).withWatermark("time", "1 hour")
    q = timelines.rotation(stream, "10 days").writeStream.outputMode("complete").format("memory").queryName("rotation").start()
    q.processAllAvailable()
    q.stop()
    want = timelines.rotation(spark.read.parquet(str(tmp_path / "e")), "10 days")
    assert spark.table("rotation").count() == want.count() > 0


def test_chains_meet_by_host_and_time(spark):
    """Pairs at the borders of the steps, before 1970 too; the join's keys hold the time, so a busy host is not compared with itself."""
    rng = random.Random(4)
    gap = 300_000_000
    ticks = [base + d for base in (0, 5 * gap, -3 * gap, 170_000 * gap) for d in (-gap, -1, 0, 1, gap - 1, gap, gap + 1, 2 * gap)]
    rows = [(rng.choice("abc"), rng.choice("abc"), rng.choice("uv"), t) for t in ticks for _ in range(6)]
    df = spark.createDataFrame(rows, "origin string, destination string, rel_type string, t long").selectExpr("origin", "destination", "rel_type", "timestamp_micros(t) AS time")
    got = timelines.chains(df, df)
    assert got.columns == ["a", "b", "u1", "t1", "b2", "c", "u2", "t2"]
    want = sorted((x[0], x[1], y[1], x[2], y[2], x[3], y[3]) for x in rows for y in rows if x[1] == y[0] and x[3] < y[3] <= x[3] + gap and x[2] != y[2] and x[0] != y[1])
    assert sorted(tuple(r) for r in got.selectExpr("a", "b", "c", "u1", "u2", "unix_micros(t1)", "unix_micros(t2)").collect()) == want
    assert "s1#" in got._jdf.queryExecution().optimizedPlan().toString().split("Join Inner", 1)[1].splitlines()[0]


def test_stream_state_has_no_more_partitions_than_its_rows_need(spark):
    from pathlib import Path

    from tracewright import source_queries
    from tracewright.operators.order import shared_dir

    key, old = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    before = set(Path(shared_dir(spark).removeprefix("file:")).glob("stream-*"))
    spark.conf.set(key, "16")
    try:
        source_queries.QUERIES["stream_chains"](spark, DIR)
        assert spark.conf.get(key) == "16"
    finally:
        spark.conf.set(key, old)
    (made,) = set(Path(shared_dir(spark).removeprefix("file:")).glob("stream-*")) - before
    assert {p.name for p in (made / "state/state/0").iterdir() if p.name.isdigit()} == {"0", "1", "2", "3"}


def test_temporal_paths_against_brute_force(spark):
    from datetime import datetime, timedelta

    begin = datetime(2024, 1, 1)

    def walks(rows, start, end):
        out, front = [], [(start, start, -1)]
        hops = 0
        while front:
            hops += 1
            front = [(f"{p}>{d}", d, t) for p, at, last in front for o, d, t in rows if o == at and t > last]
            out += [(hops, t, p) for p, at, t in front if at == end]
        return sorted(out)[:5]

    chain = [("abcdefgh"[k], "abcdefgh"[k + 1], 3 * k) for k in range(7)]  # seven hops over three weeks
    cases = [chain, [*chain, ("a", "c", 1), ("c", "b", 4), ("b", "c", 5)], [("a", "b", 5), ("b", "h", 5), ("b", "h", 4)], [("a", "b", 1), ("b", "a", 2)]]
    for seed in range(2):
        rng = random.Random(seed)
        cases.append(sorted({(*rng.sample("abcdh", 2), rng.randrange(30)) for _ in range(16)}))
    for rows in cases:
        df = spark.createDataFrame([(o, d, begin + timedelta(days=t)) for o, d, t in rows], "origin string, destination string, time timestamp_ntz")
        got = [(r.hops, (r.last - begin).days, r.path) for r in hunting.temporal_paths(df, "a", "h").collect()]
        assert got == walks(rows, "a", "h")


def test_whole_timeline_is_sorted(spark):
    from tracewright.queries import QUERIES
    from tracewright.schema import TIMELINE

    want = sorted(fixture.timeline(spark, DIR).collect(), key=lambda r: (r.time_created, r.ordinal))
    got = QUERIES["timeline_sorted"](spark, DIR).collect()
    assert [tuple(r) for r in got] == [tuple(r[c] for c in TIMELINE) for r in want] and len(got) == 1000
