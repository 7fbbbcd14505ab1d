"""Registered queries over the driver's tables and, where SQL can say it, their oracles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import fixture, schema, source_queries
from tracewright.fixture import CUTOFF, SQL
from tracewright.functions import scalars as x
from tracewright.operators import filters, timeline
from tracewright.plans import algorithms, graph, hunt, hunting
from tracewright.sources import custom_rules, edr, ual

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


def tl(spark: SparkSession, d: str) -> DataFrame:
    return fixture.timeline(spark, d)


def with_tl(rest: str) -> str:
    return f"WITH {SQL} {rest}"


# -- oracle building blocks ----------------------------------------------------------------------
_LOCAL = "('LOCAL', '127.0.0.1', '::1', '::', '0.0.0.0', 'DEFAULT_VALUE', '\"\"', '-', '', ' ')"


def _iplike(c: str) -> str:
    return f"(regexp_full_match({c}, '[0-9.]*') OR regexp_full_match({c}, '[0-9A-Fa-f:]*'))"


def _host(c: str) -> str:
    head = f"regexp_extract({c}, '^[0-9.:]*')"
    one = f"CASE WHEN contains({head}, '.') OR contains({head}, ':') THEN {head} WHEN {_iplike(c)} THEN {c} ELSE split_part({c}, '.', 1) END"
    return f"CASE WHEN {_iplike(f'({one})')} THEN ({one}) ELSE split_part({one}, ':', 1) END"


def _rel(c: str) -> str:
    name = f"regexp_replace(split_part({c}, '@', 1), '[^A-Za-z0-9_]', '_', 'g')"
    return f"upper(CASE WHEN trim({c}) = '' OR {name} = '' THEN 'NO_USER' WHEN regexp_matches({name}, '^[0-9]') THEN 'u' || {name} ELSE {name} END)"


NORM = f"""
, norm AS (
  SELECT time_created, {_host('dst_computer')} AS dst_computer, event_type, event_id, logon_type, upper(target_user_name) AS target_user_name,
    {_host('src_computer')} AS src_computer, {_host('src_ip')} AS src_ip, ordinal, ts AS event_time
  FROM tl
), ok AS (
  SELECT * FROM norm WHERE NOT ((src_computer IN {_LOCAL} AND src_ip IN {_LOCAL}) OR dst_computer = src_computer OR dst_computer = src_ip)
)"""
BEST = f"""{NORM}
, ev AS (
  SELECT src_ip AS ip, src_computer AS host, CASE WHEN event_id IN ('4778', '4779') THEN 1000 ELSE 1 END AS w FROM ok
  WHERE src_computer NOT IN {_LOCAL} AND src_ip NOT IN {_LOCAL} AND src_computer <> src_ip
  UNION ALL
  SELECT src_ip, rtrim(target_user_name, '$'), 100 FROM ok
  WHERE src_computer IN {_LOCAL} AND src_ip NOT IN {_LOCAL} AND target_user_name LIKE '%$' AND length(target_user_name) > 1
    AND NOT {_iplike("rtrim(target_user_name, '$')")} AND NOT contains(target_user_name, '.')
), weights AS (SELECT ip, host, CAST(sum(w) AS BIGINT) AS weight FROM ev GROUP BY ALL
), best AS (
  SELECT ip, host FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY weight DESC, host) AS n FROM weights) WHERE n = 1
)"""


def _resolved(rows: str, name: str) -> str:
    return f"""
, {name} AS (
  SELECT * FROM (
    SELECT r.*, CASE WHEN r.src_computer IN {_LOCAL} OR ({_iplike('r.src_computer')} AND r.src_computer = r.src_ip)
        THEN coalesce(s.host, CASE WHEN r.src_ip NOT IN {_LOCAL} THEN r.src_ip END) ELSE r.src_computer END AS origin,
      CASE WHEN {_iplike('r.dst_computer')} THEN coalesce(d.host, r.dst_computer) ELSE r.dst_computer END AS destination
    FROM {rows} r LEFT JOIN best s ON r.src_ip = s.ip LEFT JOIN best d ON r.dst_computer = d.ip
  ) WHERE origin IS NOT NULL AND lower(origin) <> lower(destination)
)"""


EDGES = f"""{BEST}{_resolved('ok', 'res')}
, edges AS (
  SELECT origin, destination, {_rel('target_user_name')} AS rel_type, event_time AS time, logon_type, src_computer, src_ip,
    CASE WHEN trim(target_user_name) = '' THEN 'NO_USER' ELSE split_part(target_user_name, '@', 1) END AS target_user_name,
    '' AS target_domain_name, '' AS subject_user_name, '' AS subject_domain_name, CAST(1 AS BIGINT) AS count, ordinal
  FROM res
), b AS (SELECT * FROM edges WHERE time < TIMESTAMP '{CUTOFF}'), w AS (SELECT * FROM edges WHERE time >= TIMESTAMP '{CUTOFF}')"""
ECOLS = ", ".join(schema.EDGE)


def edges_sql(rest: str) -> str:
    return with_tl(EDGES + " " + rest)


# -- base, scalars -------------------------------------------------------------------------------
@query(with_tl(f"SELECT {T14} FROM tl"))
def timeline_base(spark, d):
    return tl(spark, d).select(*schema.TIMELINE)


@query(with_tl("SELECT ordinal, event_id, event_type FROM (SELECT ordinal, event_id, CASE event_id WHEN '4624' THEN 'SUCCESSFUL_LOGON' WHEN '4778' THEN 'SUCCESSFUL_LOGON' WHEN '4625' THEN 'FAILED_LOGON' WHEN '4634' THEN 'LOGOFF' ELSE 'CONNECT' END AS event_type FROM tl)"))
def event_type_classify(spark, d):
    return tl(spark, d).select("ordinal", "event_id", x.classify(F.col("event_id"), F.lit("")).alias("event_type"))


@query(
    with_tl(
        """SELECT ordinal, code, CASE lower(code) WHEN '0xc0000064' THEN 'User does not exist (' || code || ')' WHEN '0xc000006a' THEN 'Wrong password (' || code || ')'
        WHEN '0xc0000234' THEN 'Account locked out (' || code || ')' ELSE code END AS detail
        FROM (SELECT ordinal, CASE user_id % 4 WHEN 0 THEN '0xC0000064' WHEN 1 THEN '0xC000006A' WHEN 2 THEN '0xc0000234' ELSE '0x1' END AS code FROM tl)"""
    )
)
def substatus_translate(spark, d):
    u = F.col("user_id") % 4
    code = F.when(u == 0, "0xC0000064").when(u == 1, "0xC000006A").when(u == 2, "0xc0000234").otherwise("0x1")
    return fixture.events(spark, d).select(F.col("event_id").alias("ordinal"), code.alias("code"), x.substatus(code).alias("detail"))


@query(with_tl("SELECT ordinal, event_id, CASE WHEN raw <> '' THEN raw WHEN event_id = '5140' THEN '3' ELSE '' END AS logon_type FROM (SELECT *, CASE WHEN ordinal % 2 = 0 THEN logon_type ELSE '' END AS raw FROM tl)"))
def logon_type_infer(spark, d):
    raw = F.when(F.col("ordinal") % 2 == 0, F.col("logon_type")).otherwise("")
    return tl(spark, d).select("ordinal", "event_id", x.infer_logon_type(F.col("event_id"), raw).alias("logon_type"))


@query(with_tl("SELECT ordinal, CASE WHEN ip LIKE '::ffff:%.%' THEN substr(ip, 8) WHEN ip LIKE 'fe80:%' THEN '' ELSE ip END AS src_ip FROM (SELECT ordinal, CASE ordinal % 3 WHEN 0 THEN '::ffff:' || src_ip WHEN 1 THEN 'fe80::' || ordinal ELSE src_ip END AS ip FROM tl)"))
def ipv4_mapped_strip(spark, d):
    n = F.col("ordinal") % 3
    ip = F.when(n == 0, F.concat(F.lit("::ffff:"), "src_ip")).when(n == 1, F.concat(F.lit("fe80::"), F.col("ordinal").cast("string"))).otherwise(F.col("src_ip"))
    return tl(spark, d).select("ordinal", x.strip_mapped(ip).alias("src_ip"))


@query(with_tl("SELECT ordinal, split_part(dst_computer || '.corp.example', '.', 1) AS host FROM tl"))
def short_host(spark, d):
    return tl(spark, d).select("ordinal", x.short_host(F.concat("dst_computer", F.lit(".corp.example"))).alias("host"))


@query(with_tl(f"SELECT ordinal, {_rel('u')} AS rel_type FROM (SELECT ordinal, CASE ordinal % 4 WHEN 0 THEN target_user_name || '@corp' WHEN 1 THEN '7' || target_user_name WHEN 2 THEN '' ELSE target_user_name END AS u FROM tl)"))
def rel_type_sanitise(spark, d):
    n, u = F.col("ordinal") % 4, F.col("target_user_name")
    user = F.when(n == 0, F.concat(u, F.lit("@corp"))).when(n == 1, F.concat(F.lit("7"), u)).when(n == 2, "").otherwise(u)
    return tl(spark, d).select("ordinal", x.rel_type(user).alias("rel_type"))


@query(with_tl("SELECT ordinal, dst_computer AS host FROM tl"))
def winrm_host(spark, d):
    return tl(spark, d).select("ordinal", x.winrm_host(F.concat(F.lit("http://"), "dst_computer", F.lit(":5985/wsman?PSVersion=5"))).alias("host"))


# -- filters -------------------------------------------------------------------------------------
_REASON = """
CASE WHEN (src_ip IN ('', '-', '127.0.0.1')) AND (lower(src_computer) IN ('', '-', 'local', 'mstsc', 'default_value') OR src_computer = dst_computer) THEN
  CASE WHEN src_ip = '127.0.0.1' THEN 'loopback_ip' WHEN lower(src_computer) = 'local' THEN 'literal_local' WHEN logon_type = '5' THEN 'service_logon'
    WHEN logon_type = '2' THEN 'interactive_logon' WHEN src_computer = dst_computer THEN 'self_reference' ELSE 'both_noise' END END"""
_LAYERED = f"""coalesce({_REASON},
  CASE WHEN lower(target_user_name) LIKE 'error!_%' ESCAPE '!' OR lower(target_user_name) LIKE '%$' THEN 'excluded_user' END,
  CASE WHEN lower(dst_computer) LIKE '%07%' OR lower(src_computer) LIKE '%07%' OR lower(dst_computer) = 'h011' OR lower(src_computer) = 'h011' THEN 'excluded_host' END,
  CASE WHEN src_ip LIKE '10.2.%' OR src_ip = '10.1.0.5' THEN 'excluded_ip' END)"""
LAYERED = filters.FilterConfig(True, ["error_*", "*$"], ["*07*", "h011"], ["10.2.0.0/16", "10.1.0.5"])


@query(with_tl(f"SELECT ordinal FROM (SELECT *, {_REASON} AS r FROM tl) WHERE r IS NULL"))
def filter_ignore_local(spark, d):
    return filters.apply_filters(tl(spark, d), filters.FilterConfig(True)).select("ordinal")


@query(with_tl(f"SELECT coalesce({_REASON}, 'kept') AS drop_reason, count(*) AS n FROM tl GROUP BY 1"))
def filter_ignore_local_reasons(spark, d):
    return filters.filter_summary(tl(spark, d), filters.FilterConfig(True))


@query(with_tl("SELECT ordinal FROM tl WHERE NOT (lower(target_user_name) LIKE 'error!_%' ESCAPE '!' OR lower(target_user_name) LIKE '%$')"))
def filter_users_glob(spark, d):
    return filters.apply_filters(tl(spark, d), filters.FilterConfig(users=["error_*", "*$"])).select("ordinal")


@query(with_tl("SELECT ordinal FROM tl WHERE NOT (lower(dst_computer) LIKE '%07%' OR lower(src_computer) LIKE '%07%' OR lower(dst_computer) = 'h011' OR lower(src_computer) = 'h011')"))
def filter_hosts_glob(spark, d):
    return filters.apply_filters(tl(spark, d), filters.FilterConfig(hosts=["*07*", "h011"])).select("ordinal")


@query(with_tl("SELECT ordinal FROM tl WHERE NOT (src_ip LIKE '10.2.%' OR src_ip = '10.1.0.5')"))
def filter_ips_cidr(spark, d):
    return filters.apply_filters(tl(spark, d), filters.FilterConfig(ips=["10.2.0.0/16", "10.1.0.5"])).select("ordinal")


@query(with_tl(f"SELECT coalesce({_LAYERED}, 'kept') AS drop_reason, count(*) AS n FROM tl GROUP BY 1"))
def filter_layered(spark, d):
    return filters.filter_summary(tl(spark, d), LAYERED)


# -- timelines -----------------------------------------------------------------------------------
@query(with_tl(f"SELECT DISTINCT {T14} FROM tl"))
def merge_union_dedup(spark, d):
    one = tl(spark, d)
    return timeline.merge([one, one.where("ordinal % 2 = 0")]).select(*schema.TIMELINE)


@query(with_tl(f"SELECT DISTINCT {T14}, ts AS event_time FROM tl WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'"))
def merge_time_window(spark, d):
    got = timeline.merge([tl(spark, d)], datetime(2024, 1, 10), datetime(2024, 1, 12, 12))
    return got.select(*schema.TIMELINE, "event_time")


@query(with_tl(f"SELECT DISTINCT {', '.join(repr('') + ' AS ' + c if c in ('event_type', 'logon_id') else c for c in schema.TIMELINE)} FROM tl"))
def merge_legacy12(spark, d):
    old = tl(spark, d).withColumnRenamed("detail", "process").select(*schema.LEGACY)
    return timeline.merge([schema.legacy_to_timeline(old)]).select(*schema.TIMELINE)


@query(
    with_tl(
        f"""SELECT {T14} FROM (SELECT *, row_number() OVER (PARTITION BY time_created, dst_computer, event_id, event_type, target_user_name, src_ip ORDER BY length(log_filename), ordinal) AS n
        FROM (SELECT * REPLACE ('live_long_name' AS log_filename) FROM tl UNION ALL SELECT * REPLACE ('vss' AS log_filename) FROM tl WHERE ordinal % 3 = 0)) WHERE n = 1"""
    )
)
def dedup_prefer_short_name(spark, d):
    one = tl(spark, d)
    both = one.withColumn("log_filename", F.lit("live_long_name")).unionByName(one.where("ordinal % 3 = 0").withColumn("log_filename", F.lit("vss")))
    return timeline.dedup(both, "ordinal").select(*schema.TIMELINE)


@query(with_tl(f"SELECT {T14} FROM tl ORDER BY time_created, ordinal"))
def timeline_sorted(spark, d):
    return timeline.ordered(tl(spark, d), "time_created", "ordinal").select(*schema.TIMELINE)


# -- graph ---------------------------------------------------------------------------------------
_N = "dst_computer, src_computer, src_ip, target_user_name, event_time, ordinal"


@query(with_tl(f"{NORM} SELECT {_N} FROM norm"))
def loader_normalise(spark, d):
    return graph.normalise(tl(spark, d)).select(*_N.split(", "))


@query(with_tl(f"{NORM} SELECT {_N} FROM ok"))
def loader_noise_drop(spark, d):
    return graph.usable(graph.normalise(tl(spark, d))).select(*_N.split(", "))


@query(with_tl(f"{BEST} SELECT ip, host, weight FROM weights"))
def ip_host_evidence(spark, d):
    return graph.evidence(graph.usable(graph.normalise(tl(spark, d))))


@query(with_tl(f"{BEST} SELECT ip, host FROM best"))
def ip_host_best(spark, d):
    return graph.best_host(graph.evidence(graph.usable(graph.normalise(tl(spark, d)))))


@query(edges_sql(f"SELECT {ECOLS} FROM edges"))
def edges_ungrouped(spark, d):
    return graph.edges(tl(spark, d)).select(*schema.EDGE)


_GROUPED = f""", g AS (
  SELECT dst_computer, split_part(target_user_name, '@', 1) AS target_user_name, logon_type, min(event_time) AS event_time, count(*) AS count,
    arg_min(src_computer, ordinal) AS src_computer, arg_min(src_ip, ordinal) AS src_ip FROM ok GROUP BY 1, 2, 3
){_resolved('g', 'gres')}"""


@query(with_tl(f"{BEST}{_GROUPED} SELECT DISTINCT origin, destination, {_rel('target_user_name')} AS rel_type, event_time AS time, logon_type, src_computer, src_ip, target_user_name, '' AS target_domain_name, '' AS subject_user_name, '' AS subject_domain_name, count FROM gres"))
def edges_grouped(spark, d):
    return graph.grouped_edges(tl(spark, d))


@query(edges_sql("SELECT * FROM (SELECT CASE WHEN origin = 'H001' THEN 'H002' ELSE origin END AS origin, CASE WHEN destination = 'H001' THEN 'H002' ELSE destination END AS destination, rel_type, time FROM edges) WHERE origin <> destination"))
def node_merge(spark, d):
    return graph.merge_nodes(graph.edges(tl(spark, d)), "H001", "H002").select("origin", "destination", "rel_type", "time")


@query(edges_sql("SELECT rel_type, count(*) AS n FROM edges WHERE origin = 'H001' OR destination = 'H001' GROUP BY 1"))
def node_merge_counts(spark, d):
    return graph.merge_counts(graph.edges(tl(spark, d)), "H001")


# -- published hunting queries -------------------------------------------------------------------
_Q = "origin, destination, rel_type, time, logon_type"
_START, _END = "2024-01-10 00:00:00", "2024-01-25 00:00:00"
_RANGE = f"time BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}'"


def e(spark, d):
    return graph.edges(tl(spark, d))


@query(edges_sql(f"SELECT {_Q} FROM edges"))
def hunt_q1(spark, d):
    return hunting.all_edges(e(spark, d)).select(*_Q.split(", "))


@query(edges_sql(f"SELECT {_Q} FROM edges WHERE {_RANGE}"))
def hunt_q2(spark, d):
    return hunting.in_range(e(spark, d), _START, _END).select(*_Q.split(", "))


_HUMAN = "target_user_name NOT LIKE '%$' AND target_user_name <> 'NO_USER'"


@query(edges_sql(f"SELECT {_Q} FROM edges WHERE {_RANGE} AND {_HUMAN}"))
def hunt_q3(spark, d):
    return hunting.human(e(spark, d), _START, _END).select(*_Q.split(", "))


@query(edges_sql(f"SELECT {_Q} FROM edges WHERE {_RANGE} AND target_user_name NOT LIKE '%$' AND logon_type = '10'"))
def hunt_q4(spark, d):
    return hunting.of_type(e(spark, d), _START, _END, "10").select(*_Q.split(", "))


@query(edges_sql(f"SELECT {_Q} FROM edges WHERE {_RANGE} AND target_user_name NOT LIKE '%$' AND logon_type = '3'"))
def hunt_q5(spark, d):
    return hunting.of_type(e(spark, d), _START, _END, "3").select(*_Q.split(", "))


@query(edges_sql(f"SELECT {_Q} FROM edges WHERE {_RANGE} AND (target_user_name LIKE 'ERR%' OR subject_user_name LIKE 'ERR%')"))
def hunt_q6(spark, d):
    return hunting.with_prefix(e(spark, d), _START, _END, "ERR").select(*_Q.split(", "))


@query(edges_sql(f"SELECT {_Q} FROM edges WHERE {_RANGE} AND {_HUMAN} AND logon_type IN ('3', '10') AND (origin IN ('H012') OR destination IN ('H012') OR target_user_name IN ('CLICK_1', 'VIEW_2') OR subject_user_name IN ('CLICK_1', 'VIEW_2') OR src_ip IN ('10.1.0.5', '10.2.0.6'))"))
def hunt_q7(spark, d):
    return hunting.entities(e(spark, d), _START, _END, hosts=["H012"], users=["CLICK_1", "VIEW_2"], ips=["10.1.0.5", "10.2.0.6"], types=["3", "10"]).select(*_Q.split(", "))


@query(edges_sql(f"SELECT {_Q} FROM edges WHERE target_user_name = 'CLICK_1'"))
def hunt_q8(spark, d):
    return hunting.by_user(e(spark, d), "CLICK_1").select(*_Q.split(", "))


_TOP = "SELECT destination AS target, count(*) AS connections FROM edges GROUP BY 1 ORDER BY connections DESC, target LIMIT 10"


@query(edges_sql(_TOP))
def hunt_q9(spark, d):
    return hunting.most_connected(e(spark, d))


@query(edges_sql(_TOP))
def indegree_top10(spark, d):
    return hunting.most_connected(e(spark, d))


@query()
def hunt_q10_temporal_path(spark, d):
    """Over all edges and any number of hops: too much for SQL, so compared with brute force in the tests."""
    return hunting.temporal_paths(e(spark, d), "H001", "H002", limit=5)


def held(spark, d):
    """The edges written once, for plans that read them several times."""
    return algorithms.cut(e(spark, d))


# -- baseline and detectors ----------------------------------------------------------------------
@query(edges_sql("SELECT CASE WHEN count(*) = 0 THEN 'Empty' WHEN count(*) FILTER (WHERE times > 1) > 0 THEN 'Ungrouped' ELSE 'Grouped' END AS mode, count(*) AS tuples, count(*) FILTER (WHERE times > 1) AS repeated FROM (SELECT count(DISTINCT time) AS times FROM edges GROUP BY origin, destination, rel_type, logon_type)"))
def graph_mode_probe(spark, d):
    return graph.mode_probe(e(spark, d))


@query(edges_sql("SELECT (SELECT count(*) FROM b) AS baseline_edges, (SELECT count(*) FROM w) AS window_edges"))
def baseline_split(spark, d):
    return hunt.split_counts(e(spark, d), CUTOFF)


def _agg(c: str) -> str:
    return f"string_agg(DISTINCT {c}, ',' ORDER BY {c})"


@query(edges_sql(f"SELECT origin, destination, {_agg('rel_type')} AS users, {_agg('logon_type')} AS logon_types, count(*) AS n FROM b GROUP BY 1, 2"))
def baseline_pairs(spark, d):
    return hunt.pairs(hunt.baseline(e(spark, d), CUTOFF))


@query(edges_sql(f"SELECT coalesce(i.host, o.host) AS host, coalesce(users, '') AS users, coalesce(sources, '') AS sources, coalesce(logon_types, '') AS logon_types, coalesce(destinations, '') AS destinations FROM (SELECT destination AS host, {_agg('rel_type')} AS users, {_agg('origin')} AS sources, {_agg('logon_type')} AS logon_types FROM b GROUP BY 1) i FULL JOIN (SELECT origin AS host, {_agg('destination')} AS destinations FROM b GROUP BY 1) o ON i.host = o.host"))
def baseline_hosts(spark, d):
    return hunt.hosts(hunt.baseline(held(spark, d), CUTOFF))


@query(edges_sql(f"SELECT rel_type, {_agg('destination')} AS hosts, {_agg('logon_type')} AS logon_types FROM b GROUP BY 1"))
def baseline_users(spark, d):
    return hunt.users(hunt.baseline(e(spark, d), CUTOFF))


@query(edges_sql("SELECT logon_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY 1"))
def logon_type_distribution(spark, d):
    return hunt.logon_types(hunt.baseline(e(spark, d), CUTOFF)).withColumn("share", F.round("share", 6))


_TXT = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"
_NOVEL = f"""SELECT 'novel-edge' AS detector, destination AS host, {_TXT.format('time')} AS time_window, round((np + nu + nt) / 3.0, 6) AS score,
  origin || ' -> ' || destination || ' by ' || rel_type || ' type ' || logon_type || ', new: ' || concat_ws('; ', CASE WHEN np = 1 THEN 'pair' END, CASE WHEN nu = 1 THEN 'user at host' END, CASE WHEN nt = 1 THEN 'type at host' END) AS summary
  FROM (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.origin = w.origin AND b.destination = w.destination) THEN 0 ELSE 1 END AS np,
    CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.destination = w.destination AND b.rel_type = w.rel_type) THEN 0 ELSE 1 END AS nu,
    CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.destination = w.destination AND b.logon_type = w.logon_type) THEN 0 ELSE 1 END AS nt FROM w) WHERE np + nu + nt > 0"""
_RARE = f"""SELECT 'rare-logon-type' AS detector, destination AS host, {_TXT.format('time')} AS time_window, round(1 - least(share / 0.005, 1.0), 6) AS score,
  'type ' || logon_type || ' from ' || origin || ' by ' || rel_type AS summary
  FROM (SELECT w.*, coalesce((SELECT count(*) FROM b WHERE b.logon_type = w.logon_type), 0) / (SELECT count(*) FROM b) AS share FROM w WHERE (SELECT count(*) FROM b) > 0) WHERE share < 0.005"""
_ROTATION = f"""SELECT 'cred-rotation' AS detector, origin AS host, {_TXT.format('min(time)')} || ' .. ' || {_TXT.format('max(time)')} AS time_window,
  round(0.5 + 0.5 * (least(count(DISTINCT rel_type), 10) - 3) / 7.0, 6) AS score, count(DISTINCT rel_type) || ' users to ' || count(DISTINCT destination) || ' hosts' AS summary
  FROM w GROUP BY origin HAVING count(DISTINCT rel_type) >= 3"""
_CHAIN = f"""SELECT 'chain-motif' AS detector, b AS host, {_TXT.format('t1')} || ' .. ' || {_TXT.format('t2')} AS time_window,
  round(least(1.0, 1 - least(gap / 600.0, 0.5) + 0.1 * (n1 + n2)), 6) AS score, a || ' -' || u1 || '-> ' || b || ' -' || u2 || '-> ' || c || ' in ' || gap || 's' AS summary
  FROM (SELECT r1.origin AS a, r1.destination AS b, r2.destination AS c, r1.rel_type AS u1, r2.rel_type AS u2, r1.time AS t1, r2.time AS t2, datesub('second', r1.time, r2.time) AS gap,
      CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.origin = r1.origin AND b.destination = r1.destination) THEN 0 ELSE 1 END AS n1,
      CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.origin = r2.origin AND b.destination = r2.destination) THEN 0 ELSE 1 END AS n2
    FROM w r1 JOIN w r2 ON r1.destination = r2.origin AND r2.time > r1.time AND r2.time - r1.time <= INTERVAL 300 SECOND AND r1.rel_type <> r2.rel_type AND r1.origin <> r2.destination)"""


@query(edges_sql(_NOVEL))
def detect_novel_edge(spark, d):
    return hunt.novel_edge(held(spark, d), CUTOFF)


@query(edges_sql(_RARE))
def detect_rare_logon_type(spark, d):
    return hunt.rare_logon_type(held(spark, d), CUTOFF)


@query(edges_sql(_ROTATION))
def detect_cred_rotation(spark, d):
    return hunt.cred_rotation(e(spark, d), CUTOFF)


@query(edges_sql(_CHAIN))
def detect_chain_motif(spark, d):
    return hunt.chain_motif(held(spark, d), CUTOFF)


def _pagerank_sql(rounds: int = 10) -> str:
    out = """, l AS MATERIALIZED (SELECT origin, destination, count(*) AS w FROM edges GROUP BY ALL),
    o AS MATERIALIZED (SELECT origin, sum(w) AS ow FROM l GROUP BY 1), h AS MATERIALIZED (SELECT origin AS host FROM l UNION SELECT destination FROM l),
    r0 AS MATERIALIZED (SELECT host, 1.0::DOUBLE / (SELECT count(*) FROM h) AS rank FROM h)"""
    for k in range(rounds):
        out += f""", r{k + 1} AS MATERIALIZED (SELECT h.host, 0.15 / (SELECT count(*) FROM h) + 0.85 * (coalesce(g.got, 0) +
          (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE host NOT IN (SELECT origin FROM o)) / (SELECT count(*) FROM h)) AS rank
          FROM h LEFT JOIN (SELECT destination, sum(rank * l.w / o.ow) AS got FROM l JOIN o USING (origin) JOIN r{k} r ON r.host = l.origin GROUP BY 1) g ON g.destination = h.host)"""
    return out


@query(
    edges_sql(
        _pagerank_sql()
        + f""" SELECT 'pagerank-spike' AS detector, destination AS host, 'from {CUTOFF}' AS time_window, s AS score, win || ' of ' || (base + win) || ' in-edges since the cutoff' AS summary
        FROM (SELECT destination, base, win, round(r10.rank * win / (base + win), 6) AS s FROM (SELECT destination, count(*) FILTER (WHERE time < TIMESTAMP '{CUTOFF}') AS base, count(*) FILTER (WHERE time >= TIMESTAMP '{CUTOFF}') AS win FROM edges GROUP BY 1) i
        JOIN r10 ON r10.host = i.destination WHERE win > 0) WHERE s >= 0.0001"""
    )
)
def detect_pagerank_spike(spark, d):
    return hunt.pagerank_spike(e(spark, d), CUTOFF)


#: Shortest paths of every length up to this one are written out: the fixture's hosts are 100, its paths far shorter.
_LEVELS = 12


def _betweenness_sql() -> str:
    """Distances and numbers of shortest paths level by level, then the share of each host between two others."""
    out = """, bl AS MATERIALIZED (SELECT DISTINCT origin, destination FROM edges), bh AS MATERIALIZED (SELECT origin AS host FROM bl UNION SELECT destination FROM bl),
    s0 AS MATERIALIZED (SELECT host AS s, host AS v, 1.0::DOUBLE AS paths, 0 AS dist FROM bh), seen0 AS MATERIALIZED (SELECT s, v FROM s0)"""
    for k in range(_LEVELS):
        out += f""", s{k + 1} AS MATERIALIZED (SELECT p.s, l.destination AS v, sum(p.paths) AS paths, {k + 1} AS dist FROM s{k} p JOIN bl l ON l.origin = p.v
          WHERE NOT EXISTS (SELECT 1 FROM seen{k} x WHERE x.s = p.s AND x.v = l.destination) GROUP BY 1, 2), seen{k + 1} AS MATERIALIZED (SELECT * FROM seen{k} UNION ALL SELECT s, v FROM s{k + 1})"""
    out += ", sp AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, _LEVELS + 1)) + ")"
    return out + """, bt AS MATERIALIZED (SELECT bh.host, coalesce(x.share, 0) / (SELECT CASE WHEN count(*) > 2 THEN (count(*) - 1) * (count(*) - 2) ELSE 1 END FROM bh) AS betweenness FROM bh LEFT JOIN (
      SELECT a.v AS host, sum(a.paths * b.paths / st.paths) AS share FROM sp a JOIN sp b ON b.s = a.v JOIN sp st ON st.s = a.s AND st.v = b.v AND st.dist = a.dist + b.dist WHERE a.s <> b.v GROUP BY 1) x ON x.host = bh.host)"""


_BETWEENNESS = f"""SELECT 'betweenness-spike' AS detector, destination AS host, 'from {CUTOFF}' AS time_window, s AS score, win || ' of ' || (base + win) || ' in-edges since the cutoff' AS summary
  FROM (SELECT destination, base, win, round(bt.betweenness * win / (base + win), 6) AS s FROM (SELECT destination, count(*) FILTER (WHERE time < TIMESTAMP '{CUTOFF}') AS base, count(*) FILTER (WHERE time >= TIMESTAMP '{CUTOFF}') AS win
  FROM edges GROUP BY 1) i JOIN bt ON bt.host = i.destination WHERE win > 0) WHERE s >= 0.0001"""


@query(edges_sql(_betweenness_sql() + " " + _BETWEENNESS))
def detect_betweenness_spike(spark, d):
    return hunt.betweenness_spike(e(spark, d), CUTOFF)


@query(edges_sql(_betweenness_sql() + " SELECT host, round(betweenness, 6) AS betweenness FROM bt"))
def betweenness_hosts(spark, d):
    return algorithms.betweenness(e(spark, d)).select("host", F.round("betweenness", 6).alias("betweenness"))


def two_halves(spark, d) -> DataFrame:
    """Edges in two communities of 20 hosts; bridges are rare, and those of hosts 1 to 9 in each half come after the cutoff only."""
    o, t, side = F.col("user_id") % 20, (F.col("event_id") / 3).cast("long") % 20, F.col("user_id") % 2
    bridge = (F.col("event_id") % 50 == 0) & ((o % 10 == 0) | (F.col("ts") >= F.lit(CUTOFF).cast("timestamp_ntz")))
    host = lambda side, n: F.concat(F.when(side == 0, "A").otherwise("B"), n.cast("string"))
    made = fixture.events(spark, d).select(host(side, o).alias("origin"), host(F.when(bridge, 1 - side).otherwise(side), t).alias("destination"), F.upper("event_type").alias("rel_type"), F.col("ts").alias("time"))
    return made.where("origin <> destination")


_TWO = f"""WITH h AS (SELECT user_id % 20 AS o, event_id // 3 % 20 AS t, user_id % 2 AS side, upper(event_type) AS rel_type, ts AS time, event_id % 50 = 0 AND (user_id % 20 % 10 = 0 OR ts >= TIMESTAMP '{CUTOFF}') AS bridge FROM events),
  edges AS (SELECT * FROM (SELECT CASE side WHEN 0 THEN 'A' ELSE 'B' END || o AS origin, CASE WHEN (side = 0) <> bridge THEN 'A' ELSE 'B' END || t AS destination, rel_type, time FROM h) WHERE origin <> destination),
  b AS (SELECT * FROM edges WHERE time < TIMESTAMP '{CUTOFF}'), w AS (SELECT * FROM edges WHERE time >= TIMESTAMP '{CUTOFF}')"""
_BRIDGE = f"""SELECT 'community-bridge' AS detector, destination AS host, {_TXT.format('time')} AS time_window, 0.7::DOUBLE AS score, origin || ' -> ' || destination || ' across communities by ' || rel_type AS summary
  FROM w WHERE origin[1] <> destination[1] AND NOT EXISTS (SELECT 1 FROM b WHERE b.origin = w.origin AND b.destination[1] = w.destination[1])"""


@query(f"{_TWO} {_BRIDGE}")
def detect_community_bridge(spark, d):
    return hunt.community_bridge(algorithms.cut(two_halves(spark, d)), CUTOFF)


@query(f"{_TWO} SELECT host, min(host) OVER (PARTITION BY host[1]) AS community FROM (SELECT origin AS host FROM edges UNION SELECT destination FROM edges)")
def communities_hosts(spark, d):
    return algorithms.communities(two_halves(spark, d))


@query(
    edges_sql(
        f"""SELECT row_number() OVER (ORDER BY score DESC, k, host, time_window, summary) AS rank, detector, host, time_window, score, summary FROM (
        SELECT 0 AS k, * FROM ({_NOVEL}) UNION ALL SELECT 2, * FROM ({_RARE}) UNION ALL SELECT 5, * FROM ({_CHAIN}) UNION ALL SELECT 6, * FROM ({_ROTATION}))"""
    )
)
def findings_ranked(spark, d):
    only = ["novel-edge", "rare-logon-type", "chain-motif", "cred-rotation"]
    return hunt.ranked(hunt.run_all(e(spark, d), CUTOFF, only=only))


_SPIKE = f"""SELECT 'pagerank-spike' AS detector, destination AS host, 'from {CUTOFF}' AS time_window, s AS score, win || ' of ' || (base + win) || ' in-edges since the cutoff' AS summary
  FROM (SELECT destination, base, win, round(r10.rank * win / (base + win), 6) AS s FROM (SELECT destination, count(*) FILTER (WHERE time < TIMESTAMP '{CUTOFF}') AS base, count(*) FILTER (WHERE time >= TIMESTAMP '{CUTOFF}') AS win FROM edges GROUP BY 1) i
  JOIN r10 ON r10.host = i.destination WHERE win > 0) WHERE s >= 0.0001"""
#: All detectors; the hosts of the fixture are one community, so none bridges two.
_ALL = f"""SELECT row_number() OVER (ORDER BY score DESC, k, host, time_window, summary) AS rank, detector, host, time_window, score, summary FROM (
  SELECT 0 AS k, * FROM ({_NOVEL}) UNION ALL SELECT 2, * FROM ({_RARE}) UNION ALL SELECT 3, * FROM ({_SPIKE}) UNION ALL SELECT 4, * FROM ({_BETWEENNESS}) UNION ALL SELECT 5, * FROM ({_CHAIN}) UNION ALL SELECT 6, * FROM ({_ROTATION}))"""


@query()
def findings_all_detectors(spark, d):
    """Communities decide rows here, which SQL can't say; the other detectors are in ``findings_but_communities``."""
    return hunt.ranked(hunt.run_all(e(spark, d), CUTOFF))


@query(edges_sql(_pagerank_sql() + _betweenness_sql() + " " + _ALL))
def findings_but_communities(spark, d):
    return hunt.ranked(hunt.run_all(e(spark, d), CUTOFF, skip=["community-bridge"]))


@query(
    edges_sql(
        f"""SELECT rank, rank || ',' || printf('%.4f', score) || ',' || detector || ',' || host || ',' || time_window || ',' || summary || ',' || '"MATCH (a)-[r]->(b) WHERE (a.name = ''' || host || ''' OR b.name = ''' || host || ''') AND r.time >= ''' || left(time_window, 26)
        || ''' AND r.time <= ''' || right(time_window, 26) || ''' RETURN a, r, b"' AS value FROM (SELECT row_number() OVER (ORDER BY score DESC, k, host, time_window, summary) AS rank, * FROM (SELECT 5 AS k, * FROM ({_CHAIN}) UNION ALL SELECT 6, * FROM ({_ROTATION})))"""
    )
)
def findings_csv(spark, d):
    return hunt.csv_lines(hunt.ranked(hunt.run_all(e(spark, d), CUTOFF, only=["chain-motif", "cred-rotation"])))


@query(
    edges_sql(
        """SELECT 'MERGE (a:host {name: $origin}) MERGE (b:host {name: $destination}) CREATE (a)-[r:`' || rel_type || '`]->(b) SET r = $properties' AS statement,
        '{"origin":"' || origin || '","destination":"' || destination || '","properties":{"time":"' || strftime(time, '%Y-%m-%dT%H:%M:%S.%f') || '","logon_type":"' || logon_type || '","src_computer":"' || src_computer || '","src_ip":"' || src_ip
        || '","target_user_name":"' || target_user_name || '","target_domain_name":"","subject_user_name":"","subject_domain_name":"","count":1}}' AS parameters FROM edges"""
    )
)
def graph_statements(spark, d):
    return graph.statements(e(spark, d).select(*schema.EDGE))


@query(edges_sql("SELECT (SELECT count(*) FROM tl) AS rows, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM (SELECT origin FROM edges UNION SELECT destination FROM edges)) AS hosts, (SELECT count(DISTINCT rel_type) FROM edges) AS users, (SELECT count(*) FROM edges) - (SELECT count(*) FROM (SELECT DISTINCT origin, destination, rel_type, logon_type FROM edges)) AS repeated"))
def load_summary(spark, d):
    return graph.load_summary(tl(spark, d), algorithms.cut(e(spark, d)))


# -- sources --------------------------------------------------------------------------------------
_PORT = "CASE user_id % 4 WHEN 0 THEN '3389' WHEN 1 THEN '445' WHEN 2 THEN '22' ELSE '8080' END"


@query(f"SELECT CASE user_id % 4 WHEN 0 THEN 'RDP' WHEN 1 THEN 'SMB' WHEN 2 THEN 'SSH' ELSE 'OTHER' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def port_buckets(spark, d):
    port = F.element_at(F.array(*[F.lit(p) for p in ("3389", "445", "22", "8080")]), (F.col("user_id") % 4 + 1).cast("int"))
    return fixture.events(spark, d).groupBy(x.port_bucket(port).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_id AS ordinal, t AS time_created, 'CORP' AS target_domain_name, 'u' || user_id AS target_user_name FROM (
      SELECT event_id, user_id, unnest(CASE WHEN event_id % 3 = 0 THEN [strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')]
        ELSE [strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S'), strftime(date_trunc('second', ts) + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S')] END) AS t FROM events)"""
)
def ual_two_events(spark, d):
    secs = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    ticks = lambda s: (s + 11_644_473_600) * 10_000_000
    rows = fixture.events(spark, d).select(
        F.col("event_id").alias("ordinal"), F.concat(F.lit("CORP\\u"), F.col("user_id").cast("string")).alias("user"), F.lit("0A 00 00 05").alias("address"), F.lit("{X}").alias("role_guid"),
        ticks(secs).alias("insert_date"), F.when(F.col("event_id") % 3 == 0, ticks(secs)).otherwise(ticks(secs + 90)).alias("last_access"),
    )
    roles = spark.createDataFrame([("{x}", "File Server")], "guid string, name string")
    return ual.events(rows, roles, "SRV", carry=["ordinal"]).select("ordinal", "time_created", "target_domain_name", "target_user_name")


@query(
    f"""SELECT event_id AS ordinal, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || '000Z' AS time_created,
      CASE WHEN user_id % 4 < 3 THEN 'AGENT' ELSE '10.9.9.9' END AS dst_computer, CASE WHEN user_id % 4 < 3 THEN '' ELSE 'AGENT' END AS src_computer,
      CASE WHEN user_id % 4 < 3 THEN '10.9.9.9' ELSE '10.0.0.1' END AS src_ip, CASE user_id % 4 WHEN 0 THEN '10' WHEN 1 THEN '3' WHEN 2 THEN 'SSH' ELSE '3' END AS logon_type FROM (SELECT *, {_PORT} AS p FROM events)"""
)
def edr_network_project(spark, d):
    ev = fixture.events(spark, d)
    port = F.element_at(F.array(*[F.lit(p) for p in ("3389", "445", "22", "50000")]), (F.col("user_id") % 4 + 1).cast("int"))
    raw = ev.select(
        F.col("event_id").alias("ordinal"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string").alias("_time"), F.lit("AGENT").alias("agent_hostname"),
        F.lit("10.0.0.1").alias("action_local_ip"), port.alias("action_local_port"), F.lit("10.9.9.9").alias("action_remote_ip"), F.lit("445").alias("action_remote_port"),
        F.lit("u").alias("actor_primary_username"), F.lit("a,b").alias("actor_process_command_line"),
    )
    return edr.network(raw, carry=["ordinal"]).select("ordinal", "time_created", "dst_computer", "src_computer", "src_ip", "logon_type")


@query("SELECT event_id AS ordinal, event_type AS target_user_name, 'H' || user_id AS src_computer FROM events WHERE event_type <> 'view'")
def custom_csv(spark, d):
    rules = custom_rules.load([custom_rules.example("csv")])
    lines = fixture.events(spark, d).select(F.col("event_id").alias("ordinal"), F.concat(F.lit("VPN,"), F.when(F.col("event_type") == "view", "skip").otherwise("login"), F.lit(", "), "event_type", F.lit(',"H'), F.col("user_id").cast("string"), F.lit('"')).alias("line"))
    return custom_rules.parse(lines, rules, carry=["ordinal"]).select("ordinal", "target_user_name", "src_computer")


@query("SELECT event_id AS ordinal, event_type AS target_user_name, '10.0.0.' || (user_id % 200) AS src_ip FROM events WHERE event_type <> 'view'")
def custom_regex(spark, d):
    rules = custom_rules.load([custom_rules.example("regex")])
    verb = F.when(F.col("event_type") == "view", "denied").otherwise("accepted")
    lines = fixture.events(spark, d).select(F.col("event_id").alias("ordinal"), F.concat_ws(" ", F.lit("gw01 vpn:"), verb, F.lit("user"), "event_type", F.lit("from"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 200).cast("string"))).alias("line"))
    return custom_rules.parse(lines, rules, carry=["ordinal"]).select("ordinal", "target_user_name", "src_ip")


@query("SELECT event_id AS ordinal, event_type AS target_user_name, 'login' AS detail FROM events")
def custom_keyvalue(spark, d):
    rules = custom_rules.load([custom_rules.example("keyvalue")])
    lines = fixture.events(spark, d).select(F.col("event_id").alias("ordinal"), F.concat(F.lit('type=vpn user="'), "event_type", F.lit('" reason="login successfully"')).alias("line"))
    return custom_rules.parse(lines, rules, carry=["ordinal"]).select("ordinal", "target_user_name", "detail")


@query(edges_sql(_pagerank_sql() + " SELECT host, round(rank, 6) AS rank FROM r10"))
def pagerank_hosts(spark, d):
    return algorithms.pagerank(e(spark, d)).select("host", F.round("rank", 6).alias("rank"))


QUERIES |= source_queries.QUERIES
ORACLES |= source_queries.ORACLES
