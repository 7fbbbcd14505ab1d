import ipaddress

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import net, scalars, times
from tracewright.operators import filters


def table(spark, values, *columns):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "n int, v string")
    return [tuple(r)[1:] for r in df.select("n", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("n").collect()]




def test_addresses_against_the_standard_library(spark):
    values = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "", "::", "::1", "fe80::1", "2001:db8::8a2e:370:7334", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::ffff:10.0.0.1", ":::", "1::2::3", "12345::", "g::", "1.2.3.4:80", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:"]

    def number(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return None, None
        return (int(a), None) if a.version == 4 else (None, f"{int(a):032x}")

    assert table(spark, values, net.v4_number(F.col("v")), net.v6_hex(F.col("v"))) == [number(v) for v in values]
    got = table(spark, values, net.in_list(F.col("v"), ["1.2.0.0/16", "2001:db8::/32", "::1"]))
    assert [v for v, (x,) in zip(values, got, strict=True) if x] == ["1.2.3.4", "::1", "2001:db8::8a2e:370:7334"]
    with pytest.raises(ValueError):
        net.in_list(F.col("v"), ["not an address"])


def test_hosts_and_names(spark):
    values = ["10.0.0.1", "10.0.0.1:445", "dc01.corp.local", "BEEF", "", "srv:3389", "[fe80::1]", "\\\\FILES", "2001:db8::1", "-"]
    up = scalars.upper_name(F.col("v"))
    assert [x for (x,) in table(spark, values, scalars.clean_host(up))] == ["10.0.0.1", "10.0.0.1", "DC01", "BEEF", "", "SRV", "FE80::1", "FILES", "2001:", "-"]
    assert [x for (x,) in table(spark, values, scalars.clean_host(up, False))] == ["10.0.0.1", "10.0.0.1", "DC01", "BEEF", "", "SRV", "FE80::1", "FILES", "2001:DB8::1", "-"]
    users = ["joe@corp.com", "svc-backup", "7zip", "", " ", "@x", "Éva"]
    assert [x for (x,) in table(spark, users, scalars.rel_type(F.col("v")))] == ["JOE", "SVC_BACKUP", "U7ZIP", "NO_USER", "NO_USER", "NO_USER", "_VA"]
    assert table(spark, ["CORP\\joe", "joe", "A\\b\\c"], scalars.domain_of(F.col("v")), scalars.user_of(F.col("v"))) == [("CORP", "joe"), ("", "joe"), ("A", "b")]
    assert table(spark, ["0A 00 00 05", "00 00 00 00 00 00 00 00 00 00 FF FF 0A 01 02 03", " ".join(["00"] * 15 + ["01"]), "x"], scalars.hex_ip(F.col("v"))) == [("10.0.0.5",), ("10.1.2.3",), ("::1",), ("",)]


def test_times(spark):
    values = ["2024-01-02T03:04:05.1234567Z", "2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05+02:00", "2024-01-02 03:04:05", "2024-01-02 03:04:05.5 UTC", "Jan 2", "", "2024-13-02T00:00:00Z"]
    got = [str(x) for (x,) in table(spark, values, times.parse_time(F.col("v")))]
    assert got == ["2024-01-02 03:04:05.123456", "2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04:05.500000", "None", "None", "None"]
    assert [x is not None for (x,) in table(spark, values, times.parse_time(F.col("v"), strict=True))] == [True, True, False, False, False, False, False, False]
    assert table(spark, ["133485408000000000", "0", "-1", "x"], times.filetime(F.col("v")), times.hive_time(F.col("v"))) == [("2024-01-01 00:00:00", "2024-01-01T00:00:00+00:00"), ("", ""), ("", ""), ("", "")]
    assert table(spark, ["1704067200123", "2024-01-01 00:00:00.5 UTC", "soon"], times.vendor_time(F.col("v"))) == [("2024-01-01T00:00:00.123000Z",), ("2024-01-01T00:00:00.500000Z",), ("soon",)]
    assert str(times.parse_bound("2024-01-02T03:04:05+09:00")) == "2024-01-02 03:04:05"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab*.", max_size=4), min_size=1, max_size=3), st.lists(st.text("aAbB.", max_size=5), min_size=1, max_size=8))
def test_globs_against_a_model(patterns, values):
    from pyspark.sql import SparkSession

    def one(p, v):
        p, v = p.strip().lower(), v.lower()
        if not p or not v:
            return False
        if p == "*":
            return True
        head, tail = p.startswith("*"), p.endswith("*")
        core = p[1 if head else 0 : len(p) - 1 if tail else None]
        if head and not core:
            return True
        return core in v if head and tail else v.endswith(core) if head else v.startswith(core) if tail else v == core

    got = table(SparkSession.getActiveSession(), values, filters.glob(F.col("v"), patterns))
    assert [x for (x,) in got] == [any(one(p, v) for p in patterns) for v in values]


def test_lists(tmp_path):
    f = tmp_path / "list.txt"
    f.write_text("# head\nsvc_*  # service\n\nadmin\n")
    assert filters.read_list(f"x, @{f},y") == ["x", "svc_*", "admin", "y"]
