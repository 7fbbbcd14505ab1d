import io
import struct
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.schema import TIMELINE
from tracewright.sources import custom_rules, edr, files, linux, windows


def lines(spark, values, name="line"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def event(provider, number, data="", user_data="", computer="HOST.corp"):
    items = "".join(f'<Data Name="{k}">{v}</Data>' for k, v in data) if data else ""
    return f'<Event><System><Provider Name="{windows.P}{provider}"/><EventID Qualifiers="0">{number}</EventID><TimeCreated SystemTime="2024-01-02T03:04:05.1Z"/><Computer>{computer}</Computer><Security UserID="S-1-5-21"/></System><EventData>{items}</EventData><UserData>{user_data}</UserData></Event>'


def test_windows_xml(spark):
    xml = [
        event("Security-Auditing", 4624, [("TargetUserName", "a&amp;b"), ("LogonType", "3"), ("IpAddress", "::ffff:10.0.0.9"), ("WorkstationName", "WS")]),
        event("Security-Auditing", 4625, [("TargetUserName", "u"), ("SubStatus", "0xC000006A")]),
        event("Security-Auditing", 1102, [("x", "y")]),
        event("SMBClient", 31001, [("UserName", "u"), ("ServerName", "FS"), ("ShareName", "\\\\FS\\c$")]),
        event("TerminalServices-LocalSessionManager", 21, "", "<EventXML><User>CORP\\joe</User><Address>10.1.1.1</Address></EventXML>"),
        event("WinRM", 6, [("connection", "http://target.corp:5985/wsman")]),
        event("WinRM", 6, [("connection", "localhost/wsman")]),
        event("WMI-Activity", 5858, "", "<Operation_ClientFailure><ClientMachine>OTHER</ClientMachine><User>CORP\\eve</User><Operation>Exec</Operation></Operation_ClientFailure>"),
        event("WMI-Activity", 5858, "", "<Operation_ClientFailure><ClientMachine>HOST</ClientMachine><User>CORP\\eve</User></Operation_ClientFailure>"),
    ]
    got = windows.to_timeline(windows.from_xml(lines(spark, xml, "xml")), "x.evtx").collect()
    assert [(r.event_id, r.event_type, r.dst_computer, r.target_user_name, r.src_computer, r.src_ip) for r in got] == [
        ("4624", "SUCCESSFUL_LOGON", "HOST.corp", "a&b", "WS", "10.0.0.9"),
        ("4625", "FAILED_LOGON", "HOST.corp", "u", "", ""),
        ("31001", "FAILED_LOGON", "FS", "u", "HOST.corp", ""),
        ("21", "SUCCESSFUL_LOGON", "HOST.corp", "joe", "", "10.1.1.1"),
        ("6", "CONNECT", "target.corp", "", "HOST.corp", ""),
        ("5858", "CONNECT", "HOST.corp", "eve", "OTHER", ""),
    ]
    assert got[1].detail == "Wrong password (0xC000006A)"


def test_winlogbeat(spark):
    good = '{"@timestamp":"2024-01-02T03:04:05.000Z","agent":{"type":"winlogbeat"},"event":{},"host":{"name":"H"},"winlog":{"provider_name":"Microsoft-Windows-Security-Auditing","event_id":4648,"event_data":{"TargetUserName":"u","IpAddress":"10.0.0.1"}}}'
    df = lines(spark, [good, "no json", good.replace("4648", '"x"')], "value")
    got = windows.to_timeline(windows.from_winlogbeat(df), "f").collect()
    assert [(r.event_id, r.logon_type, r.target_user_name, r.dst_computer) for r in got] == [("4648", "3", "u", "H")]
    assert windows.is_winlogbeat(df).count() == 1


def test_linux_text(spark):
    text = [
        "Mar  7 10:11:12 web sshd[1]: Accepted publickey for joe from 10.0.0.1 port 2 ssh2",
        "Mar  7 10:11:13 web sshd[1]: Failed password for invalid user x from 10.0.0.2 port 2",
        "Mar  7 10:11:14 web sshd[1]: Failed password for root from 10.0.0.3 port 2",
        "Mar  7 10:11:15 web sshd[1]: Accepted password for joe from :0 port 2",
        "<34>1 2024-03-07T10:11:16Z web sshd 1 - - Accepted password for amy from 10.0.0.4 port 2",
    ]
    got = linux.syslog(lines(spark, text), year=2024, file="auth.log").orderBy("time_created").collect()
    assert [(r.time_created, r.event_id, r.target_user_name, r.src_ip) for r in got] == [
        ("2024-03-07T10:11:12+00:00", "SSH_SUCCESS", "joe", "10.0.0.1"),
        ("2024-03-07T10:11:14+00:00", "SSH_FAILED", "root", "10.0.0.3"),
        ("2024-03-07T10:11:16Z", "SSH_SUCCESS", "amy", "10.0.0.4"),
    ]
    audit = ["type=USER_LOGIN msg=audit(1704067200.123:7): pid=1 acct=\"joe\" addr=10.0.0.1 res=success", "type=SYSCALL msg=audit(1.1:1): addr=10.0.0.1", "type=USER_AUTH msg=audit(1704067201.9:8): UID=\"eve\" addr=? res=failed"]
    assert [(r.time_created, r.event_type, r.target_user_name) for r in linux.audit(lines(spark, audit)).collect()] == [("2024-01-01T00:00:00+00:00", "SUCCESSFUL_LOGON", "joe")]


def test_login_records(spark):
    make = lambda kind, user, host, addr=0: struct.pack("<hxxi32s4s32s256shhiii4I20x", kind, 1, b"pts/0", b"0", user, host, 0, 0, 0, 1704067200, 0, addr, 0, 0, 0)
    data = make(7, b"joe", b"10.0.0.1") + make(9, b"x", b"10.0.0.1") + make(7, b"amy", b"", struct.unpack("<I", bytes([10, 0, 0, 2]))[0]) + make(7, b"bob", b":0")
    df = spark.createDataFrame([("file:/x/wtmp", bytearray(data)), ("file:/x/btmp", bytearray(make(7, b"eve", b"")))], "path string, content binary")
    got = sorted((r.target_user_name, r.event_type, r.src_ip) for r in linux.utmp(df).collect())
    assert got == [("amy", "SUCCESSFUL_LOGON", "10.0.0.2"), ("eve", "FAILED_LOGON", ""), ("joe", "SUCCESSFUL_LOGON", "10.0.0.1")]


def test_login_records_of_many_files_are_few_batches():
    record = struct.pack("<hxxi32s4s32s256shhiii4I20x", 7, 1, b"pts/0", b"0", b"joe", b"10.0.0.1", 0, 0, 0, 1704067200, 0, 0, 0, 0, 0)
    sizes = [1] * 700 + [0, linux.ROWS + 5]
    made = pa.RecordBatch.from_arrays([pa.array([f"/h/{k}/wtmp" for k in range(len(sizes) + 1)]), pa.array([record * n for n in sizes] + [None], pa.binary())], names=["path", "content"])
    got = list(linux.login_rows(iter([made])))
    assert [b.num_rows for b in got] == [linux.ROWS, 705]
    assert {tuple(r.values()) for b in got for r in b.to_pylist()} == {("2024-01-01T00:00:00+00:00", "joe", "10.0.0.1", "pts/0", "LOGIN", "wtmp")}


def test_rules(spark):
    rule = {
        "prefilter": {"contains_any": ["VPN"]},
        "parsers": [
            {"name": "re", "match": {"contains_any": ["in", "on"]}, "extract": {"regex": r"(?P<when>\d+) VPN (?P<who>\w+)(?: at (?P<where>\w+))?$"}, "map": {"time_created": "${when}", "target_user_name": "${who}", "computer": "${where}${nothing}", "detail": "fixed ${open"}},
            {"name": "sub", "match": {"regex": "^CSV"}, "extract": {"csv": {"delimiter": ",", "quote": '"', "columns": {1: "body"}}}, "sub_extract": {"field": "body", "strip_before": "msg: ", "keyvalue": {"pair_sep": ";", "kv_sep": "="}}, "map": {"target_user_name": "${user}", "ip_address": "${ip}", "filename": "f"}},
        ],
    }
    text = ["7 VPN inga", "8 VPN jon at HQ", "in 9 VPN", 'CSV VPN,"x, msg: user=""amy"";ip=\'10.0.0.1\';user=zoe"', "7 in", "VPN nothing"]
    df = lines(spark, text)
    got = custom_rules.parse(df, custom_rules.load([rule]), carry=["line"]).collect()
    assert [(r.parser, r.time_created, r.target_user_name, r.dst_computer, r.src_ip) for r in got] == [("re", "7", "inga", "", ""), ("re", "8", "jon", "HQ", ""), ("sub", "", "zoe", "", "10.0.0.1")]
    assert got[0].detail == "fixed ${open"
    assert {r.line for r in custom_rules.rejected(df, [rule]).collect()} == {text[2], text[4], text[5]}
    with pytest.raises(ValueError):
        custom_rules.load([{"prefilter": {}, "oops": 1}])


def test_archives_tasks_and_csv(spark, tmp_path):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/auth.log", "x")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("secure", "y")
        z.writestr("other.txt", "z")
    df = spark.createDataFrame([("a.zip", bytearray(outer.getvalue())), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    got = {r.path: bytes(r.content) for r in files.expand_archives(df, files.LINUX_NAMES).collect()}
    assert got == {"a.zip -> in.zip -> deep/auth.log": b"x", "a.zip -> secure": b"y"}
    xml = "<Task><Author>CORP\\eve</Author><Date>2024-01-01T00:00:00</Date><URI>\\x</URI><Command>c</Command><UserId>u</UserId></Task>"
    df = spark.createDataFrame([("d/t1", bytearray(b"\xff\xfe" + xml.encode("utf-16-le"))), ("d/t2", bytearray(xml.replace("CORP\\eve", "SYSTEM").encode()))], "path string, content binary")
    assert [(r.time_created, r.src_computer, r.log_filename) for r in files.tasks(df, "H").collect()] == [("2024-01-01T00:00:00Z", "CORP", "t1")]
    row = {c: "" for c in TIMELINE} | {"time_created": "2024-01-01T00:00:00Z", "detail": 'a, "b"'}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in TIMELINE))
    files.write_timeline(df, str(tmp_path / "t"))
    assert files.read_timeline(spark, str(tmp_path / "t")).collect() == df.collect() == files.read_written(spark, str(tmp_path / "t")).collect()
    files.write_timeline(df.limit(0), str(tmp_path / "e"))
    assert files.read_timeline(spark, str(tmp_path / "e")).count() == 0


def test_edr_and_mounts(spark):
    df = spark.createDataFrame([("1704067200000", "AG", "10.0.0.1", "3389", "10.0.0.2", "5000", "C\\u", "x,y"), ("t", "AG", "10.0.0.1", "5000", "10.0.0.3", "445", "u", None)], ", ".join(f"{c} string" for c in edr.NETWORK_FIELDS))
    assert [(r.dst_computer, r.src_ip, r.logon_type, r.detail) for r in edr.network(df).collect()] == [("AG", "10.0.0.2", "10", "x;y"), ("10.0.0.3", "10.0.0.1", "3", "")]
    assert {r.bucket: r.n for r in edr.by_port(df).collect()} == {"RDP": 1, "SMB": 1}
    keys = spark.createDataFrame([("u", "##FS#share", "133485408000000000"), ("u", "C", "1"), ("u", "##X#y", "0")], "user string, key string, last_write string")
    assert [(r.dst_computer, r.detail) for r in files.mount_points(keys).collect()] == [("FS", "\\\\FS\\share")]
    assert F is not None


def machine(line, delimiter=",", quote='"'):
    """Fields by a state machine, as a quoted CSV line is read."""
    out, field, inside, k = [], "", False, 0
    while k < len(line):
        c = line[k]
        if c == quote:
            if inside and line[k + 1 : k + 2] == quote:
                field, k = field + quote, k + 1
            else:
                inside = not inside
        elif c == delimiter and not inside:
            out.append(field.strip(" "))
            field = ""
        else:
            field += c
        k += 1
    return [*out, field.strip(" ")]


def test_csv_fields_equal_a_state_machine(spark):
    import itertools
    import time

    values = ["".join(x) for n in range(7) for x in itertools.product('a,"', repeat=n)]
    df = lines(spark, values).select("line", custom_rules.csv_fields(F.col("line"), ",", '"').alias("f"))
    assert all(r.f == machine(r.line) for r in df.collect())
    began = time.perf_counter()
    long = lines(spark, ['"a",' * 2_500_000, "x" * 10_000_000, '"' + "a," * 5_000_000, '""' * 4_000_000])
    sizes = [r[0] for r in long.select(F.size(custom_rules.csv_fields(F.col("line"), ",", '"'))).collect()]
    assert sizes == [2_500_001, 1, 1, 1]
    assert [r[0] for r in long.select(F.size(files.split_csv(F.col("line")))).collect()] == sizes
    assert time.perf_counter() - began < 90


def test_last_value_of_a_key_wins_in_long_lines(spark):
    text = " ".join(f"k{n % 1000}={n}" for n in range(100_000))
    got = lines(spark, [text, "a=1 b=2 a= b", ""]).select(custom_rules.key_values(F.col("line")).alias("m")).collect()
    assert got[0].m == {f"k{n}": str(99_000 + n) for n in range(1000)}
    assert got[1].m == {"a": "", "b": "2"} and got[2].m == {}
