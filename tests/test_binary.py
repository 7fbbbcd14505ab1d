"""Binary event logs and disk images against bytes made here."""

import random
import struct

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright import fixture, source_queries
from tracewright.sources import evtx, files, images, windows


def logs(n=400):
    return evtx.encode((k, 133485408000000000 + 10_000_000 * k, windows.P + ("Security-Auditing" if k % 9 else "WinRM"), 4624, "SRV", [("TargetUserName", f"u<{k}>&\"é"), ("IpAddress", "10.0.0.1"), ("Long", "x" * (k % 700))]) for k in range(1, n + 1))


def test_records_of_all_chunks():
    found = logs()
    assert len(found) > 2 and all(map(evtx.chunk_ok, found))
    rows = [r for c in found for r in evtx.Decoder(c).records()]
    assert [k for k, _ in rows] == list(range(1, 401))
    assert '<Provider Name="Microsoft-Windows-Security-Auditing"/>' in rows[0][1] and '<TimeCreated SystemTime="2024-01-01T00:00:01.000000Z"/>' in rows[0][1]
    assert '<Security UserID="S-1-5-21-1-2-3-1000"/>' in rows[0][1] and '<Data Name="TargetUserName">u&lt;1&gt;&amp;"é</Data>' in rows[0][1]


@pytest.mark.parametrize(
    ("kind", "raw", "text"),
    [
        (0, b"", ""), (1, "a&b\0".encode("utf-16-le"), "a&amp;b"), (2, b"ab\0", "ab"), (3, b"\xff", "-1"), (4, b"\xff", "255"), (6, b"\x01\x02", "513"), (7, b"\xfe\xff\xff\xff", "-2"), (10, b"\x01" + bytes(7), "1"), (0x0D, b"\1\0\0\0", "true"), (0x0E, b"\xab\x01", "AB01"),
        (0x0F, bytes(range(16)), "{03020100-0504-0706-0809-0A0B0C0D0E0F}"), (0x12, struct.pack("<8H", 2024, 2, 4, 29, 1, 2, 3, 4), "2024-02-29T01:02:03.004Z"), (0x13, bytes.fromhex("010100000000000512000000"), "S-1-5-18"), (0x14, b"\x10\0\0\0", "0x10"),
        (0x15, b"\xe7\x03" + bytes(6), "0x3e7"), (0x81, "a\0b\0".encode("utf-16-le"), "a b"),
    ],
)
def test_value_kinds(kind, raw, text):
    assert evtx.Decoder(raw + bytes(8)).value(kind, 0, len(raw)) == text


def test_damage_is_found_and_survived():
    rng, whole = random.Random(5), logs(300)[0]
    for _ in range(300):
        bad = bytearray(whole)
        for _ in range(rng.randint(1, 20)):
            bad[rng.randrange(512, evtx.u32(whole, 48))] ^= rng.randint(1, 255)
        assert not evtx.chunk_ok(bytes(bad))
        list(evtx.Decoder(bytes(bad)).records())
    assert not evtx.chunk_ok(whole[:-1]) and not evtx.chunk_ok(bytes(65536))


def test_carving_and_log_files(spark):
    found = logs()
    raw = b"x" * 512 + found[0] + bytes(100) + found[1] + bytes(412) + found[2][512 : evtx.u32(found[2], 48)] + evtx.CHUNK_MAGIC
    assert [at for at, _ in evtx.carved(raw)] == [512]  # the second lies at no sector bound
    whole = evtx.log_file(found)
    assert [at for at, _ in evtx.carved(whole)] == [4096 + 65536 * k for k in range(len(found))]
    assert evtx.orphans(whole) == 0 and evtx.orphans(bytes(8) + found[2][512 : evtx.u32(found[2], 48)]) == len(list(evtx.Decoder(found[2]).records()))
    df = spark.createDataFrame(pd.DataFrame({"path": ["a", "b", "c"], "content": [whole, b"", b"none"]}), "path string, content binary")
    chunks = evtx.chunks(df)
    assert chunks.count() == len(found)
    got = {r.provider: r.records for r in evtx.by_provider(chunks).collect()}
    assert sum(got.values()) == 400 and set(got) <= {windows.P + "Security-Auditing", windows.P + "WinRM"}
    assert evtx.orphan_counts(df).count() == 0


def test_volumes():
    assert [images.volumes(fixture.image(k)) for k in range(7)] == [[("ntfs", 4096)], [("bitlocker", 4096)], [("ext", 4096)], [("ntfs", 4096)], [("lvm", 4096)], [("ntfs", 0)], []]
    assert images.describe(fixture.image(3)) == "Basic Data, EFI System"
    for cut in (0, 1, 511, 512, 600, 1030):
        images.volumes(fixture.image(3)[:cut])


def test_virtual_disks():
    rng = random.Random(9)
    for size in (4096, 3 * 4096, 2_500_000):
        disk = bytes(size) if size == 4096 else bytearray(rng.randbytes(size))
        disk = bytes(disk[: size // 3]) + bytes(size // 3) + bytes(disk[2 * (size // 3) :])
        for packed in (False, True):
            total, read = images.open_disk("a", {"a": images.write_sparse(disk, compressed=packed)})
            assert total >= size and read(0, size) == disk
            for _ in range(20):
                at = rng.randrange(size)
                assert read(at, 5000) == (disk + bytes(total - size))[at : at + 5000]
    held = {"d": b'# Disk DescriptorFile\nRW 1 FLAT "f" 1\nRW 2 ZERO\n', "f.filepart": bytes(512) + b"y" * 512}
    total, read = images.open_disk("d", held)
    assert total == 1536 and read(500, 100) == b"y" * 12 + bytes(88)
    for bad in (b"# Disk DescriptorFile\n", b'# Disk DescriptorFile\nRW 1 ODD "f.filepart"', b'# Disk DescriptorFile\nRW 1 FLAT "none"', b"KDMV" + bytes(600)):
        with pytest.raises(ValueError):
            images.open_disk("x", held | {"x": bad})


def test_clean_path():
    assert [files.clean_path(x) for x in (' "C:\\a b\\" ', "'/x/'", "/", "a")] == ["C:\\a b", "/x", "/", "a"]


def test_hives():
    from tracewright.sources import hive

    for found in ([], [("##a#b", 5)], [("##é#ü", 1 << 60), ("C", 2)], [(f"k{k}", k) for k in range(50)]):
        assert list(hive.Hive(hive.write(found)).below(hive.MOUNT_POINTS)) == found
    assert list(hive.Hive(hive.write([("x", 1)], ("Software",))).below(hive.MOUNT_POINTS)) == []
    with pytest.raises(ValueError):
        hive.Hive(b"none")


def test_hives_of_many_keys(monkeypatch):
    from tracewright.sources import hive

    found = [(f"##FS{k}#share", k) for k in range(70_000)]  # more than two bytes count
    assert list(hive.Hive(hive.write(found)).below(hive.MOUNT_POINTS)) == found
    monkeypatch.setattr(hive, "LEAVES", 3)
    monkeypatch.setattr(hive, "LISTS", 4)
    assert list(hive.Hive(hive.write(found[:100])).below(hive.MOUNT_POINTS)) == found[:100]


def test_partitions_of_a_batch_are_a_batch():
    names, made = [f"i{k}" for k in range(700)], [fixture.image(k % 7) for k in range(699)] + [None]
    got = list(images.partition_rows(iter([pa.RecordBatch.from_arrays([pa.array(names), pa.array(made, pa.binary())], names=["path", "content"])])))
    assert len(got) == 1 and got[0].column("path").to_pylist() == names
    want = [((images.volumes(x or b"") or [("", 0)])[0], images.describe(x or b"")) for x in made]
    assert [((r["kind"], r["offset"]), r["description"]) for r in got[0].to_pylist()] == want


def test_skip_reasons_of_many_images(spark):
    """Images of every kind, made without Python; their number is that of the rows."""
    rows = spark.range(0, 7000, 1, 2).select(F.concat(F.lit("i"), "id").alias("path"), source_queries.pick(F.col("id"), [F.lit(fixture.image(k)) for k in range(7)]).alias("content"))
    assert {tuple(r) for r in images.skip_reasons(images.partitions(rows)).collect()} == {("encrypted volume", 1000), ("no partition table", 1000)}
    made = source_queries._images(spark, "/root/testdata/sf0.001")
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString() and "InPandas" not in made._jdf.queryExecution().executedPlan().toString()


def test_discovery(spark, tmp_path):
    names = ["a/Current.mdb", "b/Sum/x.mdb", "c/1/2/3/4/SystemIdentity.mdb", "c/1/2/3/4/5/Current.mdb", "a/other.mdb", "var/log/auth.log.1", "var/log/wtmp", "x/system.journal", "notes.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    strip = lambda df: sorted(r.path.split(str(tmp_path))[1][1:] for r in df.collect())
    assert strip(files.access_logging_files(spark, str(tmp_path))) == names[:3]
    assert strip(files.discover(spark, str(tmp_path), files.LINUX_NAMES)) == sorted(names[5:8])
