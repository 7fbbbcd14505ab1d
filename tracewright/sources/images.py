"""Disk images: partition tables, volume signatures and virtual disks.

Images come as the binaryFile source reads them (path, content), so one must fit a row (2 GB); what
is read of them here is tables, signatures and grains at their places.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTOR = 512
# Partition types by identifier, signatures and their places.
GPT_NAMES = {
    "C12A7328-F81F-11D2-BA4B-00A0C93EC93B": "EFI System",
    "E3C9E316-0B5C-4DB8-817D-F92DF00215AE": "MS Reserved",
    "EBD0A0A2-B9E5-4433-87C0-68B6B72699C7": "Basic Data",
    "0FC63DAF-8483-4772-8E79-3D69D8477DE4": "Linux filesystem",
    "E6D6D379-F507-44C2-A23C-238F2A3DF928": "Linux LVM",
}
BASIC_DATA, LVM = "EBD0A0A2-B9E5-4433-87C0-68B6B72699C7", "E6D6D379-F507-44C2-A23C-238F2A3DF928"
MBR_NAMES = {0x05: "Extended", 0x07: "NTFS", 0x0B: "FAT32", 0x0C: "FAT32", 0x0F: "Extended", 0x82: "Linux swap", 0x83: "Linux", 0x8E: "Linux LVM", 0xEE: "GPT protective"}
NTFS, BITLOCKER, EXT = (3, b"NTFS    "), (3, b"-FVE-FS-"), (1024 + 56, b"\x53\xef")
GPT_ENTRIES = 128


@dataclass
class Entry:
    scheme: str  # gpt or mbr
    kind: str  # type identifier, or type number as two hex digits
    start: int  # bytes

    @property
    def name(self) -> str:
        return GPT_NAMES.get(self.kind, "Unknown GPT type") if self.scheme == "gpt" else MBR_NAMES.get(int(self.kind, 16), f"Type 0x{self.kind}")


def entries(image: bytes | memoryview) -> list[Entry]:
    """The used entries of the partition table; of an MBR the four primary ones.  None without a table."""
    if image[510:512] != b"\x55\xaa":
        return []
    if image[446 + 4] != 0xEE:
        rows = [(image[at + 4], struct.unpack_from("<I", image, at + 8)[0]) for at in range(446, 510, 16)]
        return [Entry("mbr", f"{kind:02X}", lba * SECTOR) for kind, lba in rows if kind and lba]
    if image[SECTOR : SECTOR + 8] != b"EFI PART" or len(image) < 2 * SECTOR:
        return []
    first, count, size = struct.unpack_from("<QII", image, SECTOR + 72)
    out = []
    for k in range(min(count, GPT_ENTRIES)):
        at = first * SECTOR + k * size
        raw = bytes(image[at : at + 48])
        if len(raw) == 48 and any(raw[:16]):
            out.append(Entry("gpt", str(uuid.UUID(bytes_le=raw[:16])).upper(), struct.unpack_from("<Q", raw, 32)[0] * SECTOR))
    return out


def signed(image: bytes | memoryview, start: int, signature: tuple[int, bytes]) -> bool:
    at, mark = signature
    return image[start + at : start + at + len(mark)] == mark


def volumes(image: bytes | memoryview, table: list[Entry] | None = None) -> list[tuple[str, int]]:
    """(kind, offset) of the volumes that can be read: ntfs, bitlocker, ext, lvm.

    GPT: a Basic Data entry is ntfs without a look at its signature (bitlocker with that one), others go by
    signature.  MBR: type 07 needs either signature, 83 is ext, 8E lvm.  An image without any such entry may
    itself be a volume.  ``table`` has the image's entries where they are known.
    """
    out = []
    for e in entries(image) if table is None else table:
        ntfs, locked, ext = (signed(image, e.start, x) for x in (NTFS, BITLOCKER, EXT))
        if e.scheme == "gpt":
            kind = "lvm" if e.kind == LVM else "bitlocker" if e.kind == BASIC_DATA and locked else "ntfs" if e.kind == BASIC_DATA or ntfs else "ext" if ext else ""
        else:
            kind = {"07": "bitlocker" if locked else "ntfs" if ntfs else "", "83": "ext", "8E": "lvm"}.get(e.kind, "")
        if kind:
            out.append((kind, e.start))
    if not out:
        out = [(kind, 0) for kind, mark in (("ntfs", NTFS), ("bitlocker", BITLOCKER), ("ext", EXT)) if signed(image, 0, mark)][:1]
    return out


def describe(image: bytes | memoryview, table: list[Entry] | None = None) -> str:
    """What the table holds, for the report of an image that was skipped."""
    return ", ".join(e.name for e in (entries(image) if table is None else table))


def partitions(files: DataFrame) -> DataFrame:
    """(path, kind, offset, description): a row a readable volume; one of kind '' for an image without any.

    Images are looked at where Arrow holds them, without a copy; a batch of images gives one batch of rows.
    """
    return files.select("path", "content").mapInArrow(partition_rows, "path string, kind string, offset long, description string")


def partition_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            image = memoryview(content.as_buffer() or b"").cast("B")
            table = entries(image)
            text = describe(image, table)
            rows += [(path, *x, text) for x in volumes(image, table) or [("", 0)]]
        columns = [pa.array([r[k] for r in rows], pa.int64() if k == 2 else pa.string()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "kind", "offset", "description"])


def skip_reasons(found: DataFrame) -> DataFrame:
    """(reason, n): why images gave nothing."""
    reason = F.when(F.col("kind") == "bitlocker", "encrypted volume").when(F.col("description") == "", "no partition table").otherwise(F.concat(F.lit("no supported volume: "), F.col("description")))
    return found.where(F.col("kind").isin("", "bitlocker")).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def image_filename(path: Column, root: str) -> Column:
    """Name of a file extracted below ``root`` as a log's name: <image>/<what follows>, with forward slashes; other paths stay."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.contains(flat, F.lit(f"{root}/")), F.regexp_extract(flat, re.escape(root) + "/(.*)$", 1)).otherwise(path)


# -- virtual disks ---------------------------------------------------------------------------------
SPARSE_MAGIC, MARKED, NO_DIRECTORY = b"KDMV", 0x10000, 0xFFFFFFFFFFFFFFFF
EXTENT = re.compile(r'^(?:RW|RDONLY|NOACCESS)\s+(\d+)\s+(\w+)(?:\s+"([^"]*)"(?:\s+(\d+))?)?', re.M)


class Sparse:
    """A sparse extent: grains found through a directory of tables; missing ones are zeros."""

    def __init__(self, data: bytes):
        if data[:4] != SPARSE_MAGIC:
            raise ValueError("not a sparse extent")
        self.data = data
        self.flags, self.sectors, self.grain = struct.unpack_from("<IQQ", data, 8)
        self.per_table = struct.unpack_from("<I", data, 44)[0]
        directory = struct.unpack_from("<Q", data, 56)[0]
        if directory == NO_DIRECTORY:  # written as a stream: the header is repeated in the last sectors
            foot = data.rfind(SPARSE_MAGIC, len(data) - 4 * SECTOR)
            if foot <= 0:
                raise ValueError("a streamed extent without its footer")
            directory = struct.unpack_from("<Q", data, foot + 56)[0]
        if not (self.grain and self.per_table):
            raise ValueError("a sparse extent without grains")
        tables = -(-self.sectors // (self.grain * self.per_table))
        self.tables = struct.unpack_from(f"<{tables}I", data, directory * SECTOR)

    def read_grain(self, number: int) -> bytes:
        size, (table, place) = self.grain * SECTOR, divmod(number, self.per_table)
        at = struct.unpack_from("<I", self.data, self.tables[table] * SECTOR + 4 * place)[0] if self.tables[table] else 0
        if at <= 1:  # 0: never written, 1: zeroed
            return bytes(size)
        at *= SECTOR
        if self.flags & MARKED:
            return zlib.decompress(self.data[at + 12 : at + 12 + struct.unpack_from("<I", self.data, at + 8)[0]]).ljust(size, b"\0")[:size]
        return self.data[at : at + size].ljust(size, b"\0")

    def read(self, at: int, size: int) -> bytes:
        unit = self.grain * SECTOR
        size = max(0, min(size, self.sectors * SECTOR - at))
        first = at // unit
        whole = b"".join(self.read_grain(k) for k in range(first, -(-(at + size) // unit)))
        return whole[at - first * unit : at - first * unit + size]


def open_disk(name: str, files: dict[str, bytes]) -> tuple[int, Callable[[int, int], bytes]]:
    """(bytes, read(at, size)) of a virtual disk: a sparse file, a descriptor that names extents, or a flat file.

    ``files`` has the files by name; an extent of unknown type or a file that lacks is a ValueError.
    """
    data = files[name]
    if data[:4] == SPARSE_MAGIC:
        one = Sparse(data)
        return one.sectors * SECTOR, one.read
    text = data[:65536].decode("utf-8", "replace")
    if "# Disk DescriptorFile" not in text:
        return len(data), lambda at, size: data[at : at + size]
    parts: list[tuple[int, int, Callable[[int, int], bytes]]] = []
    total = 0
    for sectors, kind, file, shift in EXTENT.findall(text):
        size = int(sectors) * SECTOR
        if kind == "ZERO":
            read = lambda at, n: bytes(n)
        else:
            held = files.get(file, files.get(file + ".filepart"))
            if held is None:
                raise ValueError(f"no extent {file}")
            if kind in ("FLAT", "VMFS"):
                read = lambda at, n, held=held, base=int(shift or 0) * SECTOR: held[base + at : base + at + n].ljust(n, b"\0")
            elif kind in ("SPARSE", "VMFSSPARSE"):
                read = Sparse(held).read
            else:
                raise ValueError(f"unknown extent type {kind}")
        parts.append((total, size, read))
        total += size
    if not parts:
        raise ValueError("a descriptor without extents")

    def read_all(at: int, size: int) -> bytes:
        out, end = b"", min(at + size, total)
        for start, length, read in parts:
            low, high = max(at, start), min(end, start + length)
            if low < high:
                out += read(low - start, high - low)
        return out

    return total, read_all


def virtual_disks(files: DataFrame) -> DataFrame:
    """(path, content): the disks behind the .vmdk files of each folder as flat bytes; those that cannot be
    opened are left out, as are files that another one names as its extent."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        held = {p.rsplit("/", 1)[-1]: bytes(c) for p, c in zip(frame["path"], frame["content"], strict=True)}
        named = {m[2] for c in held.values() if b"# Disk DescriptorFile" in c[:65536] and c[:4] != SPARSE_MAGIC for m in EXTENT.findall(c[:65536].decode("utf-8", "replace"))}
        rows = []
        for path in frame["path"]:
            name = path.rsplit("/", 1)[-1]
            if not name.lower().endswith(".vmdk") or name in named:
                continue
            try:
                size, read = open_disk(name, held)
                rows.append((path, read(0, size)))
            except (ValueError, struct.error, zlib.error, IndexError):
                continue
        return pd.DataFrame(rows, columns=["path", "content"])

    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files.select("path", "content", folder.alias("folder")).groupBy("folder").applyInPandas(run, "path string, content binary")


# -- writing, for fixtures and round trips ---------------------------------------------------------
def write_sparse(disk: bytes, grain: int = 8, compressed: bool = False) -> bytes:
    """A disk as a sparse extent; grains of zeros are not written.  Compressed ones as a stream with a footer."""
    size, per_table = grain * SECTOR, 512
    pieces = [disk[at : at + size].ljust(size, b"\0") for at in range(0, len(disk), size)]
    tables = -(-len(pieces) // per_table)
    out, places = bytearray(2 * SECTOR), []  # numbers 0 and 1 stand for grains that are not there
    for k, piece in enumerate(pieces):
        if not any(piece):
            places.append(0)
            continue
        places.append(len(out) // SECTOR)
        body = zlib.compress(piece) if compressed else piece
        out += (struct.pack("<QI", k * grain, len(body)) if compressed else b"") + body
        out += bytes(-len(out) % SECTOR)
    directory = []
    for t in range(tables):
        directory.append(len(out) // SECTOR)
        out += struct.pack(f"<{per_table}I", *(places[t * per_table :][:per_table] + [0] * max(0, (t + 1) * per_table - len(places))))
    at = len(out) // SECTOR
    out += struct.pack(f"<{tables}I", *directory)
    out += bytes(-len(out) % SECTOR)
    head = lambda where: struct.pack("<4sIIQQQQIQQQ", SPARSE_MAGIC, 3, 3 | (MARKED if compressed else 0), len(pieces) * grain, grain, 0, 0, per_table, 0, where, 1).ljust(SECTOR, b"\0")
    out[:SECTOR] = head(NO_DIRECTORY if compressed else at)
    return bytes(out) + (head(at) + bytes(SECTOR) if compressed else b"")
