"""Binary Windows event logs: chunks found in files or raw bytes, and their records as XML text.

A log is a header and chunks of 64 KB, each complete in itself, so every chunk is a row of its own
and is decoded where it lies.  Chunks are looked for at every multiple of 512 bytes, which finds
those of a log file as well as those left on a disk.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
CHUNK, SECTOR, FIRST_RECORD, FILE_HEADER = 65536, 512, 512, 4096
CHUNK_MAGIC, RECORD_MAGIC, FILE_MAGIC = b"ElfChnk\0", b"**\0\0", b"ElfFile\0"
_INTS = {3: "<b", 4: "<B", 5: "<h", 6: "<H", 7: "<i", 8: "<I", 9: "<q", 10: "<Q", 11: "<f", 12: "<d"}
_ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
_BAD = (struct.error, IndexError, ValueError, KeyError, RecursionError, OverflowError)


def u16(data: bytes, at: int) -> int:
    return struct.unpack_from("<H", data, at)[0]


def u32(data: bytes, at: int) -> int:
    return struct.unpack_from("<I", data, at)[0]


def chunk_ok(chunk: bytes) -> bool:
    """Whether both checksums of a chunk hold: that of its header and that of its records."""
    if len(chunk) < CHUNK or chunk[:8] != CHUNK_MAGIC:
        return False
    end = u32(chunk, 48)
    header = zlib.crc32(chunk[128:512], zlib.crc32(chunk[:120]))
    return FIRST_RECORD <= end <= CHUNK and header == u32(chunk, 124) and zlib.crc32(chunk[FIRST_RECORD:end]) == u32(chunk, 52)


def record_at(data: bytes, at: int, end: int) -> int:
    """Length of the record that starts here, 0 if none does: its length stands at both of its ends."""
    if data[at : at + 4] != RECORD_MAGIC or at + 28 > end:
        return 0
    size = u32(data, at + 4)
    return size if 28 <= size <= min(CHUNK, end - at) and u32(data, at + size - 4) == size else 0


def carved(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the chunks in raw bytes, at sector bounds, none inside another."""
    at, free = data.find(CHUNK_MAGIC), 0
    while at >= 0:
        if at % SECTOR == 0 and at >= free and len(data) - at >= CHUNK:
            yield at, data[at : at + CHUNK]
            free = at + CHUNK
        at = data.find(CHUNK_MAGIC, at + 1)


def orphans(data: bytes) -> int:
    """Records at multiples of 8 bytes outside every chunk."""
    taken = [at for at, _ in carved(data)]
    n, at, k = 0, data.find(RECORD_MAGIC), 0
    while at >= 0:
        while k < len(taken) and taken[k] + CHUNK <= at:
            k += 1
        if at % 8 == 0 and not (k < len(taken) and taken[k] <= at) and record_at(data, at, len(data)):
            n += 1
        at = data.find(RECORD_MAGIC, at + 1)
    return n


class Decoder:
    """Records of one chunk.  Names and templates are stored once a chunk and referred to by offset."""

    def __init__(self, chunk: bytes):
        self.data = chunk

    def records(self) -> Iterator[tuple[int, str]]:
        """(record id, XML); records that do not decode are left out."""
        end, at = min(max(u32(self.data, 48), FIRST_RECORD), CHUNK), FIRST_RECORD
        while size := record_at(self.data, at, end):
            try:
                yield struct.unpack_from("<Q", self.data, at + 8)[0], self.content(at + 24, [])[0]
            except _BAD:
                pass
            at += size

    def name(self, at: int) -> tuple[str, int]:
        """The name an offset field refers to, and where reading goes on: behind the name if it stands here."""
        where, after = u32(self.data, at), at + 4
        n = u16(self.data, where + 6)
        text = self.data[where + 8 : where + 8 + 2 * n].decode("utf-16-le")
        return text, where + 10 + 2 * n if where == after else after

    def content(self, at: int, values: list[tuple[int, int, int]], quote: bool = False) -> tuple[str, int]:
        """Text of the nodes from here to one that ends them; the place of that one."""
        out: list[str] = []
        while True:
            token = self.data[at] & 0xBF
            if token == 0x0F:
                at += 4
            elif token == 0x01:
                text, at = self.element(at, values)
                out.append(text)
            elif token == 0x0C:
                text, at = self.template(at)
                out.append(text)
            elif token in (0x05, 0x07):
                start = at + (2 if token == 0x05 else 1)
                n = u16(self.data, start)
                out.append(escape(self.data[start + 2 : start + 2 + 2 * n].decode("utf-16-le", "replace")))
                at = start + 2 + 2 * n
            elif token in (0x0D, 0x0E):
                number = u16(self.data, at + 1)
                out.append(self.value(*values[number]) if number < len(values) else "")
                at += 4
            elif token == 0x08:
                out.append(escape(chr(u16(self.data, at + 1))))
                at += 3
            elif token == 0x09:
                name, at = self.name(at + 1)
                out.append(escape(_ENTITIES.get(name, "")))
            elif token == 0x0A:
                _, at = self.name(at + 1)
            elif token == 0x0B:
                at += 3 + 2 * u16(self.data, at + 1)
            else:
                return "".join(out), at

    def element(self, at: int, values: list) -> tuple[str, int]:
        attributes = self.data[at] & 0x40
        tag, at = self.name(at + 7)
        head = [tag]
        if attributes:
            at += 4
            while self.data[at] & 0xBF == 0x06:
                key, at = self.name(at + 1)
                text, at = self.content(at, values)
                head.append(f'{key}="{text.replace(chr(34), "&quot;")}"')
        if self.data[at] == 0x03:
            return f"<{' '.join(head)}/>", at + 1
        if self.data[at] != 0x02:
            raise ValueError("an element's head does not end")
        inside, at = self.content(at + 1, values)
        return f"<{' '.join(head)}>{inside}</{tag}>", at + (self.data[at] == 0x04)

    def template(self, at: int) -> tuple[str, int]:
        where, at = u32(self.data, at + 6), at + 10
        if where == at:  # defined here
            at += 24 + u32(self.data, at + 20)
        n, at = u32(self.data, at), at + 4
        if n > CHUNK // 4:
            raise ValueError("too many values")
        values, place = [], at + 4 * n
        for k in range(n):
            size, kind = u16(self.data, at + 4 * k), self.data[at + 4 * k + 2]
            values.append((kind, place, size))
            place += size
        return self.content(where + 24, values)[0], place

    def value(self, kind: int, at: int, size: int) -> str:
        raw = self.data[at : at + size]
        if kind == 0x21:
            return self.content(at, [])[0] if size else ""
        if kind in _INTS:
            return str(struct.unpack_from(_INTS[kind], raw)[0])
        if kind & 0x7F == 0x01:
            return escape(" ".join(x for x in raw.decode("utf-16-le", "replace").split("\0") if x) if kind & 0x80 else raw.decode("utf-16-le", "replace").rstrip("\0"))
        if kind == 0x02:
            return escape(raw.decode("cp1252", "replace").rstrip("\0"))
        if kind == 0x0D:
            return "true" if any(raw) else "false"
        if kind == 0x0E:
            return raw.hex().upper()
        if kind == 0x0F:
            return "{" + str(uuid.UUID(bytes_le=raw)).upper() + "}"
        if kind == 0x11:
            return (datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=struct.unpack("<Q", raw)[0] // 10)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        if kind == 0x12:
            y, mo, _, d, h, mi, s, ms = struct.unpack("<8H", raw)
            return f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}.{ms:03d}Z"
        if kind == 0x13:
            parts = struct.unpack_from(f"<{raw[1]}I", raw, 8)
            return "-".join(["S", str(raw[0]), str(int.from_bytes(raw[2:8], "big")), *map(str, parts)])
        if kind in (0x10, 0x14, 0x15):
            return f"0x{int.from_bytes(raw, 'little'):x}"
        return ""


def chunks(files: DataFrame) -> DataFrame:
    """(path, offset, chunk, whole) of the chunks in files as the binaryFile source reads them (path,
    content); ``whole``: its checksums hold.  Files without any give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for at, chunk in carved(bytes(content or b"")):
                    yield pd.DataFrame({"path": [path], "offset": [at], "chunk": [chunk], "whole": [chunk_ok(chunk)]})

    return files.select("path", "content").mapInPandas(run, "path string, offset long, chunk binary, whole boolean")


def records(found: DataFrame) -> DataFrame:
    """(path, offset, record_id, xml) of the records of chunks.  A log file's size does not bound the tasks: its chunks are dealt out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, at, chunk in zip(frame["path"], frame["offset"], frame["chunk"], strict=True):
                rows = [(path, at, *r) for r in Decoder(bytes(chunk)).records()]
                yield pd.DataFrame(rows, columns=["path", "offset", "record_id", "xml"])

    return found.select("path", "offset", "chunk").repartition("path", "offset").mapInPandas(run, "path string, offset long, record_id long, xml string")


def orphan_counts(files: DataFrame) -> DataFrame:
    """(path, n): records outside chunks, of files that have any."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "n": [orphans(bytes(c or b"")) for c in frame["content"]]}, columns=["path", "n"])

    return files.select("path", "content").mapInPandas(run, "path string, n long").where("n > 0")


def by_provider(found: DataFrame) -> DataFrame:
    """(provider, chunks, records): chunks by the provider of their first record, as a carver groups them."""
    rows = records(found)
    first = rows.groupBy("path", "offset").agg(F.min_by(F.regexp_extract("xml", r"<Provider[^>]*Name=[\"']([^\"']*)", 1), "record_id").alias("provider"), F.count(F.lit(1)).alias("n"))
    return first.groupBy("provider").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("records"))


def log_file(found: list[bytes]) -> bytes:
    """Chunks as a log file of their own, with a header that fits them."""
    last = max((struct.unpack_from("<Q", c, 32)[0] for c in found), default=0)
    head = struct.pack("<8sQQQIHHHH76xI", FILE_MAGIC, 0, max(len(found) - 1, 0), last + 1, 128, 1, 3, FILE_HEADER, len(found), 0)
    return (head + struct.pack("<I", zlib.crc32(head[:120]))).ljust(FILE_HEADER, b"\0") + b"".join(found)


# -- writing ---------------------------------------------------------------------------------------
class Encoder:
    """A chunk of records that share one template, as the system writes them; for fixtures and round trips."""

    def __init__(self) -> None:
        self.data = bytearray(FIRST_RECORD)
        self.names: dict[str, int] = {}
        self.defined = 0
        self.first = self.last = None

    def _name(self, text: str) -> None:
        at = self.names.get(text)
        here = len(self.data) + 4
        self.data += struct.pack("<I", at or here)
        if not at:
            self.names[text] = here
            self.data += struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"

    def _open(self, tag: str, attributes: list[tuple[str, bytes]] = (), empty: bool = False) -> None:
        self.data += struct.pack("<BHI", 0x41 if attributes else 0x01, 0xFFFF, 0)
        self._name(tag)
        if attributes:
            self.data += struct.pack("<I", 0)
            for k, (key, value) in enumerate(attributes):
                self.data += b"\x46" if k + 1 < len(attributes) else b"\x06"
                self._name(key)
                self.data += value
        self.data += b"\x03" if empty else b"\x02"

    @staticmethod
    def text(value: str) -> bytes:
        raw = value.encode("utf-16-le")
        return struct.pack("<BBH", 0x05, 0x01, len(raw) // 2) + raw

    @staticmethod
    def slot(number: int, kind: int) -> bytes:
        return struct.pack("<BHB", 0x0D, number, kind)

    def add(self, number: int, ticks: int, provider: str, event_id: int, computer: str, data: list[tuple[str, str]]) -> bool:
        """Append a record; false, and nothing is changed, if the chunk is full."""
        kept = bytes(self.data), dict(self.names), self.defined
        at = len(self.data)
        self.data += RECORD_MAGIC + struct.pack("<IQQ", 0, number, ticks) + b"\x0f\x01\x01\0" + b"\x0c\x01" + struct.pack("<I", 7)
        here = len(self.data) + 4
        self.data += struct.pack("<I", self.defined or here)
        if not self.defined:
            self.defined = here
            self.data += bytes(20) + b"\0\0\0\0"
            start = len(self.data)
            self.data += b"\x0f\x01\x01\0"
            self._open("Event")
            self._open("System")
            self._open("Provider", [("Name", self.slot(0, 1))], empty=True)
            self._open("EventID")
            self.data += self.slot(1, 6) + b"\x04"
            self._open("TimeCreated", [("SystemTime", self.slot(2, 0x11))], empty=True)
            self._open("Computer")
            self.data += self.slot(3, 1) + b"\x04"
            self._open("Security", [("UserID", self.slot(4, 0x13))], empty=True)
            self.data += b"\x04"
            self.data += self.slot(5, 0x21) + b"\x04\0"
            struct.pack_into("<I", self.data, start - 4, len(self.data) - start)
        sid = struct.pack("<BB6s5I", 1, 5, (5).to_bytes(6, "big"), 21, 1, 2, 3, 1000)
        values = [(1, provider.encode("utf-16-le")), (6, struct.pack("<H", event_id)), (0x11, struct.pack("<Q", ticks)), (1, computer.encode("utf-16-le")), (0x13, sid)]
        self.data += struct.pack("<I", 6)
        sizes = len(self.data)
        self.data += b"".join(struct.pack("<HBB", len(v), k, 0) for k, v in values) + struct.pack("<HBB", 0, 0x21, 0) + b"".join(v for _, v in values)
        body = len(self.data)
        self.data += b"\x0f\x01\x01\0"
        self._open("EventData")
        for key, value in data:
            self._open("Data", [("Name", self.text(key))])
            self.data += self.text(value) + b"\x04"
        self.data += b"\x04\0"
        struct.pack_into("<H", self.data, sizes + 20, len(self.data) - body)
        self.data += bytes(-(len(self.data) - at + 4) % 8)
        size = len(self.data) - at + 4
        self.data += struct.pack("<I", size)
        if len(self.data) > CHUNK:
            self.data, self.names, self.defined = bytearray(kept[0]), kept[1], kept[2]
            return False
        struct.pack_into("<I", self.data, at + 4, size)
        self.first, self.last = number if self.first is None else self.first, number
        self.at = at
        return True

    def chunk(self) -> bytes:
        out, end = bytearray(self.data), len(self.data)
        first, last = self.first or 0, self.last or 0
        struct.pack_into("<8sQQQQIIII", out, 0, CHUNK_MAGIC, first, last, first, last, 128, getattr(self, "at", FIRST_RECORD), end, zlib.crc32(bytes(out[FIRST_RECORD:end])))
        struct.pack_into("<I", out, 124, zlib.crc32(bytes(out[128:512]), zlib.crc32(bytes(out[:120]))))
        return bytes(out).ljust(CHUNK, b"\0")


def encode(rows: Iterator[tuple]) -> list[bytes]:
    """Chunks of records as ``Encoder.add`` takes them."""
    out, held = [], Encoder()
    for r in rows:
        if not held.add(*r):
            out.append(held.chunk())
            held = Encoder()
            if not held.add(*r):
                raise ValueError("a record is larger than a chunk")
    return out + [held.chunk()] if held.first is not None else out
