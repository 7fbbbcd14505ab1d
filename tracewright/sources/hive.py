"""Registry hives: the keys below a path with the time each was last written."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Where cells begin, how much a list holds as written here, and the key that lists mounted shares.
BASE = 4096
LEAVES, LISTS = 1000, 60_000  # keys of a list and lists of a list of lists; both are counted in two bytes
MOUNT_POINTS = ("Software", "Microsoft", "Windows", "CurrentVersion", "Explorer", "MountPoints2")


class Hive:
    """Keys of a hive by the offsets of their cells.  Damaged cells are a ValueError."""

    def __init__(self, data: bytes):
        if data[:4] != b"regf":
            raise ValueError("not a hive")
        self.data = data

    def cell(self, offset: int, mark: tuple[bytes, ...]) -> int:
        at = BASE + offset + 4
        if self.data[at : at + 2] not in mark:
            raise ValueError("another cell than expected")
        return at

    def root(self) -> int:
        return struct.unpack_from("<I", self.data, 36)[0]

    def name(self, key: int) -> str:
        at = self.cell(key, (b"nk",))
        size = struct.unpack_from("<H", self.data, at + 72)[0]
        raw = self.data[at + 76 : at + 76 + size]
        return raw.decode("latin-1") if struct.unpack_from("<H", self.data, at + 2)[0] & 0x20 else raw.decode("utf-16-le", "replace")

    def written(self, key: int) -> int:
        return struct.unpack_from("<Q", self.data, self.cell(key, (b"nk",)) + 4)[0]

    def subkeys(self, key: int) -> Iterator[int]:
        at = self.cell(key, (b"nk",))
        count, where = struct.unpack_from("<I", self.data, at + 20)[0], struct.unpack_from("<I", self.data, at + 28)[0]
        if count:
            yield from self._listed(where, 0)

    def _listed(self, offset: int, depth: int) -> Iterator[int]:
        at = self.cell(offset, (b"lf", b"lh", b"li", b"ri"))
        kind, count = self.data[at : at + 2], struct.unpack_from("<H", self.data, at + 2)[0]
        step = 8 if kind in (b"lf", b"lh") else 4
        for k in range(count):
            one = struct.unpack_from("<I", self.data, at + 4 + step * k)[0]
            if kind != b"ri":
                yield one
            elif depth < 4:
                yield from self._listed(one, depth + 1)

    def below(self, path: tuple[str, ...]) -> Iterator[tuple[str, int]]:
        """(name, last written as FILETIME) of the keys below a path, names compared without case; none where it lacks."""
        key = self.root()
        for part in path:
            key = next((k for k in self.subkeys(key) if self.name(k).lower() == part.lower()), None)
            if key is None:
                return
        for k in self.subkeys(key):
            yield self.name(k), self.written(k)


def keys(files: DataFrame, path: tuple[str, ...] = MOUNT_POINTS) -> DataFrame:
    """(user, key, last_write) of the keys below ``path`` in hives as the binaryFile source reads them (path,
    content).  The user is the folder a hive lies in; files that are no hives give no rows, damaged ones those before the damage."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, content in zip(frame["path"], frame["content"], strict=True):
                user = file.replace("\\", "/").split("/")[-2] if "/" in file.replace("\\", "/") else ""
                try:
                    rows += [(user, name, str(ticks)) for name, ticks in Hive(bytes(content or b"")).below(path)]
                except (ValueError, struct.error, IndexError, UnicodeDecodeError):
                    continue
            yield pd.DataFrame(rows, columns=["user", "key", "last_write"])

    return files.select("path", "content").mapInPandas(run, "user string, key string, last_write string")


def write(found: list[tuple[str, int]], path: tuple[str, ...] = MOUNT_POINTS) -> bytes:
    """A hive that holds the keys below ``path``; for fixtures and round trips."""
    data = bytearray(32)

    def add(raw: bytes) -> int:
        at = len(data)
        size = -(-(len(raw) + 4) // 8) * 8
        data.extend(struct.pack("<i", -size) + raw.ljust(size - 4, b"\0"))
        return at

    def cut(found: list[int], size: int) -> list[list[int]]:
        return [found[k : k + size] for k in range(0, len(found), size)]

    def key(name: str, ticks: int, children: list[int]) -> int:
        listed = 0xFFFFFFFF
        if len(children) > 2:  # lists of lists, in as many levels as it takes
            size = LEAVES if len(children) > LEAVES else 1
            parts = [add(struct.pack(f"<2sH{len(own)}I", b"li", len(own), *own)) for own in cut(children, size)]
            while len(parts) > LISTS:
                parts = [add(struct.pack(f"<2sH{len(own)}I", b"ri", len(own), *own)) for own in cut(parts, LISTS)]
            listed = add(struct.pack(f"<2sH{len(parts)}I", b"ri", len(parts), *parts))
        elif children:
            listed = add(struct.pack("<2sH", b"lh", len(children)) + b"".join(struct.pack("<II", c, 0) for c in children))
        plain = name.isascii()
        raw = name.encode("latin-1" if plain else "utf-16-le")
        return add(struct.pack("<2sHQIIIIII32sIHH", b"nk", 0x20 if plain else 0, ticks, 0, 0, len(children), 0, listed, 0xFFFFFFFF, bytes(32), 0, len(raw), 0) + raw)

    at = [key(name, ticks, []) for name, ticks in found]
    for part in reversed(("root", *path)):
        at = [key(part, 1, at)]
    head = b"regf" + bytes(32) + struct.pack("<I", at[0])
    return head.ljust(BASE, b"\0") + bytes(data)
