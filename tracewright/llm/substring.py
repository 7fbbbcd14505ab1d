"""Exact substring dedup with difference-cover anchors.

A window of ``LENGTH`` words that also starts elsewhere is a repeat.  Positions whose residue
modulo ``PERIOD`` lies in a difference cover are anchors: for any two positions i and j some
offset below PERIOD puts both i + offset and j + offset on the cover, so two equal windows of
LENGTH = PERIOD + ANCHOR - 1 words share at least one equal anchor of ANCHOR words at the same
offset.  Hence

1. only anchors are hashed and counted (5 of 21 positions),
2. every window that holds a repeated anchor is extended to its full length, hashed and
   counted, which settles exactly which windows repeat,
3. words covered by repeated windows are removed.

Documents are packed into batches that are written once, bucketed by batch.  A batch sends each
different hash once, however often it occurs inside, so one very common passage costs at most a
row a batch; counting is by hash, and what comes back to a batch is bounded by its own size.
Hashes are 64 bits of a polynomial over mixed word hashes; two different windows among n
collide with probability n^2 / 2^65 (1e-4 for the windows of a billion words).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import slices, with_id, words_of, written_table

LENGTH, PERIOD, ANCHOR = 35, 21, 15
COVER = (0, 1, 4, 14, 16)  # each residue modulo 21 is a difference of two of these
PACK_CHARS = 3_000_000
BLOCK_BYTES, GROUP_BYTES = 1 << 19, 1 << 17
_MULT = 0x9E3779B97F4A7C15 | 1
_ON_COVER = np.isin(np.arange(PERIOD), COVER)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(_MULT, size), _powers(pow(_MULT, -1, 1 << 64), size)
        return self.up, self.down


_POWERS = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(values: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def _hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _POWERS.get(len(prefix))
    return _mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 bytes; words are runs without ASCII white space."""
    return _word_hashes(raw)[0]


def word_hashes_each(raws: list[bytes]) -> list[np.ndarray]:
    """``word_hashes`` of each, made for GROUP_BYTES of them together: short texts cost little besides their bytes."""
    out: list[np.ndarray] = []
    ends = np.cumsum([len(x) + 1 for x in raws])
    at = 0
    while at < len(raws):
        low = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, low + GROUP_BYTES, "right")))
        found, starts = _word_hashes(b" ".join(raws[at:stop]))
        cuts = [0, *np.searchsorted(starts, ends[at:stop] - low).tolist()]
        out += [found[a:b] for a, b in zip(cuts, cuts[1:])]
        at = stop
    return out


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the byte at which it starts."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = []
    at = 0
    while at < len(starts):  # blocks of words keep the powers and sums small
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right")))
        low = starts[at]
        prefix = _prefix(data[low : ends[stop - 1]].astype(np.uint64) + np.uint64(1))
        out.append(_hashes(prefix, starts[at:stop] - low, ends[at:stop] - low))
        at = stop
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), starts


class Pack:
    """Word hashes of the documents of one batch, end to end."""

    def __init__(self, texts: list[str | None]):
        each = [word_hashes((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        self.lens = np.array([len(x) for x in each], np.int64)
        self.words = np.concatenate(each) if each else np.zeros(0, np.uint64)
        ends = np.cumsum(self.lens)
        self.starts = ends - self.lens
        at = np.arange(len(self.words))
        self.left = np.repeat(ends, self.lens) - at
        self.place = at - np.repeat(self.starts, self.lens)
        self.prefix = _prefix(self.words)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return _hashes(self.prefix, at, at + n)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the anchors of documents that hold a whole window."""
        long_enough = np.repeat(self.lens >= LENGTH, self.lens)
        at = np.flatnonzero(_ON_COVER[self.place % PERIOD] & (self.left >= ANCHOR) & long_enough)
        return at, self.hashes(at, ANCHOR)

    def windows(self, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the windows that hold an anchor repeated here or ``elsewhere``."""
        at, h = self.anchors()
        at = at[repeated(h, elsewhere)]
        edge = np.zeros(len(self.words) + 1, np.int64)
        low = np.maximum(at - (LENGTH - ANCHOR), at - self.place[at])
        np.add.at(edge, low, 1)
        np.add.at(edge, at + 1, -1)
        found = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & (self.left >= LENGTH))
        return found, self.hashes(found, LENGTH)

    def removed(self, anchors: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Mask of the words covered by repeated windows."""
        at, h = self.windows(anchors)
        at = at[repeated(h, windows)]
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + LENGTH, -1)
        return np.cumsum(edge)[:-1] > 0


def repeated(h: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
    """Which hashes occur twice in ``h`` or are among the ``elsewhere``."""
    if not len(h):
        return np.zeros(0, bool)
    kinds, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    known = counts > 1
    if len(elsewhere):
        known |= np.isin(kinds, elsewhere)
    return known[inverse]


def _texts(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _listed(scalar: pa.ListScalar) -> np.ndarray:
    return scalar.values.to_numpy().view(np.uint64) if scalar.is_valid else np.zeros(0, np.uint64)


def pack(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(batch, data): documents in bounded batches, written once as a table bucketed by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, n = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for x in pa.Table.from_batches(held).combine_chunks().to_batches():
                    out.write_batch(x)
            return pa.RecordBatch.from_pydict({"batch": pa.array([(place << 32) + n], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for part in slices(batches, 64):
            held.append(pa.RecordBatch.from_arrays([part.column(id_col), part.column(text_col)], names=["id", "text"]))
            size += part.column(text_col).nbytes
            if size >= PACK_CHARS:
                yield flush()
                n, size, held = n + 1, 0, []
        if held:
            yield flush()

    spark = df.sparkSession
    name = f"tracewright_{uuid.uuid4().hex}"
    packed = df.select(id_col, text_col).mapInArrow(run, "batch long, data binary")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed.write.format("parquet").option("compression", "none").bucketBy(buckets, "batch").saveAsTable(name)
    written_table(name)
    return spark.table(name)


def _emit(find: Callable[[Pack, dict], np.ndarray]) -> Callable:
    """Rows (h, batch): each different hash of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            texts = _texts(part.column("data")[0].as_py()).column("text").to_pylist()
            h = np.unique(find(Pack(texts), part)).view(np.int64)
            batch = part.column("batch")[0].as_py()
            for at in range(0, len(h), 100_000):
                some = h[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), batch, np.int64))], names=["h", "batch"])

    return run


def shared(rows: DataFrame, name: str) -> DataFrame:
    """(batch, ``name``): per batch its hashes that other batches hold too."""
    counted = rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("h")))
    return counted.where("n > 1").groupBy(F.col("batch").alias("b")).agg(F.collect_list("h").alias(name))


def _attach(packed: DataFrame, found: DataFrame) -> DataFrame:
    return packed.join(found, packed["batch"] == found["b"], "left").drop("b")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_removed (long) and kept_text of every document.

    kept_text is the words that no repeated window covers, joined by one space; windows are
    judged on the input.  Each row is a document of its own: repeated rows and ids are copies
    and remove each other's words.  Null and empty texts have no words; documents under LENGTH
    words lose none; null ids are carried; an empty table gives no rows; other columns are not carried.
    A result column named like ``id_col`` gives way to it.
    """
    packed = pack(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    anchors = shared(packed.mapInArrow(_emit(lambda p, _: p.anchors()[1]), "h long, batch long"), "anchors")
    with_anchors = _attach(packed, anchors)
    windows = shared(with_anchors.mapInArrow(_emit(lambda p, row: p.windows(_listed(row.column("anchors")[0]))[1]), "h long, batch long"), "windows")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            table = _texts(part.column("data")[0].as_py())
            texts = table.column("text").to_pylist()
            p = Pack(texts)
            gone = p.removed(_listed(part.column("anchors")[0]), _listed(part.column("windows")[0]))
            counts, kept = [], []
            for t, start, n in zip(texts, p.starts, p.lens, strict=True):
                mask = gone[start : start + n]
                words = words_of(t or "")
                counts.append(int(mask.sum()))
                kept.append(" ".join(words if not counts[-1] else [w for w, x in zip(words, mask.tolist(), strict=True) if not x]))
            for at in range(0, len(texts), 256):
                stop = at + 256
                yield pa.RecordBatch.from_arrays(
                    [
                        table.column("id").slice(at, 256).combine_chunks(),
                        pa.array(p.lens[at:stop]),
                        pa.array(counts[at:stop], pa.int64()),
                        pa.array(kept[at:stop], pa.string()),
                    ],
                    names=["__id", "n_words", "n_removed", "kept_text"],
                )

    done = _attach(with_anchors, windows).mapInArrow(finish, f"__id {kind}, n_words long, n_removed long, kept_text string")
    return with_id(done, id_col)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM twice
), each_word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS t FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g ON w.doc_id = g.doc_id LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
