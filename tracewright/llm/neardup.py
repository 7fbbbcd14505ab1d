"""N-gram Jaccard join by MinHash banding.

1. Every text becomes its set of five-word shingles, a digest of that set, and band hashes of
   its MinHash values.  Texts of equal sets are copies: they form one set with a count.
2. Sets are shuffled on band hashes.  Sets that share a bucket are candidates; buckets that
   share sets get a common group label (two rounds of least labels), so a set is in few groups
   while each candidate pair shares at least one.
3. Groups are verified on the full shingle sets, in square blocks of bounded size; a pair that
   shares several groups counts in the one of the least label.  Each block returns, per set, how
   many links it has and one set it is connected to; pairs themselves are never written.
4. Classes are the connected components of the verified links.

Bands and rows are chosen for a target recall at the threshold.  Shingles are compared as 64-bit
hashes: among the shingles of two texts of n words a false match has probability n^2 / 2^64.
The work on a group grows with the square of its *different* sets (counting links exactly needs
each pair); equal texts cost nothing, and no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import materialize, slices, with_id
from tracewright.llm.components import components
from tracewright.llm.substring import _hashes, _mix, _prefix, word_hashes

NGRAM, RECALL, ROWS = 5, 0.9999, 6
NUMERATOR, DENOMINATOR = 4, 5  # similarity of 0.8 or more
BLOCK = 500
CHUNK = 4096


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Least number of bands of ``rows`` values for which a pair of that similarity shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def shingles(text: str | None, n: int = NGRAM) -> np.ndarray:
    """64-bit hashes of the different word n-grams, sorted; a shorter text is one shingle of all its words."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    size = min(n, len(words))
    at = np.arange(len(words) - size + 1)
    return np.unique(_hashes(_prefix(words), at, at + size))


def digest(found: np.ndarray) -> int:
    """A signed 64-bit digest of a shingle set."""
    if not len(found):
        return 0
    total = np.bitwise_xor.reduce(_mix(found)) + np.sum(_mix(found ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return int(_mix(np.array([total + np.uint64(len(found))], np.uint64)).view(np.int64)[0])


class Bands:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(71)
        self.bands, self.rows = bands, rows
        self.xor = rng.integers(0, 1 << 32, (bands * rows, 1), np.uint64).astype(np.uint32)
        self.mul = (rng.integers(0, 1 << 32, (bands * rows, 1), np.uint64) | 1).astype(np.uint32)
        self.number = np.arange(bands, dtype=np.uint64)

    def of(self, found: np.ndarray) -> np.ndarray:
        """Band hashes (each names its band) of a shingle set; none for an empty one."""
        if not len(found):
            return np.zeros(0, np.int64)
        x = (found >> np.uint64(32)).astype(np.uint32)[None, :]
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for at in range(0, x.shape[1], CHUNK):
            least = np.minimum(least, ((x[:, at : at + CHUNK] ^ self.xor) * self.mul).min(axis=1))
        h = self.number + np.uint64(0x1234567)
        for k in range(self.rows):
            h = _mix(h ^ least[k :: self.rows].astype(np.uint64)) + self.number
        return h.view(np.int64)


def fingerprints(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Bands(bands, rows)
        for part in slices(batches):
            sets = [shingles(t) for t in part.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(id_col),
                    pa.array([digest(x) for x in sets], pa.int64()),
                    pa.array([maker.of(x) for x in sets], pa.list_(pa.int64())),
                ],
                names=["id", "sig", "bands"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, sig long, bands array<long>")


def sets_of(df: DataFrame, text_col: str) -> DataFrame:
    """(sig, shingles): each different set at least once, and at most once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches):
            sig, out = [], []
            for t in part.column(text_col).to_pylist():
                found = shingles(t)
                name = digest(found)
                if name not in seen:
                    seen.add(name)
                    sig.append(name)
                    out.append(found.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(out, pa.binary())], names=["sig", "shingles"])

    return df.select(text_col).mapInArrow(run, "sig long, shingles binary")


def groups(prints: DataFrame) -> DataFrame:
    """(sig, label): groups such that sets of one bucket share a label; sets alone in all their buckets have none."""
    one = prints.groupBy("sig").agg(F.first("bands").alias("bands"))
    rows = materialize(one.select("sig", F.explode("bands").alias("bucket")), "bands")
    full = rows.groupBy("bucket").agg(F.min("sig").alias("label"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("bucket").alias("b"), "label")
    held = materialize(rows.join(full, F.col("bucket") == F.col("b")).select("bucket", "sig", "label"), "buckets")
    for _ in range(2):
        low = held.groupBy(F.col("sig").alias("s")).agg(F.min("label").alias("low"))
        labels = held.join(low, F.col("sig") == F.col("s")).groupBy(F.col("bucket").alias("b")).agg(F.min("low").alias("new"))
        held = materialize(held.join(labels, F.col("bucket") == F.col("b")).select("bucket", "sig", F.col("new").alias("label")), "buckets")
    return materialize(held.select("sig", "label").distinct(), "groups")


# -- verification -------------------------------------------------------------------------------
def links_between(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix: which sets of the two lists are similar enough."""
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    flat = np.concatenate([*left, *right])
    kinds, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [*a, *b])
    often = counts > 1
    column = np.cumsum(often) - 1
    use = often[inverse]
    rows, cols = owner[use], column[inverse[use]]
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for at in range(0, int(often.sum()), CHUNK):
        low, high = np.searchsorted(cols, [at, at + CHUNK])
        m = np.zeros((len(left) + len(right), CHUNK), np.float32)
        m[rows[low:high], cols[low:high] - at] = 1
        common += m[: len(left)] @ m[len(left) :].T
    total = a[:, None] + b[None, :]
    # |A and B| / |A or B| >= p / q, in whole numbers
    return (NUMERATOR + DENOMINATOR) * common.astype(np.int64) >= NUMERATOR * total


def settle(label: int, members: list[tuple]) -> list[tuple[int, int, int]]:
    """(sig, links, root) of one block or pair of blocks; members: (sig, block, copies, labels, shingles)."""
    members = list({m[0]: m for m in members}.values())
    blocks = sorted({m[1] for m in members})
    left = [m for m in members if m[1] == blocks[0]]
    right = [m for m in members if m[1] == blocks[1]] if len(blocks) > 1 else left
    link = links_between([m[4] for m in left], [m[4] for m in right])
    if right is left:
        np.fill_diagonal(link, False)
    # pairs that share a smaller label count there
    tuples: dict[tuple, int] = {}
    i = np.array([tuples.setdefault(tuple(m[3]), len(tuples)) for m in left])
    j = np.array([tuples.setdefault(tuple(m[3]), len(tuples)) for m in right])
    smaller = [{x for x in t if x < label} for t in tuples]
    if any(smaller):
        mine = np.array([[not (x & y) for y in smaller] for x in smaller])
        link &= mine[i[:, None], j[None, :]]
    count = link @ np.array([m[2] for m in right], np.int64)
    names = [m[0] for m in left]
    links = list(count)
    if right is not left:
        links += list(np.array([m[2] for m in left], np.int64) @ link)
        names += [m[0] for m in right]
    roots = _roots(link, right is left)
    return [(n, int(c), names[r]) for n, c, r in zip(names, links, roots, strict=True) if c]


def _roots(link: np.ndarray, square: bool) -> np.ndarray:
    """Number of a member of each one's component."""
    n, m = link.shape
    total = n if square else n + m
    root = np.full(total, -1)
    for k in range(total):
        if root[k] >= 0:
            continue
        root[k] = k
        front = np.array([k])
        while len(front):
            if square:
                near = np.flatnonzero(link[front].any(axis=0))
            else:
                rows, cols = front[front < n], front[front >= n] - n
                near = np.concatenate([np.flatnonzero(link[rows].any(axis=0)) + n, np.flatnonzero(link[:, cols].any(axis=1))])
            front = near[root[near] < 0]
            root[front] = k
    return root


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle blocks from rows sorted by (label, i, j)."""
    key, members = None, []

    def out() -> pa.RecordBatch:
        rows = settle(key[0], members) if len(members) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["sig", "links", "root"])

    for part in slices(batches, 1024):
        cols = [part.column(c).to_pylist() for c in ("label", "i", "j", "sig", "block", "copies", "labels", "shingles")]
        for label, i, j, sig, block, copies, labels, data in zip(*cols, strict=True):
            if key != (label, i, j):
                if members:
                    yield out()
                key, members = (label, i, j), []
            members.append((sig, block, copies, labels, np.frombuffer(data, "<u8")))
    if members:
        yield out()


def verified(df: DataFrame, text_col: str, found: DataFrame, copies: DataFrame) -> DataFrame:
    """(sig, links, root) rows of all blocks; a set may have several."""
    sizes = found.groupBy(F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("size"))
    mine = found.groupBy(F.col("sig").alias("s")).agg(F.sort_array(F.collect_set("label")).alias("labels"))
    mine = mine.join(copies, F.col("s") == copies["sig"]).select("s", "labels", "copies")
    placed = found.join(sizes, F.col("label") == F.col("l")).where("size > 1").select("sig", "label", F.expr(f"cast(ceil(size / {BLOCK}) as int)").alias("blocks"))
    placed = placed.join(mine, F.col("sig") == F.col("s")).withColumn("block", F.expr("cast(pmod(xxhash64(sig, label), blocks) as int)"))
    rows = sets_of(df, text_col).join(placed.drop("sig"), F.col("sig") == F.col("s")).drop("s")
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sig", "block", "copies", "labels", "shingles")
    return rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(verify, "sig long, links long, root long")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """``id_col``, class_id and n_links of every document.

    n_links is the number of other rows whose shingle sets have a Jaccard similarity of 0.8 or more
    (copies and repeated rows included), class_id the least id in the connected component.
    Null ids come out with the class of their text and are never a class_id unless all ids are null.
    Texts without words (null, empty) are copies of each other.  An empty table gives no rows.
    A result column named like ``id_col`` gives way to it.
    """
    bands = bands_for(NUMERATOR / DENOMINATOR, recall, rows)
    prints = materialize(fingerprints(df, id_col, text_col, bands, rows), "prints")
    copies = prints.groupBy("sig").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    links = materialize(verified(df, text_col, groups(prints), copies.select("sig", "copies")), "links")
    joined = components(links.select(F.col("sig").alias("a"), F.col("root").alias("b")))
    number = links.groupBy(F.col("sig").alias("s")).agg(F.sum("links").alias("links"))
    of_set = copies.join(joined, F.col("sig") == F.col("node"), "left").join(number, F.col("sig") == F.col("s"), "left")
    of_set = of_set.select("sig", F.coalesce("root", "sig").alias("root"), "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = of_set.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("class_id"))
    of_set = of_set.join(named, F.col("root") == F.col("r")).select(F.col("sig").alias("s"), "class_id", "n_links")
    return with_id(prints.select(F.col("id").alias("__id"), "sig").join(of_set, F.col("sig") == F.col("s")).select("__id", "class_id", "n_links"), id_col)
