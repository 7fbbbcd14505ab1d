"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents; words in more than
   ``MAX_DF`` of them have no weight in the latent space.
2. A distributed randomised SVD of the TF-IDF vectors of the benchmark items and of every passage
   of every whole text gives a basis of ``RANK`` latent dimensions: each partition sends its
   share of A'(A Q), added up by blocks of rows; only the small sums reach the driver, which makes
   them orthogonal.  All passages together weigh as ``FIT_WEIGHT`` of them at most, so that the
   items, ``ITEM_WEIGHT`` each, keep their part however many documents there are.
3. Every document is cut into overlapping windows at a few lengths that suit the items.  Windows
   are projected and compared with all items by cosine (a fixed query set against all rows, in
   blocks), with the norm of the whole window below the line, so what lies outside the latent
   space counts against it; windows whose projection is too short for any item are not compared,
   which loses none; each pair over ``COSINE`` of what the item itself would reach is a
   candidate.  Nothing is capped.
4. Latent space says little of a passage so widespread that its own words are common, so an exact
   search stands beside: a leak matches ``LCS_SHARE`` of an item, so of any ``m`` of its words all
   but those it may miss.  Every stretch with that many of the item's rarest words is a candidate
   too; no leak can lack them, whatever its words weigh.
5. A candidate is a leak if the longest common subsequence of the item with some stretch of the
   document not much longer than the item covers enough of the item, and of its answer: what
   follows the last question mark, else the last sentence.

Texts are compared in lower case without ASCII punctuation, so case and marks do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import materialize, slices, with_id
from tracewright.llm.substring import word_hashes, word_hashes_each

BITS, RANK, STEP = 16, 64, 8
DIM = 1 << BITS
PASSAGE, FIT_WEIGHT, SHARE_WORDS = 48, 8000, 1 << 25  # words, what all passages weigh at most beside the items, words of a task of the fit
DOCS = 128  # of a slice of the survey
BLOCK, GATHER = 1 << 14, 2048  # passages that the fit adds at a time, rows of a table taken at a time
MAX_DF, ITEM_WEIGHT = 0.03, 4.0
COSINE, LCS_SHARE, ANSWER_SHARE, STRETCH = 0.45, 0.6, 0.5, 1.3
ITEMS_PER_PASS = 256
_PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))


def _plain(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN)


def words(text: str | None) -> np.ndarray:
    return word_hashes(_plain(text))


def words_each(texts: list[str | None]) -> list[np.ndarray]:
    return word_hashes_each([_plain(t) for t in texts])


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Item:
    ident: int
    words: np.ndarray
    answer: int  # words of the answer, at the end


def item_of(ident: int, text: str) -> Item | None:
    found = words(text)
    if not len(found):
        return None
    tail = text.rpartition("?")[2]
    if not len(words(tail)) or "?" not in text:
        tail = re.split(r"[.!?:]\s+", text.strip().rstrip(".!?"))[-1]
    return Item(ident, found, min(len(words(tail)), len(found)))


def lcs(mask: dict[int, int], n: int, other: list[int]) -> int:
    """Bits of the longest common subsequence state: zeros of the result mark matched words of the item."""
    full = (1 << n) - 1
    v = full
    for m in filter(None, map(mask.get, other)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _mask(found: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(found.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


# -- fitting ------------------------------------------------------------------------------------
def survey(df: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, int, np.ndarray, int, DataFrame]:
    """(documents that hold each hashed word, documents, its uses, passages, the passages themselves) of whole texts.

    Counts are summed by hash value; 2 DIM numbers reach the driver.  The passages of every text, PASSAGE
    words one after another and the rest of it, are written as their words' buckets in two bytes each, so
    that the fit reads no text again.  Null ids and texts, repeated rows: as any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, uses, n, passages = np.zeros(DIM, np.int64), np.zeros(DIM, np.int64), 0, 0
        place = np.empty(DOCS << BITS, np.int32)
        for part in slices(batches, DOCS):
            found = words_each(part.column("__text").to_pylist())
            sizes = np.array([len(x) for x in found], np.int64)
            flat = bucket(np.concatenate(found))
            n += len(found)
            uses += np.bincount(flat, minlength=DIM)
            # of the places of a word in a document the last one stays written
            key, at = flat + (np.repeat(np.arange(len(found)), sizes) << BITS), np.arange(len(flat), dtype=np.int32)
            place[key] = at
            total += np.bincount(flat[place[key] == at], minlength=DIM)
            if len(flat):
                cut = _cut(sizes)
                passages += len(cut)
                gaps = pa.nulls(1, pa.int64())
                raw = [pa.array([x.tobytes()], pa.binary()) for x in (flat.astype(np.uint16), cut)]
                yield pa.RecordBatch.from_arrays([gaps, gaps, gaps, *raw], names=["k", "n", "uses", "words", "sizes"])
        at = np.flatnonzero(total)
        sums = [pa.array(np.append(at, -1)), pa.array(np.append(total[at], n)), pa.array(np.append(uses[at], passages))]
        none = pa.nulls(len(at) + 1, pa.binary())
        yield pa.RecordBatch.from_arrays([*sums, none, none], names=["k", "n", "uses", "words", "sizes"])

    rows = df.select(F.col(text_col).alias("__text"))
    made = materialize(rows.mapInArrow(run, "k long, n long, uses long, words binary, sizes binary"), "survey")
    sums = made.where("k IS NOT NULL").groupBy("k").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")).collect()
    out, uses, n, passages = np.zeros(DIM, np.int64), np.zeros(DIM, np.int64), 0, 0
    for r in sums:
        if r.k >= 0:
            out[r.k], uses[r.k] = r.n, r.uses
        else:
            n, passages = r.n, r.uses
    shares = min(max(8, int(uses.sum()) // SHARE_WORDS), 256)
    return out, n, uses, passages, made.where("words IS NOT NULL").select("words", "sizes").coalesce(shares)


def _cut(sizes: np.ndarray) -> np.ndarray:
    """Words of the passages of texts of so many words, one text after another."""
    counts = -(-sizes // PASSAGE)
    out = np.full(int(counts.sum()), PASSAGE, np.uint8)
    some = counts > 0
    out[np.cumsum(counts)[some] - 1] = (sizes - PASSAGE * (counts - 1))[some]
    return out


def _added(z: np.ndarray, flat: np.ndarray, sizes: np.ndarray, idf: np.ndarray, q: np.ndarray) -> None:
    """Add A'(A q) to ``z``, where the rows of A are the normalised TF-IDF vectors of passages: buckets, and words of each."""
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    for at in range(0, len(sizes), BLOCK):
        some = sizes[at : at + BLOCK]
        b = flat[ends[at] : ends[at + len(some)]].astype(np.uint32)
        keep = idf[b] > 0
        key = np.sort((np.repeat(np.arange(len(some), dtype=np.uint32), some)[keep] << np.uint32(BITS)) + b[keep])
        if not len(key):
            continue
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        cols, own = (key[first] & np.uint32(DIM - 1)).astype(np.int64), (key[first] >> np.uint32(BITS)).astype(np.int64)
        val = np.diff(np.append(first, len(key))) * idf[cols]
        val = (val / np.sqrt(np.bincount(own, val * val))[own]).astype(np.float32)
        new = np.append(True, own[1:] != own[:-1])
        row = np.cumsum(new) - 1
        y = _sums(q, cols, val, np.flatnonzero(new))
        order = np.argsort(cols.astype(np.uint16), kind="stable")
        cols = cols[order]
        heads = np.flatnonzero(np.append(True, cols[1:] != cols[:-1]))
        z[cols[heads]] += _sums(y, row[order], val[order], heads)


def _sums(table: np.ndarray, at: np.ndarray, weights: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Weighted sums of the rows ``at`` of a table from each head to the next; runs of one length together.

    Rows are taken into a space small enough for the processor's cache, which is most of the speed.
    """
    out = np.empty((len(heads), table.shape[1]), np.float32)
    sizes = np.diff(np.append(heads, len(at)))
    order = np.argsort(sizes, kind="stable")
    kinds, first = np.unique(sizes[order], return_index=True)
    space = np.empty((max(GATHER, int(kinds[-1])), table.shape[1]), np.float32)
    for size, low, high in zip(kinds.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        each = max(1, GATHER // size)
        for k in range(low, high, each):
            some = order[k : min(k + each, high)]
            run = heads[some][:, None] + np.arange(size)
            rows = np.take(table, at[run].ravel(), axis=0, mode="clip", out=space[: run.size])  # any but "raise" fills it directly
            if size == 1:
                out[some] = weights[run] * rows
            else:
                out[some] = np.matmul(weights[run][:, None, :], rows.reshape(*run.shape, -1))[:, 0]
    return out


def basis(passages: DataFrame, share: float, idf: np.ndarray, items: list[Item], rank: int = RANK, rounds: int = 2) -> np.ndarray:
    """Orthonormal basis (DIM x rank) of the leading right singular vectors, by randomised subspace iteration.

    All passages count, each by ``share``, and the items beside them.
    """
    q = orthonormal(np.random.default_rng(5).standard_normal((DIM, rank)))
    rows_per = DIM // 32

    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            z = np.zeros((DIM, rank), np.float32)
            for part in slices(batches, 16):
                flat, sizes = (
                    np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in part.column(name)]) for name, kind in (("words", np.uint16), ("sizes", np.uint8))
                )
                _added(z, flat, sizes, idf, q)
            for k in range(32):
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "z": pa.array([z[k * rows_per : (k + 1) * rows_per].tobytes()], pa.binary())})

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table.column("z"))
            return pa.table({"k": table.column("k").slice(0, 1), "z": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        z = np.zeros((DIM, rank), np.float32)
        for r in passages.mapInArrow(run, "k int, z binary").groupBy("k").applyInArrow(add, "k int, z binary").collect():
            z[r.k * rows_per : (r.k + 1) * rows_per] = np.frombuffer(r.z, np.float32).reshape(rows_per, rank)
        z *= np.float32(share)
        own = np.zeros((DIM, rank), np.float32)
        for x in items:
            _added(own, bucket(x.words), np.array([len(x.words)]), idf, q)
        q = orthonormal(z + ITEM_WEIGHT**2 * own)
    return q


def orthonormal(z: np.ndarray) -> np.ndarray:
    """Columns of the same span made orthonormal: by the eigenvectors of the small Gram matrix, twice."""
    z = z.astype(np.float64)
    for _ in range(2):
        values, vectors = np.linalg.eigh(z.T @ z)
        z = z @ (vectors / np.sqrt(np.maximum(values, 1e-12 * max(values[-1], 1e-300))))
    return z.astype(np.float32)


@dataclass
class Seeds:
    """The words of which every leak of an item holds a number, for all items."""

    known: np.ndarray  # whether a bucket holds any of the words
    words: np.ndarray  # their hashes, sorted
    bounds: np.ndarray  # word k belongs to items[bounds[k]:bounds[k + 1]]
    items: np.ndarray
    least: np.ndarray  # of each item, how many of its words a leak holds at least
    within: np.ndarray  # and in how many words of the document


def stretch_of(n: int) -> int:
    return int(n * STRETCH) + 2


def seeds(items: list[Item], uses: np.ndarray) -> Seeds:
    """A leak misses ``spare`` words of an item at most, so it holds m - spare of its rarest m.

    m is what chance reaches least (Chernoff's bound at the words' share of all uses); it decides how
    many stretches are looked at in vain, not which leaks are found.
    """
    share = (uses + 1) / (uses.sum() + 1)
    pairs, least, within = [], [], []
    for k, x in enumerate(items):
        n = len(x.words)
        spare = n - int(np.ceil(LCS_SHARE * n - 1e-6))
        order = x.words[np.argsort(share[bucket(x.words)], kind="stable")]
        new = np.zeros(n, bool)
        new[np.unique(order, return_index=True)[1]] = True
        chance = (stretch_of(n) * np.cumsum(np.where(new, share[bucket(order)], 0.0)))[spare:]
        need = np.arange(1, n - spare + 1)
        m = spare + 1 + int(np.argmin(np.where(chance < need, need - chance + need * np.log(chance / need), 0.0)))
        pairs += [(w, k) for w in np.unique(order[:m]).tolist()]
        least.append(m - spare)
        within.append(stretch_of(n))
    pairs.sort()
    found, first = np.unique(np.array([w for w, _ in pairs], np.uint64), return_index=True)
    known = np.zeros(DIM, bool)
    known[bucket(found)] = True
    return Seeds(known, found, np.append(first, len(pairs)), np.array([k for _, k in pairs], np.int16), np.array(least, np.int64), np.array(within, np.int64))


@dataclass
class Index:
    weights: np.ndarray  # idf times basis, and a row of zeros
    squares: np.ndarray  # idf squared, and a zero
    items: list[Item]
    vectors: np.ndarray  # projections of the items, scaled so that a candidate's dot product is its norm at least
    scales: list[int]  # window lengths in steps
    seeds: Seeds


def scales_for(lengths: list[int]) -> list[int]:
    """Window lengths, in steps of STEP words, such that every item is within a factor of 1.6 of one."""
    low, high = min(lengths), max(lengths)
    out = [max(2, round(1.6 * low / STEP))]
    while out[-1] * STEP * 1.6 < high:
        out.append(round(out[-1] * 2.4 + 0.5))
    return out


def projections(items: list[Item], weights: np.ndarray, squares: np.ndarray) -> np.ndarray:
    out = np.zeros((len(items), weights.shape[1]), np.float32)
    for k, x in enumerate(items):
        b = bucket(x.words)
        v = weights[b].sum(axis=0) / max(float(np.sqrt(squares[b].sum())), 1e-9)
        # an item without weighted words is found by the exact search alone
        out[k] = v / max(float(v @ v), 1e-12) / COSINE if v.any() else 0
    return out


def build(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> list[Index]:
    """Indexes over the items, ITEMS_PER_PASS each.  The benchmark is the query set and is read to the driver."""
    rows = sorted(((r[0], r[1] or "") for r in benchmark.select(item_col, item_text).collect()), key=lambda r: (r[0] is None, r[0], r[1]))
    items = [x for x in (item_of(k, t) for k, t in rows) if x]
    if not items:
        return []
    df_counts, n, uses, count, passages = survey(df, id_col, text_col)
    idf = np.where(df_counts > max(MAX_DF * n, 5), 0.0, np.log((n + 1) / (df_counts + 1)))
    squares = np.append(idf**2, 0).astype(np.float32)
    out = []
    for at in range(0, len(items), ITEMS_PER_PASS):
        some = items[at : at + ITEMS_PER_PASS]
        q = basis(passages, min(1.0, FIT_WEIGHT / max(count, 1)), idf, some)
        weights = np.vstack([(idf[:, None] * q).astype(np.float32), np.zeros((1, q.shape[1]), np.float32)])
        out.append(Index(weights, squares, some, projections(some, weights, squares), scales_for([len(x.words) for x in some]), seeds(some, uses)))
    return out


# -- searching ----------------------------------------------------------------------------------
def windows(sums: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``size`` consecutive rows, for each start, by doubling."""
    out, have, power, span = None, 0, sums, 1
    while True:
        if size & span:
            out = power if out is None else out[: len(out) - span] + power[have : have + len(out) - span]
            have += span
        if have == size:
            return out
        power = power[:-span] + power[span:]
        span *= 2


def sown(found: list[np.ndarray], index: Seeds) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, a, b): every stretch that holds as many seeds of the item as its leaks do begins at a at most and ends at b at least.

    Stretches less than their length apart are told of together.
    """
    sizes = np.array([len(w) for w in found], np.int64)
    flat = np.concatenate(found)
    at = np.flatnonzero(index.known[bucket(flat)])
    word = np.minimum(np.searchsorted(index.words, flat[at]), len(index.words) - 1)
    same = index.words[word] == flat[at]
    at, word = at[same], word[same]
    count = index.bounds[word + 1] - index.bounds[word]
    item = index.items[np.repeat(index.bounds[word] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
    at = np.repeat(at, count)
    order = np.argsort(item, kind="stable")
    item, at = item[order], at[order]
    last = np.arange(len(at)) + index.least[item] - 1
    first = np.flatnonzero(last < len(at))
    last = last[first]
    good = (item[first] == item[last]) & (at[last] - at[first] < index.within[item[first]])
    item, first, last = item[first[good]].astype(np.int64), at[first[good]], at[last[good]]
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, first, side="right")
    good = last < ends[doc]
    item, first, last, doc = item[good], first[good], last[good], doc[good]
    if not len(doc):
        return
    apart = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] - first[:-1] >= index.within[item[1:]])
    heads, tails = np.flatnonzero(np.append(True, apart)), np.flatnonzero(np.append(apart, True))
    start = (ends - sizes)[doc[heads]]
    yield from zip(doc[heads].tolist(), item[heads].tolist(), (first[tails] - start).tolist(), (last[heads] - start).tolist(), strict=True)


def reachable(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The windows, of projection and squared norm, that an item of so large a squared length can be a candidate for.

    A dot product is at most the product of the lengths, so no other window reaches its norm; a thousandth is left for rounding.
    """
    latent = vectors[:, :-1]
    return np.flatnonzero(np.einsum("ij,ij->i", latent, latent) * (1.001 * longest) >= np.maximum(vectors[:, -1], 1e-9))


def search(texts: list[str | None], index: Index) -> list[list[tuple[int, float, float]]]:
    """Per text its leaks: (item number, share of the item in the longest common subsequence, cosine)."""
    found = words_each(texts)
    steps = np.array([-(-len(w) // STEP) for w in found])
    flat = np.full(int(steps.sum()) * STEP, DIM, np.int64)
    starts = np.concatenate([[0], np.cumsum(steps)])
    for w, s in zip(found, (starts * STEP).tolist(), strict=False):
        flat[s : s + len(w)] = bucket(w)
    rank = index.weights.shape[1]
    sums = np.empty((len(flat) // STEP, rank + 1), np.float32)  # projections, and squared norms
    sums[:, rank] = index.squares[flat].reshape(-1, STEP).sum(axis=1)
    space = np.empty((GATHER, rank), np.float32)
    for at in range(0, len(flat), GATHER):
        some = flat[at : at + GATHER]
        rows = np.take(index.weights, some, axis=0, mode="clip", out=space[: len(some)])
        sums[at // STEP : (at + GATHER) // STEP, :rank] = rows.reshape(-1, STEP, rank).sum(axis=1)
    owner = np.repeat(np.arange(len(texts)), steps)
    near: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    longest = float((index.vectors**2).sum(axis=1).max())

    def compare(vectors: np.ndarray, docs: np.ndarray, first: np.ndarray, size: int) -> None:
        able = reachable(vectors, longest)
        vectors, docs, first = vectors[able], docs[able], first[able]
        for at in range(0, len(vectors), 8192):
            dots = vectors[at : at + 8192, :rank] @ index.vectors.T
            norm = np.sqrt(np.maximum(vectors[at : at + 8192, rank], 1e-9))[:, None]
            rows, cols = np.nonzero(dots >= norm)
            for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
                near.setdefault((int(docs[at + r]), c), []).append((int(first[at + r]), size, float(dots[r, c] / norm[r, 0])))

    for size in index.scales:
        if len(sums) >= size:
            first = np.arange(len(sums) - size + 1)
            inside = owner[first] == owner[first + size - 1]
            compare(windows(sums, size)[inside], owner[first[inside]], first[inside] - starts[owner[first[inside]]], size)
        brief = np.flatnonzero((steps < size) & (steps > 0))
        if len(brief):
            compare(np.stack([sums[starts[k] : starts[k + 1]].sum(axis=0) for k in brief]), brief, np.zeros(len(brief), int), size)
    for doc, k, a, b in sown(found, index.seeds):
        # as steps from which the judge tries all stretches that begin from b - length to a
        n = len(index.items[k].words)
        first = max(0, b - stretch_of(n) + n) // STEP
        near.setdefault((doc, k), []).append((first, max(1, (a - n // 2) // STEP + 2 - first), 0.0))
    out: list[list[tuple[int, float, float]]] = [[] for _ in texts]
    masks: dict[int, tuple] = {}
    for (doc, k), hits in sorted(near.items()):
        item = index.items[k]
        n = len(item.words)
        if k not in masks:
            masks[k] = (_mask(item.words), _mask(item.words[n - item.answer :]))
        share = judge(found[doc], item, *masks[k], hits)
        if share:
            cosine = max(h[2] for h in hits)
            if not cosine:
                parts = [sums[starts[doc] + at : min(starts[doc] + at + -(-n // STEP), starts[doc + 1])].sum(axis=0) for at in range(steps[doc])]
                cosine = max(float(x[:rank] @ index.vectors[k] / np.sqrt(max(x[rank], 1e-9))) for x in parts)
            out[doc].append((k, share, COSINE * cosine))
    return out


def judge(doc: np.ndarray, item: Item, whole: dict, answer: dict, hits: list[tuple[int, int, float]]) -> float:
    """Best share of the item in a stretch of the document around the hits; 0 if it is no leak."""
    n = len(item.words)
    length, step = stretch_of(n), max(2, n // 5)
    best, tried = 0.0, set()
    for first, size, _ in hits:
        low, high = max(0, first * STEP - n), min(len(doc), (first + size) * STEP + n)
        low = low // step * step
        high = max(low + 1, high - n // 2)
        # what all stretches together do not hold, none of them does
        if lcs(whole, n, doc[low : high + length].tolist()) / n < LCS_SHARE:
            continue
        for s in range(low, high, step):
            if s in tried:
                continue
            tried.add(s)
            stretch = doc[s : s + length].tolist()
            share = lcs(whole, n, stretch) / n
            if share >= LCS_SHARE and share > best and lcs(answer, item.answer, stretch) >= ANSWER_SHARE * item.answer:
                best = share
    return best


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_col``, ``item_col``, lcs_share, cosine (double; as a part of the item's own): one row for each item leaked into each row of ``df``.

    Repeated rows are searched each on their own; null and empty texts and items leak nothing;
    empty tables give no rows.  Ids are carried as they are, null ones too.  A result column named
    like ``id_col`` gives way to it; an ``item_col`` named like another column has ``_item`` behind.
    """
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"__id {kind}, __item {item_kind}, lcs_share double, cosine double"
    out = None
    for index in build(df, benchmark, id_col, text_col, item_col, item_text):
        rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        found = rows.mapInArrow(_search_rows(index, benchmark.schema[item_col].dataType), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = df.sparkSession.createDataFrame([], schema)
    taken = (id_col, "lcs_share", "cosine")
    return with_id(out.withColumnRenamed("__item", f"{item_col}_item" if item_col in taken else item_col), id_col)


def _search_rows(index: Index, item_type):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            hits = search(part.column("__text").to_pylist(), index)
            at = [k for k, x in enumerate(hits) for _ in x]
            flat = [y for x in hits for y in x]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("__id").take(pa.array(at, pa.int64())),
                    pa.array([index.items[k].ident for k, _, _ in flat], kind),
                    pa.array([round(s, 6) for _, s, _ in flat], pa.float64()),
                    pa.array([round(c, 3) for _, _, c in flat], pa.float64()),
                ],
                names=["__id", "__item", "lcs_share", "cosine"],
            )

    return run


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` into which no item leaked, with all their columns; decided row by row, without a join.

    Null and empty texts and items leak nothing, so such rows stay; repeated rows stay or go together;
    null ids are ids like others; columns of any name are carried; empty tables stay as they are.
    """
    for index in build(df, benchmark, id_col, text_col):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 128):
                yield part.filter(pa.array([not x for x in search(part.column(text_col).to_pylist(), index)], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
