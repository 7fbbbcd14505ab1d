"""Quality classifier: ordinal cumulative-link regression over hashed words.

P(grade > k) = sigmoid(w . x - threshold_k) with one weight vector for all thresholds, which
are kept in order.  x holds the hashed lower-case words of a text and their first
letters, each once, and the bins that
its shares of letter cases, marks, stop words and different words fall into.  The model gives
the expected grade and the tail probability of the highest grades.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import lowest_hashes, slices, with_id, words_of
from tracewright.llm.quality import CLASSES, COMMON, STRIP, class_counts

BITS = 19
BINS = 12
#: Hashed words, then bins of the class shares, of the stop-word share and of the variety of words, and a constant.
DIM = (1 << BITS) + (len(CLASSES) + 2) * BINS + 1
#: The fit reads at most so many labelled rows: those with the smallest hash of their id.
SAMPLE = 12_000
EPOCHS, RATE, DECAY = 8, 0.2, 1e-6
WORD_VALUE, PREFIX = 0.5, 5
STOP = {w for x in COMMON.values() for w in x.split()}


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, one row per score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def _hash(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def features(text: str | None, seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of a text; an empty text has only its constant."""
    text = text or ""
    words = words_of(text)
    at, stops = set(), 0
    for w in words:
        k = seen.get(w)
        if k is None:
            plain = w.strip(STRIP).lower()
            k = _hash(plain), _hash("^" + plain[:PREFIX]), plain in STOP
            if len(seen) > 300_000:
                seen.clear()
            seen[w] = k
        at.update(k[:2])
        stops += k[2]
    counts, n = class_counts(text), max(len(words), 1)
    shares = np.concatenate([counts / max(counts.sum(), 1), [stops / n, min(1, len(at) / n**0.8)]])
    bins = (1 << BITS) + np.arange(len(shares)) * BINS + np.minimum(np.log2(1 + 400 * shares) * 1.3, BINS - 1).astype(int)
    idx = np.array([*sorted(at), *bins, DIM - 1], np.int64)
    return idx, np.concatenate([np.full(len(at), WORD_VALUE), np.full(len(bins) + 1, 1.0)]).astype(np.float32)


def train_rows(labelled: DataFrame, id_col: str, text_col: str, grade: Column, sample: int) -> list:
    """Features of at most ``sample`` labelled rows, made on the executors."""
    graded = labelled.select(F.col(id_col), F.col(text_col), grade.cast("int").alias("__grade")).where("__grade IS NOT NULL")
    picked = lowest_hashes(graded, id_col, sample, "__grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for part in slices(batches):
            x = [features(t, seen) for t in part.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("__grade"),
                    pa.array([i.astype("<i4").tobytes() for i, _ in x], pa.binary()),
                    pa.array([v.tobytes() for _, v in x], pa.binary()),
                ],
                names=["g", "i", "v"],
            )

    return picked.select(text_col, "__grade").repartition(8).mapInArrow(run, "g int, i binary, v binary").collect()


def fit(labelled: DataFrame, grade: Column, levels: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample (``sample`` rows at most) of rows whose ``grade`` is 0 to levels - 1.

    Rows of null grade are left out.  With no rows the model is neutral.  AdaGrad over the
    cumulative-link likelihood, in a fixed order.
    """
    rows = sorted(train_rows(labelled, id_col, text_col, grade, sample))
    w, gw = np.zeros(DIM), np.full(DIM, 1e-2)
    th, gt = np.arange(levels - 1) - (levels - 2) / 2.0, np.full(levels - 1, 1e-2)
    data = [(r.g, np.frombuffer(r.i, "<i4"), np.frombuffer(r.v, np.float32)) for r in rows]
    rng = np.random.default_rng(11)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            y, i, v = data[k]
            s = float(w[i] @ v)
            # P(y) = up - lo with up = P(grade > y - 1), lo = P(grade > y)
            up, lo = (sig(s - th[y - 1]) if y else 1.0), (sig(s - th[y]) if y < levels - 1 else 0.0)
            du, dl = up * (1 - up), lo * (1 - lo)
            p = max(up - lo, 1e-9)
            g = -(du - dl) / p * v + DECAY * w[i]
            gw[i] += g * g
            w[i] -= RATE * g / np.sqrt(gw[i])
            for j, d in ((y - 1, du / p), (y, -dl / p)):
                if 0 <= j < levels - 1:
                    gt[j] += d * d
                    th[j] -= RATE * 0.1 * d / np.sqrt(gt[j])
            th = np.maximum.accumulate(th)
    return Model(w.astype(np.float32), th)


def score(df: DataFrame, model: Model, tail: int, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Expected grade and P(grade >= tail) of every document, and whether it is selected (>= ``cut``).

    Returns ``id_col``, expected_grade, tail_probability (double, rounded to 6 places), selected;
    one row per input row.  Null and empty texts are scored by the constant alone and never
    selected; null ids are carried; an empty table gives no rows.  A result column named like ``id_col`` gives way to it.
    The model is of fixed size (1 MB), whatever the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for part in slices(batches):
            texts = part.column("__text").to_pylist()
            s = []
            for t in texts:
                i, v = features(t, seen)
                s.append(float(model.weights[i] @ v))
            p = model.tails(np.array(s, np.float64))
            chance = np.round(p[:, tail - 1], 6)
            picked = (chance >= cut) & np.array([bool(t and t.strip()) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [part.column("__id"), pa.array(np.round(p.sum(axis=1), 6)), pa.array(chance), pa.array(picked)],
                names=["__id", "expected_grade", "tail_probability", "selected"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return with_id(rows.mapInArrow(run, f"__id {kind}, expected_grade double, tail_probability double, selected boolean"), id_col)
