"""Quality rules: base counts of a text and its divergence from language references.

A reference holds, per language, how often each character class and each common word occurs in
all documents of that language that pass the base rules.  A document is rejected when the
Jensen-Shannon distance of its own histogram to the reference of its language is over a
threshold; histograms of too few characters or words are not judged, and the threshold of a
short one is wider by the spread that chance alone gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import slices, words_of

# Common words of the languages with a reference.
COMMON = {
    "en": "the of and to in a is that for it was on are as with be by at this from or an not he have his",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus avec ce il ne se aux",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus",
}
LANGS = tuple(COMMON)
# Character classes.
CLASSES = ("lower", "upper", "digit", "space", "sentence mark", "word mark", "loud mark", "symbol", "other")
MIN_WORDS, MAX_REPEATED = 20, 30
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 100, 30
# Largest distance, and how much wider it is for one character or word (falls with the square root).
MAX_CHARS_DISTANCE, CHARS_SPREAD = 0.25, 1.5
MAX_WORDS_DISTANCE, WORDS_SPREAD = 0.27, 0.6
WINDOW = 8


def _class_table() -> np.ndarray:
    out = np.full(0x3000, 8, np.uint8)
    for c in range(0x3000):
        s = chr(c)
        if s.isspace():
            out[c] = 3
        elif s in ".,;:":
            out[c] = 4
        elif s in "'\"()-’“”«»–":
            out[c] = 5
        elif s in "!?":
            out[c] = 6
        elif s.isdigit():
            out[c] = 2
        elif s.isupper():
            out[c] = 1
        elif s.isalpha():
            out[c] = 0
        elif c < 128:
            out[c] = 7
    return out


TABLE = _class_table()
INDEX = {lang: {w: k for k, w in enumerate(words.split())} for lang, words in COMMON.items()}
N_WORDS = 1 + max(len(x) for x in INDEX.values())
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "’“”«»–…¿¡"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[str], width: int = WINDOW) -> int:
    """Words inside ``width``-word windows that occur twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64)
    if len(ids) == n:
        return 0
    x = (x + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + x[k : k + len(h)]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    lines = [x for x in lines if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def base(text: str | None) -> tuple[tuple[int, int, int, int, int, bool], list[str]]:
    """((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed), words)."""
    text = text or ""
    words = words_of(text)
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEATED * len(words)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return (len(words), sum(map(len, words)), symbols, duplicate_lines(text), repeat, failed), words


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(codes) and codes.max() >= len(TABLE):
        codes = np.where(codes < len(TABLE), codes, 0x2FFF)
    return np.bincount(TABLE[codes], minlength=len(CLASSES)).astype(np.int64)


def word_counts(words: list[str], lang: str, seen: dict[str, int]) -> np.ndarray:
    """Counts of the language's common words; the last entry is all other words."""
    at = []
    for w in words:
        k = seen.get(w)
        if k is None:
            k = INDEX[lang].get(w.strip(STRIP).lower(), N_WORDS - 1)
            if len(seen) > 50_000:
                seen.clear()
            seen[w] = k
        at.append(k)
    return np.bincount(np.array(at, np.int64), minlength=N_WORDS)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, from 0 to 1; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.nansum(np.where(p > 0, p * np.log2(p / m), 0)) + np.nansum(np.where(q > 0, q * np.log2(q / m), 0))
    return float(np.sqrt(max(d / 2, 0)))


def references(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language the summed class and common-word counts of all documents that pass the base rules.

    Whole counts, so the order of summing does not matter.  What reaches the driver is at most
    len(LANGS) * (len(CLASSES) + N_WORDS) sums.
    """
    width = len(CLASSES) + N_WORDS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {lang: np.zeros(width, np.int64) for lang in LANGS}
        seen: dict[str, dict[str, int]] = {lang: {} for lang in LANGS}
        for part in slices(batches):
            for lang, text in zip(part.column(lang_col).to_pylist(), part.column(text_col).to_pylist(), strict=True):
                if lang in total and text:
                    counts, words = base(text)
                    if not counts[-1]:
                        total[lang] += np.concatenate([class_counts(text), word_counts(words, lang, seen[lang])])
        rows = [(lang, k, int(v)) for lang, x in total.items() for k, v in enumerate(x) if v]
        yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(("lang", "k", "n"))}, pa.schema([("lang", pa.string()), ("k", pa.int32()), ("n", pa.int64())]))

    sums = df.select(F.col(lang_col).cast("string").alias(lang_col), text_col).mapInArrow(count, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    total = {lang: np.zeros(width, np.int64) for lang in LANGS}
    for r in sums.collect():
        total[r.lang][r.k] = r.n
    return {lang: (x[: len(CLASSES)], x[len(CLASSES) :]) for lang, x in total.items() if x.any()}


def judge(text: str, words: list[str], lang: str | None, refs: dict, seen: dict) -> tuple[float, float, bool]:
    """(class distance, common-word distance, accepted) against the language's reference, or the
    nearest one where the language has none."""
    classes = class_counts(text)
    n_chars, n_words = int(classes.sum()), len(words)
    best = (0.0, 0.0, True)
    for k, one in enumerate([lang] if lang in refs else list(refs)):
        a = js_distance(classes, refs[one][0]) if n_chars >= MIN_CHARS_JUDGED else 0.0
        b = js_distance(word_counts(words, one, seen.setdefault(one, {})), refs[one][1]) if n_words >= MIN_WORDS_JUDGED else 0.0
        ok = a <= MAX_CHARS_DISTANCE + CHARS_SPREAD / max(n_chars, 1) ** 0.5 and b <= MAX_WORDS_DISTANCE + WORDS_SPREAD / max(n_words, 1) ** 0.5
        if not k or a + b < best[0] + best[1]:
            best = (a, b, ok)
    return best


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Base counts, distances and verdict of every document.

    Returns the ``carry`` columns (default: ``id_col``) and n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), base_failed, chars_distance, words_distance (double),
    kept.  One row per input row.  Null and empty texts have no words and fail the base rules.
    A null or unknown language is judged by the nearest reference; with no reference at all
    only the base rules count.  An empty table gives no rows.  A carried column named like a
    result column gives way to it.
    """
    names = [*BASE, "base_failed", "chars_distance", "words_distance", "kept"]
    carry = tuple(c for c in carry or (id_col,) if c not in names)
    refs = references(df, lang_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[str, int]] = {}
        for part in slices(batches):
            rows = []
            for lang, text in zip(part.column("__lang").to_pylist(), part.column("__text").to_pylist(), strict=True):
                counts, words = base(text)
                a, b, ok = (0.0, 0.0, False) if counts[-1] else judge(text, words, lang, refs, seen)
                rows.append((*counts, a, b, ok))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in carry] + [pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=[*carry, *names]
            )

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    schema = kinds + ", " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, chars_distance double, words_distance double, kept boolean"
    rows = df.select(*carry, F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, schema)


def accepted(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns whatever their names; cases as in ``quality``."""
    refs = references(df, lang_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[str, int]] = {}
        for part in slices(batches):
            keep = []
            for lang, text in zip(part.column(lang_col).to_pylist(), part.column(text_col).to_pylist(), strict=True):
                counts, words = base(text)
                keep.append(not counts[-1] and judge(text, words, lang, refs, seen)[2])
            yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
