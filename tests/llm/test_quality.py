import re

import pytest

from tracewright.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(i, i + 8)}
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def corpus():
    good = "The cat and the dog of that house are in the garden with it, for he was on the way to be by the tree. "
    texts = [good * k for k in (1, 2, 3)] + [None, "", " \n\t", "a b " * 40, "x y z " * 9, "\U0001f600 " * 25]
    texts += [f"{good}number {k} of the list is not that long and it was as good as the first\nline\nline\n \n" for k in range(30)]
    texts += [" ".join(f"W{k}RD!!%%" for k in range(60)), " | ".join(f"thing{k}x" for k in range(120)), "one " * 19, " ".join(map(str, range(20)))]
    return texts


def test_base_counts_and_verdicts(spark):
    rows = [(k, t, ("en", None, "xx")[k % 3], 0) for k, t in enumerate(corpus())] + [(None, "a", "en", 1), (3, None, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra int")
    got = quality.quality(df, carry=("doc_id", "text", "extra")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in (*quality.BASE, "base_failed")) == brute(r.text)
        assert not (r.base_failed and r.kept)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    n = len(corpus())
    assert not by[n - 4].kept and not by[n - 3].kept and not by[n - 4].base_failed
    assert all(by[k].kept for k in range(9, 39))
    assert quality.quality(df.limit(0)).count() == 0
    odd = df.withColumnRenamed("extra", "kept")
    assert quality.quality(odd, carry=("doc_id", "kept")).columns == ["doc_id", *quality.BASE, "base_failed", "chars_distance", "words_distance", "kept"]
    stay = quality.accepted(odd)
    assert stay.columns == odd.columns and stay.count() == sum(r.kept for r in got)


def test_references_cover_all_passing_documents(spark):
    rows = [(k, t, "en") for k, t in enumerate(corpus())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    chars, words = quality.references(df)["en"]
    passing = [t for t in corpus() if not brute(t)[-1]]
    assert chars.sum() == sum(len(t) for t in passing)
    assert words[0] == sum(w.strip(quality.STRIP).lower() == "the" for t in passing for w in WORD.findall(t))


def test_distance():
    import numpy as np

    assert quality.js_distance(np.array([1, 0]), np.array([0, 5])) == pytest.approx(1)
    assert quality.js_distance(np.array([2, 2]), np.array([5, 5])) == pytest.approx(0)
    assert quality.js_distance(np.array([0, 0]), np.array([5, 5])) == 0


def plain_verdicts(rows):
    """kept of (text, lang) rows, with counters and sums written out."""
    import math
    from collections import Counter

    strip = quality.STRIP
    passing = [(t, lang) for t, lang in rows if not brute(t)[-1]]
    classes = lambda t: Counter(int(quality.TABLE[ord(c)]) if ord(c) < len(quality.TABLE) else 8 for c in t)

    def common(t, lang):
        known = quality.COMMON[lang].split()
        return Counter(known.index(w) if (w := x.strip(strip).lower()) in known else -1 for x in WORD.findall(t))

    refs = {}
    for t, lang in passing:
        if lang in quality.COMMON:
            a, b = refs.setdefault(lang, (Counter(), Counter()))
            a.update(classes(t))
            b.update(common(t, lang))

    def distance(p, q):
        n, m = sum(p.values()), sum(q.values())
        if not n or not m:
            return 0.0
        total = 0.0
        for k in set(p) | set(q):
            x, y = p[k] / n, q[k] / m
            total += sum(v * math.log2(2 * v / (x + y)) for v in (x, y) if v)
        return math.sqrt(max(total / 2, 0))

    out = []
    for t, lang in rows:
        if brute(t)[-1]:
            out.append(False)
            continue
        n, words, judged = len(t), len(WORD.findall(t)), []
        for one in [lang] if lang in refs else list(refs):
            a = distance(classes(t), refs[one][0]) if n >= 100 else 0.0
            b = distance(common(t, one), refs[one][1]) if words >= 30 else 0.0
            judged.append((a + b, a <= 0.25 + 1.5 / math.sqrt(n) and b <= 0.27 + 0.6 / math.sqrt(words)))
        out.append(min(judged, key=lambda x: x[0])[1] if judged else True)
    return out


def test_verdicts_equal_brute_force(spark):
    import duckdb

    some = duckdb.connect().execute("select text, lang from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    rows = [*some, *((t, ("en", None, "xx")[k % 3]) for k, t in enumerate(corpus()))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality.quality(df).collect()}
    want = plain_verdicts(rows)
    assert [got[k] for k in range(len(rows))] == want and True in want and False in want
