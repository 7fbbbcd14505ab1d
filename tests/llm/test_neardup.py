import random

import numpy as np

from tracewright.llm import neardup
from tracewright.llm.common import words_of
from tracewright.llm.components import components


def grams(text):
    w = words_of(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    near = [[i != j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for j in range(n)] for i in range(n)]
    comp = list(range(n))
    for i in range(n):
        todo = [i]
        while todo:
            k = todo.pop()
            for j in range(n):
                if near[k][j] and comp[j] > comp[i]:
                    comp[j] = comp[i]
                    todo.append(j)
    least = {c: min(r[0] for r, d in zip(rows, comp, strict=True) if d == c) for c in comp}
    return sorted((r[0], least[c], sum(x)) for r, c, x in zip(rows, comp, near, strict=True))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    out = ["", " \n", "a b", "a b", "a b c", "x " * 50, "x " * 60]
    for n in (40, 120, 300):
        for _ in range(3):
            base = [word() for _ in range(n)]
            out.append(" ".join(base))
            for k in range(14):
                copy = list(base)
                for _ in range(max(1, n * (k % 7) // 150)):
                    copy[rng.randrange(n)] = word()
                out.append(rng.choice([" ", "\n"]).join(copy))
    out += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(40)] + out[10:14]
    return [(k, t) for k, t in enumerate(out)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)  # several blocks a group
    rows = corpus(3)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sig int").repartition(3)
    got = sorted(tuple(r) for r in neardup.classes(df).collect())
    assert got == brute(rows)


def test_odd_input(spark):
    df = spark.createDataFrame([(None, "a b"), (2, None), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in neardup.classes(df).collect())
    assert got == [(0, None, 0), (2, 2, 2), (2, 2, 2), (3, 2, 2)]
    assert neardup.classes(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands = neardup.bands_for(0.8, 0.9999, 6)
    assert 1 - (1 - 0.8**6) ** bands >= 0.9999 > 1 - (1 - 0.8**6) ** (bands - 1)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(150)] + [(5000, k) for k in range(5001, 5200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    import sys

    sys.setrecursionlimit(5000)
    for a, b in edges:
        root[find(a)] = find(b)
    same = {}
    for x, r in got.items():
        assert same.setdefault(find(x), r) == r
    assert len(set(same.values())) == len(same) and set(got) >= {x for e in edges if e[0] != e[1] for x in e}


def test_links_between():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint32)) for _ in range(30)]
    got = neardup.links_between(sets, sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == (5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)))
