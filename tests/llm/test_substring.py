import random
from collections import Counter

from tracewright.llm import substring
from tracewright.llm.common import words_of


def brute(texts):
    docs = [words_of(t or "") for t in texts]
    n = substring.LENGTH
    seen = Counter(tuple(d[i : i + n]) for d in docs for i in range(len(d) - n + 1))
    out = []
    for d in docs:
        gone = {k for i in range(len(d) - n + 1) if seen[tuple(d[i : i + n])] > 1 for k in range(i, i + n)}
        out.append((len(d), len(gone), " ".join(w for k, w in enumerate(d) if k not in gone)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 57, 90, 200)]
    out = [None, "", " \t\n", "one two", "a " * 34, "a " * 35, "a " * 36, "x y " * 60]
    for _ in range(120):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [word() for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                i = rng.randint(0, 20)
                words += p[i : i + rng.randint(20, 200)]
        out.append(rng.choice([" ", "\n", "\t "]).join(words))
    base = [word() for _ in range(150)]
    for _ in range(40):
        copy = list(base)
        copy[rng.randrange(150)] = word()
        out.append(" ".join(copy))
    return out + out[20:25]


def test_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))
    assert substring.LENGTH == substring.PERIOD + substring.ANCHOR - 1


def test_word_hashes():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n\té ") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    seen = {}
    for t in texts:
        words = words_of(t)
        h = substring.word_hashes(t.encode())
        assert len(h) == len(words)
        for w, x in zip(words, h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_equals_brute_force(spark, monkeypatch):
    for seed, size in ((1, 2000), (2, 10**6)):
        monkeypatch.setattr(substring, "PACK_CHARS", size)
        texts = corpus(seed)
        df = spark.createDataFrame([(k % 150, t, "b") for k, t in enumerate(texts)], "doc_id long, text string, batch string").repartition(3)
        got = Counter((r.n_words, r.n_removed, r.kept_text) for r in substring.dedup(df).collect())
        assert got == Counter(brute(texts))
    assert substring.dedup(df.limit(0)).count() == 0
