import random

import numpy as np

from tracewright.llm import decontaminate as d


def made(seed=3):
    rng = random.Random(seed)
    rare = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(4, 9)))
    text = lambda n: " ".join(rng.choice(["the", "of", "and", "in", "it"]) if rng.random() < 0.5 else rare() for _ in range(n))
    items = [text(rng.randint(15, 60)) + (". " + text(5) if k % 2 else "? " + rare()) for k in range(20)]
    docs, truth = [], []
    for k in range(150):
        body = text(rng.randint(1, 300))
        if k % 5 == 0:
            j = rng.randrange(20)
            words = items[j].split()
            if k % 10 == 0:  # a paraphrase: some words change, some go, case and marks differ
                words = [rare() if rng.random() < 0.1 else w.upper() for w in words[:-1] if rng.random() > 0.05] + words[-1:]
            body = f"{body} {', '.join(words) if k % 3 == 0 else ' '.join(words)} {text(40)}"
            truth.append((k, j))
        docs.append((k, body))
    return items, docs, truth


def test_finds_exact_and_paraphrased_items_and_nothing_else(spark):
    items, docs, truth = made()
    df = spark.createDataFrame([(*r, 9) for r in docs] + [(0, docs[0][1], 9), (None, None, None), (900, "", 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*enumerate(items), (77, None), (78, "  ")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in d.leaks(df, bench).collect())
    assert got == sorted([*truth, *(t for t in truth if t[0] == 0)])
    kept = d.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - len(got)
    assert d.leaks(df.limit(0), bench).count() == 0
    assert d.leaks(df, bench.limit(0)).count() == 0


def test_lcs_and_windows():
    rng = random.Random(8)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *row[1:]] if not b else row
            old = list(row)
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        return row[-1]

    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 90))] for _ in range(2))
        assert d.lcs(d._mask(np.array(a, np.uint64)), len(a), b) == plain(a, b)
    x = np.arange(40, dtype=np.float64)[:, None] ** 2
    for size in range(1, 20):
        assert np.allclose(d.windows(x, size)[:, 0], [x[k : k + size].sum() for k in range(40 - size + 1)])


def brute(docs, items):
    out = set()
    for k, text in docs:
        doc = d.words(text)
        for j, item in enumerate(d.item_of(j, x) for j, x in enumerate(items)):
            n = len(item.words)
            if d.judge(doc, item, d._mask(item.words), d._mask(item.words[n - item.answer :]), [(0, -(-len(doc) // d.STEP), 1.0)]):
                out.add((k, j))
    return out


def test_widespread_and_common_items_are_found(spark):
    items, docs, _ = made(5)
    rng = random.Random(6)
    items.append(" ".join(rng.choice(["the", "of", "and", "in", "it"]) for _ in range(30)))
    copied = f"{docs[1][1]} {items[2]} {docs[2][1]}"
    docs += [(1000 + k, copied) for k in range(75)]  # a third of the rows
    docs += [(2000 + k, f"{body} {items[3]} {docs[149 - k][1]}") for k, (_, body) in enumerate(docs[:30])]  # different texts of one passage
    docs += [(3000, items[-1]), (3001, f"{docs[4][1]} {items[-1]} {docs[6][1]}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.leaks(df, bench).collect()}
    assert got >= {(1000 + k, 2) for k in range(75)} | {(2000 + k, 3) for k in range(30)} | {(3000, 20), (3001, 20)}
    assert got == brute(docs, items)
    assert {r.doc_id for r in d.clean(df, bench).collect()} == {k for k, _ in docs} - {k for k, _ in got}


def test_fit_takes_every_passage_of_every_text(spark):
    """What the fit adds up is that of all passages, one by one, also where they are more than their weight."""
    _, docs, _ = made(7)
    docs += [(500, None), (501, ""), (502, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    counts, n, uses, passages, kept = d.survey(df, "doc_id", "text")
    found = [d.bucket(d.words(t)) for _, t in docs]
    cut = [x[at : at + d.PASSAGE] for x in found for at in range(0, len(x), d.PASSAGE)]
    assert n == len(docs) and passages == len(cut)
    assert np.array_equal(uses, np.bincount(np.concatenate(found), minlength=d.DIM))
    assert np.array_equal(counts, sum(np.bincount(np.unique(x), minlength=d.DIM) for x in found))
    got = []
    for r in kept.collect():
        ends = np.cumsum(np.frombuffer(r.sizes, np.uint8).astype(int))
        got += np.split(np.frombuffer(r.words, np.uint16).astype(int), ends[:-1])
    assert sorted(x.tolist() for x in got) == sorted(x.tolist() for x in cut)

    idf = np.where(counts > 20, 0.0, np.log((n + 1) / (counts + 1)))
    vectors = []
    for x in cut:
        cols, tf = np.unique(x, return_counts=True)
        v = tf * idf[cols]
        if v.any():
            vectors.append((cols, v / np.sqrt((v * v).sum())))
    q = d.orthonormal(np.random.default_rng(5).standard_normal((d.DIM, 8)))
    want = np.zeros((d.DIM, 8))
    for cols, v in vectors:
        want[cols] += v[:, None] * (v @ q[cols])
    z = np.zeros((d.DIM, 8), np.float32)
    d._added(z, np.concatenate(cut), np.array([len(x) for x in cut]), idf, q)
    assert np.allclose(z, want, atol=1e-6)
    one, other = d.basis(kept, 0.1, idf, [], 8, 1), d.orthonormal(want)
    assert np.allclose(one.T @ other @ other.T @ one, np.eye(8), atol=1e-3)


def test_clean_fits_on_all_passages(spark, monkeypatch):
    """As the pipeline calls it: more passages than they weigh together, and all of them reach the fit."""
    items, docs, truth = made(9)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    seen, basis = [], d.basis
    monkeypatch.setattr(d, "FIT_WEIGHT", 50)
    monkeypatch.setattr(d, "basis", lambda passages, *rest: seen.append(sum(len(r.words) // 2 for r in passages.collect())) or basis(passages, *rest))
    assert {r.doc_id for r in d.clean(df, bench).collect()} == {k for k, _ in docs} - {k for k, _ in truth}
    assert seen == [sum(len(d.words(x)) for _, x in docs)]


def test_texts_hashed_together_are_as_each_alone(monkeypatch):
    _, docs, _ = made(11)
    texts = [None, "", *(t for _, t in docs), " \n", "ΟΔΟΣ", "Σ.", "", "\udc80 İstanbul a-b", "x" * 3000, None]
    for size in (1, 500, 1 << 17):
        monkeypatch.setattr("tracewright.llm.substring.GROUP_BYTES", size)
        got = d.words_each(texts)
        assert len(got) == len(texts) and all(np.array_equal(x, d.words(t)) for x, t in zip(got, texts, strict=True))


def test_skipped_windows_reach_no_item(monkeypatch):
    """Windows go uncompared, and those only that are too short in latent space for any item."""
    items, docs, _ = made(13)
    found = [d.item_of(k, t) for k, t in enumerate(items)]
    uses = np.bincount(d.bucket(np.concatenate([d.words(t) for _, t in docs])), minlength=d.DIM)
    idf = np.where(uses > 100, 0.0, np.log(1e4 / (uses + 1)))
    z = np.zeros((d.DIM, 16), np.float32)
    for x in found:
        d._added(z, d.bucket(x.words), np.array([len(x.words)]), idf, d.orthonormal(np.random.default_rng(5).standard_normal((d.DIM, 16))))
    weights = np.vstack([(idf[:, None] * d.orthonormal(z)).astype(np.float32), np.zeros((1, 16), np.float32)])
    squares = np.append(idf**2, 0).astype(np.float32)
    scales = d.scales_for([len(x.words) for x in found])
    index = d.Index(weights, squares, found, d.projections(found, weights, squares), scales, d.seeds(found, uses))
    index.seeds.known[:] = False  # the latent search alone
    offered, judge = [], d.judge
    monkeypatch.setattr(d, "judge", lambda doc, item, whole, answer, hits: offered.append((len(doc), item.ident, hits)) or judge(doc, item, whole, answer, hits))
    windows, want = 0, {}
    for _, text in docs:
        h = d.words(text)
        flat = np.full(-(-len(h) // d.STEP) * d.STEP, d.DIM)
        flat[: len(h)] = d.bucket(h)
        sums, norms = weights[flat].reshape(-1, d.STEP, 16).sum(axis=1), squares[flat].reshape(-1, d.STEP).sum(axis=1)
        for size in scales:
            for s in range(max(1, len(sums) - size + 1)):
                windows += 1
                dots = index.vectors @ sums[s : s + size].sum(axis=0) / np.sqrt(max(norms[s : s + size].sum(), 1e-9))
                for k in np.flatnonzero(dots >= 1).tolist():
                    want.setdefault((len(h), k), []).append((s, size, float(dots[k])))
    compared = []
    monkeypatch.setattr(d, "reachable", lambda *args, real=d.reachable: compared.append(real(*args)) or compared[-1])
    d.search([t for _, t in docs], index)
    got = {}
    for n, k, hits in offered:
        got.setdefault((n, k), []).extend(hits)
    firm = lambda x: sorted((at, size) for at, size, c in x if c > 1.0001)
    assert {k: firm(v) for k, v in got.items() if firm(v)} == {k: firm(v) for k, v in want.items() if firm(v)} != {}
    assert sum(map(len, compared)) < windows


def test_sums_do_not_depend_on_what_is_taken_at_a_time(monkeypatch):
    _, docs, _ = made(12)
    flat = np.concatenate([d.bucket(d.words(t)) for _, t in docs])
    sizes = d._cut(np.array([len(flat)]))
    idf = np.ones(d.DIM)
    q = d.orthonormal(np.random.default_rng(5).standard_normal((d.DIM, 8)))
    sums = []
    for block, gather in ((1, 1), (7, 16), (1 << 14, 2048)):
        monkeypatch.setattr(d, "BLOCK", block)
        monkeypatch.setattr(d, "GATHER", gather)
        z = np.zeros((d.DIM, 8), np.float32)
        d._added(z, flat, sizes, idf, q)
        sums.append(z)
    assert sums[0].any() and all(np.allclose(sums[0], x, atol=1e-5) for x in sums[1:])
