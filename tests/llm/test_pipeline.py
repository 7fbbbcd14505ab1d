"""The pipeline over the smallest documents against the stages written out by brute force."""

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_neardup import brute as neardup_brute
from tests.llm.test_pii import brute as base_spans
from tests.llm.test_quality import brute as base_counts
from tracewright.llm import decontaminate, pii, quality
from tracewright.llm.common import words_of
from tracewright.llm.queries import word_bpe

DIR = "/root/testdata/sf0.001"


def test_equals_brute_force(spark):
    con = duckdb.connect()
    rows = con.execute(f"select doc_id, text, lang from '{DIR}/documents.parquet'").fetchall()
    bench = con.execute(f"select text from '{DIR}/benchmark.parquet'").fetchall()
    passing = [r for r in rows if not base_counts(r[1])[-1]]
    width = len(quality.CLASSES)
    sums = {}
    for _, t, lang in passing:
        sums[lang] = sums.get(lang, 0) + np.concatenate([quality.class_counts(t), quality.word_counts(words_of(t), lang, {})])
    refs = {k: (v[:width], v[width:]) for k, v in sums.items()}
    good = [(i, t) for i, t, lang in passing if quality.judge(t, words_of(t), lang, refs, {})[2]]
    single = {i for i, c, _ in neardup_brute(good) if i == c}
    clean = {i: t for i, t in good if i in single and not any(b in t for (b,) in bench)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert set(got) == set(clean)
    library = Tokenizer.from_file(word_bpe())
    plain = 0
    for i, t in clean.items():
        spans = base_spans(t)
        if not spans and not any(c in t for c in "=_0123456789"):
            plain += 1
            assert list(got[i].ids) == library.encode(t, add_special_tokens=False).ids
        for kind, a, b in spans:
            assert kind in pii.KINDS and t[a:b].lower() not in got[i].decoded.replace("</w>", "").replace(" ", "")
    assert plain > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns


def test_odd_rows_and_names(spark):
    good = "The cat and the dog of that house are in the garden with it, for he was on the way to be by the tree. "
    other = "It was not that long a day and they had this to do in all of the rooms that he was shown by her at the end. "
    rows = [(1, good, "en", "a", 1, "x"), (1, good, "en", "a", 1, "x"), (None, other + "Mail a@b.org.", None, None, None, None), (2, None, "en", "a", 0, "y"), (3, "", None, "b", 0, None), (4, good * 400, "en", "a", 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").withColumn("class_id", F.lit(5))
    for empty in (False, True):
        some = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            some = stage(spark, some, DIR)
            assert some.columns == docs.columns
        got = sorted((r.doc_id or 0, r.text[-8:], r.kept or "") for r in some.collect())
        assert got == ([] if empty else [(0, "[EMAIL].", ""), (1, good[-8:], "x")])
        last = corpus_pipeline.STAGES[-1][1](spark, some, DIR)
        assert last.columns == ["doc_id", "n_tokens", "ids", "decoded"] and last.count() == len(got)
    one = spark.createDataFrame([(None, None, None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    counts = [stage(spark, one, DIR).count() for _, stage in corpus_pipeline.STAGES]
    assert counts == [0, 1, 2, 2, 2]


def test_decontamination_fits_on_every_passage(spark, tmp_path, monkeypatch):
    """At its own weights, with more passages than they weigh together: the basis is the one of all passages written out."""
    d, rng = decontaminate, np.random.default_rng(4)
    lengths = rng.integers(1, 500, 2_400)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 20_000, n)) for n in lengths]
    items = [" ".join(f"w{k}" for k in rng.integers(0, 20_000, 30)) for _ in range(5)]
    texts[7] = f"{texts[7]} {items[2]}"
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made, basis = [], d.basis
    monkeypatch.setattr(d, "basis", lambda *given: made.append(basis(*given)) or made[-1])
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(range(len(texts))) - {7}

    found = [d.bucket(d.words(t)) for t in texts]
    counts = sum(np.bincount(np.unique(x), minlength=d.DIM) for x in found)
    idf = np.where(counts > d.MAX_DF * len(texts), 0.0, np.log((len(texts) + 1) / (counts + 1)))
    cut = [x[at : at + 48] for x in found for at in range(0, len(x), 48)]
    assert len(cut) > 12_000
    rows = [(x, 8_000 / len(cut)) for x in cut] + [(d.bucket(d.words(t)), d.ITEM_WEIGHT**2) for t in items]
    q = d.orthonormal(np.random.default_rng(5).standard_normal((d.DIM, d.RANK)))
    for _ in range(2):
        z = np.zeros((d.DIM, d.RANK))
        for x, weight in rows:
            cols, tf = np.unique(x, return_counts=True)
            v = tf * idf[cols]
            if v.any():
                v /= np.sqrt(v @ v)
                z[cols] += weight * v[:, None] * (v @ q[cols])
        q = d.orthonormal(z)
    # cosines of the angles between the two spans
    assert len(made) == 1 and np.linalg.svd(made[0].T @ q, compute_uv=False).min() > 0.999
