import random

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import ordinal


def made(n, seed):
    rng = random.Random(seed)
    common = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(n):
        g = rng.randrange(3)
        words = [rng.choice(common) for _ in range(rng.randint(20, 120))]
        words[:3] = {0: ["idiot", "word1", "scum"], 1: ["meh", "word2", "word3"], 2: ["fine", "great", "word4"]}[g]
        rng.shuffle(words)
        rows.append((k, " ".join(words), g, "x"))
    return rows


def test_held_out_accuracy_and_order(spark):
    schema = "doc_id long, text string, grade int, selected string"
    train, test = spark.createDataFrame(made(900, 1), schema), spark.createDataFrame(made(300, 2) + [(None, None, None, None), (5, "", None, "")], schema)
    model = ordinal.fit(train, F.col("grade"), 3)
    assert (np.diff(model.thresholds) >= 0).all()
    truth = {k: g for k, _, g, _ in made(300, 2)}
    got = [r for r in ordinal.score(test, model, tail=2).collect()]
    assert len(got) == 302 and sum(not r.selected for r in got if r.doc_id is None) == 1
    hit = sum(r.selected == (truth[r.doc_id] == 2) for r in got if r.doc_id is not None and r.doc_id != 5)
    assert hit >= 0.9 * 299
    mean = [np.mean([r.expected_grade for r in got if r.doc_id is not None and truth[r.doc_id] == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert ordinal.score(test.limit(0), model, tail=2).count() == 0


def test_fit_is_bounded_and_neutral_without_rows(spark):
    df = spark.createDataFrame(made(60, 3), "doc_id long, text string, grade int, selected string")
    assert len(ordinal.train_rows(df, "doc_id", "text", F.col("grade"), 25)) == 25
    model = ordinal.fit(df.limit(0), F.col("grade"), 3)
    assert not model.weights.any()


def test_scores_equal_brute_force_and_the_fit_descends(spark):
    import math

    schema = "doc_id long, text string, grade int, selected string"
    rows = made(300, 7)
    train = spark.createDataFrame(rows, schema)
    model = ordinal.fit(train, F.col("grade"), 3)
    got = {r.doc_id: r for r in ordinal.score(train, model, tail=2).collect()}
    loss = start = 0.0
    for k, text, g, _ in rows:
        words = {w.strip(ordinal.STRIP).lower() for w in text.split()}
        idx, values = ordinal.features(text, {})
        assert {ordinal._hash(w) for w in words} | {ordinal._hash("^" + w[:5]) for w in words} == {int(i) for i, v in zip(idx, values, strict=True) if v == 0.5}
        s = sum(float(model.weights[i]) * float(v) for i, v in zip(idx, values, strict=True))
        tails = [1 / (1 + math.exp(-(s - th))) for th in model.thresholds]
        assert abs(got[k].expected_grade - sum(tails)) < 1e-4 and abs(got[k].tail_probability - tails[1]) < 1e-4
        if abs(tails[1] - 0.5) > 1e-3:
            assert got[k].selected == (tails[1] >= 0.5)
        p = [1.0, *tails, 0.0]
        q = [1.0, 1 / (1 + math.exp(-0.5)), 1 / (1 + math.exp(0.5)), 0.0]  # no weights, the first thresholds
        loss, start = loss - math.log(max(p[g] - p[g + 1], 1e-9)), start - math.log(q[g] - q[g + 1])
    assert loss < 0.3 * start
