"""Ids named like result columns, null ids, sampling by hash and the removal of intermediate tables."""

import os

import pytest
from pyspark.sql import functions as F

from tracewright.llm import common, decontaminate, lengths, neardup, ordinal, substring
from tracewright.llm.queries import word_bpe

TEXT = "the one of these words and that one of the others in a row of it " * 4


def table(spark, name):
    return spark.createDataFrame([(1, TEXT), (None, TEXT), (2, None), (3, "")], f"{name} long, text string")


@pytest.mark.parametrize("name", ["class_id", "n_links", "sig", "__id"])
def test_near_duplicates(spark, name):
    got = neardup.classes(table(spark, name), name)
    assert got.columns == [name, *[c for c in ("class_id", "n_links") if c != name]]
    assert got.count() == 4


@pytest.mark.parametrize("name", ["n_words", "kept_text", "batch", "id"])
def test_substrings(spark, name):
    got = substring.dedup(table(spark, name), name)
    assert got.columns == [name, *[c for c in ("n_words", "n_removed", "kept_text") if c != name]]
    assert sorted((r[name] or 0) for r in got.collect()) == [0, 1, 2, 3]


def test_classifier(spark):
    df = table(spark, "selected")
    model = ordinal.fit(df.withColumn("g", F.lit(1)), F.col("g"), 3, id_col="selected")
    got = ordinal.score(df, model, tail=2, id_col="selected")
    assert got.columns == ["selected", "expected_grade", "tail_probability"] and got.count() == 4


def test_decontamination(spark):
    bench = spark.createDataFrame([(9, TEXT)], "cosine long, text string")
    got = decontaminate.leaks(table(spark, "cosine"), bench, "cosine", item_col="cosine")
    assert got.columns == ["cosine", "cosine_item", "lcs_share"]
    assert sorted((r[0] or 0, r[1]) for r in got.collect()) == [(0, 9), (1, 9)]
    assert decontaminate.clean(table(spark, "cosine"), bench.withColumnRenamed("cosine", "item_id"), "cosine").count() == 2


def test_histogram(spark):
    got = lengths.histogram(table(spark, "n_docs"), word_bpe(), "n_docs")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 2), (64, 2)]


def test_lowest_hashes_equal_a_full_ordering(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("g")).unionByName(spark.createDataFrame([(None, 1)] * 3, "id long, g long"))
    key = F.xxhash64(F.col("id").cast("string"))
    for n in (1, 40, 4999, 9000):
        want = [tuple(r) for r in df.orderBy(key, "id", "g").limit(n).collect()]
        assert [tuple(r) for r in common.lowest_hashes(df, "id", n, "g").collect()] == want
    one = spark.createDataFrame([(5, k) for k in range(300)], "id long, g long")  # one id only
    assert common.lowest_hashes(one, "id", 10, "g").count() == 10


def test_drop_written(spark):
    common.drop_written(spark)
    a, b = common.materialize(spark.range(3).toDF("x"), "a"), common.materialize(spark.range(4).toDF("x"), "b")
    folders = [f.removeprefix("file:").rsplit("/", 1)[0] for f in (a.inputFiles()[0], b.inputFiles()[0])]
    kept = substring.dedup(table(spark, "doc_id"))
    assert kept.count() == 4
    assert spark.catalog.tableExists(common._written[-1][0])
    name = common._written[-1][0]
    common.drop_written(spark, keep=1)
    assert not any(map(os.path.exists, folders)) and spark.catalog.tableExists(name)
    common.drop_written(spark)
    assert not spark.catalog.tableExists(name)
