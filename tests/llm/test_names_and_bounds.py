"""Working names that clash, samples and training rows that stay bounded under repeats."""

import importlib

import pytest
from pyspark.sql import functions as F

from postscreen.llm import jaccard, langid, licenses, toxicity, warc

NAMES = ("copies", "_row", "_key", "_raw", "_kind", "_letters", "_size", "_place", "_copy", "_toxic", "_copies", "_language", "_posterior", "row", "place")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    return rows.withColumns({n: F.concat(F.lit(f"{n}:"), F.col("doc_id")) for n in NAMES})


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_of_any_name(spark, docs, stage):
    _, f = importlib.import_module("corpus_pipeline").STAGES[stage]
    out = f(spark, docs, SF)
    assert out.columns == docs.columns
    found = out.collect()
    assert found and all(r[n] == f"{n}:{r['doc_id']}" for r in found for n in NAMES)


def test_operators_keep_columns_of_any_name(docs):
    train = docs.select("text", "lang")
    for out in (
        langid.predict(docs, "text", langid.fit(train, "text", "lang")),
        licenses.scan(docs, "text"),
        toxicity.score(docs, "text", toxicity.ToxicityModel([("worthless", True)], frozenset(), toxicity.smoothed({"": (0, 9)}))),
        jaccard.keep_one(docs),
    ):
        assert all(r[n] == f"{n}:{r['doc_id']}" for r in out.collect() for n in NAMES)


def test_dictionary_of_a_key_in_a_third_of_the_rows(spark, monkeypatch):
    data = [(1, f"<p>page {i} of one key</p>" * 5) for i in range(500)] + [(i, f"<h1>other {i}</h1>") for i in range(2, 1000)]
    data += [(5000 + i, "z" * (warc.SAMPLE_BYTES + 1)) for i in range(3)] + [(None, "no key"), (7000, None)]
    df = spark.createDataFrame(data, "page_id long, html string")
    given = []
    monkeypatch.setattr(warc.zstandard, "train_dictionary", lambda size, s: given.append(s) or warc.zstandard.ZstdCompressionDict(b"x" * 99))
    warc.train_dictionary(df, "page_id", F.col("html").cast("binary"))
    assert len(given[0]) == 200 == len(set(given[0])) and max(map(len, given[0])) <= warc.SAMPLE_BYTES


def test_training_rows_stay_bounded(spark):
    labels = spark.createDataFrame([(3, 0)] * 2000 + [(3, 1)] + [(i, i % 2) for i in range(10, 200)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(3, f"t{i}") for i in range(3000)] + [(i, "x") for i in range(10, 200)], "doc_id long, text string")
    rows = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", per_label=500)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    assert 0 < counts[0] <= 100 and 350 <= counts[1] <= 650


def test_texts_between_languages_stay(spark):
    docs = spark.createDataFrame([(1, "und", "en"), (2, "und", "fr"), (3, "123", "en"), (4, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs, "text", "lang")
    assert {r["doc_id"] for r in langid.keep_identified(docs, model).collect()} == {1, 2}
    none = langid.fit(docs.filter("lang is null"), "text", "lang")
    assert langid.keep_identified(docs, none).count() == 4
