import pytest
from pyspark.sql import functions as F

from postscreen.functions import remove_emoji
from postscreen.operators import bayes
from postscreen.operators.errors import leaked
from postscreen.operators.report import value_counts
from postscreen.plans import datasets, training
from postscreen.sources import models
from postscreen.sources.posts import read_posts
from tests.conftest import layouts, rows


def test_build_scraped(spark):
    first = spark.createDataFrame(
        [("a", 1, 2, "t1", None, "x")],
        "text string, repostCount int, replyCount int, createdAt string, `link/uri` string, only1 string",
    )
    second = spark.createDataFrame(
        [("b", 3, 4, "t2", "http://x", "alt")],
        "text string, repostCount int, replyCount int, createdAt string, `link/uri` string, `images/0/alt` string",
    )
    got = datasets.build_scraped(first, second)
    assert got.columns == [*datasets.SCRAPED_COLUMNS, "depressive"]
    assert rows(got) == [("a", 1, 2, 0, 0, "t1", 0), ("b", 3, 4, 1, 1, "t2", 0)]


def test_valid_and_rejected_labels_cover_the_table(edge):
    valid, rejected = datasets.valid_labels(edge), datasets.rejected_labels(edge)
    assert sorted(r["ord"] for r in valid.collect()) == list(range(10))
    assert sorted(r["ord"] for r in rejected.collect()) == [10, 11, 12]
    assert dict(valid.dtypes)["depressive"] == "int"


def test_build_final(spark, edge):
    extra = spark.createDataFrame(
        [(0, "p", 0.0), (1, "p", 1.0), (2, "q \U0001f600", 1.0), (3, "q \U0001f600", 0.0), (4, "r", None)],
        "ord long, text string, depressive double",
    )
    for df in layouts(extra, "ord"):
        got = datasets.build_final(edge, df, ["ord"])
        assert got.columns == ["text", "depressive"]
        # "p" is first seen as 0 and vanishes; emoji removal makes "tea " a duplicate, which stays.
        assert sorted(r["depressive"] for r in got.collect()) == [0] * 6 + [1] * 5
        assert got.filter("text = 'tea '").count() == 2
        assert got.filter("text = 'q '").count() == 1
    assert rows(value_counts(got, "depressive")) == [(0, 6), (1, 5)]


def test_clean_texts(edge):
    without = edge.withColumn("text", remove_emoji(F.col("text")))
    for df in layouts(without, "ord"):
        kept = [r["ord"] for r in datasets.clean_texts(df, ["ord"]).collect()]
        assert sorted(kept) == [0, 1, 4, 7, 9, 10, 11, 12]
    lowered = datasets.clean_texts(without, ["ord"], lowercase=True)
    assert 1 not in [r["ord"] for r in lowered.collect()]
    # The parity switch keeps one row of missing texts.
    words = datasets.clean_texts(without, ["ord"], null_text="nan").filter("text = 'nan'")
    assert [r["ord"] for r in words.collect()] == [3]


def test_text_expressions_run_once_before_the_blank_test(edge):
    without = edge.withColumn("text", remove_emoji(F.col("text")))
    plan = datasets.clean_texts(without, ["ord"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_build_unlabelled(spark):
    df = spark.createDataFrame([(1, "a", "x")], "id long, text string, other string")
    assert rows(datasets.build_unlabelled(df)) == [(1, "a", 0)]
    with pytest.raises(ValueError):
        datasets.build_unlabelled(df.drop("id"))


@pytest.fixture(scope="module")
def posts(spark):
    kinds = F.array(*[F.lit(w) for w in ("rain alone cry", "sun tea music", "walk tea alone", "sun rain")])
    return spark.range(400).select(
        "id",
        F.concat_ws(" ", F.get(kinds, (F.col("id") * 7 % 4).cast("int")), F.concat(F.lit("w"), F.col("id") % 90)).alias("text"),
        (F.col("id") * 7 % 4 == 0).cast("int").alias("depressive"),
    )


def test_prepare(posts):
    data = datasets.prepare(posts, "id", exact=True)
    texts = posts.select("text").distinct().count()
    assert data.table.count() == texts
    assert data.val.count() == -(-texts // 5)
    counts = {r["depressive"]: r["count"] for r in data.train.groupBy("depressive").count().collect()}
    assert counts[0] == counts[1]
    assert leaked(data.train, data.val, "text").count() == 0
    single = datasets.prepare(posts, "id", mode=None)
    assert single.train.count() == single.weighted.count()
    assert set(single.train.columns) == {"id", "text", "depressive", "copy"}


def test_weights_stand_for_copies(posts):
    data = datasets.prepare(posts, "id")
    repeated = bayes.fit_nb(data.train, "text", "depressive")
    weighted = bayes.fit_nb(data.weighted, "text", "depressive", weight="copies")
    assert weighted.log_prior == repeated.log_prior == (0.0,)
    assert rows(weighted.weights.select("token", "w")) == rows(repeated.weights.select("token", "w"))


@pytest.mark.parametrize("kind", ["bayes", "linear"])
def test_train_and_report_errors(posts, kind):
    data = datasets.prepare(posts, "id")
    trained = training.train(data, "id", kind)
    figures = trained.metrics.first()
    assert figures["accuracy"] > 0.6
    assert figures["tn"] + figures["fp"] + figures["fn"] + figures["tp"] == data.val.count()
    assert trained.loss.first()["loss"] > 0
    everything = posts.select("id", "text", "depressive")
    report = training.error_report(trained.model, everything, "id")
    counts = {r["kind"]: r["distinct_texts"] for r in report.summary.collect()}
    assert report.false_positives.count() == counts.get("false_positive", 0)
    assert report.false_negatives.count() == counts.get("false_negative", 0)
    assert report.false_positives.filter("depressive <> 1").count() == 0
    assert report.false_negatives.filter("depressive <> 0").count() == 0


@pytest.mark.parametrize("in_sample", [False, True])
def test_stacking(posts, in_sample):
    data = datasets.prepare(posts, "id")
    trained = training.train_stacked(data, "id", in_sample)
    assert trained.scores.count() == data.val.count()
    assert trained.metrics.first()["accuracy"] > 0.6


def test_stacked_model_is_of_two_kinds_saved_and_scores_posts(spark, posts, tmp_path):
    lowered = posts.withColumn("text", F.lower("text"))
    data = datasets.prepare(lowered, "id", lowercase=True)
    features = training.meta_features(data, "id").toPandas()
    assert len(features) == data.weighted.count()
    assert (features["p_a"] != features["p_b"]).mean() > 0.9
    trained = training.train_stacked(data, "id")
    models.save_model(spark, trained.model, f"{tmp_path}/model")
    again = models.load_model(spark, f"{tmp_path}/model")
    want = {r["id"]: round(r["p1"], 9) for r in trained.scores.collect()}
    got = training.score_posts(again, data.val, "id").collect()
    assert {r["id"]: round(r["p1"], 9) for r in got} == want
    report = training.error_report(again, lowered.select("id", "text", "depressive"), "id")
    training.write_error_report(report, str(tmp_path / "errors"), "stacked")
    for name, kind in (("false_positives", 1), ("false_negatives", 0)):
        back = read_posts(spark, f"{tmp_path}/errors/stacked/{name}", "id long, text string, depressive int")
        assert back.count() == getattr(report, name).count() and back.filter(F.col("depressive") != kind).isEmpty()


def test_unknown_kind(posts):
    with pytest.raises(ValueError):
        training.train(datasets.Prepared(posts, posts, posts, posts), "id", "other")


def test_stateless_steps_also_run_on_a_stream(spark, edge, tmp_path):
    edge.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(edge.schema).parquet(f"{tmp_path}/in")
    cleaned = datasets.drop_blank(
        datasets.valid_labels(stream.withColumn("text", remove_emoji(F.col("text"))))
    )
    query = (
        cleaned.writeStream.format("parquet")
        .option("checkpointLocation", f"{tmp_path}/state")
        .trigger(availableNow=True)
        .start(f"{tmp_path}/out")
    )
    query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["ord"] for r in got.collect()) == [0, 1, 2, 4, 7, 8, 9]
