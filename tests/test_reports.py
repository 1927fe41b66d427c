import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from postscreen.operators.errors import (
    false_negatives,
    false_positives,
    first_errors,
    leaked,
    outcome_summary,
    true_positives,
)
from postscreen.operators.metrics import compare, confusion, log_loss, metrics
from postscreen.operators.report import (
    box_outliers,
    box_summary,
    frequency_report,
    head,
    profile,
    value_counts,
)
from tests.conftest import layouts, rows


def test_value_counts_excludes_missing_and_orders_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in [1, 0, 0, 2, 1, None, 3]], "v int")
    assert [tuple(r) for r in value_counts(df, "v").collect()] == [(0, 2), (1, 2), (2, 1), (3, 1)]
    shares = [round(r["share"], 6) for r in frequency_report(df, "v").collect()]
    assert shares == [0.333333, 0.333333, 0.166667, 0.166667]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "k long, `a/b` string")
    assert rows(profile(df)) == [("a/b", "string", 2, 1), ("k", "bigint", 2, 2)]


def test_box_summary_agrees_with_numpy(spark):
    generator = random.Random(3)
    sizes = [generator.randint(20, 40) for _ in range(30)] + [200, 1]
    df = spark.createDataFrame([(c,) for c, n in enumerate(sizes) for _ in range(n)], "c int")
    got = box_summary(df, "c").first()
    q1, median, q3 = np.percentile(sizes, [25, 50, 75])
    inside = [s for s in sizes if q1 - 1.5 * (q3 - q1) <= s <= q3 + 1.5 * (q3 - q1)]
    assert (got["n"], got["q1"], got["median"], got["q3"]) == (32, q1, median, q3)
    assert (got["whisker_low"], got["whisker_high"]) == (min(inside), max(inside))
    assert got["n_outliers"] == len(sizes) - len(inside) == 2
    assert rows(box_outliers(df, "c")) == [(30, 200), (31, 1)]


def test_box_summary_of_nothing(spark):
    got = box_summary(spark.createDataFrame([], "c int"), "c").first()
    assert (got["n"], got["q1"], got["whisker_low"], got["n_outliers"]) == (0, None, None, 0)


def test_head(spark):
    df = spark.range(30).repartition(5)
    assert [r["id"] for r in head(df, ["id"], 3).collect()] == [0, 1, 2]
    assert head(df, ["id"], 0).count() == head(df, ["id"], -1).count() == 0


@pytest.fixture(scope="module")
def scored(spark):
    # k, text, truth, prediction, probability
    data = [
        (0, "a", 0, 0, 0.1),
        (1, "b", 0, 1, 0.9),
        (2, "b", 0, 1, 0.8),
        (3, "c", 1, 0, 0.2),
        (4, "d", 1, 1, 0.7),
        (5, "c", 1, 0, 0.4),
        (6, "b", 1, 0, 0.3),
        (7, "e", 0, 0, 0.0),
    ]
    return spark.createDataFrame(data, "k long, text string, y int, pred int, p1 double")


def test_confusion_cells_sum_to_rows(scored):
    cells = confusion(scored, "y", "pred").first()
    assert tuple(cells) == (2, 2, 3, 1)
    assert sum(cells) == scored.count()


def test_metrics(scored):
    got = metrics(scored, "y", "pred").first()
    assert (got["accuracy"], got["precision"], got["recall"]) == (0.375, round(1 / 3, 4), 0.25)
    assert got["f1"] == round(2 / 7, 4)


def test_metrics_without_predicted_positives_or_rows(spark, scored):
    none = scored.withColumn("pred", F.lit(0))
    got = metrics(none, "y", "pred").first()
    assert (got["precision"], got["recall"], got["f1"], got["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
    empty = metrics(scored.filter("k < 0"), "y", "pred").first()
    assert (empty["accuracy"], empty["tn"]) == (0.0, 0)


def test_metrics_per_run_and_step(scored):
    steps = scored.withColumn("run", F.lit("r")).withColumn("step", (F.col("k") % 2).cast("int"))
    got = {r["step"]: r["accuracy"] for r in metrics(steps, "y", "pred", ["run", "step"]).collect()}
    assert got == {0: 0.5, 1: 0.25}
    assert compare(steps, "y", "pred", "run").count() == 1


def test_log_loss_by_row_and_by_batch(scored):
    data = scored.orderBy("k").collect()
    p = [min(max(r["p1"], 1e-15), 1 - 1e-15) for r in data]
    terms = [-math.log(q if r["y"] == 1 else 1 - q) for q, r in zip(p, data, strict=True)]
    assert log_loss(scored, "y", "p1").first()["loss"] == pytest.approx(statistics.mean(terms))
    batches = [statistics.mean(terms[i : i + 3]) for i in range(0, 8, 3)]
    for df in layouts(scored, "k"):
        got = log_loss(df, "y", "p1", 3, ["k"]).first()["loss"]
        assert got == pytest.approx(statistics.mean(batches))
    with pytest.raises(ValueError):
        log_loss(scored, "y", "p1", 3)


def test_error_sets_flip_the_label(scored):
    fp = false_positives(scored, "y", "pred").select("k", "text", "y")
    assert rows(fp) == [(1, "b", 1), (2, "b", 1)]
    fn = false_negatives(scored, "y", "pred", relabel=False).select("k", "y")
    assert rows(fn) == [(3, 1), (5, 1), (6, 1)]
    assert rows(true_positives(scored, "y", "pred").select("k", "y")) == [(4, 1)]


def test_first_qualifying_row_per_text(scored):
    """Rows are filtered before texts are made distinct, so an earlier right row does not hide one."""
    for df in layouts(scored, "k"):
        fn = false_negatives(df, "y", "pred", distinct_text="text", order_by=["k"])
        assert rows(fn.select("k", "text", "y")) == [(3, "c", 0), (6, "b", 0)]
    with pytest.raises(ValueError):
        false_negatives(scored, "y", "pred", distinct_text="text")


def test_first_errors(scored):
    got = first_errors(scored, "false_negative", 2, ["k"], "y", "pred").collect()
    assert [r["k"] for r in got] == [3, 5]
    assert first_errors(scored, "false_negative", 0, ["k"], "y", "pred").count() == 0


def test_outcome_summary(scored):
    assert rows(outcome_summary(scored, "y", "pred", "text")) == [
        ("false_negative", 3, 2),
        ("false_positive", 2, 1),
        ("true_negative", 2, 2),
        ("true_positive", 1, 1),
    ]


def test_leaked(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    val = spark.createDataFrame([("a",), ("c",), (None,)], "text string")
    assert rows(leaked(train, val, "text")) == [("a", 2, 1)]
