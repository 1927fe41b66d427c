"""The regression over all folds at once, against a plain solver and single fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postscreen.operators import folded, folds, linear
from postscreen.sources import models
from postscreen.plans import training

WORDS = ["sad", "glad", "tired", "happy", "alone", "sun", "rain", "the"]
FEATURES = 1 << 8


@pytest.fixture(scope="module")
def table(spark):
    """Posts with ties, repeats, missing and empty texts, a missing label, copies, and columns that clash with working ones."""
    generator = np.random.default_rng(7)
    data = []
    for i in range(160):
        chosen = generator.choice(WORDS, size=generator.integers(1, 9))
        score = sum(w in ("sad", "tired", "alone") for w in chosen) - sum(w in ("glad", "happy") for w in chosen)
        data.append((i, " ".join(chosen), int(score + generator.normal() > 0), int(generator.integers(1, 4)), "x", i))
    data += [(200, None, 0, 1, "x", 1), (201, "", 1, 1, "x", 2), (202, "sad sad", None, 1, "x", 3), (203, "sun", 7, 1, "x", 4)]
    data += [(204, "rain rain", 1, None, "x", 5)]
    return spark.createDataFrame(data, "k long, text string, y int, copies int, row string, _counts long")


def by_hand(rows, weight):
    """Weights of the counts and the intercept, by Newton steps on the whole matrix."""
    x = np.zeros((len(rows), FEATURES))
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["n"]
    y, w = np.array([r["y"] for r in rows]), np.array([r["w"] for r in rows])
    total = w.sum()
    mean = w @ x / total
    deviation = np.sqrt(w @ (x - mean) ** 2 / (total - (w @ w) / total))
    live = (deviation > 0) & ((x > 0).sum(axis=0) < len(rows))
    z = np.column_stack([x[:, live] / deviation[live], np.ones(len(rows))])
    penalty = np.diag([weight] * live.sum() + [0.0])
    v = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ v))
        v -= np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) / total + penalty, z.T @ (w * (p - y)) / total + penalty @ v)
    out = np.zeros(FEATURES)
    out[live] = v[:-1] / deviation[live]
    return out, v[-1]


def test_all_folds_equal_a_plain_solver(table):
    fitted = folded.fit_folds(table, "k", "text", "y", 3, features=FEATURES, reg=0.01, max_iter=300, weight="copies", tol=1e-13)
    rows = [r for r in fitted.rows.collect() if r["w"] > 0]
    assert len(rows) == 162  # without the labels null and 7 and the null weight
    for slot, model in enumerate([*fitted.models, fitted.whole]):
        weights, intercept = by_hand([r for r in rows if r["fold"] != slot], 0.01)
        assert model.weights == pytest.approx(weights, abs=1e-4)
        assert model.intercept == pytest.approx(intercept, abs=1e-4)


def test_all_folds_equal_single_fits(table):
    known = table.filter("y in (0, 1) and copies is not null")
    fitted = folded.fit_folds(known, "k", "text", "y", 3, features=FEATURES, reg=0.05, max_iter=300, weight="copies", tol=1e-13)
    got = {r["k"]: r["p1"] for r in folded.out_of_fold(fitted).collect()}

    def fit(rows):
        return linear.fit_lr(rows, "text", "y", features=FEATURES, reg=0.05, max_iter=300, weight="copies")

    narrow = known.select("k", "text", "y", "copies")
    want = {r["k"]: r["p1"] for r in folds.out_of_fold(narrow, "k", fit, linear.score_lr, 3).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-3  # the single fits stop at a change of 1e-6


def test_scores_keep_all_rows_and_columns(table):
    model = folded.fit_linear(table, "text", "y", features=FEATURES, weight="copies")
    scored = folded.score_linear(model, table.withColumn("fold", F.lit("mine")), "text")
    assert scored.columns == [*table.columns, "fold", "p1", "pred"]
    assert scored.count() == table.count() and scored.filter("p1 is null or p1 < 0 or p1 > 1").isEmpty()
    p1 = {r["k"]: r["p1"] for r in scored.collect()}
    assert p1[200] == p1[201] == pytest.approx(1 / (1 + np.exp(-model.intercept)))
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_key_are_in_no_fold(table):
    lost = table.withColumn("k", F.when(F.col("k") >= 5, F.col("k")))
    fitted = folded.fit_folds(lost, "k", "text", "y", 3, features=FEATURES, weight="copies")
    assert folded.out_of_fold(fitted).count() == table.count() - 5
    kept = folded.fit_folds(lost.filter("k is not null"), "k", "text", "y", 3, features=FEATURES, weight="copies")
    for a, b in zip(fitted.models, kept.models, strict=True):
        assert a.weights == pytest.approx(b.weights, abs=1e-9)
    assert fitted.whole.weights == pytest.approx(folded.fit_linear(table, "text", "y", features=FEATURES, weight="copies").weights, abs=1e-9)


def test_one_label_and_no_rows(table):
    ones = folded.fit_linear(table.filter("y = 1"), "text", "y", features=FEATURES)
    assert {r["p1"] for r in folded.score_linear(ones, table, "text").collect()} == {1.0}
    none = folded.fit_linear(table.limit(0), "text", "y", features=FEATURES)
    assert {r["p1"] for r in folded.score_linear(none, table, "text").collect()} == {0.5}
    empty = folded.fit_folds(table.limit(0), "k", "text", "y", 3, features=FEATURES)
    assert folded.out_of_fold(empty).isEmpty()


def test_saved_and_loaded(spark, table, tmp_path):
    model = folded.fit_linear(table, "text", "y", features=FEATURES, weight="copies")
    models.save_model(spark, model, f"{tmp_path}/m")
    again = models.load_model(spark, f"{tmp_path}/m")
    assert (again.weights == model.weights).all() and again.intercept == model.intercept
    assert training.score_posts(again, table, "k", label="y").count() == table.count()
