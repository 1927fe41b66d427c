import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postscreen.operators import bayes, features, linear
from postscreen.sources.models import load_model, save_model
from tests.conftest import layouts, rows

WORDS = "alone tired rain sun walk tea friend cry sleep music bus work".split()


def words_of(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


@pytest.fixture(scope="module")
def posts(spark):
    generator = random.Random(5)
    data = []
    for k in range(120):
        y = int(k % 4 == 0)
        pool = WORDS[:6] if y else WORDS[4:]
        count = generator.randint(1, 9)
        data.append((k, " ".join(generator.choice(pool).title() for _ in range(count)), y))
    data += [(120, None, 0), (121, "123 !", 1), (122, "unseen_word ünïcode", 0)]
    return spark.createDataFrame(data, "k long, text string, y int").cache()


def bayes_by_hand(train, scored, alpha=1.0):
    counts = {0: Counter(), 1: Counter()}
    docs = Counter(y for _, _, y in train)
    for _, text, y in train:
        counts[y].update(words_of(text))
    vocabulary = set(counts[0]) | set(counts[1])
    totals = {c: sum(counts[c].values()) + alpha * len(vocabulary) for c in (0, 1)}
    margins = {}
    for k, text, _ in scored:
        m = math.log(docs[1] / docs[0])
        for t in words_of(text):
            if t in vocabulary:
                m += math.log((counts[1][t] + alpha) / totals[1])
                m -= math.log((counts[0][t] + alpha) / totals[0])
        margins[k] = m
    return margins


def test_bayes_agrees_with_a_plain_loop(posts):
    data = [tuple(r) for r in posts.collect()]
    want = bayes_by_hand(data, data)
    for df in layouts(posts, "k"):
        got = bayes.score(bayes.fit_nb(df, "text", "y"), df, "k", "text", ["y"]).collect()
        assert len(got) == len(data)
        for r in got:
            assert r["margin"] == pytest.approx(want[r["k"]], abs=1e-8)
            assert r["p1"] == pytest.approx(1 / (1 + math.exp(-want[r["k"]])))
            assert r["pred"] == int(want[r["k"]] > 0)


@pytest.mark.parametrize("max_hot", [1, 12])
def test_bayes_beyond_the_broadcast_bound_gives_the_same(posts, max_hot):
    model = bayes.fit_nb(posts, "text", "y")
    near = bayes.score(model, posts, "k", "text", ["y"])
    far = bayes.score(model, posts, "k", "text", ["y"], max_hot=max_hot)
    assert rows(far) == rows(near)
    assert "_salt" in far._jdf.queryExecution().executedPlan().toString()
    # T tokens hold at most H with a count of T/H or more.
    hot = model.weights.filter(F.col("n") * max_hot >= model.token_total).count()
    assert hot <= max_hot < model.vocabulary
    assert hot > 0 or max_hot == 1


@pytest.mark.parametrize("max_hot", [12, 500_000])
def test_bayes_scores_row_for_row_without_a_shuffle(spark, posts, max_hot):
    model = bayes.fit_nb(posts, "text", "y")
    words = [r["text"] for r in posts.filter("text is not null").limit(3).collect()]
    data = [(1, words[0]), (1, words[1]), (None, words[2]), (None, None), (2, ""), (3, "unheardof")]
    df = spark.createDataFrame(data, "k long, text string")
    got = bayes.score(model, df, "k", "text", ["text"], max_hot=max_hot)
    alone = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(data)], "i long, text string")
    want = {r["text"]: r["margin"] for r in bayes.score(model, alone, "i", "text", ["text"]).collect()}
    assert sorted(map(str, ((r["k"], r["text"]) for r in got.collect()))) == sorted(map(str, data))
    assert all(r["margin"] == want[r["text"]] for r in got.collect())
    if max_hot > model.vocabulary:
        plan = got.filter("pred = 1")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_tie_is_class_0(spark):
    train = spark.createDataFrame([(0, "a", 0), (1, "a", 1)], "k long, text string, y int")
    got = bayes.score(bayes.fit_nb(train, "text", "y"), train, "k", "text").first()
    assert (got["margin"], got["pred"], got["p1"]) == (0.0, 0, 0.5)


def test_one_class_cannot_be_fitted(spark):
    with pytest.raises(ValueError):
        bayes.fit_nb(spark.createDataFrame([(0, "a", 0)], "k long, text string, y int"), "text", "y")


def test_case_is_an_option(spark):
    train = spark.createDataFrame([(0, "Tea", 0), (1, "tea", 1)], "k long, text string, y int")
    assert bayes.fit_nb(train, "text", "y").vocabulary == 1
    assert bayes.fit_nb(train, "text", "y", fold_case=False).vocabulary == 2


def test_out_of_fold_agrees_with_one_fit_per_fold(posts):
    data = [tuple(r) for r in posts.collect()]
    folds = dict(rows(bayes.with_fold(posts, "k", 3).select("k", "fold")))
    assert set(folds.values()) == {0, 1, 2}
    want = {}
    for f in range(3):
        train = [r for r in data if folds[r[0]] != f]
        want |= bayes_by_hand(train, [r for r in data if folds[r[0]] == f])
    for r in bayes.out_of_fold(posts, "k", "text", "y", k=3).collect():
        assert r["margin"] == pytest.approx(want[r["k"]], abs=1e-8)


def test_vocabulary_order_and_size(spark):
    long = "x" * 101
    df = spark.createDataFrame([("b a a C",), ("c a " + long,), (None,)], "text string")
    vocab = features.build_vocab(df, "text")
    assert [tuple(r) for r in vocab.orderBy("id").collect()] == [("a", 4), ("c", 5), ("b", 6), (long, 7)]
    assert rows(features.build_vocab(df, "text", size=6)) == [("a", 4), ("c", 5)]
    assert features.build_vocab(df, "text", size=4).count() == 0
    assert features.build_vocab(df.filter("text is null"), "text").count() == 0


@pytest.mark.parametrize("max_length", [2, 5, 128])
def test_encoding_by_lookup_and_by_join(posts, max_length):
    vocab = features.build_vocab(posts, "text", size=12).cache()
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    by_lookup = features.encode(posts, "text", vocab, max_length)
    by_join = features.encode(posts, "text", vocab, max_length, max_lookup=1)
    columns = ["k", "input_ids", "attention_mask"]
    assert rows(by_lookup.select(columns)) == rows(by_join.select(columns))
    for r in by_lookup.collect():
        kept = [ids.get(t, features.UNKNOWN) for t in words_of(r["text"])][: max_length - 2]
        if r["k"] == 122:
            continue  # the underscore splits words differently here
        padding = max_length - len(kept) - 2
        assert r["input_ids"] == [2, *kept, 3] + [0] * padding
        assert r["attention_mask"] == [1] * (len(kept) + 2) + [0] * padding
    plan = by_lookup._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan


def test_encoding_needs_room(posts):
    with pytest.raises(ValueError):
        features.encode(posts, "text", features.build_vocab(posts, "text"), 1)


def test_linear_model_beats_the_majority(posts):
    model = linear.fit_lr(posts.fillna("", ["text"]), "text", "y", features=1 << 10)
    scored = linear.score_lr(model, posts.fillna("", ["text"]))
    assert scored.columns == ["k", "text", "y", "p1", "pred"]
    right = scored.filter("pred = y").count() / scored.count()
    assert right > 0.9
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def newton(x, y, c=1.0):
    """Logistic regression with penalty |w|^2 / 2 and weight c on the summed loss, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = c * x.T @ (p - y) + penalty @ w
        w -= np.linalg.solve(c * x.T @ (x * (p * (1 - p))[:, None]) + penalty, gradient)
    return w


def test_meta_model_solves_the_usual_objective(spark):
    generator = np.random.default_rng(0)
    x = generator.uniform(size=(200, 2))
    y = (x @ [2.0, -1.0] + generator.normal(scale=0.5, size=200) > 0.5).astype(int)
    data = [(float(a), float(b), int(t)) for (a, b), t in zip(x, y, strict=True)]
    df = spark.createDataFrame(data, "p_a double, p_b double, y int")
    fitted = linear.fit_meta(df, ["p_a", "p_b"], "y").stages[-1]
    want = newton(x, y)
    assert [*fitted.coefficients, fitted.intercept] == pytest.approx(list(want), abs=1e-3)


def test_stack_joins_by_key(posts):
    model = bayes.fit_nb(posts, "text", "y")
    scores = bayes.score(model, posts, "k", "text", ["y"])
    both = linear.stack({"a": scores, "b": scores}, "k", "y")
    assert both.columns == ["k", "y", "p_a", "p_b"]
    assert both.filter("p_a = p_b").count() == posts.count()


def test_external_model_runs_once_and_on_filtered_rows_only(spark, posts):
    # Local, because the workers cannot import the test module.
    def count_model():
        def predict(texts):
            return np.array([min(len(t), 10) / 10 for t in texts])

        return predict

    df = posts.fillna("", ["text"]).filter("y = 0")
    scored = linear.score_external(df, "text", count_model, batch_size=7)
    wrong = scored.filter("pred = 1")
    plan = wrong._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    for r in scored.collect():
        assert r["p1"] == pytest.approx(min(len(r["text"]), 10) / 10)
        assert r["pred"] == int(r["p1"] > 0.5)


def test_models_survive_saving(spark, posts, tmp_path):
    model = bayes.fit_nb(posts, "text", "y")
    save_model(spark, model, f"{tmp_path}/nb")
    save_model(spark, model, f"{tmp_path}/nb")
    loaded = load_model(spark, f"{tmp_path}/nb")
    assert rows(bayes.score(loaded, posts, "k", "text")) == rows(bayes.score(model, posts, "k", "text"))
    filled = posts.fillna("", ["text"])
    pipeline = linear.fit_lr(filled, "text", "y", features=1 << 10, max_iter=3)
    save_model(spark, pipeline, f"{tmp_path}/lr")
    again = linear.score_lr(load_model(spark, f"{tmp_path}/lr"), filled)
    assert rows(again.select("k", "p1")) == rows(linear.score_lr(pipeline, filled).select("k", "p1"))


def test_encode_keeps_rows_one_for_one(spark):
    posts = spark.createDataFrame(
        [(1, "a b"), (1, "b c"), (None, "a"), (2, None), (2, "zz")], "k long, text string"
    )
    vocab = features.build_vocab(posts, "text", size=7).cache()
    looked = features.encode(posts, "text", vocab, 5).select("k", "input_ids", "attention_mask")
    joined = features.encode(posts, "text", vocab, 5, max_lookup=1)
    assert looked.count() == 5
    assert rows(looked) == rows(joined.select("k", "input_ids", "attention_mask"))


def test_long_tokens_are_in_the_vocabulary(spark):
    posts = spark.createDataFrame([("x" * 5000,), ("x" * 5000,), ("b",)], "text string")
    assert rows(features.build_vocab(posts, "text")) == [("b", 5), ("x" * 5000, 4)]


def test_linear_model_takes_missing_texts(spark):
    posts = spark.createDataFrame([("bad", 1), ("good", 0), (None, 0)] * 4, "text string, y int")
    model = linear.fit_lr(posts, "text", "y", features=1 << 8)
    scored = linear.score_lr(model, posts)
    assert (scored.count(), scored.filter("p1 is null").count()) == (12, 0)


def test_a_loaded_model_is_saved_over_its_own_path(spark, posts, tmp_path):
    path = f"{tmp_path}/own"
    save_model(spark, bayes.fit_nb(posts, "text", "y"), path)
    first = rows(bayes.score(load_model(spark, path), posts, "k", "text").select("k", "p1"))
    for _ in range(2):
        save_model(spark, load_model(spark, path), path)
        assert rows(bayes.score(load_model(spark, path), posts, "k", "text").select("k", "p1")) == first


def test_a_save_that_dies_leaves_the_old_model(spark, posts, tmp_path):
    path = f"{tmp_path}/dies"
    with pytest.raises(FileNotFoundError):
        load_model(spark, path)
    save_model(spark, bayes.fit_nb(posts, "text", "y"), path)
    first = load_model(spark, path)
    broken = posts.select(F.raise_error(F.lit("lost")).cast("string").alias("token"), F.lit(1).cast("long").alias("n"), F.array(F.lit(0.0)).alias("w"))
    with pytest.raises(Exception, match="lost"):
        save_model(spark, bayes.NaiveBayesModel(broken, first.log_prior, 1, 1, 1, True), path)
    assert load_model(spark, path) == first or rows(load_model(spark, path).weights) == rows(first.weights)
