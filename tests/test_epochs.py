"""Training by epochs against a plain loop, restarts, and encoding with a given vocabulary."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postscreen.bindings.queries import QUERIES, SUBWORD_END, SUBWORD_START, _subword_file
from postscreen.operators import epochs, subwords

SF = "/root/testdata/sf0.001"
SETTINGS = epochs.Settings(epochs=4, batch_size=30, features=512)


@pytest.fixture(scope="module")
def posts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    odd = spark.createDataFrame([(90001, None, 1), (90002, "", 0), (None, "x", 1), (90003, "y", None), (90004, "z", 7)], "doc_id long, text string, label int")
    rows = docs.join(labels, "doc_id").unionByName(odd)
    return rows.withColumns({"n": F.lit(1) + F.coalesce("doc_id", F.lit(0)) % 3, "ids": F.lit("kept")}).cache()


def plain_epochs(rows, settings):
    """The same steps in one loop over dense arrays."""
    x = np.zeros((len(rows), settings.features + 1))
    for i, r in enumerate(rows):
        for t in r["ids"]:
            x[i, t] += 1 / len(r["ids"])
    x[:, -1] = 1
    y, w = (np.array([r[c] for r in rows], float) for c in ("label", "n"))
    theta, m, v, step, out = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, []
    for epoch in range(settings.epochs):
        order = sorted(range(len(rows)), key=lambda i: (hashlib.md5(f"{settings.seed}:{epoch}:{rows[i]['doc_id']}".encode()).hexdigest(), rows[i]["doc_id"]))
        losses = []
        for a in range(0, len(order), settings.batch_size):
            b = order[a : a + settings.batch_size]
            p = 1 / (1 + np.exp(-x[b] @ theta))
            losses.append(-(w[b] * (y[b] * np.log(p) + (1 - y[b]) * np.log(1 - p))).sum() / w[b].sum())
            g = x[b].T @ (w[b] * (p - y[b])) / w[b].sum()
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            shrunk = theta * (1 - settings.rate * settings.decay)
            shrunk[-1] = theta[-1]
            theta = shrunk - settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        out.append((theta.copy(), np.mean(losses)))
    return out


def test_epochs_equal_a_plain_loop(spark, posts, tmp_path):
    rows = epochs.hashed(posts.filter("doc_id is not null and label in (0, 1)"), "text", SETTINGS, "doc_id", "label", "n").collect()
    want = plain_epochs(rows, SETTINGS)
    for i, layout in enumerate((posts, posts.repartition(5))):
        done = epochs.fit_epochs(layout, "doc_id", "text", "label", f"{tmp_path}/{i}", SETTINGS, weight="n")
        assert [e.epoch for e in done] == list(range(4))
        for e, (theta, loss) in zip(done, want, strict=True):
            assert np.allclose(e.weights, theta, atol=1e-9) and abs(e.loss - loss) < 1e-9
    assert done[-1].loss < done[0].loss


def test_training_goes_on_where_it_stopped(spark, posts, tmp_path, monkeypatch):
    whole = epochs.fit_epochs(posts, "doc_id", "text", "label", f"{tmp_path}/whole", SETTINGS)
    steps, plain = [], epochs.adamw

    def dies(state, slope, settings):
        if len(steps) == len(whole) * 2:
            raise RuntimeError("lost")
        steps.append(state.epoch)
        return plain(state, slope, settings)

    monkeypatch.setattr(epochs, "adamw", dies)
    with pytest.raises(RuntimeError):
        epochs.fit_epochs(posts, "doc_id", "text", "label", f"{tmp_path}/cut", SETTINGS)
    saved = epochs.load_epochs(spark, f"{tmp_path}/cut")
    assert 0 < len(saved) < 4
    monkeypatch.setattr(epochs, "adamw", plain)
    again = epochs.fit_epochs(posts, "doc_id", "text", "label", f"{tmp_path}/cut", SETTINGS)
    assert all(np.allclose(a.weights, b.weights, atol=1e-9) and a.step == b.step for a, b in zip(whole, again, strict=True))


def test_scores_of_each_epoch(posts, tmp_path):
    done = epochs.fit_epochs(posts, "doc_id", "text", "label", f"{tmp_path}/s", SETTINGS)
    scored = epochs.score_epochs(done, posts, "text", SETTINGS, "doc_id", "n").collect()
    assert len(scored) == 4 * posts.count() and {r["epoch"] for r in scored} == set(range(4))
    rows = {r["doc_id"]: r["ids"] for r in epochs.hashed(posts, "text", SETTINGS, "doc_id").collect()}
    for r in scored[:200]:
        w, ids = done[r["epoch"]].weights, rows[r["doc_id"]]
        z = (sum(w[i] for i in ids) / len(ids) if ids else 0.0) + w[-1]
        assert abs(r["p1"] - 1 / (1 + np.exp(-z))) < 1e-12 and r["pred"] == int(r["p1"] > 0.5)


def test_no_rows_train_nothing(posts, tmp_path):
    done = epochs.fit_epochs(posts.limit(0), "doc_id", "text", "label", f"{tmp_path}/none", SETTINGS)
    assert len(done) == 4 and not done[-1].weights.any() and done[-1].step == 0


def test_metrics_by_epoch(spark):
    rows = QUERIES["metrics_by_epoch"](spark, SF).orderBy("epoch").collect()
    assert [r["epoch"] for r in rows] == list(range(5))
    assert len({r["tp"] + r["fn"] + r["tn"] + r["fp"] for r in rows}) == 1


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_subword_file()).encode(text or "", add_special_tokens=False).ids


def test_subwords_equal_a_plain_loop(spark):
    texts = ["Hello, World!", "", None, "naïve 日本語 don't", "long " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in subwords.encode_subwords(df, "text", _subword_file(), SUBWORD_START, SUBWORD_END, max_length=20).collect()}
    for i, t in enumerate(texts):
        ids = [SUBWORD_START, *plain_ids(t)[:18], SUBWORD_END]
        assert got[i]["input_ids"] == ids + [0] * (20 - len(ids))
        assert got[i]["attention_mask"] == [1] * len(ids) + [0] * (20 - len(ids))
    counts = {}
    for t in texts:
        for x in plain_ids(t):
            counts[x] = counts.get(x, 0) + 1
    assert {r["id"]: r["n"] for r in subwords.subword_counts(df, "text", _subword_file()).collect()} == counts
    with pytest.raises(ValueError):
        subwords.encode_subwords(df, "text", _subword_file(), 1, 2, max_length=1)


def test_batches_are_padded_to_their_longest(spark):
    fixed = QUERIES["subword_encode"](spark, SF).cache()
    want = {r["doc_id"]: r["input_ids"][: sum(r["attention_mask"])] for r in fixed.collect()}
    rows = subwords.pad_batches(fixed, "doc_id", batch_size=16).collect()
    assert {r["doc_id"]: r["input_ids"][: sum(r["attention_mask"])] for r in rows} == want and len(rows) == len(want)
    widths = {}
    for r in rows:
        widths.setdefault(r["batch"], []).append((len(r["input_ids"]), sum(r["attention_mask"])))
    assert all(len(w) <= 16 and {n for n, _ in w} == {max(m for _, m in w)} for w in widths.values())
    assert sum(n for w in widths.values() for n, _ in w) <= sum(len(r["input_ids"]) for r in fixed.collect())
    assert subwords.pad_batches(fixed.limit(0), "doc_id").count() == 0
