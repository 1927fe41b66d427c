"""What grows with a table stays off the driver, out of single tasks and out of single steps."""

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postscreen.bindings.queries import _subword_file
from postscreen.operators import bayes, epochs, folded, subwords


@pytest.fixture(scope="module")
def words(spark):
    """Many rare tokens, one frequent one, a token twice in a text, repeated and missing keys, missing texts."""
    rare = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(400)]
    data = [(i % 60, f"often {w} {w} {rare[i // 2]} x{'q' * 50}", i % 2, i % 3) for i, w in enumerate(rare)]
    data += [(None, "often often unheard", 1, 0), (7, None, 0, 1), (None, "", 1, None), (8, "b c d", 0, None)]
    return spark.createDataFrame(data, "k long, text string, y int, fold int").repartition(4).cache()


@pytest.mark.parametrize("fold", [None, "fold"])
def test_rare_tokens_meet_their_weights_without_a_broadcast(spark, words, fold):
    model = bayes.fit_nb(words.filter("fold is not null"), "text", "y", fold=fold, n_folds=3)
    whole = bayes.score(model, words, "k", "text", ["text", "y"], fold)
    split = bayes.score(model, words, "k", "text", ["text", "y"], fold, max_hot=20)
    told = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert told(split) == told(whole) and split.count() == words.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bayes.score(model, words, "k", "text", ["y"], fold, max_hot=20)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan


def test_what_is_collected_of_a_vocabulary_is_small():
    assert bayes.MAX_HOT_BYTES <= 16 << 20 and bayes.MAX_HOT_TOKENS <= 200_000


def test_a_step_is_one_stage_over_its_own_rows(spark, words, tmp_path, monkeypatch):
    settings = epochs.Settings(epochs=2, batch_size=30, features=64)
    rows = words.withColumn("k", F.monotonically_increasing_id()).cache()
    steps = -(-rows.count() // 30)
    log = []
    plain = epochs.gradient

    def watched(blocks, at, weights):
        group = f"step-{len(log)}"
        spark.sparkContext.setJobGroup(group, group)
        out = plain(blocks, at, weights)
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getJobInfo(j).stageIds for j in tracker.getJobIdsForGroup(group)]
        ran = [t for s in stages for i in s if (t := tracker.getStageInfo(i)) and t.numCompletedTasks]
        log.append((len(ran), sum(t.numTasks for t in ran)))
        return out

    monkeypatch.setattr(epochs, "gradient", watched)
    try:
        done = epochs.fit_epochs(rows, "k", "text", "y", f"{tmp_path}/one", settings)
        monkeypatch.setattr(epochs, "BLOCK_ROWS", 8)
        split = epochs.fit_epochs(rows, "k", "text", "y", f"{tmp_path}/many", settings)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert log[: 2 * steps] == [(1, 1)] * (2 * steps) and log[2 * steps :] == [(1, 4)] * (2 * steps)
    assert all(np.allclose(a.weights, b.weights, atol=1e-9) and abs(a.loss - b.loss) < 1e-9 for a, b in zip(done, split, strict=True))


ODD = [
    "a b ́x é 'S it's don 't", "<|endoftext|>x <|startoftext|> <|ENDOFTEXT|>", "\u0085q 　w\x1cz", "ΣΑΣ İI",
    "", " \t\n\r ", None, "x" * 5_000, "  " * 3_000 + "late", "1 2 3\r\n4\t5 " * 400, "word​ " * 300, "\U0001f600 " * 200, "日本語 " * 400,
]


def saved(folder, change):
    with open(_subword_file(), encoding="utf-8") as f:
        parts = json.load(f)
    change(parts)
    path = folder / "changed.json"
    path.write_text(json.dumps(parts), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("kind", ["given", "blanks_kept", "added"])
def test_subwords_of_odd_texts_by_words_and_by_heads(spark, tmp_path, kind):
    path = _subword_file()
    if kind == "blanks_kept":
        path = saved(tmp_path, lambda t: t.update(pre_tokenizer={"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}))
    if kind == "added":
        path = saved(tmp_path, lambda t: t["added_tokens"].append({**t["added_tokens"][0], "id": 49408, "content": "3 4"}))
    plain = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        assert subwords.splits_at_blanks(f.read()) == (kind == "given")
    ids = [plain.encode(t or "", add_special_tokens=False).ids for t in ODD]
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    counts = subwords.subword_counts(df, "text", path)
    assert {r["id"]: r["n"] for r in counts.collect()} == Counter(x for found in ids for x in found)
    for most in (2, 20, 128):
        got = {r["doc_id"]: r for r in subwords.encode_subwords(df, "text", path, -1, -2, max_length=most).collect()}
        for i, found in enumerate(ids):
            want = [-1, *found[: most - 2], -2]
            assert got[i]["input_ids"] == want + [0] * (most - len(want)) and sum(got[i]["attention_mask"]) == len(want)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert ("keys=[text" in plan) == (kind == "given")


def test_texts_are_tokenized_in_pieces_of_few_characters():
    texts = ["a" * 300_000] * 9 + [None, "b" * 3_000_000, ""] + ["c"] * 2_500
    pieces = list(subwords._pieces(pa.array(texts)))
    assert [t for p in pieces for t in p] == texts
    assert all(len(p) <= 1_000 and (len(p) == 1 or sum(len(t or "") for t in p) <= 1 << 20) for p in pieces)


def test_padded_batches_leave_a_task_in_few_arrow_batches(spark):
    data = [(i, [7] * (i % 9 + 1) + [0] * (9 - i % 9), [1] * (i % 9 + 1) + [0] * (9 - i % 9)) for i in range(100)]
    df = spark.createDataFrame(data, "k long, input_ids array<int>, attention_mask array<int>").coalesce(1)
    rows = subwords.pad_batches(df, "k", batch_size=8, pad=5, gather=50).collect()
    assert sorted(r["k"] for r in rows) == list(range(100))
    assert all(r["input_ids"] == [7] * (r["k"] % 9 + 1) + [5] * (len(r["input_ids"]) - r["k"] % 9 - 1) for r in rows)
    sizes = Counter(r["batch"] for r in rows)
    assert sorted(sizes.values()) == [2, 2] + [8] * 12 and {(r["batch"], r["place"]) for r in rows} == {(b, i) for b, n in sizes.items() for i in range(n)}
    assert all(len({len(r["input_ids"]) for r in rows if r["batch"] == b}) == 1 for b in sizes)


def test_pairs_and_sums_of_the_descent_are_not_held_whole(spark, words, monkeypatch, tmp_path):
    rows = folded.hashed_counts(words, "text", 64, True, y=F.col("y").cast("double"), w=F.lit(1.0), fold=F.col("k") % 3)
    rows = rows.filter("fold is not null").cache()
    whole = folded._fit(rows, 3, 64, True, 1e-3, 20, 1e-9)
    monkeypatch.setattr(folded, "PIECE", 7)
    pieces = folded._fit(rows, 3, 64, True, 1e-3, 20, 1e-9)
    assert all(np.allclose(a.weights, b.weights) and abs(a.intercept - b.intercept) < 1e-9 for a, b in zip(whole, pieces, strict=True))
    # A bent valley of its own: the descent finds its floor, with no vector of a pair in the object.
    scale = np.arange(1.0, 41.0)
    descent = folded._Descent(np.ones(40), 200, 1e-15, str(tmp_path))
    while not descent.done:
        x = descent.trial
        descent.seen(float(scale @ (x * x)) / 2, scale * x)
    assert np.abs(descent.x).max() < 1e-3 and len(descent.pairs.known) == folded.HISTORY
    assert not any(isinstance(v, np.ndarray) for v in vars(descent.pairs).values())
    assert len(list(tmp_path.iterdir())) == 2 * folded.HISTORY


def test_a_descent_holds_no_vector_between_its_steps(tmp_path):
    descent = folded._Descent(np.ones(40), 200, 1e-15, str(tmp_path))
    scale = np.arange(1.0, 41.0)
    for _ in range(3):
        x = descent.trial
        descent.seen(float(scale @ (x * x)) / 2, scale * x)
        assert not any(isinstance(v, np.ndarray) for v in [*vars(descent).values(), *vars(descent.kept).values()])


def test_sums_come_in_blocks_and_unused_features_take_no_place(spark, words, monkeypatch):
    rows = folded.hashed_counts(words, "text", 1 << 12, True, y=F.col("y").cast("double"), w=F.lit(1.0), fold=F.col("k") % 3)
    rows = rows.filter("fold is not null").cache()
    whole, seen, add = folded._fit(rows, 3, 1 << 12, True, 1e-3, 20, 1e-9), set(), folded._Pairs.add
    monkeypatch.setattr(folded, "BLOCK", 5, raising=False)
    monkeypatch.setattr(folded._Pairs, "add", lambda self, moved, *more: (seen.add(len(moved)), add(self, moved, *more)))
    blocks = folded._fit(rows, 3, 1 << 12, True, 1e-3, 20, 1e-9)
    assert all(np.allclose(a.weights, b.weights) and abs(a.intercept - b.intercept) < 1e-9 for a, b in zip(whole, blocks, strict=True))
    known = {i for r in rows.select("at").collect() for i in r["at"]}
    assert seen and max(seen) <= len(known) + 1
