"""The Jaccard join's rare-first prefixes and regions against brute force, and what it keeps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postscreen.llm import jaccard
from postscreen.llm.graph import components


def near_sets(rng, groups, each, size=60, spoil=5):
    out = []
    for _ in range(groups):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        for _ in range(rng.integers(1, each)):
            own = base.copy()
            own[rng.integers(0, size, spoil)] = rng.integers(0, 2**63, spoil, dtype=np.uint64)
            out.append(np.unique(own))
    return out


def classes(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(i) for i in range(n)]


def all_links(found, rule):
    sets = [set(x.tolist()) for x in found]
    return [
        (i, j) for i in range(len(sets)) for j in range(i)
        if rule.den * len(sets[i] & sets[j]) >= rule.num * len(sets[i] | sets[j])
    ]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("rule", [jaccard.Rule(5, 80, 100), jaccard.Rule(3, 90, 100), jaccard.Rule(2, 50, 100)])
def test_regions_find_the_components(seed, rule, monkeypatch):
    rng = np.random.default_rng(seed)
    shared = rng.integers(0, 2**63, 30, dtype=np.uint64)
    found = near_sets(rng, 20, 15, spoil=int(rng.integers(1, 9)))
    # Passages that many sets hold, and sets at distance 1.
    found = [np.unique(np.concatenate([x, shared])) if i % 3 and seed % 2 else x for i, x in enumerate(found)]
    monkeypatch.setattr(jaccard, "FEW", 4)
    used = []
    plain = jaccard.local_links
    monkeypatch.setattr(jaccard, "local_links", lambda f, o, r: used.append(len(f)) or plain(f, o, r))
    links = jaccard.region_links(found, np.ones(len(found), bool), rule)
    want = all_links(found, rule)
    assert classes(len(found), links) == classes(len(found), want)
    assert set(map(frozenset, links)) <= set(map(frozenset, want))
    # Passages that most sets share put all of them into one another's windows.
    assert seed % 2 or rule.radius > 0.2 or max(used) < len(found) / 2
    # Some are known to be of one component.
    known = classes(len(found), want)
    main = max(set(known), key=known.count)
    open_ = np.array([k != main for k in known]) | (rng.random(len(found)) < 0.1)
    links = jaccard.region_links(found, open_, rule)
    joined = links + [(int(np.flatnonzero(~open_)[0]), int(i)) for i in np.flatnonzero(~open_)]
    assert classes(len(found), joined) == classes(len(found), want)


@pytest.mark.parametrize("rule", [jaccard.Rule(5, 80, 100), jaccard.Rule(3, 90, 100)])
def test_linked_sets_share_a_rare_shingle(rule):
    rng = np.random.default_rng(9)
    found = near_sets(rng, 30, 8, spoil=1) + near_sets(rng, 10, 6, size=30, spoil=1)
    levels = [rng.integers(0, 256, 1 << 13, dtype=np.uint8) for _ in range(3)]
    keys = [set(jaccard.prefix_keys(x, rule, levels).tolist()) for x in found]
    links = [(i, j) for i, j in all_links(found, rule) if set(found[i].tolist()) != set(found[j].tolist())]
    assert links and all(keys[i] & keys[j] for i, j in links)


def chained(rng, n):
    """Documents of a few passages of a pool each, and near copies of some."""
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    pool = [" ".join(word() for _ in range(30)) for _ in range(25)]
    texts = []
    for _ in range(n):
        own = [" ".join(word() for _ in range(rng.randint(20, 60))), *rng.sample(pool, 2)]
        text = " ".join(own)
        texts.append(text)
        if rng.random() < 0.2:
            words = text.split()
            words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    return texts


def test_crowds_are_cut_again_without_loss(spark, monkeypatch):
    rng = random.Random(21)
    texts = chained(rng, 250) + [None, "", "one"]
    data = [(i, t) for i, t in enumerate(texts)] + [(3, texts[9]), (None, texts[0])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    rule = jaccard.Rule(5, 80, 100)
    want = sorted((r["doc_id"] is not None, r["doc_id"], r["component_id"]) for r in jaccard.join(df, rule=rule).collect())
    cut = []
    plain = jaccard.sharing

    def spy(*args):
        out = plain(*args)
        cut.append(components(out).groupBy("component").count().agg(F.max("count")).first()[0])
        return out

    def by_hash(df, rule, total):  # as if the bitmaps were full
        return plain_counts(df, rule, total) if cut else [np.full(1 << 10, 255, np.uint8)]

    plain_counts = jaccard.commonness
    monkeypatch.setattr(jaccard, "commonness", by_hash)

    monkeypatch.setattr(jaccard, "RECUT", 500)
    monkeypatch.setattr(jaccard, "sharing", spy)
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["component_id"]) for r in jaccard.join(df, rule=rule).collect())
    assert got == want
    # By hash nearly all hang together, by what is rare only near copies do.
    assert len(cut) == 2 and cut[1] < cut[0] / 4


def test_what_is_kept_of_rows_that_share_a_key(spark):
    data = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other text of the same key"), (2, None), (2, None), (None, "x"), (None, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("y") for c in ("_key", "key", "k", "d", "row", "component_id_")})
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(
        map(str, df.sparkSession.createDataFrame([data[0], data[2], data[3], data[5], data[6]], "doc_id long, text string").collect())
    )
    assert kept.filter("_key = 'y' and row = 'y'").count() == 5
