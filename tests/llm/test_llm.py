"""The operators against brute force, round trips and edge cases, on small tables."""

import importlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from postscreen.llm import ann, jaccard, langid, licenses, mixing, packing, sharding, topk, toxicity, warc
from postscreen.llm.common import word_count
from postscreen.llm.graph import components
from postscreen.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, v) for v in r])


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, copies, a repeated row, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = [None, "", " \t ", "one", "A b", "a B c d e f", "a b c d e f", long, long + " end", "Ünï cödé 日本語 テキスト"]
    data = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    data += [(None, "no key", "en", "s1"), data[5], data[5]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit("x") for c in ("key", "score", "raw", "group", "node", "hashes", "block", "label", "size")}
    return df.withColumns(clash)


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.limit(0)


# --- queries ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = QUERIES[name](spark, SF)
    theirs = db.execute(f"SELECT {', '.join(mine.columns)} FROM ({ORACLE[name]})").fetchall()
    as_text = lambda rs: sorted(["" if v is None else str(v) for v in r] for r in rs)
    assert as_text(mine.collect()) == as_text(theirs)


# --- 1: WARC ------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    data = [(1, None, None), (2, "u\r\nx", ""), (3, "u", "é" * 200), (4, "u", "é" * 200), (5, "u", "y" * 99),
            (6, "u", "y" * 99), (None, "u", "é" * 200), (3, "u", "é" * 200)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    payload = F.col("html").cast("binary")
    marked = warc.mark_revisits(df, "page_id", payload)
    named = marked.select(
        F.concat(F.lit("p"), F.coalesce(F.col("page_id").cast("string"), F.lit("?"))).alias("record_id"),
        F.concat(F.lit("p"), F.col("refers_to").cast("string")).alias("refers_to"),
        F.col("url").alias("address"), "payload", "payload_bytes", "payload_digest",
    )
    warc.write_archives(named, f"{tmp_path}/a", warc.train_dictionary(df, "page_id", payload))
    back = warc.valid(warc.read_archives(spark, f"{tmp_path}/a"))
    got = rows(back.select("record_id", "record_type", "refers_to", "payload_bytes"))
    assert got == [("p1", "response", None, 0), ("p2", "response", None, 0), ("p3", "response", None, 400),
                   ("p3", "response", None, 400), ("p4", "revisit", "p3", 400), ("p5", "response", None, 99),
                   ("p6", "response", None, 99), ("p?", "revisit", "p3", 400)]
    texts = {r["record_id"]: bytes(r["payload"]) for r in back.filter("payload is not null").collect()}
    assert texts["p3"] == ("é" * 200).encode()
    assert warc.mark_revisits(df.limit(0), "page_id", payload).count() == 0


def test_broken_archives_say_so():
    good = warc._record("r", None, "u", b"text", 4, __import__("hashlib").sha256(b"text").hexdigest(), "2020-01-01T00:00:00Z")
    frame = zstandard.ZstdCompressor().compress
    one = lambda raw: [r["problem"] for r in warc.read_archive(frame(raw))]
    assert one(good) == [None]
    assert one(good.replace(b"text", b"tex")) == ["the block is not as long as its header says"]
    assert one(good.replace(b"text", b"twit")) == ["the payload differs from its digest"]
    assert one(good.replace(b"WARC-Date", b"WARC-Day")) == ["no warc-date"]
    assert one(b"HTTP/1.1 200 OK\r\n\r\n") == ["no WARC header"]
    packed = frame(good)
    assert "ends within" in list(warc.read_archive(packed[:-9]))[0]["problem"]
    assert list(warc.read_archive(packed + b"abc"))[1]["problem"] == "bytes behind the last frame"
    skipped = struct.pack("<II", 0x184D2A50, 3) + b"abc" + packed + struct.pack("<II", 0x184D2A51, 0)
    assert [r["problem"] for r in warc.read_archive(skipped)] == [None]


# --- 2: licences --------------------------------------------------------------------------------


def test_licences(spark, no_docs):
    texts = ["Under the MIT License. mit-license", "GNU General Public License, version 3", None, "",
             "This work is licensed under the GNU General Public License, version 3.", "mit é license",
             "word " * 20_000 + "apache license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.digest(licenses.scan(df, "text")).drop("text", "score")
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got.collect()}
    assert got == {0: (6, 2, 2, 4, "mit"), 1: (6, 1, 1, 1, "gpl"), 2: (0, 0, None, None, ""), 3: (0, 0, None, None, ""),
                   4: (12, 1, 7, 7, "gpl"), 5: (3, 0, None, None, ""), 6: (20_002, 1, 20_000, 20_000, "apache")}
    labels = {r["doc_id"]: r["labels"] for r in licenses.digest(licenses.scan(df, "text")).collect()}
    assert labels[4] == "gpl,gpl-3.0"
    assert licenses.scan(no_docs, "text").count() == 0


# --- 3: packing ---------------------------------------------------------------------------------


def test_packing_holds_everything_once():
    rng = random.Random(1)
    lengths = [rng.randint(1, 4096) for _ in range(3000)]
    bins = packing.pack(lengths)
    assert sorted(i for _, items in bins for i in items) == list(range(3000))
    for capacity, items in bins:
        held = sum(lengths[i] for i in items)
        assert held <= capacity and capacity == min(c for c in packing.CAPACITIES if c >= held)
    assert sum(lengths) / sum(c for c, _ in bins) > 0.95


def test_packing_rows(spark, odd_docs):
    sized = odd_docs.select("doc_id", word_count(F.col("text")).alias("n"), F.lit("x").alias("bin"))
    got = packing.pack_rows(sized, "doc_id", "n")
    assert got.agg(F.sum("length")).first()[0] == sized.agg(F.sum("n")).first()[0]
    assert got.select("doc_id").distinct().count() == sized.select("doc_id").distinct().count()
    used = got.filter("bin is not null").groupBy("bin").agg(F.sum("length").alias("n"), F.max("capacity").alias("c"))
    assert used.filter("n > c").isEmpty()
    assert packing.pack_rows(sized.limit(0), "doc_id", "n").count() == 0


# --- 4: toxicity --------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_the_edit_distance():
    entries = [("idiot", False), ("worthless", False), ("scum", False)]
    automaton = toxicity.Automaton(entries)
    rng = random.Random(0)
    for _ in range(3000):
        word = list(rng.choice(entries)[0])
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "i", "s"])
        word = "".join(word)
        fits = [(distance(word, e), i) for i, (e, _) in enumerate(entries)]
        fits = [(d, i) for d, i in fits if d <= toxicity.max_edits(len(entries[i][0]))]
        assert automaton.match(word) == min(fits, default=None), word
    assert toxicity.Automaton([("lowei", True)]).match("loweischaft") == (0, 0)


def test_toxicity_learns_and_generalises(spark, odd_docs, no_docs):
    rng = random.Random(3)
    data, marks = [], []
    for i in range(400):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 60)}" for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[rng.randint(3, 25)] = rng.choice(["worthless", "pathetic", "disgusting"])
        data.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    data += [(1000, "you are a worthles s person"), (1001, None), (1002, ""), (None, "null key")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (7, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.detect(docs, labels).collect()}
    assert len(got) == 404
    assert all(got[i]["predicted"] == y for i, y in marks)
    assert got[1000]["predicted"] == 1 and got[1001]["predicted"] == got[1002]["predicted"] == 0
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in marks)
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.detect(odd_docs, none).collect()} == {0.0}
    assert toxicity.detect(no_docs, labels).count() == 0


def test_one_clean_text_takes_no_misspelling_away(spark):
    """However many rows are learned from, rare terms count, and so do misspellings that one clean text has too."""
    rng = random.Random(8)
    data = []
    for i in range(8000):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 60)}" for _ in range(12)]
        if i % 2:
            words[rng.randint(2, 9)] = "worthles" if i < 60 else "rarebad" if i < 84 else "worthless"
        elif i < 2:
            words[5] = "worthles"
        elif i < 200:
            words[5] = "worthies"
        data.append((" ".join(words), i % 2))
    model = toxicity.fit(spark.createDataFrame(data, "text string, label int"), "text", "label")
    assert ("rarebad", False) in model.entries and ("worthless", False) in model.entries
    assert "worthies" in model.other and "worthles" not in model.other
    new = spark.createDataFrame([("a worthles b",), ("a worthies b",), ("a rarebad b",)], "text string")
    got = {r["text"]: r["score"] for r in toxicity.score(new, "text", model).collect()}
    assert got["a worthles b"] > 0.5 and got["a rarebad b"] > 0.5 and got["a worthies b"] < 0.3


def test_words_stay_beside_their_stem(spark):
    rng = random.Random(9)
    forms = ["idiot", "idiott", "idioot", "worthless", "worthlessly", "worthlessness"]
    data = []
    for i in range(900):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 60)}" for _ in range(12)]
        if i % 3 == 0:
            words[rng.randint(2, 9)] = forms[i // 3 % 6]
        data.append((" ".join(words), int(i % 3 == 0)))
    model = toxicity.fit(spark.createDataFrame(data, "text string, label int"), "text", "label")
    assert {("idiot", False), ("worthless", False)} <= set(model.entries) and any(stem for _, stem in model.entries)
    automaton = toxicity.Automaton(model.entries)
    assert all(automaton.match(w)[0] == 1 for w in ("iidiot", "1diot", "vorthless", "worhless"))
    assert automaton.match("wxrthlxss")[0] == 2 and automaton.match("idiotic")[0] == 0


def test_the_strongest_hit_counts():
    automaton, cache = toxicity.Automaton([("worthless", False), ("idiot", False)]), {}
    kinds = lambda t: toxicity.evidence(t, automaton, cache, frozenset())
    far = " ".join(["w"] * 40)
    assert kinds(f'a "worthless" b {far} you 1diot') == ["mu1", "xq1"]
    assert kinds(f'a "worthless" b {far} "1diot" c') == ["xq1", "mq1"]
    assert kinds("you idiot and worthles") == ["xu1"] and kinds(far) == []
    assert kinds("i don’t like it idiot and you’re out") == ["xu1"] and kinds("l’idiot n’est") == ["xu1"]
    assert kinds("a ’idiot’ b") == ["xq1"] and kinds("they don’t, a “idiot” b") == ["xq1"]


# --- 5 and 9: vectors ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def some_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)) * rng.lognormal(size=(600, 1))
    x[100:200] = x[100]  # many copies of one vector
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(1000, None), (1020, [1.0, None] + [0.0] * 6), (1040, [float("nan")] * 8), (1060, [0.0] * 8), (1080, [1.0]), (None, data[0][1]), (1100, [])]
    return spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("block", F.lit("x")), x


def test_ann_recall_and_ties(some_vectors):
    df, x = some_vectors
    got = ann.search(df, df.filter("vec_id % 20 = 0"), "vec_id", "embedding", n_centroids=16)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(found[q]) & set(np.lexsort((np.arange(600), -s))[:20]))
    assert hits / 600 >= 0.9 and set(found) == set(range(0, 600, 20))
    assert found[100] == sorted(found[100], key=lambda i: (-float((x[i] * x[100]).sum()), i))
    assert ann.search(df.limit(0), df, "vec_id", "embedding").count() == 0


def test_top_k_is_exact(some_vectors, monkeypatch):
    monkeypatch.setattr(topk, "ENTRIES", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    df, x = some_vectors
    whole = np.floor(64 * np.vstack([x, np.zeros((1, 8))]))
    ids = np.array([*range(600), 1060])
    want = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = whole @ whole[k]
        s[k] = -np.inf
        for rank, i in enumerate(np.lexsort((ids, -s))[:20], 1):
            want.append((int(ids[k]), rank, int(ids[i]), int(s[i])))
    got = topk.search(df, df.filter("vec_id % 20 = 0"), "vec_id", "embedding")
    assert rows(got.select("query_id", "rank", "vec_id", "score")) == sorted(want)
    assert topk.search(df.limit(0), df, "vec_id", "embedding").count() == 0


# --- 6: Jaccard join ----------------------------------------------------------------------------


def brute_components(data, rule):
    sets = {}
    for i, t in data:
        w = [x.lower() for x in (t or "").encode().split()]
        n = rule.words
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            u = len(sets[a] | sets[b])
            if a < b and sets[a] and sets[b] and rule.den * len(sets[a] & sets[b]) >= rule.num * u:
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {k: new if v == old else v for k, v in comp.items()}
    return [(i, len(sets[i]), comp[i]) for i in sets]


def near_copies(seed):
    rng = random.Random(seed)
    data = []
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 160))]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = str(rng.random())
            data.append((len(data), " ".join(text)))
    return data + [(900, None), (901, ""), (902, "  "), (903, "Two words"), (904, "two WORDS")]


@pytest.mark.parametrize("rule", [jaccard.Rule(3, 90, 100), jaccard.Rule(5, 80, 100), jaccard.Rule(2, 60, 100)])
def test_join_is_exact(spark, rule):
    data = near_copies(rule.words)
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(jaccard.join(df, rule=rule)) == sorted(brute_components(data, rule))


@pytest.mark.parametrize("levels", [1, 2])
def test_large_crowds_are_exact(spark, monkeypatch, levels):
    monkeypatch.setattr(jaccard, "FITS", 1500)
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    rng = random.Random(5)
    base = [str(k) for k in range(60)]
    data = []
    for i in range(120):  # one crowd, in which links are just above or just below the threshold
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(60)] = f"x{rng.randint(0, 3)}"
        data.append((i, " ".join(text)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    rule = jaccard.Rule(3, 90, 100)
    want = brute_components(data, rule)
    assert 1 < len({c for _, _, c in want}) < 120
    assert rows(jaccard.join(df, rule=rule)) == sorted(want)


def test_join_takes_odd_rows(odd_docs, no_docs):
    got = jaccard.join(odd_docs, rule=jaccard.Rule(3, 90, 100))
    assert got.count() == odd_docs.count()
    comp = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert comp[6] == 5 and comp[8] == 7 and comp[None] is None and comp[0] == 0
    kept = jaccard.keep_one(odd_docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([0, 1, 2, 3, 4, 5, 7, 9, None], key=str)
    assert jaccard.join(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (7, 7), (3, 1)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 55: 50, 60: 50}


# --- 7: shards ----------------------------------------------------------------------------------


def test_shards_fit_and_only_large_ones_split(spark):
    data = [(i, 10) for i in range(2000)] + [(None, None), (5000, 400), (7, 10), (7, 10)]
    df = spark.createDataFrame(data, "doc_id long, n long").withColumn("cell", F.lit(1))
    got = sharding.shard(df, "doc_id", "n", 300)
    assert got.count() == len(data)
    shards = got.groupBy("shard").agg(F.sum("n_bytes").alias("n"), F.max("shard_bytes").alias("said"), F.max("oversized").alias("o"))
    found = {r["shard"]: r for r in shards.collect()}
    assert all(r["n"] == r["said"] and (r["n"] <= 300 or r["o"]) for r in found.values())
    assert sum(r["o"] for r in found.values()) == 1
    for s in found:  # a shard's parent was too large
        assert not s or sum(r["n"] for k, r in found.items() if k.startswith(s[:-1])) > 300
    assert sharding.shard(df.limit(0), "doc_id", "n", 300).count() == 0



def test_a_key_with_an_empty_text_too(spark):
    base = [f"w{k}" for k in range(60)]
    data = [(i, " ".join([*base, f"x{i}"])) for i in range(1, 5)] + [(1, None), (2, " "), (9, None), (9, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.join(df, rule=jaccard.Rule(3, 90, 100)).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 1), (4, 1), (9, 9), (9, 9)]


# --- 8: languages -------------------------------------------------------------------------------


def test_languages(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count()
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd_docs).collect()}
    assert odd[0] == odd[1] == odd[2] == "und" and odd[3] == "en"
    assert langid.identify(no_docs).count() == 0
    nothing = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in nothing.collect()} == {("und", 0.0)}


# --- 10: mixing ---------------------------------------------------------------------------------


def test_flight_keeps_both_totals():
    rng = random.Random(2)
    sizes = [float(rng.randint(1, 900)) for _ in range(500)]
    p = mixing.flight(sizes, [0.3] * 500, random.Random(1))
    assert sum(0 < x < 1 for x in p) <= 2
    assert abs(sum(p) - 150) < 1e-6
    assert abs(sum(s * x for s, x in zip(sizes, p, strict=True)) - 0.3 * sum(sizes)) < 1e-4


def test_mix_meets_targets(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(4)
    data = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", "d", None])) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    size = word_count(F.col("text"))
    got = mixing.mix(df, "doc_id", size, "source", block_rows=100)
    assert got.count() == 3000 and rows(got) == rows(mixing.mix(df.repartition(7), "doc_id", size, "source", block_rows=100))
    per = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum("size").alias("size"))
    per = {r["source"]: r for r in per.collect()}
    total = sum(r["size"] for r in per.values())
    assert abs(sum(r["target"] for r in per.values()) - 1.5 * total) < 1e-6
    assert all(r["target"] <= 2 * r["size"] + 1e-6 and abs(r["taken"] - r["target"]) <= 30 for r in per.values())
    assert per["a"]["target"] == 2 * per["a"]["size"] and abs(per["c"]["target"] - 2 * per["b"]["target"]) < 1e-6 or per["c"]["target"] == 2 * per["c"]["size"]
    assert got.filter("taken > 2 * size").isEmpty()
    assert mixing.mix(odd_docs, "doc_id", size, "source").count() == odd_docs.count()
    assert mixing.mix(no_docs, "doc_id", size, "source").count() == 0


def test_long_documents_land_on_the_target(spark):
    """One that dwarfs the rest, in a source of many blocks and in one that fits a block beside it."""
    rng = random.Random(6)
    data = [(i, rng.randint(10, 50), "a") for i in range(1500)] + [(i, rng.randint(10, 50), "b") for i in range(1500, 1560)]
    data += [(2000, 9000, "a"), (2001, 600, "b"), (2002, 40, "c")]
    df = spark.createDataFrame(data, "doc_id long, size long, source string")
    for seed in range(3):
        got = mixing.mix(df, "doc_id", F.col("size"), "source", seed, block_rows=100, weights=(20, 1, 1), share=0.8)
        per = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n"))
        per = {r["source"]: r for r in per.collect()}
        assert [per[k]["n"] for k in "abc"] == [1501, 61, 1]
        assert all(abs(per[k]["taken"] - per[k]["target"]) <= 2 for k in "ab")


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:3]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == docs.columns and after.count() <= docs.count(), name
        docs = after
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], jaccard.Rule(5, 80, 100))
    assert all(i == c for i, _, c in want)
    mixed = pipeline.STAGES[3][1](spark, docs, SF).cache()
    copies = mixed.groupBy("doc_id").count()
    assert mixed.columns == docs.columns and copies.filter("count > 2").isEmpty()
    packed = pipeline.STAGES[4][1](spark, mixed, SF)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in mixed.select("text").collect())
    assert packed.agg(F.sum("length")).first()[0] == words


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, odd_docs, no_docs, stage):
    name, f = importlib.import_module("corpus_pipeline").STAGES[stage]
    assert f(spark, no_docs, SF).count() == 0
    out = f(spark, odd_docs, SF)
    assert out.count() > 0
    if stage < 4:
        assert out.columns == odd_docs.columns


def test_mixed_rows_repeat_at_most_twice(spark):
    """Rows that share a key, or have none, don't multiply one another."""
    pipeline = importlib.import_module("corpus_pipeline")
    keys = [5] * 30 + [None] * 30 + list(range(100, 140))
    data = [(k, f"t{i} " + "w " * (i % 17), "ab"[i % 2]) for i, k in enumerate(keys)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = pipeline.mix_sources(spark, docs, SF)
    assert out.groupBy("text").count().filter("count > 2").isEmpty()
    words = word_count(F.col("text"))
    size = docs.agg(F.sum(words)).first()[0]
    assert abs(out.agg(F.sum(words)).first()[0] - 1.5 * size) <= 2
    assert rows(out) == rows(pipeline.mix_sources(spark, docs.repartition(7), SF))
