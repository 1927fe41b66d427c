"""Order-preserving packing, phrase mining and hard negatives against brute force, and their edge cases."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postscreen.llm import gaps, negatives, phrases, windows

PATH = public_tokenizers.path("word_bpe_49k.json")
CLASH = ("key", "ids", "start", "length", "text_", "lang_", "raw", "k", "f", "rank", "score", "label_", "vec", "asked", "_row")


def clash(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, v) for v in r])


# --- windows ------------------------------------------------------------------------------------


def plain_cost(at, penalty, capacity, overhead):
    """Least cost over all ways to cut, by the square of the places."""
    least = [0] + [10**9] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= capacity:
                pad = 0 if n & (n - 1) == 0 else capacity - n
                least[j] = min(least[j], least[i] + pad + overhead + penalty[j])
    return least[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_cheapest(seed):
    rng = random.Random(seed)
    capacity, overhead = rng.choice([16, 24, 64]), rng.choice([0, 1, 5])
    at = np.cumsum([0] + [rng.randint(1, min(capacity, 9)) for _ in range(rng.randint(1, 60))])
    penalty = np.array([0] + [rng.randint(0, 6) for _ in range(len(at) - 1)])
    chosen = windows.cuts(at, penalty, capacity, overhead)
    cost, last = 0, 0
    for j in chosen:
        n = at[j] - last
        assert 0 < n <= capacity
        cost += (0 if n & (n - 1) == 0 else capacity - n) + overhead + penalty[j]
        last = at[j]
    assert last == at[-1] and cost == plain_cost(at.tolist(), penalty.tolist(), capacity, overhead)


def test_words_give_the_ids_of_the_tokenizer():
    texts = [
        "", None, " ", "Don't. I'll pay 12.50, (see 3rd): \"no\"!? ...", "a\x1cb \x85 c<|endoftext|>d <|ENDOFTEXT|> <|endoftext|>.",
        "É é İstanbul ΣΑΣ ΟΔΟΣ. क़ ́x ﬁ ǅ 日本語。テスト", "tab\tline\r\nend.\n\n", "A.b,c;d:e!f?g", "x" * 5000,
    ]
    with open(PATH, encoding="utf-8") as f:
        words = windows.Words(f.read())
    plain = Tokenizer.from_file(PATH)
    for _ in range(2):  # the second time they are known
        ids, sizes = words.encode(pa.array(texts))
        ends = np.cumsum(sizes)
        for t, n, e in zip(texts, sizes, ends, strict=True):
            assert ids[e - n : e].tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_packing_keeps_every_id_in_order(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta.", "gamma", "Delta,"]) for _ in range(30_000))
    junk = "q" * 20_000
    data = [(2**60 + i, " ".join(["word one."] * rng.randint(0, 400))) for i in range(60)]
    data += [(None, "no key"), (None, None), (5, None), (5, ""), (6, long), (6, long), (7, junk)]
    df = clash(spark.createDataFrame(data, "doc_id long, text string")).coalesce(2)
    got = windows.pack(df, "doc_id", "text", PATH).toPandas()
    plain = Tokenizer.from_file(PATH)
    texts = {}
    for k, t in data:
        texts.setdefault(k, []).append([*plain.encode(t or "", add_special_tokens=False).ids, 2])
    ids = [np.frombuffer(b, "<u4").tolist() for b in got["ids"]]
    assert [len(x) for x in ids] == got["length"].tolist()
    # Each document's pieces make up its ids; those of repeated rows lie apart in order.
    exact = windows.pack(df, "doc_id", "text", PATH).select(F.col("doc_id").cast("string").alias("k"), "start", "ids", "doc_tokens")
    found = {}
    for r in exact.collect():
        part = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        key = None if r["k"] is None else int(r["k"])
        found.setdefault(key, Counter()).update((r["start"] + i, x, r["doc_tokens"]) for i, x in enumerate(part))
    want = {k: Counter((i, x, len(t)) for t in ts for i, x in enumerate(t)) for k, ts in texts.items()}
    assert found == want
    used = 0
    for _, window in got.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert (window["offset"].to_numpy() == np.cumsum(window["length"]) - window["length"]).all()
        n = int(window["length"].sum())
        assert n <= 4096
        used += n if n & (n - 1) == 0 else 4096
    assert used <= 1.01 * sum(len(t) for ts in texts.values() for t in ts)
    assert windows.pack(df.limit(0), "doc_id", "text", PATH).count() == 0


# --- phrases ------------------------------------------------------------------------------------


def plain_counts(data):
    grams, sizes = Counter(), Counter()
    for text, lang in data:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            for k in range(1, 5):
                grams.update((lang or "und", k, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return grams, sizes


def test_extensions_of_an_index():
    rng = random.Random(1)
    text = np.array([0] + [rng.choice([0, 1, 2, 3]) for _ in range(300)] + [0], np.int32)
    index = phrases.Index(phrases.bwt(text), np.arange(4, dtype=np.uint64))
    for depth in range(1, 4):
        grams = Counter(tuple(text[i : i + depth].tolist()) for i in range(len(text) - depth + 1))
        whole = np.flatnonzero(index.whole)
        names = {int(w): tuple(index.words(index.low[[w]])[0].tolist()) for w in whole}
        assert {names[w]: int(index.count[w]) for w in whole} == {g: n for g, n in grams.items() if 0 not in g}
        longer = Counter(tuple(text[i : i + depth + 1].tolist()) for i in range(len(text) - depth))
        want = Counter()
        for g, n in longer.items():
            if 0 not in g:
                want[(g[1:], g[0], 0)] += n
                want[(g[:-1], g[-1], 1)] += n
        got = {(names[int(w)], int(s), int(side)): int(n) for w, s, n, side in zip(*index.extensions(), strict=True)}
        assert got == dict(want)
        index.extend(np.ones(len(index.low), bool))


@pytest.mark.parametrize("top", [1, 200, 2**20, 2**40, 2**63])
def test_squeezed_numbers_come_back(top):
    rng = np.random.default_rng(4)
    for n in (0, 1, 500):
        x = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        assert (gaps.expand(gaps.squeeze(x)) == x).all()


def test_phrase_counts_equal_plain_counts(spark):
    rng = random.Random(5)
    words = ["a", "B", "c,", "d.", "É", "e\tf", "g\nh", "x y", "\x00", "z!"]
    data = [(" ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "fr", None, "a\tb"])) for _ in range(80)]
    data += [(None, "en"), ("", None), (" \t ", "xx"), ("a a a a a a", "en"), ("a a a a a a", "en"), ("one two " * 3000, "long")]
    df = clash(spark.createDataFrame(data, "text string, lang string"))
    grams, sizes = plain_counts(data)
    for layout in (df.coalesce(1), df.repartition(5)):
        found, n = phrases.count(layout, "text", "lang", least=4, shard=200)
        assert rows(found) == sorted((*g, f) for g, f in grams.items() if f >= 4)
        assert {r["lang"]: r["n"] for r in n.collect() if r["n"]} == {k: v for k, v in sizes.items() if v}


def test_a_shard_is_held_in_few_bytes_a_word():
    n = 200_000
    text = np.random.default_rng(6).integers(0, 300, n).astype(np.int32)
    symbols, hashes = phrases.bwt(text), np.arange(300, dtype=np.uint64)
    tracemalloc.start()
    index = phrases.Index(symbols, hashes)
    for _ in range(3):
        index.extend(np.ones(len(index.low), bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.low) > 0.9 * n and peak < 80 * n


def test_a_shard_is_a_row_group_and_phrases_leave_in_parts(spark, monkeypatch, tmp_path):
    rng = random.Random(7)
    data = [(" ".join(rng.choices("abcdefg", k=40)), rng.choice(["en", "fr"])) for _ in range(60)]
    df = spark.createDataFrame(data, "text string, lang string").coalesce(1)
    for name, value in (("GATHER", 40), ("NAMES", 7), ("new_table_path", lambda spark, name: f"{tmp_path}/{name}")):
        monkeypatch.setattr(phrases, name, value, raising=False)
    found, _ = phrases.count(df, "text", "lang", least=5, shard=300)
    assert rows(found) == sorted((*g, f) for g, f in plain_counts(data)[0].items() if f >= 5)
    meta = [pq.ParquetFile(f).metadata for f in tmp_path.glob("indexes/*.parquet")]
    groups = [m.row_group(i).num_rows for m in meta for i in range(m.num_row_groups)]
    assert len(groups) > 3 and set(groups) == {1}


def test_scores_of_phrases(spark):
    # "p q" is within "p q r" four times in five; "s t" is cut in one way only.
    data = [("p q r. " * 40 + "p q. " * 10 + "s t. " * 30 + "s. " * 30, "en"), ("u v. " * 29, "en")]
    df = spark.createDataFrame(data, "text string, lang string")
    got = [tuple(r) for r in phrases.mine(df).orderBy("rank").collect()]
    n = 40 * 3 + 20 + 60 + 30 + 58
    assert got == [
        ("en", 1, "p q r", 40, 50, 40, n, 2_000_000 * 40 // 90), ("en", 2, "s t", 30, 60, 30, n, 2_000_000 * 30 // 90),
    ]
    assert phrases.mine(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**17
    grams = spark.createDataFrame([("en", 1, "a", big + 1), ("en", 1, "b", big), ("en", 2, "a b", big)], "lang string, k int, phrase string, f long")
    sizes = spark.createDataFrame([("en", 2 * big)], "lang string, n long")
    assert phrases.score(grams, sizes).first()["score"] == 2_000_000 * big // (2 * big + 1)


# --- hard negatives -----------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (40, 64, 70), (33, 17, 19), (0, 5, 7), (5, 0, 3), (65, 33, 129)])
def test_products_are_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(sum(shape))
    for top in (300, 2**28):
        a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
        assert (negatives.strassen(a, b, leaf=4) == a @ b).all()
    a, b = rng.integers(-(2**62), 2**62, (m, k)), rng.integers(-1, 2, (n, k))
    want = a.astype(object) @ b.astype(object).T
    if max((abs(x) for x in want.ravel()), default=0) < 2**63:
        assert (negatives.products(a, b) == want).all()
    else:
        with pytest.raises(OverflowError):
            negatives.products(a, b)


def test_heaps_take_tiles_in_any_order():
    rng = np.random.default_rng(2)
    score, ids = rng.integers(-3, 3, (7, 500)), rng.permutation(500)
    ok = rng.random((7, 500)) < 0.6
    ok[3] = False
    for parts in (1, 9):
        heap = negatives.Heaps(7, 5)
        for cols in np.array_split(rng.permutation(500), parts):
            heap.take(score[:, cols], ok[:, cols], ids[cols])
        got = list(zip(*(x.tolist() for x in heap.rows()), strict=True))
        want = []
        for q in range(7):
            best = sorted((-int(s), int(i)) for s, i, o in zip(score[q], ids, ok[q], strict=True) if o)[:5]
            want += [(q, i, -s) for s, i in best]
        assert got == want


def plain_negatives(data, k=5):
    sound = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, lab, v in data
             if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in sound if i % 10 == 0}):
        lab, vec = min((lab, v) for i, lab, v in sound if i == a)
        scored = [(-sum(x * y for x, y in zip(vec, v, strict=True)), i, m) for i, m, v in sound if i != a and len(v) == len(vec)]
        for p, pid, _ in sorted(s for s in scored if s[2] == lab)[:k]:
            hard = sorted(s for s in scored if s[2] != lab and -80 * p <= -100 * s[0] <= -100 * p)[:k]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(hard)]
    return sorted(out)


def test_negatives_equal_plain_loops(spark, monkeypatch):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(9)] for _ in range(3)]
    data = [(i, rng.randrange(3), [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for i in range(400)]
    # Ties, repeated rows, a repeated anchor with another label, other lengths, and rows that take no part.
    data += [(1000 + i, 1, centres[0]) for i in range(20)] + [data[7], data[7], (10, 2, data[3][2]), (20, 0, [])]
    data += [(2000, 1, [1.0, 2.0]), (2001, 1, [2.0, 1.0]), (2002, 2, [1.0, 1.9]), (None, 1, centres[0]), (3000, None, centres[0])]
    data += [(3010, 1, None), (3020, 1, [None] + centres[0][1:]), (3030, 1, [float("nan")] + centres[0][1:])]
    df = clash(spark.createDataFrame(data, "vec_id long, label int, embedding array<float>"))
    monkeypatch.setattr(negatives, "GATHER", 100)
    monkeypatch.setattr(negatives, "ENTRIES", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    monkeypatch.setattr(negatives, "CELL_ANCHORS", 16)
    for layout in (df.coalesce(1), df.repartition(4)):
        got = negatives.mine(layout, "vec_id", F.col("label"), "embedding", F.col("vec_id") % 10 == 0)
        assert sorted(tuple(r) for r in got.collect()) == plain_negatives(data)
    assert negatives.mine(df.limit(0), "vec_id", F.col("label"), "embedding", F.col("vec_id") % 10 == 0).count() == 0
