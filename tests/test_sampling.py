import hashlib
import math

import pytest
from pyspark.sql import functions as F

from postscreen.operators import sampling
from postscreen.operators.sampling import oversample, shuffle, shuffled_batches, split
from tests.conftest import layouts, rows


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("exact", [False, True])
def test_split_is_the_same_in_any_layout(spark, exact):
    df = spark.range(1000).withColumnRenamed("id", "k")
    first, *others = [rows(split(d, "k", exact=exact)) for d in layouts(df, "k")]
    assert first == others[0] == others[1]
    assert [k for k, _ in first] == list(range(1000))


def test_bucket_split_is_stable_under_added_rows(spark):
    small = dict(rows(split(spark.range(500), "id")))
    large = dict(rows(split(spark.range(2000), "id")))
    assert all(large[k] == side for k, side in small.items())
    assert 300 < sum(s == "val" for s in large.values()) < 500


@pytest.mark.parametrize("n,frac", [(1000, 0.2), (1001, 0.2), (7, 0.5), (15, 0.2), (3, 0.0), (3, 1.0), (0, 0.2)])
def test_exact_split_takes_the_smallest_hashes(spark, n, frac):
    got = dict(rows(split(spark.range(n), "id", frac, exact=True)))
    wanted = math.ceil(round(frac * n, 9))
    ranked = sorted(range(n), key=lambda k: (md5(f"42:{k}"), k))
    assert {k for k, s in got.items() if s == "val"} == set(ranked[:wanted])


def test_exact_split_of_string_keys(spark):
    df = spark.range(300).select(F.concat(F.lit("post-"), "id").alias("k"))
    assert split(df, "k", 0.1, exact=True).filter("side = 'val'").count() == 30


@pytest.mark.parametrize("frac,side", [(0.0, "train"), (1.0, "val")])
def test_bucket_split_extremes(spark, frac, side):
    assert split(spark.range(50), "id", frac).filter(F.col("side") == side).count() == 50


def classes(spark, *sizes):
    rows_ = [(i, c) for c, n in enumerate(sizes) for i in range(sum(sizes[:c]), sum(sizes[:c]) + n)]
    return spark.createDataFrame(rows_, "k long, y int")


@pytest.mark.parametrize("mode", ["even", "bootstrap"])
@pytest.mark.parametrize("sizes", [(50, 7), (50, 7, 23), (9, 9), (12,), (100, 1)])
def test_classes_come_out_equal_and_originals_stay(spark, mode, sizes):
    df = classes(spark, *sizes)
    layouts_ = [rows(oversample(d, "y", "k", mode=mode)) for d in layouts(df, "k")]
    assert layouts_[0] == layouts_[1] == layouts_[2]
    got = layouts_[0]
    for c in range(len(sizes)):
        assert sum(y == c for _, y, _ in got) == max(sizes)
    assert {k for k, _, copy in got if copy == 1} == set(range(sum(sizes)))
    assert len(set(got)) == len(got)


def test_even_copies_differ_by_one(spark):
    got = oversample(classes(spark, 50, 7), "y", "k").filter("y = 1")
    counts = {r["k"]: r["count"] for r in got.groupBy("k").count().collect()}
    smallest = sorted(counts, key=lambda k: md5(f"42:{k}"))[: 50 % 7]
    assert all(counts[k] == 50 // 7 + (k in smallest) for k in counts)


def test_bootstrap_follows_the_draws(spark):
    got = oversample(classes(spark, 40, 6), "y", "k", mode="bootstrap").filter("y = 1")
    ranked = sorted(range(40, 46), key=lambda k: md5(f"42:{k}"))
    want = dict.fromkeys(ranked, 1)
    for i in range(34):
        want[ranked[int(md5(f"42:1:{i}")[:15], 16) % 6]] += 1
    assert {r["k"]: r["count"] for r in got.groupBy("k").count().collect()} == want


@pytest.mark.parametrize("mode", ["even", "bootstrap"])
def test_many_copies_are_made_in_blocks(spark, mode, monkeypatch):
    df = classes(spark, 500, 2, 37)
    want = rows(oversample(df, "y", "k", mode=mode))
    monkeypatch.setattr(sampling, "_BLOCK", 7)
    assert rows(oversample(df, "y", "k", mode=mode)) == want


def test_rows_without_label_stay_single(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None)], "k long, y int")
    for mode in ("even", "bootstrap"):
        got = rows(oversample(df, "y", "k", mode=mode))
        assert [r for r in got if r[0] == 4] == [(4, None, 1)]
        assert len(got) == 5


@pytest.mark.parametrize("mode", ["even", "bootstrap"])
def test_empty_table(spark, mode):
    empty = spark.createDataFrame([], "k long, y int")
    assert oversample(empty, "y", "k", mode=mode).count() == 0
    assert split(empty, "k").count() == 0


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        oversample(classes(spark, 1), "y", "k", mode="other")


def test_shuffle_differs_by_epoch(spark):
    orders = [[r["id"] for r in shuffle(spark.range(100), "id", epoch=e).collect()] for e in (0, 0, 1)]
    assert orders[0] == orders[1] != orders[2]
    assert orders[0] == sorted(range(100), key=lambda k: md5(f"42:0:{k}"))
    batches = dict(rows(shuffled_batches(spark.range(100), "id")))
    assert batches == {k: i // 8 for i, k in enumerate(orders[0])}


def test_balancing_does_not_shuffle_the_table(spark):
    df = spark.range(100).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"), F.lit("t").alias("text"))
    plan = oversample(df, "y", "id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_cutoffs_by_more_digits_are_the_same(spark):
    df = spark.range(3_000).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"), "id")
    # Hashes that agree in their first digits, so that one cell holds everything, and some that agree in all.
    alike = F.when(F.col("g") == 2, F.lit("0" * 32)).otherwise(F.concat(F.lit("0" * 6), F.substring("h", 7, 26)))
    hashed = df.select(F.col("g").alias("_g"), alike.alias("_h"), F.col("id").alias("_k"))
    cells = sampling._histogram(hashed, ["_g"])
    quotas = spark.createDataFrame([(0, 17), (1, 1000), (2, 400)], "_g long, _quota long")
    data = sorted((r["_g"], r["_h"], r["_k"]) for r in hashed.collect())
    want = [[r for r in data if r[0] == g][q - 1] for g, q in ((0, 17), (1, 1000), (2, 400))]
    for most in (2, 50, 10_000):
        got = sampling._cutoffs(hashed, ["_g"], cells, quotas, most)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert sampling._cutoffs(hashed.limit(0), ["_g"], cells.limit(0), quotas, 2).isEmpty()
