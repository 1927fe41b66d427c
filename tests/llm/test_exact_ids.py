"""Keys beyond 2^53 beside null ones, rows that repeat, and packings against the optimum."""

import random
from collections import Counter
from functools import cache

import pytest
from pyspark.sql import functions as F

from postscreen.llm import mixing, packing

BIG = 2**60


def sized(spark, n=89):
    data = [(BIG + i, 10 + i % 7, f"s{i % 3}") for i in range(n)] + [(None, 5, "s1")] * 3
    return spark.createDataFrame(data, "doc_id long, n long, source string")


def test_packing_keeps_large_keys_beside_null_ones(spark):
    df = sized(spark)
    got = packing.pack_rows(df, "doc_id", "n")
    assert dict(got.dtypes)["doc_id"] == "bigint"
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in df.collect())
    names = df.withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id")))
    assert Counter(r["doc_id"] for r in packing.pack_rows(names, "doc_id", "n").collect())[None] == 3


def test_mixing_keeps_large_keys_beside_null_ones(spark):
    df = sized(spark)
    for block_rows in (2000, 10):
        got = mixing.mix(df, "doc_id", F.col("n"), "source", block_rows=block_rows)
        assert dict(got.dtypes)["doc_id"] == "bigint"
        assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in df.collect())


def test_a_row_in_a_third_of_the_table_fills_no_group(spark, monkeypatch):
    data = [(7, 30, "a")] * 6000 + [(i, 20 + i % 50, "a") for i in range(12_000)]
    df = spark.createDataFrame(data, "doc_id long, n long, source string")
    bins = packing.pack_rows(df, "doc_id", "n", group_rows=1000).filter("bin is not null")
    groups = bins.groupBy(F.split("bin", "-")[0].alias("g")).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert groups[0] < 1300 and groups[1] == 18
    seen = []
    plain = mixing.F.xxhash64

    def spy(*columns):
        if "spread" in [c for c in columns if isinstance(c, str)]:
            seen.append(columns)
        return plain(*columns)

    monkeypatch.setattr(mixing.F, "xxhash64", spy)
    got = mixing.mix(df, "doc_id", F.col("n"), "source", block_rows=500, share=0.5).cache()
    assert seen and got.count() == 18_000
    taken, due = got.agg(F.sum("taken"), F.max("target")).first()
    assert abs(taken - due) <= 70


@pytest.mark.parametrize("seed", range(25))
def test_packings_are_near_the_optimum(seed):
    rng = random.Random(seed)
    sizes = (8, 16, 32)
    lengths = [rng.randint(1, 32) for _ in range(rng.randint(1, 7))]

    @cache
    def best(left: tuple[int, ...]) -> int:
        if not left:
            return 0
        first, rest, out = left[0], left[1:], 10**9
        for pick in range(1 << len(rest)):
            held = first + sum(n for i, n in enumerate(rest) if pick >> i & 1)
            if held <= max(sizes):
                others = tuple(n for i, n in enumerate(rest) if not pick >> i & 1)
                out = min(out, packing.cost(min(c for c in sizes if c >= held)) + best(others))
        return out

    found = packing.pack(lengths, sizes)
    spent = sum(packing.cost(c) for c, _ in found)
    assert best(tuple(lengths)) <= spent <= 1.25 * best(tuple(lengths))
    assert sorted(i for _, items in found for i in items) == list(range(len(lengths)))


def test_several_sizes_are_opened_where_that_is_cheaper():
    """A table on which the joint choice is cheaper than best fit with any one largest size."""
    rng = random.Random(0)
    sizes, won = sorted(packing.CAPACITIES), 0
    for _ in range(40):
        lengths = sorted((rng.choice([400, 500, 900, 1000, 1800, 2000, 2600, 3500]) - rng.randint(0, 60) for _ in range(60)), reverse=True)

        def spent(bins, lengths=lengths):
            return sum(packing.cost(min(c for c in sizes if c >= sum(lengths[i] for i in b))) for b in bins)

        joint = spent(packing._joint(lengths, sizes))
        single = min(spent(packing._best_fit(lengths, sizes, largest)) for largest in sizes)
        won += joint < single
        assert spent(b for _, b in packing.pack(lengths)) <= min(joint, single)
    assert won >= 5


def test_draws_hold_tokens_and_documents():
    rng = random.Random(4)
    sizes = sorted([400.0] + [float(random.Random(i).randint(20, 60)) for i in range(300)], reverse=True)
    for _ in range(20):
        p = mixing.steady(sizes, [0.4] * len(sizes), rng)
        assert abs(sum(p) - 0.4 * len(sizes)) <= 1e-6
        assert abs(sum(s * x for s, x in zip(sizes, p, strict=True)) - 0.4 * sum(sizes)) <= 1e-6 * sum(sizes)
