import random

import pytest
from pyspark.sql import functions as F

from postscreen.operators.ordinal import batch_id, file_ordinal, number_parts, with_ordinal
from postscreen.operators.sized import join_small
from tests.conftest import layouts, rows


def test_ordinal_follows_the_order(spark):
    values = random.Random(1).sample(range(10**6), 1001)
    df = spark.createDataFrame([(v % 10, v) for v in values], "g int, v int")
    want = [(i, *p) for i, p in enumerate(sorted((v % 10, v) for v in values))]
    for layout in layouts(df, "v"):
        got = with_ordinal(layout, ["g", "v"]).select("ord", "g", "v")
        assert rows(got) == want


def test_parts_of_500(spark):
    df = spark.range(1001).select((1000 - F.col("id")).alias("k"))
    parts = number_parts(df, ["k"])
    assert parts.columns == ["k", "part"]
    got = rows(parts.groupBy("part").agg(F.count("*"), F.min("k"), F.max("k")))
    assert got == [(1, 500, 0, 499), (2, 500, 500, 999), (3, 1, 1000, 1000)]


def test_empty_and_single(spark):
    assert with_ordinal(spark.range(0), ["id"]).count() == 0
    assert rows(with_ordinal(spark.range(1), ["id"])) == [(0, 0)]


def test_more_ranges_than_rows(spark):
    assert rows(with_ordinal(spark.range(3), ["id"], ranges=16)) == [(0, 0), (1, 1), (2, 2)]
    with pytest.raises(ValueError):
        with_ordinal(spark.range(3), ["id"], ranges=0)


def test_rows_of_files_are_numbered_where_they_stand(spark, tmp_path):
    path = str(tmp_path / "sorted")
    df = spark.range(1000).select((999 - F.col("id")).alias("k"), F.lit(None).cast("string").alias("_file"), F.lit(1).alias("_place"))
    df.repartitionByRange(7, "k").sortWithinPartitions("k").write.parquet(path)
    spark.range(0).select(F.col("id").alias("k"), F.lit("").alias("_file"), F.lit(1).alias("_place")).write.mode("append").parquet(path)
    near = file_ordinal(spark, path)
    assert near.columns == ["k", "_file", "_place", "ord"]
    assert rows(near) == rows(with_ordinal(df, ["k"]).select(*near.columns))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert rows(file_ordinal(spark, path, max_files=3)) == rows(near)
    with pytest.raises(ValueError):
        file_ordinal(spark, path, "k")


def test_large_files_are_cut_and_still_numbered(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(20_000).coalesce(1).write.option("parquet.block.size", 1024).parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = file_ordinal(spark, path)
        assert df.rdd.getNumPartitions() > 1
        assert df.filter("id = ord").count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_without_rows(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert file_ordinal(spark, str(tmp_path / "none")).count() == 0


def test_batches(spark):
    got = batch_id(spark.range(20), ["id"]).groupBy("batch").count()
    assert rows(got) == [(0, 8), (1, 8), (2, 4)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_join_beyond_the_bound_gives_the_same(spark, how):
    big = spark.range(1000).select("id", (F.col("id") % 13).alias("g"))
    small = spark.range(10).select(F.col("id").alias("g"), *([] if how == "left_semi" else [F.lit(1).alias("x")]))
    near = join_small(big, small, ["g"], "id", how)
    far = join_small(big, small, ["g"], "id", how, max_rows=5)
    assert rows(near.select(*sorted(near.columns))) == rows(far.select(*sorted(near.columns)))
    assert "Broadcast" in near._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in far._jdf.queryExecution().executedPlan().toString()
