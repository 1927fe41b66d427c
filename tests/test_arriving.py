import os

import pytest
from pyspark.sql import functions as F

from postscreen.sources import arriving
from postscreen.sources.posts import write_parts, write_posts
from tests.conftest import rows

SCHEMA = "k long, text string"


def deliver(spark, folder, lo, hi, at):
    """One file of posts, some without a text or with line breaks, dated ``at``."""
    text = F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit('a "b",\n'), "id"))
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    write_posts(spark.range(lo, hi).select(F.col("id").alias("k"), text.alias("text")).coalesce(1), folder, "append")
    for name in set(os.listdir(folder)) - before:
        os.utime(f"{folder}/{name}", (at, at))


def run(spark, tmp, n=10, per_batch=None):
    stream = arriving.read_arriving(spark, f"{tmp}/in", SCHEMA, per_batch)
    arriving.write_arriving_parts(stream, f"{tmp}/out", f"{tmp}/log", ["k"], n).awaitTermination()


def parts(spark, path):
    schema = "k long, text string, posts_part long"
    back = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows(back.select("posts_part", "k", "text"))


def expected(spark, tmp, name, n=10):
    """The parts of everything that has arrived, written at once."""
    whole = spark.read.schema(SCHEMA).csv(f"{tmp}/in", header=True, multiLine=True, quote='"', escape='"')
    write_parts(whole, f"{tmp}/{name}", ["k"], n)
    return parts(spark, f"{tmp}/{name}")


def test_runs_fill_the_last_part(spark, tmp_path):
    for i, (lo, hi) in enumerate([(0, 13), (13, 15), (15, 40), (40, 40), (40, 61)]):
        deliver(spark, f"{tmp_path}/in", lo, hi, 1_700_000_000 + i)
        run(spark, tmp_path)
        assert parts(spark, f"{tmp_path}/out") == expected(spark, tmp_path, f"want{i}")
    files = [f for _, _, names in os.walk(f"{tmp_path}/out") for f in names if f.endswith(".csv")]
    assert len(files) == 7  # a file for each part


def test_batches_of_one_file(spark, tmp_path):
    for i in range(4):
        deliver(spark, f"{tmp_path}/in", i * 9, i * 9 + 9, 1_700_000_000 + i)
    run(spark, tmp_path, per_batch=1)
    assert os.listdir(f"{tmp_path}/log/parts").__len__() == 4
    assert parts(spark, f"{tmp_path}/out") == expected(spark, tmp_path, "want")


@pytest.mark.parametrize("dies_in", ["save_parts", "_keep"])
@pytest.mark.parametrize("after", [False, True])
def test_a_run_that_dies_is_made_good(spark, tmp_path, monkeypatch, dies_in, after):
    deliver(spark, f"{tmp_path}/in", 0, 23, 1_700_000_000)
    run(spark, tmp_path)
    deliver(spark, f"{tmp_path}/in", 23, 47, 1_700_000_001)
    works = getattr(arriving, dies_in)

    def dies(*args, **options):
        if after:
            works(*args, **options)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(arriving, dies_in, dies)
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path)
    deliver(spark, f"{tmp_path}/in", 47, 58, 1_700_000_002)
    run(spark, tmp_path)
    assert parts(spark, f"{tmp_path}/out") == expected(spark, tmp_path, "want")


def test_keys_that_are_missing_or_repeat_lose_no_row(spark, tmp_path):
    for i, keys in enumerate([[None, 1, 2], [3, 3, 3, None, None]]):
        df = spark.createDataFrame([(k, f"{i} {j}") for j, k in enumerate(keys)], SCHEMA)
        write_posts(df.coalesce(1), f"{tmp_path}/in", "append")
        run(spark, tmp_path, 2)
    got = parts(spark, f"{tmp_path}/out")
    assert sorted(p for p, _, _ in got) == [1, 1, 2, 2, 3, 3, 4, 4]
    assert sorted(t for _, _, t in got) == ["0 0", "0 1", "0 2", "1 0", "1 1", "1 2", "1 3", "1 4"]


def test_nothing_arrives(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    run(spark, tmp_path)
    assert not os.path.exists(tmp_path / "out")


def test_clashing_names(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    stream = arriving.read_arriving(spark, f"{tmp_path}/in", "k long, _ord long")
    with pytest.raises(ValueError, match="_ord"):
        arriving.write_arriving_parts(stream, f"{tmp_path}/out", f"{tmp_path}/log", ["k"])
