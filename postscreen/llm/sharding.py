"""Shards of bounded size by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of the key's hash. A bucket over the limit splits on
the next bit and no other bucket does, so the leaves have different depths. The sizes come from
one aggregate over 16 bits of the hash at a time: at most 65,536 cells for each bucket that is
still too large, and rows meet the directory by those bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postscreen.session import materialise

STEP = 16
MAX_BITS = 64


def key_bits(key: Column, step: int) -> Column:
    """Bits 16 * step to 16 * step + 15 of the md5 of the key as text, as a number; null counts as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 4 * step + 1, 4), 16, 10).cast("int")


def _bits(value: Column, width: Column) -> Column:
    """The first ``width`` bits of a 16-bit value, as a string of 0 and 1."""
    return F.substring(F.lpad(F.bin(value), STEP, "0"), F.lit(1), width)


def _directory(cells: DataFrame, limit: int, last: bool) -> DataFrame:
    """The shard of every cell of ``cells`` (prefix, cell, bytes, rows); ``open`` if still too large."""
    depth = F.explode(F.sequence(F.lit(0), F.lit(STEP)))
    deep = cells.withColumn("d", depth).withColumn("part", F.expr(f"shiftright(cell, {STEP} - d)"))
    sizes = deep.groupBy("prefix", "d", "part").agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows")
    )
    fits = (F.col("shard_bytes") <= limit) | (F.col("d") == STEP)
    sizes = sizes.filter(fits).withColumn("open", F.col("shard_bytes") > limit)
    mine = deep.select("prefix", "cell", "d", "part").join(sizes, ["prefix", "d", "part"])
    leaf = mine.groupBy("prefix", "cell").agg(
        F.min(F.struct("d", "part", "shard_bytes", "shard_rows", "open")).alias("leaf")
    )
    bits = F.concat("prefix", _bits(F.col("cell"), F.col("leaf.d")))
    return leaf.select(
        "prefix",
        "cell",
        bits.alias("shard"),
        "leaf.shard_bytes",
        "leaf.shard_rows",
        (F.col("leaf.open") & F.lit(not last)).alias("open"),
        (F.col("leaf.open") & F.lit(last)).alias("oversized"),
    )


def shard(df: DataFrame, key: str, n_bytes: str, limit: int) -> DataFrame:
    """Each row's key and size with ``shard`` (its bits), ``depth``, ``shard_bytes``, ``shard_rows``, ``oversized``.

    ``df`` is read once for each 16 bits in use, and only its key and size. Defined results: a
    null size counts 0; rows with equal keys stay together, null keys too; a shard that has used
    all 64 bits and is still over the limit is ``oversized`` (a single row over the limit, or
    repeated keys); an empty table gives no rows; the whole table is one shard with no bits when it fits.
    """
    rows = df.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(n_bytes), F.lit(0)).cast("long").alias("n_bytes"),
        F.lit("").alias("prefix"),
    )
    done = []
    for step in range(MAX_BITS // STEP):
        rows = rows.withColumn("cell", key_bits(F.col("key"), step))
        cells = rows.groupBy("prefix", "cell").agg(
            F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")
        )
        last = step == MAX_BITS // STEP - 1
        directory = materialise(_directory(cells, limit, last), "directory")
        found = rows.join(F.broadcast(directory) if step == 0 else directory, ["prefix", "cell"])
        done.append(found.filter(~F.col("open")))
        if directory.filter("open").isEmpty():
            break
        rows = found.filter("open").select("key", "n_bytes", F.col("shard").alias("prefix"))
    return reduce(DataFrame.unionByName, done).select(
        F.col("key").alias(key),
        "n_bytes",
        "shard",
        F.length("shard").alias("depth"),
        "shard_bytes",
        "shard_rows",
        "oversized",
    )


def write_shards(df: DataFrame, key: str, n_bytes: str, limit: int, path: str) -> None:
    """Writes ``df`` with a folder per shard. Keys must be unique."""
    placed = shard(df, key, n_bytes, limit).select(F.col(key).alias("_key"), "shard")
    rows = df.join(placed, F.col(key) == F.col("_key")).drop("_key")
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
