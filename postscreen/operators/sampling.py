"""Reproducible splitting, balancing and shuffling.

Every choice is made by the md5 of seed and key, so a row's fate depends neither on partitioning
nor on cluster size. Keys must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postscreen.operators.ordinal import with_ordinal
from postscreen.operators.sized import join_small
from postscreen.session import materialise

# Hash prefix of four hexadecimal digits: at most 65,536 histogram cells per class.
_PREFIX = 4
# Digits of a hash, and rows of a class that one task ranks at most where keys are unique.
_DIGITS, MAX_RANKED = 32, 100_000
# Sixty bits of a hash, enough that a remainder of it is even over any class size.
_INDEX_DIGITS = 15
# Rows that one row is turned into at a time.
_BLOCK = 10_000


def seeded_hash(key: str, seed: int | str) -> Column:
    """32 hexadecimal digits: md5 of ``seed:key``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def split(
    df: DataFrame, key: str, frac: float = 0.2, seed: int = 42, exact: bool = False
) -> DataFrame:
    """Add ``side``: ``val`` for a share ``frac`` of the rows, ``train`` for the rest.

    By default a row is ``val`` when its hash lies in the lowest ``frac`` of the hash range: no
    shuffle, no second pass, stable when rows are added, size approximate. With ``exact`` the
    ceil(frac * n) rows with the smallest hashes are ``val``; that takes two extra passes over the
    key column alone, and the table itself is still not shuffled.
    """
    digest = seeded_hash(key, seed)
    if exact:
        hashed = df.select(F.lit(0).alias("_g"), digest.alias("_h"), F.col(key).alias("_k"))
        cells = materialise(_histogram(hashed, ["_g"]), "split")
        rows = cells.agg(F.sum("_n").alias("n")).first()["n"] or 0
        # Rounded first, so that 0.2 * 15 does not come out a hair above 3.
        wanted = math.ceil(round(frac * rows, 9))
        quotas = cells.select("_g").distinct().withColumn("_quota", F.lit(wanted).cast("long"))
        cut = _cutoffs(hashed, ["_g"], cells, quotas).first()
        if cut is None:
            in_val = F.lit(False)
        else:
            in_val = (digest < cut["_cut_h"]) | (
                (digest == cut["_cut_h"]) & (F.col(key) <= F.lit(cut["_cut_k"]))
            )
    else:
        bound = round(frac * 16**8)
        in_val = (
            F.lit(True) if bound >= 16**8 else F.substring(digest, 1, 8) < F.lit(f"{bound:08x}")
        )
    return df.withColumn("side", F.when(in_val, "val").otherwise("train"))


def _histogram(hashed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group and hash prefix: at most 65,536 per group, whatever the table's size."""
    return hashed.groupBy(*by, F.substring("_h", 1, _PREFIX).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_n")
    )


def _cutoffs(
    hashed: DataFrame, by: Sequence[str], cells: DataFrame, quotas: DataFrame, most: int = MAX_RANKED
) -> DataFrame:
    """Per group the hash and key of its ``_quota``-th smallest row; no row for a quota of 0.

    The histogram names the one cell per group in which the quota is reached. A cell of more than ``most`` rows is counted
    again by the next digits of the hash, as often as it takes, and only the rows of the last cell are ranked.
    """
    digits, boundary = _PREFIX, _boundary(cells, by, quotas)
    while digits < _DIGITS and (boundary.agg(F.max("_n")).first()[0] or 0) > most:
        inside = _in_cells(hashed, by, boundary, digits)
        digits += _PREFIX
        finer = inside.groupBy(*by, F.substring("_h", 1, digits).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
        wanted = boundary.select(*by, F.col("_need").alias("_quota"))
        boundary = materialise(_boundary(materialise(finer, "cells"), by, wanted), "boundary")
    order = W.partitionBy(*by).orderBy("_h", "_k")
    ranked = _in_cells(hashed, by, boundary, digits).withColumn("_r", F.row_number().over(order))
    return ranked.filter(F.col("_r") == F.col("_need")).select(
        *by, F.col("_h").alias("_cut_h"), F.col("_k").alias("_cut_k")
    )


def _boundary(cells: DataFrame, by: Sequence[str], quotas: DataFrame) -> DataFrame:
    """Per group the cell in which ``_quota`` is reached, its rows as ``_n``, and how many of them are needed."""
    running = W.partitionBy(*by).orderBy("_cell")
    return (
        cells.withColumn("_upto", F.sum("_n").over(running))
        .join(quotas, list(by))
        .filter((F.col("_quota") <= F.col("_upto")) & (F.col("_quota") > F.col("_upto") - F.col("_n")))
        .select(*by, "_cell", "_n", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )


def _in_cells(hashed: DataFrame, by: Sequence[str], boundary: DataFrame, digits: int) -> DataFrame:
    """The hashed rows of the cells in ``boundary``, which are prefixes of so many digits."""
    placed = hashed.withColumn("_cell", F.substring("_h", 1, digits))
    return join_small(placed, boundary.select(*by, "_cell", "_need"), [*by, "_cell"], spread="_k", how="inner")


@dataclass(frozen=True)
class Balanced:
    """A table with ``copies``: how often each row must occur for all classes to be of equal size.

    A model that takes weights can use the column as it is, instead of reading a text as often as
    it is repeated.
    """

    weighted: DataFrame
    # Whether some rows are needed so often that their copies should be made by many tasks.
    heavy: bool

    def repeated(self) -> DataFrame:
        """Each row as often as its ``copies`` says, numbered from 1 by ``copy``."""
        df = self.weighted
        if not self.heavy:
            return _repeat(df, None)
        often = F.col("copies") > _BLOCK
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return _repeat(df.filter(~often), None).unionByName(_repeat(df.filter(often), tasks))


def _repeat(df: DataFrame, tasks: int | None) -> DataFrame:
    """Two nested explodes, so that no array is longer than a block; with ``tasks`` the blocks of
    a row are spread over that many."""
    blocks = df.withColumn("_block", F.explode(F.expr(f"sequence(0L, (copies - 1L) div {_BLOCK})")))
    if tasks is not None:
        blocks = blocks.repartition(tasks)
    copy = F.explode(
        F.expr(f"sequence(_block * {_BLOCK} + 1, least((_block + 1) * {_BLOCK}, copies))")
    )
    return blocks.withColumn("copy", copy).drop("copies", "_block")


def oversample(
    df: DataFrame, label: str, key: str, seed: int = 42, mode: str = "even"
) -> DataFrame:
    """Raise every class to the size of the largest by repeating rows; every original stays.

    Adds ``copy``, counted from 1 per original. See ``balance`` for the modes.
    """
    return balance(df, label, key, seed, mode).repeated()


def balance(
    df: DataFrame, label: str, key: str, seed: int = 42, mode: str = "even"
) -> Balanced:
    """How often each row must occur for every class to be as large as the largest.

    ``even`` repeats all rows of a class equally often, give or take one; ``bootstrap`` draws the
    repeats with replacement. Rows without a label occur once.
    """
    if mode not in ("even", "bootstrap"):
        raise ValueError(f"unknown mode {mode!r}")
    hashed = df.filter(F.col(label).isNotNull()).select(
        label, seeded_hash(key, seed).alias("_h"), F.col(key).alias("_k")
    )
    cells = materialise(_histogram(hashed, [label]), "classes")
    classes = cells.groupBy(label).agg(F.sum("_n").alias("_size"))
    sizes = classes.agg(F.max("_size").alias("most"), F.min("_size").alias("least")).first()
    largest = sizes["most"] or 0
    if mode == "even":
        weighted = _even_copies(df, hashed, cells, classes, label, key, seed, largest)
    else:
        weighted = _drawn_copies(df, hashed, classes, label, key, seed, largest)
    return Balanced(weighted, heavy=largest > _BLOCK * (sizes["least"] or 1))


def _even_copies(
    df: DataFrame,
    hashed: DataFrame,
    cells: DataFrame,
    classes: DataFrame,
    label: str,
    key: str,
    seed: int,
    largest: int,
) -> DataFrame:
    """``largest div size`` copies of every row, one more for the ``largest mod size`` smallest.

    One row per class is joined on; the table itself is not shuffled.
    """
    quotas = classes.select(label, F.expr(f"{largest}L % _size").alias("_quota"))
    plan = classes.select(label, F.expr(f"{largest}L div _size").alias("_times")).join(
        _cutoffs(hashed, [label], cells, quotas), label, "left"
    )
    digest = seeded_hash(key, seed)
    extra = (digest < F.col("_cut_h")) | (
        (digest == F.col("_cut_h")) & (F.col(key) <= F.col("_cut_k"))
    )
    times = F.coalesce(F.col("_times"), F.lit(1)).cast("long")
    return (
        join_small(df, materialise(plan, "copies"), [label], spread=key)
        .withColumn("copies", times + F.coalesce(extra, F.lit(False)).cast("long"))
        .select(*[F.col(f"`{c}`") for c in df.columns], "copies")
    )


def _drawn_copies(
    df: DataFrame,
    hashed: DataFrame,
    classes: DataFrame,
    label: str,
    key: str,
    seed: int,
    largest: int,
) -> DataFrame:
    """One copy of every row and one for each of ``largest - size`` seeded draws of its class.

    Draw i of a class hits the row with rank md5(seed:label:i) modulo the class size in hash order.
    Draws are counted per rank before the join, and ranks are unique, so no join key is hot.
    """
    short = classes.filter(F.col("_size") < largest)
    ranked = with_ordinal(
        join_small(hashed, short.select(label), [label], spread="_k", how="left_semi"),
        [label, "_h", "_k"],
        "_ord",
    )
    firsts = ranked.groupBy(label).agg(F.min("_ord").alias("_first"))
    ranked = join_small(ranked, firsts, [label], spread="_k").select(
        label, F.col("_k").alias(key), (F.col("_ord") - F.col("_first")).alias("_rank")
    )
    # The draws of a class are generated in blocks, so that no task makes them all. The explicit
    # number keeps adaptive execution from merging the still tiny partitions.
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last_block = F.expr(f"({largest}L - _size - 1) div {_BLOCK}")
    draw = F.explode(
        F.expr(
            f"sequence(_block * {_BLOCK}L, "
            f"least((_block + 1) * {_BLOCK}L, {largest}L - _size) - 1)"
        )
    )
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(label).cast("string"), F.col("_draw")))
    index = F.conv(F.substring(digest, 1, _INDEX_DIGITS), 16, 10).cast("long")
    hits = (
        short.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
        .repartition(ranges, label, "_block")
        .select(label, "_size", draw.alias("_draw"))
        .select(label, (index % F.col("_size")).alias("_rank"))
        .groupBy(label, "_rank")
        .agg(F.count(F.lit(1)).alias("_hits"))
    )
    extra = ranked.join(hits, [label, "_rank"]).select(key, "_hits")
    # Only the classes that are drawn from meet their draws; the largest is not shuffled.
    drawn = join_small(df, short.select(label), [label], spread=key, how="left_semi")
    others = join_small(df, short.select(label), [label], spread=key, how="left_anti")
    once = F.lit(1).cast("long")
    return (
        drawn.join(extra, key, "left")
        .withColumn("copies", once + F.coalesce("_hits", F.lit(0)))
        .select(*[F.col(f"`{c}`") for c in df.columns], "copies")
        .unionByName(others.withColumn("copies", once))
    )


def shuffle(df: DataFrame, key: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Rows in a seeded order that differs from epoch to epoch."""
    return df.orderBy(seeded_hash(key, f"{seed}:{epoch}"), key)


def shuffled_batches(
    df: DataFrame, key: str, size: int = 8, seed: int = 42, epoch: int = 0
) -> DataFrame:
    """Add ``batch``: the number of the batch of ``size`` rows in the seeded order of an epoch."""
    mixed = df.withColumn("_h", seeded_hash(key, f"{seed}:{epoch}"))
    return (
        with_ordinal(mixed, ["_h", key], "_ord")
        .withColumn("batch", F.expr(f"_ord div {int(size)}"))
        .drop("_h", "_ord")
    )
