"""Best-fit packing of documents into sequences of several permitted lengths.

A document longer than the longest sequence gives full sequences and a rest. Rests are dealt by a
hash of their row into groups of bounded size, and each group is packed in one task. For the longest rest left,
every permitted size that takes it is filled with the rests that fit best, and the size is opened whose
cost for each token that it then holds is least; so all sizes are weighed for each bin, by what is there to fill them. Beside that,
rests go in falling length, each into the fullest open bin that takes it, once for each choice of the largest size to
open. The cheapest of these packings is kept, with every bin downsized to the smallest size that holds its contents. Groups
lose at most a few unfilled bins each.

Defined results: a null or negative length counts as 0; a row of length 0 needs no room and comes back
with null bin, capacity and start; repeated rows are packed each; null keys are packed like others.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscreen.llm.common import parts_for
from postscreen.session import materialise

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
OUT = "key string, part long, length long, bin string, capacity long, start long"


def cost(capacity: int) -> int:
    """Cost of a sequence: its tokens, padding included, and a fixed part for each sequence."""
    return capacity + OVERHEAD


def _best_fit(falling: list[int], sizes: list[int], largest: int) -> list[list[int]]:
    """Items of each bin, opening no size over ``largest`` but for items that need it."""
    bins: list[list[int]] = []
    open_: dict[int, list[int]] = defaultdict(list)  # by room left
    mask = 0  # bit r is set if a bin with room r is open
    for item, n in enumerate(falling):
        room = mask >> n
        if room:
            r = n + (room & -room).bit_length() - 1
            b = open_[r].pop()
            if not open_[r]:
                mask &= ~(1 << r)
        else:
            fits = [c for c in sizes if c >= n]
            # The size of least cost for each token it holds.
            r = min([c for c in fits if c <= largest] or fits[:1], key=lambda c: (cost(c) / c, -c))
            b = len(bins)
            bins.append([])
        bins[b].append(item)
        if r > n:
            open_[r - n].append(b)
            mask |= 1 << (r - n)
    return bins


def _joint(falling: list[int], sizes: list[int]) -> list[list[int]]:
    """Items of each bin, the size of each chosen by what the lengths that are left can fill of it."""
    left: dict[int, list[int]] = defaultdict(list)
    for i in range(len(falling) - 1, -1, -1):
        left[falling[i]].append(i)
    mask = 0  # bit n is set if a rest of length n is left
    for n in left:
        mask |= 1 << n

    def filled(c: int, first: int) -> tuple[list[int], int]:
        """Lengths that go with ``first`` into a bin of size ``c``, each the longest that fits, and their sum."""
        used, room, taken, open_ = [first], c - first, {first: 1}, mask
        if len(left[first]) == 1:
            open_ &= ~(1 << first)
        while room:
            n = (open_ & ((2 << room) - 1)).bit_length() - 1
            if n <= 0:
                break
            used.append(n)
            room -= n
            taken[n] = taken.get(n, 0) + 1
            if taken[n] == len(left[n]):
                open_ &= ~(1 << n)
        return used, c - room

    bins = []
    while mask:
        first = mask.bit_length() - 1
        tried = [filled(c, first) for c in sizes if c >= first]
        # What a bin costs when it is downsized, for each token in it.
        used, _ = min(tried, key=lambda t: (cost(next(c for c in sizes if c >= t[1])) / t[1], -t[1]))
        items = []
        for n in used:
            items.append(left[n].pop())
            if not left[n]:
                mask &= ~(1 << n)
        bins.append(items)
    return bins


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, list[int]]]:
    """(capacity, items) of each bin of the cheapest packing found.

    Lengths are 1 to the largest capacity; items are places in ``lengths``.
    """
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    falling = [lengths[i] for i in order]
    found = []
    ways = [_joint(falling, sizes), *(_best_fit(falling, sizes, largest) for largest in sizes)]
    for way, bins in enumerate(ways):
        held = [sum(falling[i] for i in items) for items in bins]
        packed = [
            (next(c for c in sizes if c >= n), [order[i] for i in items])
            for n, items in zip(held, bins, strict=True)
        ]
        found.append((sum(cost(c) for c, _ in packed), way, packed))
    return min(found)[2]


def pack_rows(
    df: DataFrame, key: str, length: str, capacities: tuple[int, ...] = CAPACITIES, group_rows: int = 20_000
) -> DataFrame:
    """One row for each part of each row: key, part, length, bin, capacity, start.

    Only keys and lengths are shuffled, and groups hold about ``group_rows`` rests.
    """
    top = max(capacities)
    rows = df.select(
        # As text, in which pandas holds large keys beside null ones exactly.
        F.col(key).cast("string").alias("key"),
        F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long").alias("n"),
    )
    rows = materialise(rows, "lengths").withColumn("row", F.monotonically_increasing_id())
    n_groups = parts_for(rows.count(), group_rows)
    last = F.when(F.col("n") == 0, 0).otherwise(F.expr(f"(n - 1) div {top}")).cast("long")
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    left = F.least(F.lit(top), F.col("n") - F.col("part") * top).cast("long")
    parts = parts.select("key", "part", left.alias("length"), "row")
    # Parts that fill the largest sequence are bins of their own, made where they are read.
    whole = parts.filter(F.col("length") == top).select(
        "key", "part", "length",
        F.concat(F.lit("w"), F.col("row"), F.lit("-"), F.col("part")).alias("bin"),
        F.lit(top).cast("long").alias("capacity"),
        F.lit(0).cast("long").alias("start"),
    )
    none = parts.filter(F.col("length") == 0).select(
        "key", "part", "length",
        F.lit(None).cast("string").alias("bin"),
        F.lit(None).cast("long").alias("capacity"),
        F.lit(None).cast("long").alias("start"),
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key", "part", "row"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].tolist()
        group = int(pdf["group"].iloc[0])
        names, caps, starts = [""] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        for b, (capacity, items) in enumerate(pack(lengths, capacities)):
            at = 0
            for i in items:
                names[i], caps[i], starts[i] = f"g{group}-{b}", capacity, at
                at += lengths[i]
        return pdf[["key", "part", "length"]].assign(bin=names, capacity=caps, start=starts)

    rest = parts.filter((F.col("length") > 0) & (F.col("length") < top))
    # By the number of the row, so that copies of one row spread over the groups.
    group = F.pmod(F.xxhash64("row", "part"), F.lit(n_groups)).alias("group")
    packed = rest.select("key", "part", "length", "row", group).groupBy("group").applyInPandas(run, OUT)
    out = whole.unionByName(packed).unionByName(none)
    return out.withColumn("key", F.col("key").cast(df.schema[key].dataType)).withColumnRenamed("key", key)
