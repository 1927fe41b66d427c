"""Mixing sources to target weights by the cube method.

Every document of a source is to be taken target / size times on average, 0 to 2 times. The whole
part of that is taken for certain; the fraction is an inclusion probability, and the cube method
turns it into 0 or 1: it moves the probabilities of three documents at a time along the null
space of the balancing equations (tokens and documents), so that both totals stay what they are,
until one is 0 or 1. Blocks of bounded size do this in parallel, each leaves few open, and
what is open meets again in fewer blocks, until one small block of the source is left. There a few documents
of all sizes are kept aside; they and the last ones of the flight land on the rounding whose
tokens come nearest to the target. A source that fits a block does so at once.

A document that dwarfs those behind it hardly moves with them. It is drawn by its probability instead, and
the difference in tokens goes into the probabilities of the documents behind it: within a block, and, for
the longest documents of a source of several blocks, over the whole source beforehand.

All random numbers come from
the seed and the block, so reruns agree, whatever the partitions.

Defined results: a null text has size 0; the null source is a source of its own, behind all
others; documents of size 0 and sources of size 0 are taken 0 times; repeated rows are documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import random
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postscreen.llm.common import parts_for, small
from postscreen.operators.ordinal import with_ordinal
from postscreen.session import materialise

# Weights in the order of the sources, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
EPS = 1e-9
# Documents kept for the landing of each source.
LANDING = 14
# Documents of a source of several blocks that may be drawn beforehand, and how many times as long as those
# behind it (on average, or the next) a document is that is drawn.
LONGEST, WIDE = 64, 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target of each row of ``sizes`` (source, source_size, n_docs).

    Sources go by code point with null last. A target stops at ``most`` times its source; the
    excess is shared again by weight, one small aggregate per round, until none is above.
    """
    ranked = with_ordinal(
        sizes.withColumns({"none": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))}),
        ["none", "name"],
        name="ordinal",
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("ordinal", F.lit(len(weights))) + 1).cast("int"))
    rows = materialise(ranked.select("source", "source_size", "n_docs", weight.alias("weight")), "sources")
    pool = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * most
    at = 0.0  # tokens for each unit of weight; it only rises, and what stops once stays stopped
    while True:
        stopped = cap < F.col("weight") * at if at else F.lit(False)
        row = rows.agg(
            F.sum(F.when(stopped, cap)).alias("held"), F.sum(F.when(~stopped, F.col("weight"))).alias("free")
        ).first()
        free = row["free"] or 0
        after = (pool - (row["held"] or 0.0)) / free if free else at
        if not free or after <= at:
            break
        at = after
    return rows.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(at))))


def flight(sizes: list[float], probs: list[float], rng: random.Random) -> list[float]:
    """The flight phase over one block, in the given order: at most two probabilities stay open.

    The sums of probs and of sizes * probs stay what they are.
    """
    p = list(probs)
    live: list[int] = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        live.append(i)
        while len(live) == 3:
            live = _step(sizes, p, live, rng)
    # Two of equal size can still move against each other.
    while len(live) == 2 and sizes[live[0]] == sizes[live[1]]:
        live = _move(p, live, (1.0, -1.0), rng)
    return p


def _step(sizes: list[float], p: list[float], live: list[int], rng: random.Random) -> list[int]:
    a, b, c = (sizes[i] for i in live)
    u = (b - c, c - a, a - b)  # orthogonal to (1, 1, 1) and to the sizes
    if not any(u):
        u = (1.0, -1.0, 0.0)
    scale = max(map(abs, u))
    return _move(p, live, tuple(x / scale for x in u), rng)


def _move(p: list[float], live: list[int], u: tuple[float, ...], rng: random.Random) -> list[int]:
    """To the nearer face in direction u or -u, with the chances that keep every mean."""
    up = min(((1 - p[i]) / x if x > 0 else -p[i] / x) for i, x in zip(live, u, strict=True) if x)
    down = min((p[i] / x if x > 0 else (p[i] - 1) / x) for i, x in zip(live, u, strict=True) if x)
    step = up if rng.random() * (up + down) < down else -down
    for i, x in zip(live, u, strict=True):
        p[i] += step * x
        if p[i] < EPS:
            p[i] = 0.0
        elif p[i] > 1 - EPS:
            p[i] = 1.0
    return [i for i in live if 0 < p[i] < 1]


def draw_longest(sizes: list[float], p: float, tokens: float, rows: int, rng: random.Random) -> tuple[list[float], float]:
    """0 or 1 for the first of the longest ``sizes`` of a source, and the probability of all others.

    The source has ``rows`` documents with ``tokens`` in all, each of probability ``p``. Drawn are those that
    are ``WIDE`` times as long as the average of the others. Where the others can't make up for one
    of the choices, the other one is made.
    """
    out, due = [], p * tokens
    for s in sizes:
        if rows < 2 or s * (rows - 1) < WIDE * (tokens - s):
            break
        off = [max(-(due - take * s), due - take * s - (tokens - s), 0.0) for take in (0, 1)]
        take = int(rng.random() < p) if abs(off[0] - off[1]) < EPS else int(off[1] < off[0])
        out.append(float(take))
        tokens, rows = tokens - s, rows - 1
        due = min(max(due - take * s, 0.0), tokens)
        p = due / tokens if tokens else 0.0
    return out, p


def _shifted(sizes: np.ndarray, p: np.ndarray, rows: float, size: float) -> np.ndarray | None:
    """``p`` with ``rows`` more documents and ``rows * size`` more tokens in all; None if that leaves 0 to 1."""
    w = p * (1 - p)
    sums = [float((w * sizes**k).sum()) for k in range(3)]
    by = sums[0] * sums[2] - sums[1] ** 2
    if by <= EPS * max(1.0, sums[1] ** 2):
        return None
    a = (rows * sums[2] - rows * size * sums[1]) / by
    b = (rows * size * sums[0] - rows * sums[1]) / by
    out = p + w * (a + b * sizes)
    return out if len(out) and out.min() >= 0 and out.max() <= 1 else None


def steady(sizes: list[float], probs: list[float], rng: random.Random, last: bool = False) -> list[float]:
    """The flight over documents of falling sizes, with those drawn that dwarf the ones behind them.

    A draw moves the probabilities of all documents behind, so that tokens and documents stay what they are, or,
    where that would leave 0 to 1, the tokens. If
    these can't make up for both choices, the document stays open, or, in a ``last`` block, goes the way they can.
    """
    size, p = np.asarray(sizes, float), np.asarray(probs, float)
    live: list[int] = []

    def drawn(j: int, i: int) -> bool:
        rest, s = size[i:], size[j]
        free, held = float(rest @ (1 - p[i:])), float(rest @ p[i:])
        can = [p[j] * s <= free, (1 - p[j]) * s <= held]
        if not (all(can) or last and any(can)):
            return False
        take = rng.random() < p[j] if all(can) else can[1]
        both = _shifted(size[i:], p[i:], p[j] - take, s)
        if both is not None:
            p[i:] = both
        elif take:
            p[i:] *= 1 - (1 - p[j]) * s / held
        else:
            p[i:] += (1 - p[i:]) * (p[j] * s / free)
        p[j] = float(take)
        return True

    for i in range(len(p)):
        while live and size[live[0]] > WIDE * size[i] and drawn(live[0], i):
            live.pop(0)
        if not EPS < p[i] < 1 - EPS:
            p[i] = round(p[i])
            continue
        live.append(i)
        while len(live) == 3:
            live = _step(size, p, live, rng)
    while len(live) == 2 and size[live[0]] == size[live[1]]:
        live = _move(p, live, (1.0, -1.0), rng)
    return p.tolist()


def landing(sizes: list[float], p: list[float], due: float) -> list[float]:
    """Rounds what is open so that the tokens taken come nearest to ``due``, then the documents."""
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    tokens, rows = np.zeros(1), np.zeros(1)
    for i in open_:  # every choice, those of one more document behind the others
        tokens = np.concatenate([tokens, tokens + sizes[i]])
        rows = np.concatenate([rows, rows + 1])
    taken = sum(s for s, x in zip(sizes, p, strict=True) if x == 1)
    off = np.abs(tokens + taken - due)
    best = int(np.lexsort((np.abs(rows - sum(p[i] for i in open_)), off))[0])
    out = list(p)
    for k, i in enumerate(open_):
        out[i] = float(best >> k & 1)
    return out


def settle(sizes: list[float], probs: list[float], rng: random.Random) -> list[float]:
    """The flight and the landing of a source's last block, in which sizes fall.

    ``LANDING`` documents, spread over the sizes, stay out of the flight; they land together with what it
    leaves open, on the best of all their roundings.
    """
    n = len(sizes)
    aside = sorted({(2 * k + 1) * n // (2 * LANDING) for k in range(LANDING)} if n > LANDING else range(n))
    # One that dwarfs the others aside would land beside the target; it goes with the flight.
    while n > LANDING and len(aside) > 1 and sizes[aside[0]] > sum(sizes[i] for i in aside[1:]) / 2:
        aside.pop(0)
    rest = sorted(set(range(n)).difference(aside))
    p = list(probs)
    for i, x in zip(rest, steady([sizes[i] for i in rest], [p[i] for i in rest], rng, last=True), strict=True):
        p[i] = x
    return landing(sizes, p, sum(s * x for s, x in zip(sizes, probs, strict=True)))


def mix(
    df: DataFrame, key: str, size: Column, source: str, seed: int = 0, block_rows: int = 2000,
    **shares,
) -> DataFrame:
    """key, source, size, source_size, target, copies, taken (copies * size) of every row.

    Only keys, sizes and sources are shuffled; blocks hold about ``block_rows`` documents.
    """
    docs = materialise(
        df.select(
            # As text, in which pandas holds large keys beside null ones exactly.
            F.col(key).cast("string").alias("key"), size.cast("long").alias("size"), F.col(source).alias("source"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    # Rows that repeat so often that they would fill a block are dealt out by their number.
    same = F.xxhash64("key", "size", "source")
    heavy = docs.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(block_rows // 8, 1))
    heavy = small(materialise(heavy.select("same", F.lit(True).alias("heavy")), "heavy"))
    docs = docs.withColumn("same", same).join(heavy, "same", "left")
    docs = docs.withColumn("spread", F.when(F.col("heavy"), F.col("row")).otherwise(0)).drop("same", "heavy")
    sizes = docs.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum((F.col("size") > 0).cast("long")).alias("n_docs"),
    )
    goal = targets(sizes, **shares)
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Ratios like 1.9999999999 are whole numbers that were not computed as such.
    whole = F.floor(per + EPS)
    goal = goal.withColumns({"whole": whole, "p": F.greatest(per - whole, F.lit(0.0))})
    goal = goal.select("*", F.xxhash64("source", F.lit(seed)).alias("source_id"))
    joined = docs.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    open_ = joined.filter((F.col("p") > EPS) & (F.col("size") > 0)).select(
        "key", "size", "source_id", "p", "n_docs", "row", "spread", "source_size"
    )
    most = goal.filter(F.col("p") > EPS).agg(F.max("n_docs")).first()[0] or 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "spread"], ascending=[False, True, True], ignore_index=True)
        name = f"{seed}/{pdf['source_id'].iloc[0]}/{pdf['block'].iloc[0]}/{len(pdf)}"
        sizes, p = pdf["size"].astype(float).tolist(), pdf["p"].tolist()
        last = pdf["n_docs"].iloc[0] <= block_rows  # the source's only block
        p = (settle if last else steady)(sizes, p, random.Random(zlib.crc32(name.encode())))
        return pdf[["key", "size", "source_id", "spread"]].assign(p=p)

    def longest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "row"], ascending=[False, True, True], ignore_index=True)
        of = pdf.iloc[0]
        rng = random.Random(zlib.crc32(f"{seed}/{of['source_id']}/longest".encode()))
        sizes = pdf["size"].astype(float).tolist()
        p, others = draw_longest(sizes, float(of["p"]), float(of["source_size"]), int(of["n_docs"]), rng)
        return pdf[["key", "size", "source_id", "row"]].head(len(p)).assign(p=p, others=others, drawn=len(p))

    columns = ["key", "size", "source_id", "p"]
    decided = [joined.filter((F.col("p") <= EPS) | (F.col("size") == 0)).select(*columns[:3], F.lit(0.0).alias("p"))]
    if most > block_rows:
        order = Window.partitionBy("source_id").orderBy(F.desc("size"), "key", "row")
        first = open_.filter(F.col("n_docs") > block_rows).withColumn("place", F.row_number().over(order))
        first = first.filter(F.col("place") <= LONGEST).drop("place")
        schema = "key string, size long, source_id long, row long, p double, others double, drawn long"
        first = materialise(first.groupBy("source_id").applyInPandas(longest, schema), "longest")
        decided.append(first.select(*columns))
        after = first.select("source_id", "others", "drawn").distinct()
        open_ = open_.join(small(first.select("row")), "row", "left_anti").join(small(after), "source_id", "left")
        open_ = open_.withColumns(
            {"p": F.coalesce("others", "p"), "n_docs": F.col("n_docs") - F.coalesce("drawn", F.lit(0))}
        )
    while most > 0:
        last = most <= block_rows
        # As many blocks per source as it has open documents for; each leaves few.
        n_blocks = F.ceil(F.col("n_docs") / F.lit(block_rows))
        block = F.pmod(F.xxhash64("key", "size", "spread", F.lit(parts_for(most, block_rows))), n_blocks).cast("long")
        moved = open_.select("key", "size", "source_id", "p", "n_docs", "spread", block.alias("block"))
        moved = moved.groupBy("source_id", "block").applyInPandas(
            run, "key string, size long, source_id long, spread long, p double"
        )
        moved = materialise(moved, "flight")
        decided.append(moved.filter("p = 0 or p = 1").select(*columns))
        if last:
            break
        rest = moved.filter("p > 0 and p < 1")
        left = rest.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_docs"))
        open_ = materialise(rest.join(left, "source_id"), "open")
        most = open_.agg(F.max("n_docs")).first()[0] or 0
    per_source = goal.select("source_id", "source", "source_size", "target", "whole")
    rows = reduce(DataFrame.unionByName, decided).join(per_source, "source_id")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("long")).otherwise(0)
    return rows.select(
        F.col("key").cast(df.schema[key].dataType).alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
