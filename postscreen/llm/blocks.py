"""Vectors packed into blocks of bounded size, and pairs of query blocks and entry blocks.

A block is one row: the ids and the vectors of its rows as bytes. Tasks work on a pair of blocks
at a time with numpy, so that memory is bounded by two blocks whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postscreen.llm.common import parts_for

BLOCK = "block long, ids binary, vectors binary, more binary"
FOUND = "query_id long, vec_id long, score {}"


def finite(vector: Column) -> Column:
    """Whether a vector is there, not empty, and has only finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, vec (doubles) of the rows that take part.

    Left out are null keys, vectors that are null, empty or hold null or non-finite components,
    and those of another length than most have (the longer at a tie).
    """
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    most = sizes.first()
    return rows.filter(F.size("vec") == (most["d"] if most else 0))


def pack_blocks(df: DataFrame, block: str = "block", more: str | None = None) -> DataFrame:
    """One row for each block of ``df`` (vec_id, vec, block): see ``BLOCK``. Rows go by id in a block.

    ``more`` names a long column that is packed too.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame(
            {
                "block": [int(pdf["block"].iloc[0])],
                "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                "vectors": [np.stack(pdf["vec"].to_list()).astype(np.float64).tobytes()],
                "more": [pdf["more"].to_numpy(np.int64).tobytes()],
            }
        )

    rows = df.select("vec_id", "vec", F.col(block).alias("block"), (F.col(more) if more else F.lit(0)).cast("long").alias("more"))
    return rows.groupBy("block").applyInPandas(run, BLOCK)


TOGETHER = 32


def query_blocks(asked: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The queries in blocks of about ``rows``, and how many; repeated keys are asked once."""
    once = asked.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    n = parts_for(once.count(), rows)
    return pack_blocks(once.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)))), n


def meet(
    asking: DataFrame, packed: DataFrame, n_query_blocks: int,
    pair: Callable[[object, object], tuple[np.ndarray, ...]], score: str,
) -> DataFrame:
    """query_id, vec_id, score of ``pair`` for each query block of ``asking`` and the entry block it names.

    ``asking`` has the number of the query block (q_block) and of the entry block (block). One task call holds one
    entry block and at most ``TOGETHER`` query blocks.
    """
    together = F.floor(F.col("q_block") / TOGETHER).alias("together")
    n_groups = parts_for(n_query_blocks, TOGETHER)
    groups = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("together")
    kind = np.int64 if score == "long" else np.float64

    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        found = [
            pair(q, e)
            for e in entries.itertuples(index=False)
            for q in queries.itertuples(index=False)
        ]
        columns = zip(*found, strict=True) if found else ((), (), ())
        names = (("query_id", np.int64), ("vec_id", np.int64), ("score", kind))
        return pd.DataFrame(
            {n: np.concatenate([np.empty(0, t), *c]).astype(t) for (n, t), c in zip(names, columns, strict=True)}
        )

    left = asking.select("*", together).groupBy("block", "together")
    right = packed.select("*", groups).groupBy("block", "together")
    return left.cogroup(right).applyInPandas(run, FOUND.format(score))


def unpack(ids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vecs, np.float64).reshape(len(ids), -1)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each query, ties to the smaller id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(query: np.ndarray, ids: np.ndarray, vecs: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact products of the ``k`` best rows for a query, given rough products.

    Products are made again row by row, so that equal vectors have equal scores wherever they
    stand, and ties go by id.
    """
    if len(ids) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        margin = 1e-12 * (1 + np.abs(query).sum() * np.abs(vecs).max())
        near = rough >= least - margin
        ids, vecs = ids[near], vecs[near]
    exact = (vecs * query).sum(axis=1)
    order = np.lexsort((ids, -exact))[:k]
    return ids[order], exact[order]
