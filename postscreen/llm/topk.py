"""Exact top-k by inner product with norm buckets.

Vectors are grouped by length into buckets of bounded size. The bucket of the longest vectors gives
each query a first threshold, its ``k``-th best product so far. A bucket whose longest vector cannot
reach the threshold is skipped for that query; otherwise the threshold over the query's length and the
bucket's length is the bucket's local cosine threshold. Where it is low, the bucket is pruned by
length (vectors too short to reach the threshold are left out); where it is high, by coordinates
too: a vector at that cosine must lie in an interval in the query's largest coordinate. Which local threshold is high is
chosen for each bucket from a few of its queries. All that is left is verified by its product.

Components are floor(scale * x). Products are whole numbers, exact in doubles up to 2^53;
beyond that they are made with Python's integers, and one over 2^63 raises an error.

Defined results: rows without a key, null or empty vectors, those that hold null or non-finite
components and those whose length most others don't have take no part; zero vectors do. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscreen.llm import blocks
from postscreen.llm.common import parts_for
from postscreen.session import materialise

ENTRIES, QUERIES = 4096, 512
TRIED = 8
ASKED = "q_block long, q_ids binary, q_vectors binary, q_least binary, block long"


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered vectors."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if top < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q]
    return np.array(exact, dtype=np.int64)  # raises beyond 2^63


def _interval(u: float, cosine: float) -> tuple[float, float]:
    """Where the coordinate of a unit vector lies whose cosine with a unit query is ``cosine`` or more."""
    a, b = np.arccos(np.clip(u, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return float(np.cos(min(np.pi, a + b))), float(np.cos(max(0.0, a - b)))


def retrieve(
    q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the rows of a bucket that reach the query's ``least``, ``k`` best each."""
    norms = np.sqrt((x**2).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    ids, x, norms = ids[order], x[order], norms[order]
    unit = x / np.maximum(norms, 1e-300)[:, None]
    q_norms = np.sqrt((q**2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((q_norms > 0) & np.isfinite(least) & (least > 0), least / (q_norms * norms[0]), 0.0)
    queries = np.flatnonzero(local <= 1 + 1e-9)
    if not len(queries):
        return tuple(np.empty(0, np.int64) for _ in range(3))

    def candidates(i: int, by_coordinate: bool) -> np.ndarray:
        # Longest first: a prefix of the bucket is long enough.
        n = np.searchsorted(-norms, -(least[i] / q_norms[i]) * (1 - 1e-9), side="right") if local[i] > 0 else len(ids)
        if not by_coordinate or not local[i]:
            return np.arange(n)
        u = q[i] / q_norms[i]
        keep = np.ones(n, bool)
        for f in np.argsort(-np.abs(u))[:2]:
            low, high = _interval(u[f], local[i])
            keep &= (unit[:n, f] >= low - 1e-9) & (unit[:n, f] <= high + 1e-9)
        return np.flatnonzero(keep)

    # The lowest tried threshold at which coordinates leave out a third of what lengths keep.
    tried = queries[np.argsort(local[queries], kind="stable")][:: max(1, len(queries) // TRIED)]
    high = 2.0
    for i in tried[::-1]:
        if len(candidates(i, True)) <= 2 / 3 * len(candidates(i, False)):
            high = local[i]
        else:
            break
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    full = [i for i in queries if local[i] < high]
    dense = dict(zip(full, products(q[full], x), strict=True)) if full else {}
    for i in queries:
        rows = candidates(i, local[i] >= high)
        score = dense[i][rows] if i in dense else products(q[i : i + 1], x[rows])[0]
        good = (score >= least[i]) & (ids[rows] != q_ids[i])
        rows, score = rows[good], score[good]
        if len(rows) > k:
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[near], score[near]
        first = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(first), q_ids[i]), ids[rows][first], score[first]))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _pair(k: int):
    def run(q_row, e_row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q_ids, q = blocks.unpack(q_row.q_ids, q_row.q_vectors)
        ids, x = blocks.unpack(e_row.ids, e_row.vectors)
        return retrieve(q_ids, q, np.frombuffer(q_row.q_least, np.float64), ids, x, k)

    return run


def search(
    df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 20, scale: float = 64.0
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``df`` with the largest product for each query."""
    def whole(rows: DataFrame) -> DataFrame:
        floor = F.transform("vec", lambda x: F.floor(x * scale).cast("double"))
        return blocks.vectors(rows, key, vector).select("vec_id", floor.alias("vec"))

    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    entries = materialise(whole(df).withColumn("norm", norm), "entries")
    n = entries.count()
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = F.size("vec")
    # Buckets by length between quantiles; what has the same length is dealt out by its hash.
    n_buckets = parts_for(n, ENTRIES)
    cuts = [1 - i / n_buckets for i in range(1, n_buckets)]
    bounds = entries.agg(F.percentile_approx("norm", cuts, 10_000)).first()[0] if cuts else []
    bounds = sorted(set(bounds), reverse=True)
    bucket = F.lit(0)
    if bounds:
        bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b > F.col("norm")))
    entries = entries.withColumn("bucket", bucket)
    stats = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"))
    stats = stats.orderBy("bucket").collect()  # one row for each bucket
    first, longest, at = {}, [], 0
    for r in stats:
        size = parts_for(r["n"], ENTRIES)
        first[r["bucket"]] = (at, size)
        longest += [r["longest"]] * size
        at += size
    start = F.create_map(*[F.lit(v) for b, (s, _) in first.items() for v in (b, s)])[F.col("bucket")]
    size = F.create_map(*[F.lit(v) for b, (_, c) in first.items() for v in (b, c)])[F.col("bucket")]
    placed = entries.withColumn("block", (start + F.pmod(F.xxhash64("vec_id"), size)).cast("long"))
    packed = materialise(blocks.pack_blocks(placed.drop("norm", "bucket")), "buckets")
    head = first[stats[0]["bucket"]][1]  # blocks of the longest vectors

    width = entries.select(d.alias("d")).first()["d"]
    asked = whole(queries).filter(d == width)
    query_blocks, n_query_blocks = blocks.query_blocks(asked, QUERIES)
    query_blocks = materialise(query_blocks, "queries")

    def ask(r, least: np.ndarray, to: list[int]) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "q_block": r.block,
                "q_ids": [r.ids] * len(to),
                "q_vectors": r.vectors,
                "q_least": least.tobytes(),
                "block": to,
            }
        )

    def ask_head(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                none = np.full(len(r.ids) // 8, -np.inf)
                yield ask(r, none, list(range(head)))

    def meet(asking: DataFrame) -> DataFrame:
        return blocks.meet(asking, packed, n_query_blocks, _pair(k), "long")

    from_head = materialise(blocks.best(meet(query_blocks.mapInPandas(ask_head, ASKED)), k), "head")
    if at == head:
        return from_head
    # The k-th best so far of each query, by query block; none where fewer are known.
    least = from_head.filter(F.col("rank") == k).select("query_id", "score")
    least = least.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_query_blocks)))
    least = least.groupBy("block").agg(F.collect_list(F.struct("query_id", "score")).alias("least"))
    bounds_left = list(enumerate(longest))[head:]

    def ask_rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                ids, q = blocks.unpack(r.ids, r.vectors)
                known = {x["query_id"]: x["score"] for x in (r.least if r.least is not None else [])}
                bound = np.array([float(known.get(int(i), -np.inf)) for i in ids])
                reach = np.sqrt((q**2).sum(axis=1))
                to = [b for b, top in bounds_left if (reach * top * (1 + 1e-9) >= bound).any()]
                if to:
                    yield ask(r, bound, to)

    rest = meet(query_blocks.join(least, "block", "left").mapInPandas(ask_rest, ASKED))
    return blocks.best(from_head.drop("rank").unionByName(rest), k)
