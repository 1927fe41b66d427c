"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately by k-means; a pair of centroids is a cell. A query
walks the pairs from the nearest on, with a heap over the two sorted lists, until the cells
visited hold ``visit`` of all entries; the entries of those cells are reranked with their exact inner
products. The quantisers are fitted to a bounded sample; every row is indexed.

Work is dealt as pairs of a query block and an entry block. Entry blocks hold whole cells, or a part
of a cell with too many entries (as copies of one vector make), so no block is unbounded.

Defined results: rows without a key, null vectors and vectors that are zero or hold null or
non-finite components take no part, nor do those whose length most others don't have. Repeated keys are
entries each; an entry with the query's own key is not found. A query with fewer than
``k`` other rows finds all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscreen.llm import blocks
from postscreen.llm.common import parts_for
from postscreen.session import materialise

CENTROIDS = 32
SAMPLE = 20_000
ENTRIES, QUERIES = 4096, 512


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds from a seeded sample of distinct rows; an empty cluster keeps its centre."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        for c in range(len(centres)):
            own = x[near == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, least: int) -> list[int]:
    """Cells (i * len(second) + j) by falling first[i] + second[j], until they hold ``least`` entries.

    The multi-sequence algorithm: a pair enters the heap when both pairs before it have left.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    left = np.zeros((len(a) + 1, len(b) + 1), bool)
    left[-1, :] = left[:, -1] = True  # what would stand before the first row and column
    cells, held = [], 0
    while heap and held < least:
        _, i, j = heapq.heappop(heap)
        left[i, j] = True
        cell = int(a[i] * len(second) + b[j])
        held += counts[cell]
        cells.append(cell)
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and left[x - 1, y] and left[x, y - 1]:
                heapq.heappush(heap, (-(first[a[x]] + second[b[y]]), x, y))
    return cells


def search(
    df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 20, visit: float = 0.5,
    n_centroids: int = CENTROIDS, sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each row of ``queries``."""
    nonzero = F.exists("vec", lambda x: x != 0)
    entries = blocks.vectors(df, key, vector).filter(nonzero)
    asked = blocks.vectors(queries, key, vector).filter(nonzero)
    rows = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toArrow()
    if not rows.num_rows:
        return _none(df)
    seen = np.array(rows.column(0).to_pylist())
    d = seen.shape[1]
    asked = asked.filter(F.size("vec") == d)
    half = max(1, d // 2)
    halves = (slice(0, half), slice(half, d) if d > 1 else slice(0, half))
    books = [kmeans(seen[:, h], n_centroids) for h in halves]
    n_cells = len(books[0]) * len(books[1])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("vec").to_pylist())
                near = [nearest(x[:, h], b) for h, b in zip(halves, books, strict=True)]
                cell = near[0] * len(books[1]) + near[1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=["vec_id", "vec", "cell"])

    indexed = materialise(entries.mapInArrow(cells, "vec_id long, vec array<double>, cell long"), "index")
    # At most n_centroids squared numbers.
    counts = np.zeros(n_cells, np.int64)
    for r in indexed.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    least = int(np.ceil(visit * counts.sum())) + k + 1
    # Cells are laid out in blocks of about ENTRIES; a larger cell has blocks of its own.
    first_block, n_blocks, at, room = np.zeros(n_cells, np.int64), np.ones(n_cells, np.int64), -1, 0
    for c in range(n_cells):
        if counts[c] > ENTRIES:
            first_block[c], n_blocks[c] = at + 1, -(-counts[c] // ENTRIES)
            at, room = at + n_blocks[c], 0
        else:
            if counts[c] > room:
                at, room = at + 1, ENTRIES
            first_block[c], room = max(at, 0), room - counts[c]
    layout = F.create_map(*[F.lit(x) for c in range(n_cells) if n_blocks[c] > 1 for x in (c, int(n_blocks[c]))]) if (n_blocks > 1).any() else None
    starts = F.array(*[F.lit(int(x)) for x in first_block])
    spread = F.pmod(F.xxhash64("vec_id"), F.coalesce(layout[F.col("cell")], F.lit(1))) if layout is not None else F.lit(0)
    placed = indexed.withColumn("block", (F.element_at(starts, (F.col("cell") + 1).cast("int")) + spread).cast("long"))
    packed = blocks.pack_blocks(placed, more="cell")

    query_blocks, n_query_blocks = blocks.query_blocks(asked, QUERIES)
    # Cells of each block, for the list of blocks that a query block needs.
    spans = [(int(first_block[c]), int(n_blocks[c])) for c in range(n_cells)]

    def visits(ids: bytes, vecs: bytes) -> tuple[np.ndarray, list[int]]:
        _, q = blocks.unpack(ids, vecs)
        near = [q[:, h] @ b.T for h, b in zip(halves, books, strict=True)]
        seen = np.zeros((len(q), n_cells), bool)
        for i in range(len(q)):
            seen[i, walk(near[0][i], near[1][i], counts, least)] = True
        used = {s + j for c in np.flatnonzero(seen.any(axis=0)) if counts[c] for s, n in [spans[c]] for j in range(n)}
        return np.packbits(seen), sorted(used)

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                bits, used = visits(r.ids, r.vectors)
                yield pd.DataFrame(
                    {
                        "q_block": r.block,
                        "q_ids": [r.ids] * len(used),
                        "q_vectors": r.vectors,
                        "visited": bits.tobytes(),
                        "block": used,
                    }
                )

    asking = query_blocks.mapInPandas(
        walked, "q_block long, q_ids binary, q_vectors binary, visited binary, block long"
    )
    found = blocks.meet(asking, packed, n_query_blocks, lambda q, e: _rerank(q, e, n_cells, k), "double")
    return blocks.best(found, k)


def _rerank(q_row, e_row, n_cells: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best entries of one entry block for each query of one query block."""
    q_ids, q = blocks.unpack(q_row.q_ids, q_row.q_vectors)
    ids, x = blocks.unpack(e_row.ids, e_row.vectors)
    cell = np.frombuffer(e_row.more, np.int64)
    visited = np.unpackbits(np.frombuffer(q_row.visited, np.uint8), count=len(q) * n_cells)
    visited = visited.reshape(len(q), n_cells).astype(bool)
    rough = q @ x.T
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for i in range(len(q)):
        mine = np.flatnonzero(visited[i, cell] & (ids != q_ids[i]))
        if len(mine):
            near, score = blocks.top(q[i], ids[mine], x[mine], rough[i, mine], k)
            out.append((np.full(len(near), q_ids[i]), near, score))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
