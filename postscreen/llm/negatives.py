"""Hard negatives of anchors by exact integer products, with Strassen's multiplication.

Rows are packed into blocks of int64 vectors where they are read, sorted by label, so no shuffle
brings the rows of one label or one key together. Anchor blocks meet entry blocks in cells: each cell holds a few of either, and
each pair of blocks is a tile whose products come from Strassen's seven half-sized products,
recursively, with zero padding to even sides. Additions wrap modulo 2^64 and so stay exact for
every product that fits a long.

Two rounds are made. The first keeps each anchor's best rows of its own label in a heap of k, the second, for
each positive score, the best rows of other labels within its window. Heaps of tiles are merged
within a cell, and heaps of cells by Spark.

Defined results: rows without a key, label or vector, and those with a null or non-finite component, take no part, nor do they
have a product with vectors of another length; an empty vector has product 0. Equal scores go by the smaller key.
Rows that repeat a key are all candidates but for anchors of that key, which is asked once, with the
smallest of its labels and vectors. An anchor without positives, or a positive without negatives in its window,
gives no row. A component or product beyond 64 bits is an error. Other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postscreen.llm.blocks import finite
from postscreen.llm.common import parts_for
from postscreen.session import materialise

# Rows that are sorted by label together, rows of a block, and of blocks of anchors.
GATHER, ENTRIES, ANCHORS = 32_768, 2_048, 256
# Rows that a cell holds on either side.
CELL_ENTRIES, CELL_ANCHORS = 65_536, 4_096
LEAF = 16
NONE = np.iinfo(np.int64).min
BLOCK = "width int, ids binary, labels binary, vectors binary, asked binary"
HEAP = "anchor_id long, asked_score long, vec_id long, score long"


# --- products ------------------------------------------------------------------------------------


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Plain product; through doubles where every sum is exact in them."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    # Python integers, and bounds rather than abs(): the least int64 has no positive twin.
    top = [max(int(m.max()), -int(m.min())) for m in (a, b)]
    if top[0] * top[1] * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices modulo 2^64, by seven products of half the sides."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    # Odd sides get a row or column of zeros.
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * i, 2 * h), np.int64)
    c[:i, :h] = p1 + p4 - p5 + p7
    c[:i, h:] = p3 + p5
    c[i:, :h] = p2 + p4
    c[i:, h:] = p1 - p2 + p3 + p6
    return c[:m, :n]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of ``a`` with those of ``b``; an error where one is beyond 64 bits."""
    if a.size and b.size:
        longest = [float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max())) for m in (a, b)]
        if longest[0] * longest[1] > 2.0**62:
            # Rare: only then is each product made with Python's integers.
            exact = a.astype(object) @ b.astype(object).T
            if max(map(abs, exact.ravel().tolist())) >= 2**63:
                raise OverflowError("a product does not fit 64 bits")
            return exact.astype(np.int64)
    return strassen(a, np.ascontiguousarray(b.T))


# --- heaps ---------------------------------------------------------------------------------------


class Heaps:
    """The ``k`` best (score, id) of each of ``n`` askers, ties to the smaller id; they take whole tiles."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), NONE, np.int64)
        self.ids = np.zeros((n, k), np.int64)
        self.size = np.zeros(n, np.int64)

    def take(self, score: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
        """Rows of ``score`` for each asker; only entries that are ``ok``. Ids are those of the columns."""
        full = self.size >= self.k
        worst = self.score.min(axis=1)
        # Entries that are no better than a full heap's worst can't matter unless they tie with it.
        ok = ok & ~(full[:, None] & (score < worst[:, None]))
        many = ok.sum(axis=1) > self.k
        if many.any():
            masked = np.where(ok[many], score[many], NONE)
            least = np.partition(masked, masked.shape[1] - self.k, axis=1)[:, masked.shape[1] - self.k]
            ok[many] &= score[many] >= least[:, None]
        who, at = np.nonzero(ok)
        if not len(who):
            return
        held = np.arange(self.k)[None, :] < self.size[:, None]
        old, place = np.nonzero(held)
        askers = np.concatenate([old, who])
        scores = np.concatenate([self.score[old, place], score[who, at]])
        names = np.concatenate([self.ids[old, place], ids[at]])
        # ~score falls as the score rises, without overflow.
        order = np.lexsort((names, ~scores, askers))
        askers, scores, names = askers[order], scores[order], names[order]
        first = np.searchsorted(askers, askers)
        rank = np.arange(len(askers)) - first
        best = rank < self.k
        askers, rank = askers[best], rank[best]
        self.score[askers, rank] = scores[best]
        self.ids[askers, rank] = names[best]
        self.size = np.minimum(np.bincount(askers, minlength=len(self.size)), self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asker, id, score) of all that is held."""
        who, at = np.nonzero(np.arange(self.k)[None, :] < self.size[:, None])
        return who, self.ids[who, at], self.score[who, at]


# --- blocks --------------------------------------------------------------------------------------


def take_part(df: DataFrame, key: str, label: Column, vector: str, scale: float) -> DataFrame:
    """vec_id, label, vec (whole numbers) of the rows that take part."""
    components = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), components.alias("vec"))
    sound = finite(F.col("vec")) | F.coalesce(F.size("vec") == 0, F.lit(False))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & sound)
    # Of a double, floor() is a long; one beyond 64 bits must not turn into another number.
    floor = F.transform("vec", lambda x: F.floor(F.when(F.abs(x * scale) < 2.0**63, x * scale).otherwise(
        F.raise_error(F.lit("a component does not fit 64 bits")).cast("double"))))
    return rows.select("vec_id", "label", floor.alias("vec"))


def _packed(width: int, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, asked: np.ndarray) -> dict:
    return {
        "width": width, "ids": ids.tobytes(), "labels": labels.tobytes(),
        "vectors": np.ascontiguousarray(vecs).tobytes(), "asked": asked.tobytes(),
    }


def pack(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (vec_id, label, vec, and asked: a list of scores) in blocks of up to ``size``; see ``BLOCK``.

    A task sorts the rows that it gathers by length of vector, label and key, so that few blocks hold several labels.
    """
    kinds = [("width", pa.int32()), *((n, pa.binary()) for n in ("ids", "labels", "vectors", "asked"))]
    schema = pa.schema(kinds)

    def blocks(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, labels = (batch.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        vec, asked = (batch.column(c).combine_chunks() for c in ("vec", "asked"))
        widths, n_asked = (np.diff(x.offsets.to_numpy()) for x in (vec, asked))
        starts = vec.offsets.to_numpy()[:-1] - vec.offsets[0].as_py()
        asked_starts = asked.offsets.to_numpy()[:-1] - asked.offsets[0].as_py()
        flat, flat_asked = vec.flatten().to_numpy(), asked.flatten().to_numpy()
        order = np.lexsort((ids, labels, widths))
        for width in np.unique(widths):
            same = order[widths[order] == width]
            for i in range(0, len(same), size):
                some = same[i : i + size]
                # Scores asked for, each with the row of the block that asks.
                by = np.repeat(np.arange(len(some)), n_asked[some])
                each = [flat_asked[asked_starts[r] : asked_starts[r] + n_asked[r]] for r in some]
                pairs = np.stack([by, np.concatenate([np.empty(0, np.int64), *each])]).astype(np.int64)
                vecs = flat[starts[some][:, None] + np.arange(width)]
                row = _packed(int(width), ids[some], labels[some], vecs.astype(np.int64), pairs)
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= GATHER:
                yield from blocks(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from blocks(pa.Table.from_batches(held))

    return rows.mapInArrow(run, BLOCK)


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
    vecs = np.frombuffer(row.vectors, np.int64).reshape(len(ids), row.width)
    return ids, labels, vecs, np.frombuffer(row.asked, np.int64).reshape(2, -1)


def _positives(heaps: dict, a: tuple, e: tuple, k: int) -> None:
    """One tile of the first round: rows of the anchor's label."""
    (a_ids, a_labels, a_vecs, _), (ids, labels, vecs, _) = a, e
    if not np.isin(a_labels, labels).any():
        return
    heap = heaps.setdefault("best", Heaps(len(a_ids), k))
    ok = (a_labels[:, None] == labels[None, :]) & (a_ids[:, None] != ids[None, :])
    heap.take(products(a_vecs, vecs), ok, ids)


def _negatives(heaps: dict, a: tuple, e: tuple, k: int) -> None:
    """One tile of the second round: rows of other labels, for each score asked within its window."""
    (a_ids, a_labels, a_vecs, (by, score)), (ids, labels, vecs, _) = a, e
    if not len(by) or (a_labels.min() == a_labels.max() and (labels == a_labels[0]).all()):
        return
    heap = heaps.setdefault("best", Heaps(len(by), k))
    product = products(a_vecs, vecs)[by]
    other = a_labels[by][:, None] != labels[None, :]
    # 80 p <= 100 n is n >= p - floor(p / 5), without a product that could overflow.
    low = score - score // 5
    heap.take(product, other & (product >= low[:, None]) & (product <= score[:, None]), ids)


def meet(anchors: DataFrame, entries: DataFrame, n: tuple[int, int], tile: Callable, k: int) -> DataFrame:
    """``HEAP`` rows of each cell of anchor blocks and entry blocks; ``n`` are the rows on either side."""
    spark = anchors.sparkSession
    down = parts_for(n[0], CELL_ANCHORS)
    across = max(parts_for(n[1], CELL_ENTRIES), -(-spark.sparkContext.defaultParallelism // down))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def dealt(count: int, block: str = "vectors") -> Column:
        # By contents and number, so that blocks of equal rows are spread too.
        return F.pmod(F.xxhash64("ids", block, F.monotonically_increasing_id()), F.lit(count)).cast("int")

    left = anchors.withColumn("i", dealt(down)).withColumn("j", every(across))
    right = entries.withColumn("j", dealt(across)).withColumn("i", every(down))

    def run(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        blocks = [_unpack(e) for e in held.itertuples(index=False)]
        for row in asking.itertuples(index=False):
            a, heaps = _unpack(row), {}
            for e in blocks:
                if e[2].shape[1] == row.width:
                    tile(heaps, a, e, k)
            if "best" in heaps:
                who, ids, score = heaps["best"].rows()
                by = a[3][0][who] if tile is _negatives else who
                asked = a[3][1][who] if tile is _negatives else np.zeros(len(who), np.int64)
                out.append((a[0][by], asked, ids, score))
        columns = [np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*out, strict=True)] if out else [[]] * 4
        names = ("anchor_id", "asked_score", "vec_id", "score")
        return pd.DataFrame(dict(zip(names, columns, strict=True)), dtype="int64")

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, HEAP)


def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The heaps of all cells merged: the ``k`` best of each asker with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# --- the operator --------------------------------------------------------------------------------


def mine(
    df: DataFrame, key: str, label: Column, vector: str, is_anchor: Column,
    positives: int = 5, negatives: int = 5, scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``. Negatives are rows of other labels whose score is between 80 %
    of the positive's and the positive's.
    """
    rows = materialise(take_part(df, key, label, vector, scale), "rows")
    asked = rows.filter(is_anchor)
    once = asked.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("least"))
    anchors = materialise(once.select("vec_id", "least.label", "least.vec"), "anchors")
    n = (anchors.count(), rows.count())
    none = F.array().cast("array<long>").alias("asked")
    entries = materialise(pack(rows.select("vec_id", "label", "vec", none), ENTRIES), "entries")

    blocks = pack(anchors.select("vec_id", "label", "vec", none), ANCHORS)
    found = first(meet(materialise(blocks, "blocks"), entries, n, _positives, positives), ["anchor_id"], positives)
    near = found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = materialise(near, "positives")

    scores = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score")).alias("asked"))
    blocks = materialise(pack(anchors.join(scores, "vec_id").select("vec_id", "label", "vec", "asked"), ANCHORS), "blocks")
    hard = first(meet(blocks, entries, n, _negatives, negatives), ["anchor_id", "asked_score"], negatives)
    hard = hard.select(
        "anchor_id", F.col("asked_score").alias("positive_score"), "rank",
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    return near.join(hard, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
