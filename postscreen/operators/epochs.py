"""A linear classifier trained by epochs: mini-batches in a seeded order, AdamW steps, a checkpoint after each epoch.

Texts become hashed token ids once, written to the shared folder. An epoch's batches are consecutive rows of its seeded
order, dealt to partitions by batch, written there once more and kept by the executors for the epoch, so that a step is one job of a single stage
over its own partitions. The rows of a step give their share of the gradient where they are, and the driver, which holds
nothing but vectors of ``features`` numbers, adds the shares up and takes the step. A batch may be as large as the cluster
makes worth while: many tasks share a large one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postscreen.functions.text import tokens
from postscreen.operators.sampling import shuffled_batches
from postscreen.session import materialise, shared_folder

# The usual rates of decay of the two moments, and what keeps the divisor from 0.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
# Rows of a batch in one partition, about.
BLOCK_ROWS = 4096
_STATE = "epoch int, step long, loss double, weights array<double>, first array<double>, second array<double>"


@dataclass(frozen=True)
class Settings:
    epochs: int = 5
    batch_size: int = 256
    rate: float = 0.05
    decay: float = 0.01
    features: int = 1 << 14
    seed: int = 42
    fold_case: bool = True


@dataclass(frozen=True)
class Epoch:
    """Weights after an epoch (the last is the intercept), both moments, steps so far, and the mean loss of its steps."""

    epoch: int
    step: int
    loss: float
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray


def hashed(df: DataFrame, text: str, settings: Settings, *keep: str) -> DataFrame:
    """The ``keep`` columns and ``ids``, the hashed tokens of a text; none for a missing or blank one."""
    words = tokens(F.coalesce(F.col(text), F.lit("")), settings.fold_case)
    ids = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(settings.features)).cast("int"))
    return df.select(*keep, ids.alias("ids"))


def _logits(flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of flat ids, their values (a row's tokens share 1), and the logit of each row."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    values = 1.0 / np.maximum(sizes, 1)[rows]
    return rows, values, np.bincount(rows, weights[flat] * values, minlength=len(sizes)) + weights[-1]


def _flat(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())


def _blocks(mixed: DataFrame, key: str, label: str, weight: str, steps: int, per: int) -> RDD:
    """The rows of batch ``k`` as partitions from ``k * per`` on, ``per`` of them, each packed into arrays."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _flat(batch.column("ids"))
            y, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("y", "w"))
            arrays = {"ids": flat.astype(np.int32), "sizes": sizes.astype(np.int32), "y": y, "w": w}
            yield pa.RecordBatch.from_pydict({name: pa.array([x.tobytes()], pa.binary()) for name, x in arrays.items()})

    block = F.col("batch") * per + F.pmod(F.xxhash64(key), F.lit(per))
    rows = mixed.select(
        block.cast("int").alias("block"),
        "ids",
        F.col(label).cast("double").alias("y"),
        F.col(weight).cast("double").alias("w"),
    )
    dealt = rows.repartitionById(steps * per, F.col("block")).drop("block")
    return dealt.mapInArrow(pack, "ids binary, sizes binary, y binary, w binary").rdd


def gradient(blocks: RDD, at: range, weights: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Sum over the rows of the partitions ``at`` of the gradient of the log loss, of the loss, and of the rows' weights."""
    n = len(weights)

    def share(packed: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, float, float]]:
        for part in packed:
            flat, sizes = np.frombuffer(part["ids"], np.int32), np.frombuffer(part["sizes"], np.int32)
            y, w = np.frombuffer(part["y"]), np.frombuffer(part["w"])
            rows, values, z = _logits(flat, sizes, weights)
            off = w * (1 / (1 + np.exp(-z)) - y)
            own = np.append(np.bincount(flat, off[rows] * values, minlength=n - 1), off.sum())
            held = np.flatnonzero(own)
            yield held, own[held], float((w * (np.logaddexp(0, z) - y * z)).sum()), float(w.sum())

    slope, loss, total = np.zeros(n), 0.0, 0.0
    for held, own, lost, times in blocks.context.runJob(blocks, share, list(at)):
        slope[held] += own
        loss, total = loss + lost, total + times
    return slope, loss, total


def adamw(state: Epoch, slope: np.ndarray, settings: Settings) -> Epoch:
    """One step; weights decay apart from the gradient, the intercept does not decay."""
    step = state.step + 1
    first = BETA1 * state.first + (1 - BETA1) * slope
    second = BETA2 * state.second + (1 - BETA2) * slope**2
    move = first / (1 - BETA1**step) / (np.sqrt(second / (1 - BETA2**step)) + EPSILON)
    keep = np.full(len(slope), 1 - settings.rate * settings.decay)
    keep[-1] = 1.0
    return Epoch(state.epoch, step, state.loss, keep * state.weights - settings.rate * move, first, second)


def load_epochs(spark: SparkSession, path: str) -> list[Epoch]:
    """The epochs saved under ``path``, in order; a folder that is not there has none."""
    try:
        rows = spark.read.schema(_STATE).parquet(f"{path}/*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    arrays = ("weights", "first", "second")
    found = [Epoch(r["epoch"], r["step"], r["loss"], *(np.array(r[c]) for c in arrays)) for r in rows]
    return sorted(found, key=lambda e: e.epoch)


def _save(spark: SparkSession, path: str, state: Epoch) -> None:
    # A folder of its own for each epoch: one that dies half-way leaves the earlier ones as they are.
    row = [(state.epoch, state.step, state.loss, *(x.tolist() for x in (state.weights, state.first, state.second)))]
    spark.createDataFrame(row, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/{state.epoch:06d}")


def fit_epochs(
    train: DataFrame, key: str, text: str, label: str, path: str, settings: Settings = Settings(), weight: str | None = None
) -> list[Epoch]:
    """Train for ``settings.epochs`` epochs, going on behind the last one saved under ``path``.

    ``key`` must be unique; rows without a key or a label of 0 or 1 take no part. ``weight`` names a column with the number of
    times each row counts. An empty table leaves all weights 0.
    """
    spark = train.sparkSession
    done = load_epochs(spark, path)[: settings.epochs]
    n = settings.features + 1
    state = done[-1] if done else Epoch(-1, 0, 0.0, *(np.zeros(n) for _ in range(3)))
    if len(done) == settings.epochs:
        return done
    rows = train.withColumn("_w", F.col(weight) if weight else F.lit(1)).filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    narrow = materialise(hashed(rows, text, settings, key, label, "_w"), "hashed")
    steps, per = -(-narrow.count() // settings.batch_size), -(-settings.batch_size // BLOCK_ROWS)
    for epoch in range(state.epoch + 1, settings.epochs):
        losses = []
        if steps:
            mixed = shuffled_batches(narrow, key, settings.batch_size, settings.seed, epoch)
            blocks = _blocks(mixed, key, label, "_w", steps, per).persist(StorageLevel.MEMORY_AND_DISK)
            # All batches are packed at once, not each by its own step, and a step's job doesn't carry how they were made.
            blocks.checkpoint()
            blocks.count()
            for k in range(steps):
                slope, loss, total = gradient(blocks, range(k * per, (k + 1) * per), state.weights)
                state = adamw(state, slope / max(total, 1.0), settings)
                losses.append(loss / max(total, 1.0))
            blocks.unpersist()
        mean = float(np.mean(losses)) if losses else 0.0
        state = Epoch(epoch, state.step, mean, state.weights, state.first, state.second)
        _save(spark, path, state)
        done.append(state)
    return done


def score_epochs(done: list[Epoch], df: DataFrame, text: str, settings: Settings, *keep: str) -> DataFrame:
    """The ``keep`` columns, ``epoch``, ``p1`` and ``pred`` (0 on a tie) of each row by each epoch, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast([(e.epoch, e.weights) for e in done])

    @F.arrow_udf("array<double>")
    def chances(ids: pa.Array) -> pa.Array:
        found = [1 / (1 + np.exp(-_logits(*_flat(ids), w)[2])) for _, w in shared.value]
        flat = np.stack(found, axis=1).ravel() if found else np.empty(0)
        offsets = np.arange(len(ids) + 1, dtype=np.int32) * len(found)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    scored = hashed(df, text, settings, *keep).withColumn("_p", chances("ids")).drop("ids")
    out = scored.select(*keep, F.posexplode("_p").alias("epoch", "p1"))
    return out.withColumn("pred", (F.col("p1") > 0.5).cast("int"))
