"""Logistic regression for all folds at once: texts are hashed once, and one pass over them serves every model's next step.

The objective is that of ``linear.fit_lr``: token counts by idf, each feature by its standard deviation, the mean loss and an
L2 penalty on all weights but the intercept. An idf cancels where features are divided by their deviation, unless it is 0: a
feature of all rows, or of one value in all rows, has no weight.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postscreen.operators.bayes import with_fold
from postscreen.session import materialise

# Pairs of steps kept for the curvature, halvings of a step before a model is left as it is.
HISTORY, HALVINGS = 10, 30
# Sums that are added up as one array, and those that the driver takes in at a time.
BLOCK, PIECE = 1 << 11, 1 << 19
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class LinearModel:
    """Weights of hashed token counts, and the intercept."""

    weights: np.ndarray
    intercept: float
    fold_case: bool = True


@dataclass(frozen=True)
class Folds:
    """A model for each fold, fitted on the others; one fitted on all rows; and the rows, hashed, with their folds."""

    models: list[LinearModel]
    whole: LinearModel
    rows: DataFrame


def hashed_counts(df: DataFrame, text: str, features: int, fold_case: bool, **keep: Column) -> DataFrame:
    """The ``keep`` columns, and ``at`` and ``n``: the hashed tokens of a text and their counts; none for a missing text."""
    narrow = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), *[c.alias(name) for name, c in keep.items()])
    split = RegexTokenizer(inputCol="_text", outputCol="_words", pattern="[\\p{L}]+", gaps=False, toLowercase=fold_case)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features).transform(split.transform(narrow))
    vector = F.unwrap_udt("_counts")
    return counts.select(*keep, vector["indices"].alias("at"), vector["values"].alias("n"))


def _flat(at: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, counts and the places of their rows in the batch."""
    sizes = np.diff(at.offsets.to_numpy())
    return at.flatten().to_numpy(), n.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def _chance(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is shuffled within goes when its query ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _total(rows: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all rows of what ``add`` adds to an array of ``size``, which no table makes longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size)
        for batch in batches:
            add(own, batch)
        for at in range(0, size, BLOCK):
            if own[at : at + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"i": [at // BLOCK], "g": [own[at : at + BLOCK].tobytes()]})

    def added(table: pa.Table) -> pa.Table:
        own = sum(np.frombuffer(x.as_buffer()) for x in table.column("g"))
        return pa.table({"i": table.column("i")[:1], "g": [own.tobytes()]})

    whole, out, blocks = size <= 4 * PIECE, np.zeros(size), -(-size // BLOCK)
    with _shuffles_dropped(rows.sparkSession):
        sums = rows.mapInArrow(run, "i long, g binary").groupBy("i").applyInArrow(added, "i long, g binary")
        if not whole:
            sums = materialise(sums, "sums")
        each = blocks if whole else max(1, PIECE // BLOCK)
        for at in range(0, blocks, each):
            part = (sums if whole else sums.filter((F.col("i") >= at) & (F.col("i") < at + each))).toArrow()
            for i, x in zip(part.column("i").to_pylist(), part.column("g"), strict=True):
                out[i * BLOCK : (i + 1) * BLOCK] = np.frombuffer(x.as_buffer())
    return out


class _Vectors:
    """Vectors of one length by name, in a file of the driver: each is read while it is needed."""

    def __init__(self):
        self.file, self.places = tempfile.TemporaryFile(buffering=0), {}

    def __setitem__(self, name: str, value: np.ndarray) -> None:
        self.file.seek(self.places.setdefault(name, len(self.places)) * value.nbytes)
        value.tofile(self.file)
        self.bytes = value.nbytes

    def __getitem__(self, name: str) -> np.ndarray:
        return np.frombuffer(os.pread(self.file.fileno(), self.bytes, self.places[name] * self.bytes))


class _Pairs:
    """The last steps with the changes of the gradient, as files of the driver: a pair is read while it is needed."""

    def __init__(self, folder: str):
        self.folder, self.known, self.next = Path(folder), [], 0

    def add(self, moved: np.ndarray, bent: np.ndarray, curve: float) -> None:
        # The oldest pair's files are written anew.
        place = self.next % HISTORY
        moved.tofile(self.folder / f"moved-{place}")
        bent.tofile(self.folder / f"bent-{place}")
        self.known = [*self.known, (place, curve)][-HISTORY:]
        self.next += 1

    def moved(self, place: int) -> np.ndarray:
        return np.fromfile(self.folder / f"moved-{place}")

    def bent(self, place: int) -> np.ndarray:
        return np.fromfile(self.folder / f"bent-{place}")


class _Descent:
    """Minimises one model's objective by limited-memory quasi-Newton steps; ``trial`` is the point to be looked at next."""

    def __init__(self, start: np.ndarray, max_iter: int, tol: float, folder: str, done: bool = False):
        self.kept = _Vectors()
        self.kept["x"] = start
        self.value, self.step = np.inf, 1.0
        self.pairs = _Pairs(folder)
        self.left, self.tol, self.halved, self.done = max_iter, tol, 0, done

    @property
    def x(self) -> np.ndarray:
        return self.kept["x"]

    @property
    def trial(self) -> np.ndarray:
        return self.x + self.step * self.kept["move"] if "move" in self.kept.places else self.x

    def seen(self, value: float, slope: np.ndarray) -> None:
        """Take in the objective and its gradient at ``trial``, and choose the next one."""
        trial = self.trial
        if "move" in self.kept.places:
            before = self.kept["slope"]
            if not value <= self.value + 1e-4 * self.step * float(before @ self.kept["move"]):
                self.step, self.halved = self.step / 2, self.halved + 1
                self.done = self.halved > HALVINGS
                return
            moved, bent = trial - self.x, slope - before
            if (curve := float(moved @ bent)) > 1e-12 * float(bent @ bent):
                self.pairs.add(moved, bent, curve)
            self.left -= 1
            small = abs(self.value - value) <= self.tol * max(abs(value), abs(self.value))
            self.done = small or self.left <= 0
        self.kept["x"], self.kept["slope"] = trial, slope
        self.value, self.halved, self.step = value, 0, 1.0
        if not (self.done or np.abs(slope).max() <= 1e-12):
            self.kept["move"] = -self._bent(slope)
            if not self.pairs.known:
                self.step = 1 / max(1.0, float(np.linalg.norm(slope)))
        else:
            self.done = True

    def _bent(self, slope: np.ndarray) -> np.ndarray:
        """The gradient through the inverse curvature that the pairs tell."""
        q, back, pairs = slope.copy(), [], self.pairs
        for place, curve in reversed(pairs.known):
            back.append(float(pairs.moved(place) @ q) / curve)
            q -= back[-1] * pairs.bent(place)
        if pairs.known:
            place, curve = pairs.known[-1]
            bent = pairs.bent(place)
            q *= curve / float(bent @ bent)
        for (place, curve), a in zip(pairs.known, reversed(back), strict=True):
            q += (a - float(pairs.bent(place) @ q) / curve) * pairs.moved(place)
        return q


def _fit(
    rows: DataFrame, slots: int, features: int, fold_case: bool, reg: float, max_iter: int, tol: float
) -> list[LinearModel]:
    """A model for each slot, over the rows whose fold is another: those of fold ``slots`` are in none left out.

    ``rows`` has ``y``, ``w``, ``fold``, ``at`` and ``n``. Driver and tasks hold arrays of features x slots, whatever the table;
    a model's vectors, and the pairs for the curvature, twenty times its weights, are in temporary files of the driver. Vectors
    have no place for features that have no weight in any model.
    """
    with ExitStack() as folders:
        places = [folders.enter_context(tempfile.TemporaryDirectory(prefix="pairs-")) for _ in range(slots)]
        return _fitted(rows, places, features, fold_case, reg, max_iter, tol)


def _fitted(
    rows: DataFrame, places: list[str], features: int, fold_case: bool, reg: float, max_iter: int, tol: float
) -> list[LinearModel]:
    slots = len(places)
    width = 3 * features + 4

    def moments(own: np.ndarray, batch: pa.RecordBatch) -> None:
        y, w, fold = (batch.column(c).to_numpy().astype(np.float64) for c in ("y", "w", "fold"))
        at, n, place = _flat(batch.column("at"), batch.column("n"))
        for f in np.unique(fold):
            mine, base = fold == f, int(f) * width
            picked = mine[place]
            a, b, c = at[picked], n[picked], w[place[picked]]
            for k, values in enumerate((np.ones(len(a)), c * b, c * b * b)):
                own[base + k * features : base + (k + 1) * features] += np.bincount(a, values, minlength=features)
            v = w[mine]
            own[base + 3 * features : base + width] += [len(v), v.sum(), (v * v).sum(), (v * y[mine]).sum()]

    parts = _total(rows, (slots + 1) * width, moments).reshape(slots + 1, width)

    def scaled(s: int) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Of a slot's features, 1 / deviation (0 without a weight) and the mean times it; the rows' weight, and that of label 1."""
        own = np.zeros(width)
        for other in (r for r in range(slots + 1) if r != s):
            own += parts[other]
        held, first, second = own[: 3 * features].reshape(3, features)
        count, total, squares, ones = own[3 * features :]
        mean = first / max(total, 1e-300)
        # The unbiased deviation of weighted rows.
        spread = np.sqrt(np.maximum(second - total * mean**2, 0) / max(total - squares / max(total, 1e-300), 1e-300))
        live = (held < count) & (spread > 1e-9 * np.maximum(mean, 1e-300))
        scale = np.divide(1.0, spread, out=np.zeros(features), where=live)
        return scale, mean * scale, total, ones

    used = np.flatnonzero(sum(scaled(s)[0] != 0 for s in range(slots))).astype(np.int32)
    size = len(used)
    descents, sums = [], []
    for s in range(slots):
        scale, mean, total, ones = scaled(s)
        with np.errstate(divide="ignore"):
            odds = float(np.log(ones) - np.log(total - ones)) if total > 0 else 0.0
        one_kind = total <= 0 or not np.isfinite(odds)
        descents.append(_Descent(np.append(np.zeros(size), odds), max_iter, tol, places[s], one_kind))
        descents[s].kept["scale"] = np.append(scale[used], 1.0)
        descents[s].kept["mean"] = np.append(mean[used], 0.0)
        sums.append(total)
    del parts, scale, mean
    context = rows.sparkSession.sparkContext

    def plain(s: int, point: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights and intercept as they apply to plain counts."""
        mean = descents[s].kept["mean"][:-1]
        return point[:-1] * descents[s].kept["scale"][:-1], point[-1] - float(mean @ point[:-1])

    while active := [s for s in range(slots) if not descents[s].done]:
        shared = context.broadcast((used, active, [plain(s, descents[s].trial) for s in active]))

        def slopes(own: np.ndarray, batch: pa.RecordBatch) -> None:
            y, w, fold = (batch.column(c).to_numpy().astype(np.float64) for c in ("y", "w", "fold"))
            at, n, place = _flat(batch.column("at"), batch.column("n"))
            used, active, models = shared.value
            # Features without a weight come last, as one.
            short = np.full(features, len(used), np.int32)
            short[used] = np.arange(len(used), dtype=np.int32)
            at = short[at]
            for k, (s, (weights, intercept)) in enumerate(zip(active, models, strict=True)):
                z = np.bincount(place, np.append(weights, 0.0)[at] * n, minlength=len(y)) + intercept
                v = w * (fold != s)
                off = v * (_chance(z) - y)
                base = k * (size + 2)
                own[base : base + size] += np.bincount(at, off[place] * n, minlength=size + 1)[:size]
                own[base + size] += off.sum()
                own[base + size + 1] += (v * (np.logaddexp(0, z) - y * z)).sum()

        found = _total(rows, len(active) * (size + 2), slopes).reshape(len(active), -1)
        shared.destroy()
        for s, own in zip(active, found, strict=True):
            kept, point = descents[s].kept, descents[s].trial
            raw, off, loss = own[:size], own[-2], own[-1]
            slope = (raw * kept["scale"][:-1] - kept["mean"][:-1] * off) / sums[s] + reg * point[:-1]
            value = loss / sums[s] + reg / 2 * float(point[:-1] @ point[:-1])
            descents[s].seen(value, np.append(slope, off / sums[s]))
    models = []
    for s in range(slots):
        weights = np.zeros(features)
        weights[used], intercept = plain(s, descents[s].x)
        models.append(LinearModel(weights, float(intercept), fold_case))
    return models


def _trainable(label: str, weight: str | None) -> tuple[Column, Column]:
    """Label and weight of a row; a row without a label of 0 or 1, or without a weight, counts 0 times."""
    known = F.col(label).isin(0, 1)
    times = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    return F.when(known, F.col(label)).otherwise(0).cast("double"), F.when(known, times).otherwise(0.0)


def fit_linear(
    train: DataFrame,
    text: str,
    label: str,
    fold_case: bool = True,
    features: int = 1 << 18,
    reg: float = 1e-3,
    max_iter: int = 50,
    weight: str | None = None,
    tol: float = 1e-6,
) -> LinearModel:
    """One model on all rows with a label of 0 or 1. Rows of one label give that label, no rows a chance of 0.5."""
    y, w = _trainable(label, weight)
    counts = hashed_counts(train, text, features, fold_case, y=y, w=w, fold=F.lit(1))
    rows = materialise(counts.filter("w > 0"), "hashed")
    return _fit(rows, 1, features, fold_case, reg, max_iter, tol)[0]


def fit_folds(
    train: DataFrame,
    key: str,
    text: str,
    label: str,
    k: int = 5,
    seed: int = 42,
    fold_case: bool = True,
    features: int = 1 << 18,
    reg: float = 1e-3,
    max_iter: int = 50,
    weight: str | None = None,
    tol: float = 1e-6,
) -> Folds:
    """``k`` models, each on the rows outside of its fold, and one on all; a pass over the hashed rows serves all of them.

    Rows without a key are in no fold: only the last model is fitted on them. Rows that count 0 times are scored only.
    """
    y, w = _trainable(label, weight)
    folded = with_fold(train, key, k, seed)
    fold = F.coalesce(F.col("fold"), F.lit(k + 1))
    row = F.struct(F.col(key), F.col(label))
    rows = materialise(hashed_counts(folded, text, features, fold_case, row=row, y=y, w=w, fold=fold), "folds")
    # Slot k leaves no row out; rows without a key, as fold k + 1, would be in every slot, so they come in for slot k alone.
    keyed = _fit(rows.filter((F.col("w") > 0) & (F.col("fold") < k)), k + 1, features, fold_case, reg, max_iter, tol)
    keyless = rows.filter((F.col("w") > 0) & (F.col("fold") > k))
    whole = keyed[k]
    if not keyless.isEmpty():
        alike = rows.filter("w > 0").withColumn("fold", F.lit(1))
        whole = _fit(alike, 1, features, fold_case, reg, max_iter, tol)[0]
    return Folds(keyed[:k], whole, rows.filter(F.col("fold") < k))


def _scored(df: DataFrame, models: list[LinearModel], slot: Column) -> Column:
    """The chance of label 1 by the model of each row's slot."""
    shared = df.sparkSession.sparkContext.broadcast([(m.weights, m.intercept) for m in models])

    @F.arrow_udf("double")
    def chance(at: pa.Array, n: pa.Array, slots: pa.Array) -> pa.Array:
        mine, (flat, times, place) = slots.to_numpy(zero_copy_only=False), _flat(at, n)
        z = np.zeros(len(mine))
        for s in np.unique(mine):
            weights, intercept = shared.value[s]
            own = np.bincount(place, weights[flat] * times, minlength=len(mine)) + intercept
            z = np.where(mine == s, own, z)
        return pa.array(_chance(z))

    return chance(F.col("at"), F.col("n"), slot)


def out_of_fold(folds: Folds) -> DataFrame:
    """The key, the label, ``fold``, ``p1`` and ``pred`` (0 on a tie) of every row with a key, by the model that has not seen it."""
    p1 = _scored(folds.rows, folds.models, F.col("fold"))
    scored = folds.rows.select("row.*", "fold", p1.alias("p1"))
    return scored.withColumn("pred", (F.col("p1") > 0.5).cast("int"))


def score_linear(model: LinearModel, df: DataFrame, text: str) -> DataFrame:
    """Add ``p1`` and ``pred`` (0 on a tie). Row by row: no shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    counts = hashed_counts(df, text, len(model.weights), model.fold_case, row=row)
    scored = counts.select("row.*", _scored(df, [model], F.lit(0)).alias("p1"))
    return scored.withColumn("pred", (F.col("p1") > 0.5).cast("int"))
