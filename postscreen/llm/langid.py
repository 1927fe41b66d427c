"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams per language come from all training rows, as one aggregate. The matrix of log
probabilities (languages by 16,384 hash buckets) goes to the tasks; each batch of texts is scored
as a sparse matrix, in numpy.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every
text where nothing was learned; rows without text or language teach nothing; equal posteriors go
to the language that is first in code-point order; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postscreen.llm.common import fold, unused

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
UNKNOWN = "und"
# Characters worked on at once, which bounds the memory of a batch whatever the texts' lengths.
CHUNK = 1 << 17


def buckets(codes: np.ndarray, order: int, n_buckets: int = BUCKETS) -> np.ndarray:
    """Hash buckets of the n-grams of one text, by a multiplicative hash of their code points."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    acc = codes[:n].astype(np.uint64) + np.uint64(order)
    for k in range(1, order):
        acc = acc * np.uint64(0x100000001B3) + codes[k : k + n]
    acc = acc * np.uint64(0x9E3779B97F4A7C15)
    return (acc >> np.uint64(64 - n_buckets.bit_length() + 1)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text between blanks."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)


def _ngrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the whole text, in pieces of at most ``CHUNK``."""
    codes = _codes(text)
    for order in ORDERS:
        for start in range(0, len(codes) - order + 1, CHUNK):
            yield buckets(codes[start : start + CHUNK + order - 1], order)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets by languages


def fit(df: DataFrame, text: str, lang: str, alpha: float = 0.5) -> LanguageModel:
    """Counts over all rows that have a text and a language.

    What reaches the driver is bounded: a count for each language and bucket.
    """
    rows = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        n_rows: dict[str, int] = {}
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1), strict=True):
                name = name.as_py()
                total = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                n_rows[name] = n_rows.get(name, 0) + 1
                total += np.bincount(np.concatenate(list(_ngrams(t.as_py()))), minlength=BUCKETS)
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": [name] * (len(used) + 1),
                    "bucket": np.append(used, -1).astype(np.int32),
                    "n": np.append(total[used], n_rows[name]).astype(np.int64),
                }
            )

    counts = (
        rows.mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = sorted(set(counts.column("lang").to_pylist()))
    index = {name: i for i, name in enumerate(names)}
    matrix = np.full((BUCKETS, len(names)), alpha)
    prior = np.ones(len(names))
    column = np.array([index[x] for x in counts.column("lang").to_pylist()], np.int64)
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    at = bucket >= 0
    np.add.at(matrix, (bucket[at], column[at]), n[at])
    np.add.at(prior, column[~at], n[~at])
    return LanguageModel(
        names, np.log(prior / max(prior.sum(), 1)), np.log(matrix / matrix.sum(axis=0))
    )


def _log_likelihood(texts: list[str], log_prob: np.ndarray) -> np.ndarray:
    """Rows by languages: the sparse matrix of n-gram counts times the log probabilities."""
    out = np.zeros((len(texts), log_prob.shape[1]))
    held, owners, size = [], [], 0

    def flush() -> None:
        starts = np.cumsum([0, *(len(x) for x in held[:-1])])
        np.add.at(out, owners, np.add.reduceat(log_prob[np.concatenate(held)], starts, axis=0))

    for i, text in enumerate(texts):
        for cells in _ngrams(text):
            held.append(cells)
            owners.append(i)
            size += len(cells)
            if size >= CHUNK:
                flush()
                held, owners, size = [], [], 0
    if held:
        flush()
    return out


def predict(
    df: DataFrame, text: str, model: LanguageModel, language: str = "lang_pred", posterior: str = "score"
) -> DataFrame:
    """``df`` with ``language`` and ``posterior``; columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop(language, posterior)
    schema = df.withColumns({language: F.lit(""), posterior: F.lit(0.0)}).schema
    flag = unused(df, "letters")
    flagged = df.withColumn(flag, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            letters = batch.column(flag).to_numpy(zero_copy_only=False)
            names = np.full(batch.num_rows, UNKNOWN, object)
            best = np.zeros(batch.num_rows)
            rows = np.flatnonzero(letters)
            if len(rows) and known.languages:
                texts = batch.column(text).take(pa.array(rows)).to_pylist()
                logs = _log_likelihood(texts, known.log_prob) + known.log_prior
                logs -= logs.max(axis=1, keepdims=True)
                share = np.exp(logs)
                share /= share.sum(axis=1, keepdims=True)
                top = share.argmax(axis=1)
                names[rows] = np.array(known.languages, object)[top]
                best[rows] = share[np.arange(len(rows)), top]
            kept = batch.drop_columns([flag])
            arrays = [*kept.columns, pa.array(names, pa.string()), pa.array(best)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept.schema.names, language, posterior])

    return flagged.mapInArrow(score, schema)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Key, ``held_out``, ``lang_pred`` and ``score`` for each row.

    Learns from the rows whose crc32 of the key, modulo 5, is not 0 (rows without a key are held out).
    """
    held = F.coalesce(fold(F.col(key), 5) == 0, F.lit(True))
    rows = df.select(F.col(key).alias("key"), held.alias("held_out"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = fit(rows.filter(~F.col("held_out")), "text", "lang")
    scored = predict(rows.select("key", "held_out", "text"), "text", model)
    return scored.select(F.col("key").alias(key), "held_out", "lang_pred", "score")


def keep_identified(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a language: all but null texts and those without a letter.

    A text between two close languages has one of them, so no posterior is too low. Where no language could be
    learned, no text can be told to have none, and all rows stay.
    """
    if not model.languages:
        return df
    language, posterior = unused(df, "language"), unused(df, "posterior")
    found = predict(df, text, model, language, posterior)
    return found.filter(F.col(language) != UNKNOWN).select(*[F.col(f"`{c}`") for c in df.columns])
