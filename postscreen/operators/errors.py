"""The rows a model got right or wrong. Works on scored rows, so the model runs once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscreen.operators.dedup import keep_first
from postscreen.operators.report import head

# Each kind of outcome as (prediction, truth).
KINDS = {
    "false_positive": (1, 0),
    "false_negative": (0, 1),
    "true_positive": (1, 1),
    "true_negative": (0, 0),
}


def outcome_rows(df: DataFrame, kind: str, label: str, pred: str) -> DataFrame:
    """Rows of one outcome kind."""
    guess, truth = KINDS[kind]
    return df.filter((F.col(label) == truth) & (F.col(pred) == guess))


def _extract(
    df: DataFrame,
    kind: str,
    label: str,
    pred: str,
    relabel: bool,
    distinct_text: str | None,
    order_by: Sequence[str] | None,
) -> DataFrame:
    rows = outcome_rows(df, kind, label, pred)
    if distinct_text is not None:
        if not order_by:
            raise ValueError("distinct texts need an order_by")
        rows = keep_first(rows, [distinct_text], order_by)
    # The set is written with the class the model saw in it, not the one it was labelled with.
    return rows.withColumn(label, F.lit(KINDS[kind][0])) if relabel else rows


def false_positives(
    df: DataFrame,
    label: str,
    pred: str,
    relabel: bool = True,
    distinct_text: str | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Rows predicted 1 but labelled 0, labelled 1 in the result unless ``relabel`` is off.

    ``distinct_text`` names the text column to keep only the first qualifying row per text.
    """
    return _extract(df, "false_positive", label, pred, relabel, distinct_text, order_by)


def false_negatives(
    df: DataFrame,
    label: str,
    pred: str,
    relabel: bool = True,
    distinct_text: str | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Rows predicted 0 but labelled 1, labelled 0 in the result unless ``relabel`` is off."""
    return _extract(df, "false_negative", label, pred, relabel, distinct_text, order_by)


def true_positives(
    df: DataFrame,
    label: str,
    pred: str,
    distinct_text: str | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Rows predicted 1 and labelled 1."""
    return _extract(df, "true_positive", label, pred, False, distinct_text, order_by)


def first_errors(
    df: DataFrame, kind: str, n: int, order_by: Sequence[str], label: str, pred: str
) -> DataFrame:
    """The first ``n`` rows of one outcome kind in input order; none for n <= 0."""
    return head(outcome_rows(df, kind, label, pred), order_by, n)


def outcome_summary(df: DataFrame, label: str, pred: str, text: str) -> DataFrame:
    """Rows and distinct texts per outcome kind that occurs."""
    kind = F.lit(None).cast("string")
    for name, (guess, truth) in KINDS.items():
        kind = F.when((F.col(pred) == guess) & (F.col(label) == truth), name).otherwise(kind)
    # Grouped by text first, so a kind with most of the rows is already reduced before it meets
    # in one task.
    per_text = (
        df.select(kind.alias("kind"), F.col(text).alias("_text"))
        .filter(F.col("kind").isNotNull())
        .groupBy("kind", "_text")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return per_text.groupBy("kind").agg(
        F.sum("_n").alias("rows"), F.count("_text").alias("distinct_texts")
    )


def leaked(train: DataFrame, val: DataFrame, text: str) -> DataFrame:
    """Texts found on both sides, with their number of rows on each.

    A count per text over both sides instead of a join: a text that makes up a third of the rows
    is reduced to one partial count per task before the shuffle.
    """
    sides = train.select(text, F.lit(True).alias("_train")).unionByName(
        val.select(text, F.lit(False).alias("_train"))
    )
    return (
        sides.filter(F.col(text).isNotNull())
        .groupBy(text)
        .agg(
            F.count_if("_train").alias("n_train"),
            F.count_if(~F.col("_train")).alias("n_val"),
        )
        .filter("n_train > 0 and n_val > 0")
    )
