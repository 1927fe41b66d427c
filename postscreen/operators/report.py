"""Frequency tables, profiles and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscreen.session import materialise


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; missing values are not counted. Ties go by value."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), column)
    )


def frequency_report(df: DataFrame, column: str) -> DataFrame:
    """``value_counts`` with each value's share of the counted rows."""
    counts = value_counts(df, column)
    total = df.agg(F.count(column)).first()[0]
    return counts.withColumn("share", F.col("count") / F.lit(total))


def profile(df: DataFrame) -> DataFrame:
    """Per column its type, the number of rows and the number of non-missing values, in one pass."""
    names = df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(names)],
    )
    lines = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("type"),
            F.col("_rows").alias("rows"),
            F.col(f"_c{i}").alias("non_null"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return counted.select(F.inline(F.array(*lines)))


def _count_histogram(df: DataFrame, column: str) -> DataFrame:
    """How many classes have each frequency. n rows have fewer than sqrt(2 n) distinct ones."""
    classes = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("v"))
    return classes.groupBy("v").agg(F.count(F.lit(1)).alias("m"))


def box_summary(df: DataFrame, column: str) -> DataFrame:
    """Box-plot figures of the class frequencies of ``column``, as one row.

    Quartiles interpolate linearly; whiskers end at the last frequency within 1.5 interquartile
    ranges of the box; ``n_outliers`` counts the classes beyond. Works on the histogram of
    frequencies, which stays small however many classes there are and is written once, so that
    the table is read in one pass.
    """
    histogram = materialise(_count_histogram(df, column), "frequencies")
    low, high, q1, median, q3 = _fences(histogram)
    inside = F.col("v").between(low, high)
    return histogram.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("n"),
        F.lit(q1).cast("double").alias("q1"),
        F.lit(median).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("m"))), F.lit(0)).alias("n_outliers"),
    )


def box_outliers(df: DataFrame, column: str) -> DataFrame:
    """The classes whose frequency lies beyond the whiskers of ``box_summary``."""
    low, high, *_ = _fences(_count_histogram(df, column))
    return value_counts(df, column).filter(~F.col("count").between(low, high))


def _fences(histogram: DataFrame) -> tuple[float | None, ...]:
    quartiles = F.expr("percentile(v, array(0.25D, 0.5D, 0.75D), m)")
    q1, median, q3 = histogram.agg(quartiles.alias("q")).first()["q"] or (None, None, None)
    if q1 is None:
        return (None,) * 5
    reach = 1.5 * (q3 - q1)
    return q1 - reach, q3 + reach, q1, median, q3


def head(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in the order of ``order_by``; none for n <= 0."""
    return df.orderBy(*[F.col(f"`{c}`") for c in order_by]).limit(max(int(n), 0))
