"""CSV and Parquet posts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postscreen.functions.text import NA_VALUES, missing_to_null
from postscreen.operators.ordinal import number_parts
from postscreen.operators.report import value_counts
from postscreen.session import materialise

_CORRUPT = "_corrupt_record"
# Quoted fields may span lines and hold doubled quotes; blanks at a field's edges belong to it.
_READ = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
_WRITE = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "emptyValue": "",
}


def _as_schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _typed(df: DataFrame, schema: T.StructType, na_values: Sequence[str]) -> DataFrame:
    """Missing-value spellings to null, then each column to its declared type."""
    return df.select(
        *[
            missing_to_null(F.col(f"`{f.name}`"), na_values).try_cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def _header(reader: DataFrameReader, path: str | list[str]) -> list[str]:
    """Column names of the header (of the first file, where there are several)."""
    return reader.csv(path).columns


def read_posts(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    na_values: Sequence[str] = NA_VALUES,
    delimiter: str = ",",
    multi_line: bool = True,
) -> DataFrame:
    """Posts from CSV files with a header. Types are declared, never inferred.

    Columns are taken by their names in the header: others are ignored, the order is free, and an
    absent one raises. Files read together must have the same header, or reading them raises.

    A multi-line file is read by one task, so a large set should come as many files, or be
    converted to Parquet once. Files known to have no line breaks in fields are split with
    ``multi_line=False``.
    """
    schema = _as_schema(schema)
    reader = spark.read.options(**{**_READ, "multiLine": multi_line}, sep=delimiter)
    names = _header(reader, path)
    if not names:  # not even a header
        return spark.createDataFrame([], schema)
    check_names(names, *schema.names)
    strings = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = reader.schema(strings).option("enforceSchema", False).csv(path)
    return _typed(raw, schema, na_values)


def read_tolerant(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    na_values: Sequence[str] = NA_VALUES,
    delimiter: str = ",",
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Posts from CSV files, and the rejected records as ``record``.

    A record with more fields than the header is rejected. One with fewer is kept and its last
    columns are missing. Columns are taken by name, as in ``read_posts``; the header is that of
    the first file. The files are parsed once, into the shared folder, for both results.
    """
    schema = _as_schema(schema)
    reader = spark.read.options(**{**_READ, "multiLine": multi_line}, sep=delimiter)
    names = _header(reader, path)
    if not names:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "record string")
    check_names(names, *schema.names)
    strings = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]])
    parsed = (
        reader.schema(strings)
        .options(mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
        .csv(path)
    )
    # The parser reports short and long records alike. One that fills the last column is long; if
    # that column is empty, the delimiters outside of quoted fields tell.
    filled = F.col(f"`{names[-1]}`").isNotNull()
    long = F.col(_CORRUPT).isNotNull() & (filled | (_fields(F.col(_CORRUPT), delimiter) > len(names)))
    raw = materialise(parsed.select(*schema.names, long.alias("_long"), F.when(long, F.col(_CORRUPT)).alias("_record")), "parsed")
    good = _typed(raw.filter(~F.col("_long")), schema, na_values)
    return good, raw.filter("_long").select(F.col("_record").alias("record"))


def _fields(record: Column, delimiter: str) -> Column:
    """Number of fields of a record. As for the parser, a quote only opens at the start of a field."""
    # Doubled quotes first, so that no pattern has to repeat a group.
    single = F.replace(record, F.lit('""'), F.lit("\u0001"))
    sep = re.escape(delimiter)
    bare = F.regexp_replace(single, F.lit(f'(^|{sep})\u0001*"[^"]*+"'), F.lit("$1"))
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def check_names(found: Sequence[str], *names: str) -> None:
    """An error that lists the columns that are not among ``found``."""
    absent = [n for n in names if n not in found]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The table itself, or an error that lists the columns it lacks."""
    check_names(df.columns, *names)
    return df


def write_posts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header and without an index column."""
    df.write.mode(mode).options(**_WRITE).csv(path)


def write_counts(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """The frequency table of a column as CSV, a row per value, most frequent first."""
    write_posts(value_counts(df, column), path, mode)


def write_parts(
    df: DataFrame,
    path: str,
    order_by: Sequence[str],
    n: int = 500,
    name: str = "posts",
    mode: str = "errorifexists",
) -> None:
    """Consecutive parts of ``n`` rows, each as one CSV file under ``<name>_part=<k>``, k from 1.

    Parts are range-partitioned by number, so a part is written by one task, whole and in order.
    """
    column = f"{name}_part"
    parts = number_parts(df, order_by, n, ordinal="_ord").withColumnRenamed("part", column)
    save_parts(parts, path, column, "_ord", mode)


def save_parts(parts: DataFrame, path: str, part: str, ordinal: str, mode: str, **options: str) -> None:
    """Numbered rows as one CSV file for each value of ``part``, in the order of ``ordinal``, which is dropped."""
    ranges = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        parts.repartitionByRange(ranges, part)
        .sortWithinPartitions(part, ordinal)
        .drop(ordinal)
        .write.mode(mode)
        .partitionBy(part)
        .options(**_WRITE, **options)
        .csv(path)
    )
