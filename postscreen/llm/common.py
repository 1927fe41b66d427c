"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space: blank and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(n))


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts_for(total: float, each: float) -> int:
    """How many parts of about ``each`` hold ``total``."""
    return max(1, -(-int(total) // int(each)))


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most ``rows`` of them."""
    return F.broadcast(df) if df.count() <= rows else df


def binary(batch, name: str) -> list[bytes]:
    """A column of an Arrow batch as Python bytes; null becomes empty."""
    return [v if v is not None else b"" for v in batch.column(name).to_pylist()]


def unused(df: DataFrame, name: str) -> str:
    """A name for a working column that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name = f"_{name}"
    return name
