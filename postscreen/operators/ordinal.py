"""Global row numbers without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postscreen.session import materialise

MAX_RANGES = 50_000
MAX_FILES = 1_000_000
_LOCAL_BITS = 33


def with_ordinal(
    df: DataFrame, order_by: Sequence[str], name: str = "ord", ranges: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order_by``, which must be unique.

    Rows are range-partitioned and sorted once, and numbered within their range; the ranges are
    written to the shared folder, because a second evaluation could draw other range bounds. What
    is added to each local number is the size of all earlier ranges: one row per range, at most
    ``MAX_RANGES``, so that table is broadcast.
    """
    spark = df.sparkSession
    if ranges is None:
        ranges = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    if not 0 < ranges <= MAX_RANGES:
        raise ValueError(f"ranges must be between 1 and {MAX_RANGES}")
    keys = [F.col(f"`{c}`") for c in order_by]
    numbered = materialise(
        df.repartitionByRange(ranges, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
        # The id holds the partition above bit 33 and the row within it below.
        .withColumn("_range", F.shiftright("_id", _LOCAL_BITS).cast("int"))
        .withColumn("_local", F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_id"),
        "ordinal",
    )
    sizes = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_size")).collect()
    start, starts = 0, []
    for row in sorted(sizes):
        starts.append((row["_range"], start))
        start += row["_size"]
    offsets = spark.createDataFrame(starts, "_range int, _start long")
    return (
        numbered.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_range", "_local", "_start")
    )


def file_ordinal(
    spark: SparkSession, path: str | list[str], name: str = "ord", max_files: int = MAX_FILES
) -> DataFrame:
    """The rows of Parquet files with their 0-based position: files by path, rows as they stand.

    A scan tells the file of each row and its place there, so nothing is sorted and no row moves;
    what is added is the number of rows in all earlier files. That table has 16 bytes and a row
    for each file, is counted without reading a column, and is broadcast up to ``max_files``.
    Beyond, or if two paths share a digest, rows are ordered by file and place, with the same
    result. Files that Spark wrote from sorted ranges are in order of their paths.

    Empty files and tables add nothing; nulls and repeated rows are numbered like all others. A
    column called ``name`` raises, any other name may occur.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if name in df.columns:
        raise ValueError(f"the files have a column {name}")
    file, place, start = (_free(df, c) for c in ("_file", "_place", "_start"))
    source = df.metadataColumn("_metadata")
    sizes = df.groupBy(source["file_path"].alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each file: few enough for a task, as the scan's own list of files is for the driver.
    starts = materialise(
        sizes.select(
            F.xxhash64("path").alias(file), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(start)
        ),
        "files",
    )
    found = starts.agg(F.count(F.lit(1)).alias("files"), F.count_distinct(file).alias("digests")).first()
    if found["files"] > max_files or found["digests"] < found["files"]:
        placed = df.withColumns({file: source["file_path"], place: source["row_index"]})
        return with_ordinal(placed, [file, place], name).drop(file, place)
    placed = df.withColumns({file: F.xxhash64(source["file_path"]), place: source["row_index"]})
    joined = placed.join(F.broadcast(starts), file)
    return joined.withColumn(name, F.col(start) + F.col(place)).drop(file, place, start)


def _free(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def number_parts(
    df: DataFrame, order_by: Sequence[str], n: int = 500, ordinal: str | None = None
) -> DataFrame:
    """Add ``part``, counted from 1, so that consecutive parts hold ``n`` rows each.

    ``ordinal`` names the column for the row number itself; by default it is dropped.
    """
    name = ordinal or "_ord"
    parts = with_ordinal(df, order_by, name).withColumn(
        "part", F.expr(f"cast(`{name}` div {int(n)} as long) + 1")
    )
    return parts if ordinal else parts.drop(name)


def batch_id(
    df: DataFrame, order_by: Sequence[str], size: int = 8, name: str = "batch"
) -> DataFrame:
    """Add the 0-based number of the batch of ``size`` consecutive rows."""
    return (
        with_ordinal(df, order_by, "_ord")
        .withColumn(name, F.expr(f"_ord div {int(size)}"))
        .drop("_ord")
    )
