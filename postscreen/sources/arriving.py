"""Posts that arrive as files over time, numbered and written in parts as they come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postscreen.functions.text import NA_VALUES
from postscreen.operators.ordinal import with_ordinal
from postscreen.sources.posts import _READ, _as_schema, save_parts, _typed


def read_arriving(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    files_per_batch: int | None = None,
    na_values: Sequence[str] = NA_VALUES,
    delimiter: str = ",",
) -> DataFrame:
    """A stream of the posts in CSV files that land in a folder, each file once, by its time.

    Columns are those of the header, in the order of ``schema``; a file with other ones fails the
    stream. ``files_per_batch`` bounds what a batch reads. A file is taken however old it is when it
    arrives, so the stream's log keeps the names of all files.
    """
    schema = _as_schema(schema)
    reader = spark.readStream.options(**_READ, sep=delimiter, enforceSchema=False, maxFileAge="36500d")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    strings = T.StructType([T.StructField(f, T.StringType()) for f in schema.names])
    return _typed(reader.schema(strings).csv(path), schema, na_values)


def write_arriving_parts(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    order_by: Sequence[str],
    n: int = 500,
    name: str = "posts",
) -> StreamingQuery:
    """Number what has arrived in parts of ``n`` rows, each one CSV file, and stop at the end of it.

    Rows of an earlier batch come first; within a batch they follow ``order_by``, which must be
    unique there. Deliveries in order therefore give the files of ``write_parts`` over all of them.
    The next run, from the same ``checkpoint``, goes on where this one ended: the last part is
    filled up before another is opened.

    Each row lands in one part, once, whenever a run dies. The rows of a part not yet full are kept
    beside the stream's own log, under the number of the batch, and written after the parts. A
    batch that runs again starts from what its predecessor kept, makes the same parts, and
    replaces them. An empty batch changes nothing. ``name`` must be the same in all runs.
    """
    part = f"{name}_part"
    for clash in (part, "_new", "_key", "_ord"):
        if clash in stream.columns:
            raise ValueError(f"the posts have a column {clash}")

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, total = batch.withColumn("_new", F.lit(1)), 0
        if number:
            total, rest = _kept(spark, checkpoint, number - 1, batch.schema)
            rows = rest.withColumn("_new", F.lit(0)).unionByName(rows)
        full = total - total % n
        numbered = _numbered(rows, ["_new", *order_by])
        parts = numbered.drop("_new").withColumn("_ord", F.col("_ord") + F.lit(full)).withColumn(
            part, F.expr(f"cast(_ord div {int(n)} as long) + 1")
        )
        total = full + rows.count()
        if total > full:
            save_parts(parts, path, part, "_ord", "overwrite", partitionOverwriteMode="dynamic")
        rest = parts.filter(F.col("_ord") >= total - total % n).drop("_ord", part)
        _keep(rest, checkpoint, number, total)

    return (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _numbered(rows: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Rows with ``_ord``, their position in the order.

    Only the order's columns are sorted and written; the files of the batch are read again to meet
    them. Where keys repeat after all, whole rows are numbered, so that none is lost or doubled.
    """
    keys = with_ordinal(rows.select(*[F.col(f"`{c}`") for c in order_by]), order_by, "_ord")
    key = F.struct(*[F.col(f"`{c}`") for c in order_by])
    keys = keys.select(key.alias("_key"), "_ord")
    if not keys.groupBy("_key").count().filter("count > 1").isEmpty():
        return with_ordinal(rows, order_by, "_ord")
    return rows.withColumn("_key", key).join(keys, "_key").drop("_key")


def _keep(rest: DataFrame, checkpoint: str, number: int, total: int) -> None:
    """The rows of the open part (fewer than a part holds) and the number of rows up to this batch."""
    rest.write.mode("overwrite").parquet(f"{checkpoint}/parts/{number}/rest")
    count = rest.sparkSession.createDataFrame([(total,)], "total long")
    count.coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/parts/{number}/total")


def _kept(spark: SparkSession, checkpoint: str, number: int, schema: T.StructType) -> tuple[int, DataFrame]:
    """What ``_keep`` wrote for a batch."""
    folder = f"{checkpoint}/parts/{number}"
    total = spark.read.parquet(f"{folder}/total").first()["total"]
    return total, spark.read.schema(schema).parquet(f"{folder}/rest")
