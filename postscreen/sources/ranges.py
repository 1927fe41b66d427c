"""Large CSV files with line breaks in fields, read in byte ranges by many tasks.

Spark's text scan cuts a file into ranges of ``spark.sql.files.maxPartitionBytes`` and gives each its whole lines. Whether a line
starts a record depends on all lines before it, so a first pass notes for each range how it ends if it starts between records
and how if it starts within a quoted field. A prefix scan over these notes, one row a range, tells how each range does start; a
second pass joins the lines of a record, and only records across the border of two ranges are brought together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postscreen.functions.text import NA_VALUES
from postscreen.session import materialise
from postscreen.sources.posts import _CORRUPT, _READ, _as_schema, _fields, _header, _typed, check_names

# The rest of a quoted field: a doubled quote belongs to it.
_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')
# What a piece of text is: a whole record, the rest of one that began in an earlier range, one that goes on in the next.
_WHOLE, _REST, _OPEN = 0, 1, 2


def ends_inside(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted field is open at the end of a line. A quote opens at the start of a field only."""
    at = 0
    if not inside:
        if not line.startswith('"'):
            at = line.find(f'{delimiter}"')
            if at < 0:
                return False
            at += len(delimiter)
        at += 1
    while True:
        at = _QUOTED.match(line, at).end()
        if at == len(line):
            return True
        at = line.find(f'{delimiter}"', at + 1)
        if at < 0:
            return False
        at += len(delimiter) + 1


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of the files, with their file, the start of their range, and a hash of both."""
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return lines.withColumn("hash", F.xxhash64("file", "start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, list[str], list[bool]]]:
    """The stretches of a batch that come from one range: file, start, hash, lines, and whether they hold a quote."""
    hashes = batch.column("hash").to_numpy()
    lines = batch.column("value").to_pylist()
    quotes = pc.match_substring(batch.column("value"), '"').to_pylist()
    cuts = (np.flatnonzero(np.diff(hashes)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True):
        if a < b:
            file, start = batch.column("file")[a].as_py(), batch.column("start")[a].as_py()
            yield file, start, int(hashes[a]), lines[a:b], quotes[a:b]


def _ends(lines: DataFrame, delimiter: str) -> DataFrame:
    """``file, start, after_out, after_in`` of each range: whether a field is open behind it, for both ways to start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, inside = None, False, True
        for batch in batches:
            for file, start, _, values, quotes in _runs(batch):
                if (file, start) != now:
                    if now:
                        yield _row(now, out, inside)
                    now, out, inside = (file, start), False, True
                for line, quoted in zip(values, quotes, strict=True):
                    if quoted:
                        out, inside = ends_inside(line, out, delimiter), ends_inside(line, inside, delimiter)
        if now:
            yield _row(now, out, inside)

    def _row(now: tuple[str, int], out: bool, inside: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": now[0], "start": now[1], "after_out": out, "after_in": inside}])

    return lines.mapInArrow(run, "file string, start long, after_out boolean, after_in boolean")


def _started_inside(ends: DataFrame) -> DataFrame:
    """``file, start`` of the ranges that start within a quoted field.

    A range that ends alike either way settles what follows; between two of these, each range that turns the state counts.
    """
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("after_out") & ~F.col("after_in")).cast("int")).over(before), F.lit(0))
    settled = F.when(F.col("after_out") == F.col("after_in"), F.struct("after_out", F.col("turns_through").alias("turns")))
    counted = ends.withColumn("turns", turns).withColumn(
        "turns_through", F.sum((F.col("after_out") & ~F.col("after_in")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    last = F.last(settled, ignorenulls=True).over(before)
    found = counted.withColumn("last", last)
    known = F.coalesce(F.col("last.after_out"), F.lit(False)).cast("int")
    since = F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))
    return found.filter((known + since) % 2 == 1).select("file", "start")


def read_records(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> DataFrame:
    """``record``, the raw text of every record, without headers and blank lines; the files' ranges are read in parallel.

    A header is the first record of a file, blank lines aside, and begins in its first range. Lines end in a line feed, with or without a carriage return before it. A field that is still open at the end of a file
    ends there. Broadcast is one number for each range that starts within a field, so at most one for every
    ``spark.sql.files.maxPartitionBytes`` of input. Records across a border, at most two for each range, are shuffled.
    """
    lines = _lines(spark, path)
    starts = _started_inside(_ends(lines, delimiter))
    inside_of = {r[0] for r in starts.select(F.xxhash64("file", "start")).collect()}
    shared = spark.sparkContext.broadcast(inside_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind, inside, held, headed = None, _WHOLE, False, [], True
        for batch in batches:
            out: list[dict] = []
            for file, start, mark, values, quotes in _runs(batch):
                if (file, start) != now:
                    if held:  # what is open at the end of a range goes on, the rest of an earlier record too
                        out.append(_piece(now, kind if kind == _REST else _OPEN, held))
                    now, held, headed = (file, start), [], start > 0
                    inside = mark in shared.value
                    kind = _REST if inside else _WHOLE
                for line, quoted in zip(values, quotes, strict=True):
                    held.append(line.removesuffix("\r"))
                    if quoted:
                        inside = ends_inside(held[-1], inside, delimiter)
                    if not inside:
                        if kind == _REST or (headed and held != [""]):
                            out.append(_piece(now, kind, held))
                        headed = headed or held != [""]
                        kind, held = _WHOLE, []
            yield pa.RecordBatch.from_pylist(out, schema=_PIECES)
        if held:
            yield pa.RecordBatch.from_pylist([_piece(now, kind if kind == _REST else _OPEN, held)], schema=_PIECES)

    def _piece(now: tuple[str, int], kind: int, held: list[str]) -> dict:
        return {"file": now[0], "start": now[1], "kind": kind, "record": "\n".join(held)}

    found = materialise(lines.mapInArrow(run, "file string, start long, kind int, record string"), "pieces")
    order = Window.partitionBy("file").orderBy("start", "kind")
    cut = found.filter(F.col("kind") != _WHOLE).withColumn("number", F.sum((F.col("kind") == _OPEN).cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("start", "kind", "record")))
    joined = cut.groupBy("file", "number").agg(F.array_join(parts["record"], "\n").alias("record"))
    return found.filter(F.col("kind") == _WHOLE).select("record").unionByName(joined.select("record"))


_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])


def _parsed(spark: SparkSession, path: str | list[str], schema: T.StructType, delimiter: str) -> tuple[DataFrame, list[str]]:
    names = _header(spark.read.options(**{**_READ, "multiLine": False}, sep=delimiter), path)
    if not names:
        return spark.createDataFrame([], "record string, row struct<x string>"), names
    check_names(names, *schema.names)
    strings = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]])
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in _READ.items() if k not in ("header", "multiLine")}
    row = F.from_csv("record", _ddl(strings), {**options, "sep": delimiter, "columnNameOfCorruptRecord": _CORRUPT})
    return read_records(spark, path, delimiter).select("record", row.alias("row")), names


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)


def read_posts_by_ranges(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    na_values: Sequence[str] = NA_VALUES,
    delimiter: str = ",",
) -> DataFrame:
    """The rows of ``read_posts`` by many tasks for each file. The header, in one line, is that of the first file."""
    schema = _as_schema(schema)
    parsed, names = _parsed(spark, path, schema, delimiter)
    return _typed(parsed.select("row.*"), schema, na_values) if names else spark.createDataFrame([], schema)


def read_tolerant_by_ranges(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    na_values: Sequence[str] = NA_VALUES,
    delimiter: str = ",",
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``read_tolerant``, and the records with too many fields, by many tasks for each file."""
    schema = _as_schema(schema)
    parsed, names = _parsed(spark, path, schema, delimiter)
    if not names:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "record string")
    long = F.coalesce(_fields(F.col("record"), delimiter) > len(names), F.lit(False))
    good = _typed(parsed.filter(~long).select("row.*"), schema, na_values)
    return good, parsed.filter(long).select("record")
