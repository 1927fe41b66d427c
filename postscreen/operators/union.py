"""Union of tables with differing columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(*frames: DataFrame, rank: str | None = "source_rank") -> DataFrame:
    """All rows of all tables; a column that a table lacks is missing there.

    ``rank`` names a column with the table's position, the leading part of an order key over the
    result. Pass None to leave it out.
    """
    if rank is not None:
        frames = tuple(f.withColumn(rank, F.lit(i)) for i, f in enumerate(frames))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
