import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from postscreen.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def edge(spark):
    """One row per awkward case: ord, text, raw label."""
    rows = [
        (0, "Sunny walk today", "0"),
        (1, "sunny walk today", "0"),
        (2, "Sunny walk today", "1"),
        (3, None, "1"),
        (4, "null", "0"),
        (5, "\t\n ", "0"),
        (6, "\U0001f600", "1"),
        (7, "tea \U0001f600", " 1 "),
        (8, "tea ", "0"),
        (9, 'line one\nline "two", end', "0"),
        (10, "rain", "maybe"),
        (11, "snow", "1.0"),
        (12, "wind", None),
    ]
    return spark.createDataFrame(rows, "ord long, text string, depressive string")


def layouts(df, key):
    """The same rows in differing partitions and orders."""
    from pyspark.sql import functions as F

    return [df.repartition(1), df.repartition(7), df.orderBy(F.xxhash64(key).desc()).coalesce(3)]


def rows(df):
    """Rows as a sorted list of tuples; missing values sort first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, v) for v in r])
