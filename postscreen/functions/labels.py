"""Label parsing and presence flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postscreen.functions.text import strip

# The accepted spellings of a class label.
VALID_LABELS = ("0", "1")


def is_valid_label(label: Column) -> Column:
    """True when the stripped label is exactly ``0`` or ``1``; never null.

    The test is on the string, so ``1.0`` is rejected.
    """
    return F.coalesce(strip(label.cast("string")).isin(*VALID_LABELS), F.lit(False))


def parse_label(label: Column) -> Column:
    """Stripped label as a nullable int; anything that is no integer becomes null."""
    return strip(label.cast("string")).try_cast("int")


def presence_flag(value: Column) -> Column:
    """1 when the value is present, 0 when it is missing."""
    return value.isNotNull().cast("int")
