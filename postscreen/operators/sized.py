"""Join to a table expected to be small, with a size check before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
SALTS = 64


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: str,
    how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join ``big`` to ``small`` on a key with few values, such as a class label.

    The rows of ``small`` are counted, stopping at the bound. Up to the bound ``small`` is
    broadcast. Beyond it both sides are shuffled on the key and a salt: ``small`` is repeated once
    per salt and ``big`` takes its salt from the column ``spread``, so that a key holding a third
    of all rows is spread over many tasks.
    """
    on = list(on)
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    return big.withColumn("_salt", salt).join(salted, [*on, "_salt"], how).drop("_salt")
