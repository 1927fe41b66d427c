"""Scores of a training set by models that have not seen the rows they score."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscreen.operators.bayes import with_fold


def out_of_fold(
    df: DataFrame,
    key: str,
    fit: Callable[[DataFrame], Any],
    score: Callable[[Any, DataFrame], DataFrame],
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Each fold scored by ``score`` with what ``fit`` makes of the other folds; any kind of model.

    Rows without a key are in no fold. For naive Bayes ``bayes.out_of_fold`` fits all folds in one pass.
    """
    folded = with_fold(df, key, k, seed)
    parts = [score(fit(folded.filter(F.col("fold") != i)), folded.filter(F.col("fold") == i)) for i in range(k)]
    return reduce(DataFrame.unionByName, parts)
