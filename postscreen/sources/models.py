"""Saving and loading trained models by path."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from postscreen.operators.bayes import NaiveBayesModel
from postscreen.operators.folded import LinearModel
from postscreen.operators.stacked import StackedModel

Model = NaiveBayesModel | LinearModel | PipelineModel | StackedModel

_FIGURES = (
    "log_prior array<double>, vocabulary long, vocabulary_bytes long, token_total long, "
    "fold_case boolean"
)
_LINEAR = "weights array<double>, intercept double, fold_case boolean"


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Write a model as a new version under ``path``, which readers see once it is whole.

    The files of a version go to a folder of their own, and a manifest of one line, written last, names it. So a save that
    dies leaves the version before it readable, and a model can be saved over the path it was loaded from.
    Older versions stay until they are expired with the folder.
    """
    number = max((n for n, _ in _versions(spark, path)), default=0) + 1
    name = f"{number:06d}-{uuid.uuid4().hex}"
    _write(spark, model, f"{path}/versions/{name}")
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(f"{path}/manifests/{name}")


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and name of the versions that were written to the end, in order."""
    try:
        rows = spark.read.text(f"{path}/manifests/*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((int(r["value"].split("-")[0]), r["value"]) for r in rows)


def _write(spark: SparkSession, model: Model, path: str) -> None:
    """The files of a model and a note of its kind, to a folder that is not there yet."""
    if isinstance(model, StackedModel):
        kind = "stacked"
        for part in ("bayes", "linear", "meta"):
            _write(spark, getattr(model, part), f"{path}/{part}")
    elif isinstance(model, NaiveBayesModel):
        kind = "bayes"
        model.weights.write.parquet(f"{path}/weights")
        figures = (
            list(model.log_prior),
            model.vocabulary,
            model.vocabulary_bytes,
            model.token_total,
            model.fold_case,
        )
        spark.createDataFrame([figures], _FIGURES).write.parquet(f"{path}/figures")
    elif isinstance(model, LinearModel):
        kind = "linear"
        figures = [(model.weights.tolist(), model.intercept, model.fold_case)]
        spark.createDataFrame(figures, _LINEAR).coalesce(1).write.parquet(f"{path}/figures")
    else:
        kind = "pipeline"
        model.write().save(f"{path}/pipeline")
    spark.createDataFrame([(kind,)], "value string").write.text(f"{path}/kind")


def load_model(spark: SparkSession, path: str) -> Model:
    """The newest whole version of the model saved under ``path``, whatever its kind."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no model under {path}")
    return _read(spark, f"{path}/versions/{versions[-1][1]}")


def _read(spark: SparkSession, path: str) -> Model:
    kind = spark.read.text(f"{path}/kind").first()["value"]
    if kind == "stacked":
        return StackedModel(*(_read(spark, f"{path}/{part}") for part in ("bayes", "linear", "meta")))
    if kind == "pipeline":
        return PipelineModel.load(f"{path}/pipeline")
    if kind == "linear":
        figures = spark.read.schema(_LINEAR).parquet(f"{path}/figures").first()
        return LinearModel(np.array(figures["weights"]), figures["intercept"], figures["fold_case"])
    figures = spark.read.schema(_FIGURES).parquet(f"{path}/figures").first()
    weights = spark.read.schema("token string, n long, w array<double>").parquet(f"{path}/weights")
    return NaiveBayesModel(
        weights=weights,
        log_prior=tuple(figures["log_prior"]),
        vocabulary=figures["vocabulary"],
        vocabulary_bytes=figures["vocabulary_bytes"],
        token_total=figures["token_total"],
        fold_case=figures["fold_case"],
    )
