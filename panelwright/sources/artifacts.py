"""Fitted model and feature statistics under one folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from panelwright.operators.features import FeatureModel
from panelwright.operators.boosting import BoostedFit
from panelwright.operators.models import LinearFit, predict

#: Name of the row that holds the intercept; no column can be called so in a panel.
INTERCEPT = "(intercept)"


@dataclass(frozen=True)
class Artifacts:
    features: FeatureModel
    pipeline: PipelineModel | LinearFit | BoostedFit

    def predict(self, df: DataFrame) -> DataFrame:
        return predict(self.pipeline, df)


def save_fit(spark: SparkSession, path: str, pipeline: PipelineModel | LinearFit | BoostedFit) -> None:
    """A linear fit as a table of weights, boosted trees as one line of JSON, others as Spark writes them."""
    rows: list[tuple[int, str, float, float | None]] = []
    if isinstance(pipeline, LinearFit):
        fitted = zip(pipeline.features, pipeline.weights, pipeline.spreads)
        rows = [(i, *f) for i, f in enumerate(fitted)] + [(-1, INTERCEPT, pipeline.intercept, None)]
    elif not isinstance(pipeline, BoostedFit):
        pipeline.write().overwrite().save(f"{path}/model")
    trees = [(pipeline.to_json(),)] if isinstance(pipeline, BoostedFit) else []
    spark.createDataFrame(trees, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/trees")
    weights = spark.createDataFrame(rows, "place long, feature string, weight double, spread double")
    weights.coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")


def load_fit(spark: SparkSession, path: str) -> PipelineModel | LinearFit | BoostedFit:
    rows = spark.read.parquet(f"{path}/weights").orderBy("place").collect()
    if not rows:
        trees = spark.read.text(f"{path}/trees", wholetext=True).first()
        if trees is not None and trees[0].strip():
            return BoostedFit.from_json(trees[0])
        return PipelineModel.load(f"{path}/model")
    names, weights, spreads = zip(*((r.feature, r.weight, r.spread) for r in rows[1:])) if rows[1:] else ((), (), ())
    return LinearFit(names, weights, spreads, rows[0].weight)


def save_artifacts(
    spark: SparkSession, path: str, features: FeatureModel, pipeline: PipelineModel | LinearFit | BoostedFit
) -> None:
    save_fit(spark, path, pipeline)
    features.save(spark, f"{path}/features")


def load_artifacts(spark: SparkSession, path: str) -> Artifacts:
    try:
        return Artifacts(FeatureModel.load(spark, f"{path}/features"), load_fit(spark, path))
    except AnalysisException as missing:
        raise FileNotFoundError(f"No fitted model under {path}: train first") from missing
