"""Features, forecasts and strategy metrics as stages of ``pyspark.ml`` pipelines and cross-validators.

``Pipeline(stages=[PanelFeatures(...), PanelElasticNet(...)])`` fits, saves and loads like any other; the
parameters carry the names and defaults of :mod:`panelwright.spec` in Spark's spelling. The stages pass
data frames with plain columns, no vectors, so that a linear forecast stays one expression and Catalyst
prunes the windows that feed only features of weight zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession

from panelwright.functions.scalars import position
from panelwright.operators.boosting import BoostingSpec
from panelwright.operators.evaluation import strategy_report
from panelwright.operators.features import FeatureEstimator, FeatureModel
from panelwright.operators.models import PREDICTION, TrainedModel, train_model, train_models
from panelwright.session import materialize
from panelwright.sources.artifacts import load_fit, save_fit
from panelwright.spec import FeatureSpec, ModelSpec, PanelSpec, StrategySpec


def _param(name: str, doc: str, converter: Any) -> Param:
    return Param(Params._dummy(), name, doc, converter)


class _Roles(Params):
    """Column roles, as of :class:`PanelSpec`."""

    dateCol = _param("dateCol", "date or instant of a row", TypeConverters.toString)
    keyCol = _param("keyCol", "key of the series", TypeConverters.toString)
    labelCol = _param("labelCol", "target; none if not set", TypeConverters.toString)
    tiebreakCols = _param("tiebreakCols", "columns that order rows of one instant", TypeConverters.toListString)
    grain = _param("grain", "day or instant", TypeConverters.toString)
    featureCols = _param("featureCols", "feature columns; if not set, numeric ones without a role", TypeConverters.toListString)

    def __init__(self, **params: Any) -> None:
        super().__init__()
        self._setDefault(dateCol="date", keyCol="symbol", tiebreakCols=[], grain="day")
        self._defaults()
        self._set(**params)

    def _defaults(self) -> None:
        """Defaults of the parameters that a stage adds."""

    def panel(self) -> PanelSpec:
        value = self.getOrDefault
        features = tuple(value("featureCols")) if self.isDefined("featureCols") else None
        target = value("labelCol") if self.isDefined("labelCol") else None
        return PanelSpec(value("dateCol"), value("keyCol"), target, tuple(value("tiebreakCols")), value("grain"), features)


# -- persistence ----------------------------------------------------------------------------------


class _FittedWriter(MLWriter):
    """Parameters as Spark writes them, and what was fitted beside them."""

    def __init__(self, instance: _Fitted) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance._save_fitted(self.sparkSession, f"{path}/fitted")


class _FittedReader(MLReader):
    def __init__(self, kind: type) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Any:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.kind(self.kind._load_fitted(self.sparkSession, f"{path}/fitted"))
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        return instance


class _Fitted(Model, _Roles, MLWritable, MLReadable):
    """A model made of parameters and something fitted."""

    def __init__(self, fitted: Any) -> None:
        super().__init__()
        self.fitted = fitted

    def write(self) -> MLWriter:
        return _FittedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FittedReader(cls)


# -- features -------------------------------------------------------------------------------------


class _Engineering(_Roles):
    """Feature engineering, as of :class:`FeatureSpec`."""

    lags = _param("lags", "rows back", TypeConverters.toListInt)
    rollingWindows = _param("rollingWindows", "rows of the trailing frames", TypeConverters.toListInt)
    winsorLower = _param("winsorLower", "lower winsor quantile", TypeConverters.toFloat)
    winsorUpper = _param("winsorUpper", "upper winsor quantile", TypeConverters.toFloat)
    winsorizeTarget = _param("winsorizeTarget", "whether the target is clipped too", TypeConverters.toBoolean)
    imputation = _param("imputation", "median, mean, most_frequent or constant", TypeConverters.toString)
    scaler = _param("scaler", "standard or none", TypeConverters.toString)
    bounds = _param("bounds", "batch or fitted", TypeConverters.toString)
    quantiles = _param("quantiles", "exact or approx", TypeConverters.toString)
    rowsPerBlock = _param("rowsPerBlock", "rows one task windows at most", TypeConverters.toInt)
    carryCols = _param("carryCols", "columns that pass through", TypeConverters.toListString)

    #: Parameters and the fields of the specification they set.
    _FIELDS = {
        "lags": "lags", "rollingWindows": "rolling_windows", "winsorLower": "winsor_lower", "winsorUpper": "winsor_upper",
        "winsorizeTarget": "winsorize_target", "imputation": "imputation", "scaler": "scaler", "bounds": "bounds",
        "quantiles": "quantiles", "rowsPerBlock": "rows_per_block",
    }

    def _defaults(self) -> None:
        usual = {name: getattr(FeatureSpec(), field) for name, field in self._FIELDS.items()}
        plain = {name: list(value) if isinstance(value, tuple) else value for name, value in usual.items()}
        self._setDefault(carryCols=[], **plain)

    def features(self) -> FeatureSpec:
        values = {field: self.getOrDefault(name) for name, field in self._FIELDS.items()}
        return FeatureSpec(**{f: tuple(v) if isinstance(v, list) else v for f, v in values.items()})


class PanelFeatures(Estimator, _Engineering, DefaultParamsReadable, DefaultParamsWritable):
    """Winsorise, lag, roll, impute and scale; the result holds roles, carried columns and features."""

    def _fit(self, dataset: DataFrame) -> PanelFeaturesModel:
        matrix, fitted = FeatureEstimator(self.panel(), self.features()).fit_transform(dataset)
        model = self._copyValues(PanelFeaturesModel(fitted))
        model._matrix = (dataset, matrix)
        return model


class PanelFeaturesModel(_Fitted, _Engineering):
    """Fitted statistics as a stage. The frame it was fitted on is not windowed a second time."""

    #: The training frame and its matrix, which a pipeline asks for right after the fit.
    _matrix: tuple[DataFrame, DataFrame] | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        carry = self.getOrDefault("carryCols")
        if self._matrix and dataset is self._matrix[0] and not carry:
            return self._matrix[1]
        return self.fitted.transform(dataset, carry)

    def _save_fitted(self, spark: SparkSession, path: str) -> None:
        self.fitted.save(spark, path)

    @staticmethod
    def _load_fitted(spark: SparkSession, path: str) -> FeatureModel:
        return FeatureModel.load(spark, path)


# -- forecasts ------------------------------------------------------------------------------------


class _Forecast(_Roles):
    predictionCol = _param("predictionCol", "forecast", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(predictionCol=PREDICTION)


class _Forecaster(Estimator, _Forecast, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a model of :mod:`panelwright.operators.models` on a feature matrix."""

    def spec(self) -> ModelSpec:
        raise NotImplementedError

    def _names(self, dataset: DataFrame) -> tuple[list[str], str]:
        panel = self.panel()
        if panel.target is None:
            raise ValueError("labelCol is not set")
        return panel.feature_columns(dataset), panel.target

    def _fit(self, dataset: DataFrame) -> PanelForecastModel:
        return self._model(train_model(self.spec(), dataset, *self._names(dataset)))

    def _model(self, trained: TrainedModel) -> PanelForecastModel:
        model = self._copyValues(PanelForecastModel(trained.pipeline))
        model.rmse = trained.rmse
        return model


class PanelForecastModel(_Fitted, _Forecast):
    """A fitted elastic net or boosted trees; adds the forecast."""

    #: Error on the training rows; not kept by a saved model.
    rmse: float | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = TrainedModel(self.fitted, (), 0.0).predict(dataset)
        return scored.withColumnRenamed(PREDICTION, self.getOrDefault("predictionCol"))

    def _save_fitted(self, spark: SparkSession, path: str) -> None:
        save_fit(spark, path, self.fitted)

    @staticmethod
    def _load_fitted(spark: SparkSession, path: str) -> Any:
        return load_fit(spark, path)


class PanelElasticNet(_Forecaster):
    """Elastic net. Many parameter maps, as of a cross-validator, share one scan of the rows."""

    alpha = _param("alpha", "penalty", TypeConverters.toFloat)
    l1Ratio = _param("l1Ratio", "share of the absolute weights in the penalty", TypeConverters.toFloat)

    def _defaults(self) -> None:
        super()._defaults()
        self._setDefault(alpha=0.5, l1Ratio=0.5)

    def spec(self) -> ModelSpec:
        return ModelSpec("elastic_net", {"alpha": self.getOrDefault("alpha"), "l1_ratio": self.getOrDefault("l1Ratio")})

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]) -> Iterator[tuple[int, PanelForecastModel]]:
        each = [self.copy(extra) for extra in paramMaps]
        if any(one.panel() != self.panel() for one in each):
            return super().fitMultiple(dataset, paramMaps)
        trained = train_models([one.spec() for one in each], dataset, *self._names(dataset))
        return iter([(i, one._model(t)) for i, (one, t) in enumerate(zip(each, trained))])


class PanelBoostedTrees(_Forecaster):
    """Histogram trees that grow leaf by leaf, with the parameters of :class:`BoostingSpec`."""

    nEstimators = _param("nEstimators", "trees", TypeConverters.toInt)
    numLeaves = _param("numLeaves", "leaves of a tree", TypeConverters.toInt)
    maxDepth = _param("maxDepth", "depth of a tree; unlimited if not positive", TypeConverters.toInt)
    learningRate = _param("learningRate", "share of a leaf's value that is added", TypeConverters.toFloat)
    minChildSamples = _param("minChildSamples", "rows of a leaf", TypeConverters.toInt)
    subsample = _param("subsample", "share of the rows a tree sees", TypeConverters.toFloat)
    colsampleBytree = _param("colsampleBytree", "share of the features a tree sees", TypeConverters.toFloat)
    regAlpha = _param("regAlpha", "L1 term", TypeConverters.toFloat)
    regLambda = _param("regLambda", "L2 term", TypeConverters.toFloat)
    maxBin = _param("maxBin", "bins of a feature", TypeConverters.toInt)
    seed = _param("seed", "seed of the samples", TypeConverters.toInt)

    _FIELDS = {
        "nEstimators": "n_estimators", "numLeaves": "num_leaves", "maxDepth": "max_depth", "learningRate": "learning_rate",
        "minChildSamples": "min_child_samples", "subsample": "subsample", "colsampleBytree": "colsample_bytree",
        "regAlpha": "reg_alpha", "regLambda": "reg_lambda", "maxBin": "max_bin", "seed": "random_state",
    }

    def _defaults(self) -> None:
        super()._defaults()
        self._setDefault(**{name: getattr(BoostingSpec(), field) for name, field in self._FIELDS.items()})

    def spec(self) -> ModelSpec:
        return ModelSpec("lightgbm", {field: self.getOrDefault(name) for name, field in self._FIELDS.items()})


# -- evaluation -----------------------------------------------------------------------------------


class StrategyEvaluator(Evaluator, _Forecast, DefaultParamsReadable, DefaultParamsWritable):
    """A metric of the pooled strategy report on the positions that the forecasts give; larger is better.

    NaN where the metric is NULL, as for an empty table.
    """

    metricName = _param("metricName", "a column of the strategy report", TypeConverters.toString)
    leverageMin = _param("leverageMin", "least position", TypeConverters.toFloat)
    leverageMax = _param("leverageMax", "greatest position", TypeConverters.toFloat)
    volatilityCap = _param("volatilityCap", "deviation above which Sharpe is penalised", TypeConverters.toFloat)

    def _defaults(self) -> None:
        super()._defaults()
        usual = StrategySpec()
        self._setDefault(
            metricName="competition_sharpe", leverageMin=usual.leverage_min, leverageMax=usual.leverage_max,
            volatilityCap=usual.volatility_cap,
        )

    def _evaluate(self, dataset: DataFrame) -> float:
        panel, value = self.panel(), self.getOrDefault
        strategy = StrategySpec(value("leverageMin"), value("leverageMax"), volatility_cap=value("volatilityCap"))
        sized = position(value("predictionCol"), strategy).alias("position")
        # The pooled scan reads its input twice.
        held = materialize(dataset.select(*panel.order, panel.key, panel.target, sized), "positions")
        found = strategy_report(held, panel, "position", panel.target, strategy).first()[value("metricName")]
        return float("nan") if found is None else float(found)

    def isLargerBetter(self) -> bool:
        return True
