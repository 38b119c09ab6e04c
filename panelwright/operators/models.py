"""Forecast models: elastic net from one scan of moments (or Spark's solver), gradient-boosted trees."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import nullcontext
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.partials import gathered, on_doubles
from panelwright.functions.quantiles import Summary, long_form, summarize
from panelwright.operators.boosting import PREDICTION, BoostedFit, BoostingSpec, boost, predict_boosted
from panelwright.operators.features import CONSTANT_SPREAD
from panelwright.session import small_splits
from panelwright.spec import ModelSpec

RAW, SCALED = "_raw_features", "_features"

#: Iteration cap of the elastic net (fixed value).
MAX_ITERATIONS = 5000
#: Bytes of stored features a task of Spark's trees reads: it keeps a row in memory, at about five times its stored size.
TREE_SPLIT_BYTES = 32 << 20


@dataclass(frozen=True)
class LinearFit:
    """A linear model: weights per unit of the raw feature, and what each feature was divided by."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    spreads: tuple[float, ...]
    intercept: float


@dataclass(frozen=True)
class Moments:
    """Means, spreads and the covariances of the features, each divided by its spread, and the target.

    The last row and column belong to the target, which is not divided.
    """

    features: tuple[str, ...]
    means: np.ndarray
    spreads: np.ndarray
    covariances: np.ndarray


@dataclass(frozen=True)
class TrainedModel:
    pipeline: PipelineModel | LinearFit | BoostedFit
    features: tuple[str, ...]
    rmse: float

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with a ``prediction`` column."""
        return predict(self.pipeline, df)


def linear_weights(fitted: PipelineModel | LinearFit | BoostedFit) -> tuple[dict[str, float], float] | None:
    """Weights per raw feature and the intercept of a fitted elastic net; None for other models."""
    if isinstance(fitted, LinearFit):
        return dict(zip(fitted.features, fitted.weights)), fitted.intercept
    if isinstance(fitted, BoostedFit):
        return None
    last = fitted.stages[-1]
    if not isinstance(last, LinearRegressionModel):
        return None
    assembler, scaler = fitted.stages[0], fitted.stages[1]
    scaled = [float(w * s) for w, s in zip(last.coefficients, scaler.getScalingVec())]
    return dict(zip(assembler.getInputCols(), scaled)), float(last.intercept)


def _total(terms: list[Column]) -> Column:
    """A balanced sum: its depth grows with the logarithm of the number of terms."""
    while len(terms) > 1:
        pairs = [a + b for a, b in zip(terms[::2], terms[1::2])]
        terms = pairs + (terms[-1:] if len(terms) % 2 else [])
    return terms[0]


def predict(fitted: PipelineModel | LinearFit | BoostedFit, df: DataFrame) -> DataFrame:
    """Add ``prediction``.

    A linear model is one expression over the features it uses: no vectors, and what feeds only
    features of weight zero is pruned from the plan, windows included.
    """
    if isinstance(fitted, BoostedFit):
        return predict_boosted(fitted, df)
    linear = linear_weights(fitted)
    if linear is None:
        return fitted.transform(df).select(*df.columns, PREDICTION)
    weights, intercept = linear
    used = [F.lit(w) * F.col(name) for name, w in weights.items() if w != 0.0]
    return df.select("*", _total([F.lit(intercept), *used]).alias(PREDICTION))


@dataclass(frozen=True)
class MomentSums:
    """Number of rows, means and centred products of columns: sums that merge, over tasks or over folds."""

    n: int
    means: np.ndarray
    #: Some rows of the matrix of centred products, from ``first`` on.
    products: np.ndarray
    first: int
    #: Values of each column that are NULL, NaN or infinite.
    bad: np.ndarray

    def merge(self, other: MomentSums) -> MomentSums:
        """Both together, by the pairwise update of centred products."""
        n = self.n + other.n
        if not self.n or not other.n:
            kept = self if self.n else other
            return MomentSums(n, kept.means, kept.products, self.first, self.bad + other.bad)
        gap = other.means - self.means
        own = gap[self.first : self.first + len(self.products)]
        products = self.products + other.products + np.outer(own, gap) * (self.n / n * other.n)
        return MomentSums(n, self.means + gap * (other.n / n), products, self.first, self.bad + other.bad)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.first, len(self.means), *self.bad], np.int64)
        return head.tobytes() + self.means.tobytes() + self.products.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> MomentSums:
        n, first, width = np.frombuffer(data, np.int64, 3).tolist()
        bad = np.frombuffer(data, np.int64, width, 24)
        floats = np.frombuffer(data, np.float64, offset=24 + 8 * width)
        return cls(n, floats[:width], floats[width:].reshape(-1, width), first, bad)


def _merge_moments(payloads: list[bytes]) -> bytes:
    """Neighbours two by two, so that rounding grows with the logarithm of their number."""
    sums = [MomentSums.from_bytes(x) for x in payloads]
    while len(sums) > 1:
        pairs = [a.merge(b) for a, b in zip(sums[::2], sums[1::2])]
        sums = pairs + (sums[-1:] if len(sums) % 2 else [])
    return sums[0].to_bytes()


#: Bytes of the matrix in one payload; wider matrices are merged in blocks of rows.
BLOCK_BYTES = 1 << 20


def moment_sums(df: DataFrame, columns: Sequence[str]) -> MomentSums:
    """One scan. What is shuffled and returned is bounded by the width, and no task merges more than
    ``FAN_IN`` partial sums."""
    width = len(columns)
    height = max(1, min(width, BLOCK_BYTES // (8 * width)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        total = MomentSums(0, np.zeros(width), np.zeros((width, width)), 0, np.zeros(width, np.int64))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            bad = ~np.isfinite(x)
            x = x[~bad.any(axis=1)]
            means = x.mean(axis=0) if len(x) else np.zeros(width)
            centred = x - means
            total = total.merge(MomentSums(len(x), means, centred.T @ centred, 0, bad.sum(axis=0)))
        for first in range(0, width, height):
            part = MomentSums(total.n, total.means, total.products[first : first + height], first, total.bad)
            yield first, part.to_bytes()

    found = gathered(on_doubles(df, columns, build), _merge_moments)
    if not found:
        return MomentSums(0, np.zeros(width), np.zeros((width, width)), 0, np.zeros(width, np.int64))
    parts = [MomentSums.from_bytes(x) for _, x in sorted(found.items())]
    return MomentSums(parts[0].n, parts[0].means, np.concatenate([p.products for p in parts]), 0, parts[0].bad)


def moments_of(sums: MomentSums, features: Sequence[str], target: str) -> Moments:
    columns = [*features, target]
    if sums.bad.any():
        bad = [c for c, n in zip(columns, sums.bad) if n]
        raise ValueError(f"Training columns hold NULL or infinite values: {bad}")
    n = max(sums.n, 1)
    deviations = np.sqrt(np.diag(sums.products) / n)
    constant = deviations <= CONSTANT_SPREAD * np.maximum(1.0, np.abs(sums.means))
    spreads = np.where(constant, 1.0, deviations)
    spreads[-1] = 1.0
    return Moments(tuple(features), sums.means, spreads, sums.products / n / np.outer(spreads, spreads))


def moments(df: DataFrame, features: Sequence[str], target: str) -> Moments:
    return moments_of(moment_sums(df, [*features, target]), features, target)


def _spread(summary: Summary) -> float:
    """The population deviation, 1 for a constant column."""
    mean, std = summary.mean or 0.0, (summary.variance or 0.0) ** 0.5
    return 1.0 if std <= CONSTANT_SPREAD * max(1.0, abs(mean)) else std


def coordinate_descent(
    m: Moments, alpha: float, l1_ratio: float, sweeps: int = MAX_ITERATIONS, tol: float = 1e-12
) -> tuple[LinearFit, float]:
    """The elastic net of the moments and its in-sample error.

    Minimises ``|y - Xw|^2 / 2n + alpha l1 |w|_1 + alpha (1 - l1) / 2 |w|^2`` for columns divided by
    their population deviation without centring, with a free intercept.
    """
    return elastic_net_path(m, [alpha], l1_ratio, sweeps, tol)[0]


def elastic_net_path(
    m: Moments, alphas: Sequence[float], l1_ratio: float, sweeps: int = MAX_ITERATIONS, tol: float = 1e-12
) -> list[tuple[LinearFit, float]]:
    """The elastic nets of several penalties, in the order given.

    They are solved from the greatest penalty down, each from the weights of the one before. Between full
    sweeps only the features with a weight (the active set) are swept; a full sweep that moves no weight
    ends the search.
    """
    p = len(m.features)
    g, c = m.covariances[:p, :p], m.covariances[:p, p]
    w, slope = np.zeros(p), c.copy()  # slope = c - g w

    def sweep(places: Sequence[int], a1: float, a2: float) -> float:
        moved = 0.0
        for j in places:
            if g[j, j] == 0.0:
                continue
            rho = slope[j] + g[j, j] * w[j]
            step = math.copysign(max(abs(rho) - a1, 0.0), rho) / (g[j, j] + a2) - w[j]
            if step:
                slope[:] -= g[:, j] * step
                w[j] += step
                moved = max(moved, abs(step))
        return moved

    found: dict[float, tuple[LinearFit, float]] = {}
    for alpha in sorted(set(alphas), reverse=True):
        a1, a2, left = alpha * l1_ratio, alpha * (1.0 - l1_ratio), sweeps
        still = lambda moved: moved <= tol * max(1.0, float(np.abs(w).max(initial=0.0)))
        while left > 0:
            left -= 1
            if still(sweep(range(p), a1, a2)):
                break
            active = np.flatnonzero(w).tolist()
            while left > 0:
                left -= 1
                if still(sweep(active, a1, a2)):
                    break
        found[alpha] = _linear_fit(m, w)
    return [found[a] for a in alphas]


def _linear_fit(m: Moments, w: np.ndarray) -> tuple[LinearFit, float]:
    p = len(m.features)
    g, c, spread = m.covariances[:p, :p], m.covariances[:p, p], m.covariances[p, p]
    raw = w / m.spreads[:p]
    fit = LinearFit(m.features, tuple(map(float, raw)), tuple(map(float, m.spreads[:p])), float(m.means[p] - raw @ m.means[:p]))
    return fit, math.sqrt(max(0.0, float(spread - 2 * w @ c + w @ g @ w)))


def reads_once(spec: ModelSpec) -> bool:
    """Whether :func:`train_models` fits the model in the one scan of the moments."""
    return spec.type.lower() == "elastic_net" and _solver(spec) == "moments"


def train_models(
    specs: Sequence[ModelSpec], df: DataFrame, features: Sequence[str], target: str
) -> list[TrainedModel]:
    """Fit several models on the same rows; all elastic nets share the scan of the data, and those that
    differ in the penalty alone are one regularisation path."""
    paths: dict[tuple, list[int]] = {}
    found: list[TrainedModel | None] = [None] * len(specs)
    for i, spec in enumerate(specs):
        if reads_once(spec):
            p = spec.params
            key = (float(p.get("l1_ratio", 0.5)), int(p.get("max_iter", MAX_ITERATIONS)), float(p.get("tol", 1e-12)))
            paths.setdefault(key, []).append(i)
        else:
            found[i] = train_model(spec, df, features, target)
    if paths:
        shared = moments(df, features, target)
        for (l1_ratio, sweeps, tol), places in paths.items():
            alphas = [float(specs[i].params.get("alpha", 0.5)) for i in places]
            for i, (fit, rmse) in zip(places, elastic_net_path(shared, alphas, l1_ratio, sweeps, tol)):
                found[i] = TrainedModel(fit, tuple(features), rmse)
    return found


def train_model(
    spec: ModelSpec, df: DataFrame, features: Sequence[str], target: str
) -> TrainedModel:
    """Fit on the rows of ``df`` and report the in-sample error."""
    if reads_once(spec):
        return train_models([spec], df, features, target)[0]
    if spec.type.lower() in BOOSTED:
        _known(spec, BOOSTED_PARAMS)
        fit, rmse = boost(df, features, target, BoostingSpec(**{"random_state": spec.seed, **spec.params}))
        return TrainedModel(fit, tuple(features), rmse)
    features = list(features)
    rows = df.select(target, *features)
    split = small_splits(df.sparkSession, TREE_SPLIT_BYTES) if spec.type.lower() == "gbt" else nullcontext()
    with split:
        pipeline = build_model(spec, rows, features, target).fit(rows)
    error = F.col(target) - F.col(PREDICTION)
    rmse = predict(pipeline, rows).agg(F.sqrt(F.avg(error * error))).first()[0]
    return TrainedModel(pipeline, tuple(features), rmse)


def build_model(
    spec: ModelSpec, df: DataFrame, features: Sequence[str], target: str
) -> Estimator:
    """An unfitted pipeline. The elastic net reads the feature scales and the target spread first."""
    kind = spec.type.lower()
    if kind == "elastic_net":
        return _elastic_net(spec, df, list(features), target)
    if kind == "gbt":
        return _boosted_trees(spec, list(features), target)
    raise ValueError(f"No pipeline is called {spec.type!r}; there are elastic_net, gbt and, for train_model, lightgbm")


#: Elastic-net parameters; the solver is ``moments`` (covariances, then coordinate descent) or
#: ``l-bfgs`` (Spark's, one pass over the data for each iteration, memory linear in the width).
ELASTIC_NET_PARAMS = ("alpha", "l1_ratio", "max_iter", "tol", "solver")
#: Names of the histogram trees, and their parameters.
BOOSTED = ("lightgbm", "lgbm")
BOOSTED_PARAMS = tuple(f.name for f in fields(BoostingSpec))
#: Boosting parameters that Spark's trees know, under their usual names.
BOOSTING_PARAMS = (
    "max_depth", "n_estimators", "learning_rate", "min_child_samples", "subsample", "colsample_bytree", "random_state",
)


def _known(spec: ModelSpec, names: Sequence[str]) -> None:
    unknown = sorted(set(spec.params) - set(names))
    if unknown:
        raise ValueError(f"{spec.type} does not know the parameters {unknown}; it has {sorted(names)}")


def _solver(spec: ModelSpec) -> str:
    _known(spec, ELASTIC_NET_PARAMS)
    solver = spec.params.get("solver", "moments")
    if solver not in ("moments", "l-bfgs"):
        raise ValueError(f"solver must be moments or l-bfgs, not {solver!r}")
    return solver


def _elastic_net(
    spec: ModelSpec, df: DataFrame, features: list[str], target: str
) -> Pipeline:
    """Elastic net with ``|y - Xw|^2 / 2n + alpha l1 |w|_1 + alpha (1 - l1) / 2 |w|^2``.

    Columns are divided by their population deviation without centring. Spark scales the label by its
    sample deviation inside, which would divide the L2 term by it, so the penalty is restated.
    """
    alpha = float(spec.params.get("alpha", 0.5))
    l1_ratio = float(spec.params.get("l1_ratio", 0.5))
    summaries = summarize(df, [*features, target], moments=True)
    inverse = [1.0 / _spread(summaries[c]) for c in features]
    y = summaries[target]
    spread = ((y.variance or 0.0) * y.values / max(1, y.values - 1)) ** 0.5
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio) * (spread or 1.0)
    total = l1 + l2
    regression = LinearRegression(
        featuresCol=SCALED,
        labelCol=target,
        predictionCol=PREDICTION,
        regParam=total,
        elasticNetParam=l1 / total if total > 0.0 else 0.0,
        standardization=False,
        fitIntercept=True,
        solver="l-bfgs",
        maxIter=int(spec.params.get("max_iter", MAX_ITERATIONS)),
        tol=float(spec.params.get("tol", 1e-10)),
    )
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol=RAW, handleInvalid="error"),
            ElementwiseProduct(
                scalingVec=Vectors.dense(inverse), inputCol=RAW, outputCol=SCALED
            ),
            regression,
        ]
    )


def _boosted_trees(spec: ModelSpec, features: list[str], target: str) -> Pipeline:
    """Gradient-boosted trees; parameter names follow the usual boosting libraries.

    Spark has no unlimited depth and no leaf limit, L1 or L2 term: such parameters are refused.
    """
    _known(spec, BOOSTING_PARAMS)
    p = spec.params
    depth = int(p.get("max_depth", 5))
    if not 0 <= depth <= 30:
        raise ValueError(f"max_depth must be between 0 and 30, not {depth}")
    share = float(p.get("colsample_bytree", 1.0))
    trees = GBTRegressor(
        featuresCol=RAW,
        labelCol=target,
        predictionCol=PREDICTION,
        maxIter=int(p.get("n_estimators", 100)),
        stepSize=float(p.get("learning_rate", 0.1)),
        maxDepth=depth,
        minInstancesPerNode=int(p.get("min_child_samples", 20)),
        subsamplingRate=float(p.get("subsample", 1.0)),
        featureSubsetStrategy="all" if share >= 1.0 else str(share),
        seed=int(p.get("random_state", spec.seed)),
        checkpointInterval=10,
    )
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol=RAW, handleInvalid="error"),
            trees,
        ]
    )


def feature_weights(spark: SparkSession, model: TrainedModel) -> DataFrame:
    """Coefficients (per unit of the raw feature) with the intercept last, or importances."""
    linear = linear_weights(model.pipeline)
    if linear is not None:
        weights, intercept = linear
        rows = [*weights.items(), ("(intercept)", intercept)]
    elif isinstance(model.pipeline, BoostedFit):
        rows = list(model.pipeline.importances().items())
    else:
        importances = model.pipeline.stages[-1].featureImportances
        rows = [(n, float(w)) for n, w in zip(model.features, importances)]
    return spark.createDataFrame(rows, "feature string, weight double")


def optimality_gaps(
    df: DataFrame, model: TrainedModel, target: str, alpha: float, l1_ratio: float
) -> DataFrame:
    """Per feature, how far the fitted elastic net is from satisfying its optimality conditions.

    For scaled column x: ``|x'r/n - a2 w| <= a1`` and equality with sign(w) where w is not 0.
    """
    if isinstance(model.pipeline, LinearFit):
        scales = [1.0 / s for s in model.pipeline.spreads]
    else:
        scales = [float(s) for s in model.pipeline.stages[-2].getScalingVec()]
    raw, _ = linear_weights(model.pipeline)
    scaled = [raw[c] / s for c, s in zip(model.features, scales)]
    a1, a2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    scored = model.predict(df.select(target, *model.features))
    residual = F.col(target) - F.col(PREDICTION)
    slopes = [
        F.col(c) * F.lit(s) * residual for c, s in zip(model.features, scales)
    ]
    averaged = long_form(scored, slopes).groupBy("_id").agg(F.avg("_value").alias("slope"))
    found = {r["_id"]: r["slope"] for r in averaged.collect()}
    rows = []
    for i, (name, w) in enumerate(zip(model.features, scaled)):
        slope = found[i] - a2 * w
        gap = max(0.0, abs(slope) - a1) if w == 0.0 else abs(slope - math.copysign(a1, w))
        rows.append((name, float(w), float(gap)))
    return df.sparkSession.createDataFrame(rows, "feature string, weight double, gap double")
