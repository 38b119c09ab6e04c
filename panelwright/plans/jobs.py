"""Train, backtest, batch scoring and walk-forward evaluation."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalars import position
from panelwright.operators.evaluation import rmse, strategy_report
from panelwright.operators.features import FeatureEstimator
from panelwright.operators.models import PREDICTION, TrainedModel, reads_once, train_model, train_models
from panelwright.operators.quality import assert_daily, observed, observed_report
from panelwright.operators.splits import Fold, fold_filter, trailing_window, walk_forward_folds
from panelwright.session import materialize, shared_folder
from panelwright.sources.buckets import write_bucketed
from panelwright.sources.artifacts import Artifacts, load_artifacts, save_artifacts
from panelwright.sources.readers import explode_payloads
from panelwright.sources.writers import read_written, write_metrics, write_panel
from panelwright.spec import (
    FeatureSpec,
    ModelSpec,
    PanelSpec,
    ServingSpec,
    SplitSpec,
    StrategySpec,
    as_panel,
    require_columns,
)


#: Folds whose jobs are submitted at the same time.
FOLDS_AT_ONCE = 4
#: Rows of one bucket of a panel that a job stores for its own windows, on the average.
ROWS_PER_BUCKET = 250_000


def bucketed(df: DataFrame, panel: PanelSpec, buckets: int | None = None) -> DataFrame:
    """A daily panel, read from a table, in buckets in the shared folder: its windows need no exchange, so that
    nothing as wide as the features has to be stored to be read again."""
    spark = df.sparkSession
    if buckets is None:
        buckets = max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_BUCKET))
    return write_bucketed(df, f"{shared_folder(spark)}/panel-{uuid.uuid4().hex}", panel, buckets)


def train(
    df: DataFrame,
    panel: PanelSpec,
    out: str,
    features: FeatureSpec = FeatureSpec(),
    model: ModelSpec = ModelSpec(),
    *,
    bucket: str = "year",
) -> TrainedModel:
    """Feature matrix, fitted artifacts, metrics, feature list and a quality report under ``out``.

    The report comes with the write of the cleaned table, which takes no scan of its own.
    The matrix is written first and training reads it back, so the solver's passes scan a table and
    not the window plan. Of a daily panel it is the one table of that width: the windows read the panel in
    buckets, and with ``bucket="year"`` their tasks write the matrix as they have it, without an exchange.
    """
    spark = df.sparkSession
    require_columns(df, panel.roles)
    if panel.grain == "day":
        assert_daily(df, panel)
    columns = [*([panel.target] if panel.target else []), *panel.feature_columns(df)]
    watched, seen = observed(df, panel, columns)
    write_panel(watched, f"{out}/processed/cleaned_train", panel, bucket=bucket)
    quality = observed_report(spark, seen, columns)
    quality.coalesce(1).write.mode("overwrite").json(f"{out}/artifacts/metadata/quality")
    cleaned = read_written(spark, f"{out}/processed/cleaned_train")
    daily = panel.grain == "day"
    if daily:
        cleaned = bucketed(as_panel(cleaned, panel), panel)
    matrix, fitted = FeatureEstimator(panel, features).fit_transform(cleaned)
    gather = not (daily and bucket == "year")
    write_panel(matrix, f"{out}/processed/feature_matrix", panel, bucket=bucket, gather=gather)
    matrix = read_written(spark, f"{out}/processed/feature_matrix")
    trained = train_model(model, matrix, fitted.fitted_columns, panel.target)
    save_artifacts(spark, f"{out}/artifacts", fitted, trained.pipeline)
    statistics = spark.createDataFrame([((trained.rmse,),)], "training struct<rmse: double>")
    write_metrics(statistics, f"{out}/artifacts/metadata/training_statistics")
    names = spark.createDataFrame([(fitted.fitted_columns,)], "features array<string>")
    write_metrics(names, f"{out}/artifacts/metadata/feature_list")
    return trained


def positions(
    df: DataFrame, artifacts: Artifacts, strategy: StrategySpec, carry: Sequence[str] = ()
) -> DataFrame:
    """Key, date, target, raw prediction and sized position of every row."""
    panel = artifacts.features.panel
    scored = artifacts.predict(artifacts.features.transform(df, carry))
    kept = [*panel.order, panel.key, *([panel.target] if panel.target in df.columns else [])]
    return scored.select(
        *kept, *carry, PREDICTION, position(PREDICTION, strategy).alias("position")
    )


def backtest(
    df: DataFrame,
    artifacts: Artifacts | str,
    strategy: StrategySpec = StrategySpec(),
    *,
    by: str | None = None,
) -> DataFrame:
    """Strategy metrics of a fitted model on a holdout: transform, predict, size, evaluate."""
    if isinstance(artifacts, str):
        artifacts = load_artifacts(df.sparkSession, artifacts)
    panel = artifacts.features.panel
    require_columns(df, panel.roles)
    # The pooled scan reads its input twice; the window and model run once.
    held = positions(df, artifacts, strategy)
    if by is None:
        held = materialize(held, "positions")
    return strategy_report(held, panel, "position", panel.target, strategy, by=by)


def score(
    df: DataFrame, artifacts: Artifacts | str, serving: ServingSpec = ServingSpec()
) -> DataFrame:
    """Predictions with their key and date for the trailing inference window."""
    if isinstance(artifacts, str):
        artifacts = load_artifacts(df.sparkSession, artifacts)
    panel, days = artifacts.features.panel, serving.feature_window_days
    if serving.history == "trimmed":
        processed = artifacts.features.transform(trailing_window(df, panel, days))
    else:
        processed = trailing_window(artifacts.features.transform(df), panel, days)
    return artifacts.predict(processed).select(*panel.order, panel.key, PREDICTION)


def score_payloads(
    df: DataFrame,
    column: str,
    artifacts: Artifacts | str,
    fields: Mapping[str, str] | None = None,
    serving: ServingSpec = ServingSpec(),
) -> DataFrame:
    """Forecasts for JSON records of arrays: rows, dates, trailing window, features, prediction.

    ``fields`` are the element types of the arrays; by default date, key (text) and all base features.
    """
    if isinstance(artifacts, str):
        artifacts = load_artifacts(df.sparkSession, artifacts)
    panel = artifacts.features.panel
    if fields is None:
        measures = {c: "double" for c in artifacts.features.base_features}
        fields = {panel.date: "string", panel.key: "string", **measures}
    rows = explode_payloads(df.select(column), column, fields, dates=[panel.date])
    return score(rows, artifacts, serving)


def walk_forward(
    df: DataFrame,
    panel: PanelSpec,
    split: SplitSpec,
    features: FeatureSpec = FeatureSpec(),
    models: Sequence[ModelSpec] = (ModelSpec(),),
    strategy: StrategySpec = StrategySpec(),
    *,
    buckets: int | None = None,
) -> DataFrame:
    """One row per fold and model: validation error and strategy metrics.

    A daily panel is exchanged once, into a bucketed table in the shared folder (of ``buckets`` buckets, if that is
    given), and the windows of all folds read it as it lies. Their features are not stored unless a model reads
    them more than once.

    The driver loops over folds and models only, like any cross-validator; features are built once per
    fold and shared by its models, and all models of a fold score its rows in one pass, so a parameter
    search costs solver passes, not window shuffles. All curves are one scan, told apart by fold and model.
    """
    panel = dataclasses.replace(panel, features=tuple(panel.feature_columns(df)))
    clean = as_panel(df, panel)
    if buckets is None:
        clean = materialize(clean, "panel")
    if panel.grain == "day" or buckets:
        clean = bucketed(clean, panel, buckets)
        assert_daily(clean, panel)
    one_scan = all(reads_once(spec) for spec in models)
    runs, kept = ["fold_id", "model_id"], [*panel.order, panel.key, panel.target]

    def one(fold: Fold) -> tuple[list[tuple], DataFrame]:
        """Facts about the fold's models, and its validation rows scored and sized by each."""
        matrix, valid, names = _fold_matrices(clean, panel, fold, features, one_scan)
        guesses, facts = [], []
        for i, (spec, trained) in enumerate(zip(models, train_models(models, matrix, names, panel.target))):
            valid = trained.predict(valid).withColumnRenamed(PREDICTION, f"{PREDICTION}_{i}")
            guesses.append(F.struct(F.lit(i).cast("long").alias("model_id"), F.col(f"{PREDICTION}_{i}").alias(PREDICTION)))
            numbers = [spec.params.get(k) for k in ("alpha", "l1_ratio")]
            facts.append((fold.fold_id, i, spec.type, *(None if x is None else float(x) for x in numbers), trained.rmse))
        # Stored with a column for each model, of which only the readers make rows.
        wide = materialize(valid.select(*kept, *[f"{PREDICTION}_{i}" for i in range(len(models))]), "scored")
        each = wide.select(F.lit(fold.fold_id).cast("long").alias("fold_id"), *kept, F.inline(F.array(*guesses)))
        return facts, each.select("*", position(PREDICTION, strategy).alias("position"))

    # The jobs of several folds run side by side; each waits for its own only.
    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
        done = list(pool.map(one, walk_forward_folds(clean, panel, split)))
    scored, fitted = done[0][1], [f for facts, _ in done for f in facts]
    for _, part in done[1:]:
        scored = scored.unionByName(part)
    report = strategy_report(scored, panel, "position", panel.target, strategy, runs=runs)
    errors = rmse(scored, panel.target, PREDICTION, runs).withColumnRenamed("rmse", "valid_rmse")
    # A row for each fold and model.
    known = df.sparkSession.createDataFrame(
        fitted, "fold_id long, model_id long, model string, alpha double, l1_ratio double, train_rmse double"
    )
    whole = report.join(errors, runs).join(F.broadcast(known), runs)
    return whole.select(*known.columns, "valid_rmse", *[c for c in report.columns if c not in runs])


def _fold_matrices(clean: DataFrame, panel: PanelSpec, fold: Fold, features: FeatureSpec, one_scan: bool):
    train_rows = fold_filter(clean, panel, fold, "train")
    matrix, fitted = FeatureEstimator(panel, features).fit_transform(train_rows)
    valid = fitted.transform(fold_filter(clean, panel, fold, "valid"))
    if not one_scan:
        matrix = materialize(matrix, "train")
    return matrix, valid, fitted.fitted_columns


def search(
    df: DataFrame,
    panel: PanelSpec,
    split: SplitSpec,
    alphas: Sequence[float],
    l1_ratios: Sequence[float],
    features: FeatureSpec = FeatureSpec(),
    strategy: StrategySpec = StrategySpec(),
) -> DataFrame:
    """Elastic-net grid scored by the mean validation Sharpe over all folds, best first."""
    grid = [
        ModelSpec("elastic_net", {"alpha": a, "l1_ratio": r}) for a in alphas for r in l1_ratios
    ]
    folds = walk_forward(df, panel, split, features, grid, strategy)
    return (
        folds.groupBy("alpha", "l1_ratio")
        .agg(
            F.avg("competition_sharpe").alias("mean_sharpe"),
            F.avg("valid_rmse").alias("mean_rmse"),
            F.count(F.lit(1)).alias("n_folds"),
        )
        .orderBy(F.desc_nulls_last("mean_sharpe"), "alpha", "l1_ratio")
    )
