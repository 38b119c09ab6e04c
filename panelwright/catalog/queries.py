"""Registered queries: each reads the given tables whole and returns a DataFrame.

Computed doubles are rounded to fewer digits than summation order can change; see :func:`rounded`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.catalog.panels import (
    EVENT_TYPE,
    EVENTS,
    PRIORITY,
    SUPPLIER,
    event_type_daily,
    events_by_type,
    events_raw,
    priority_daily,
    supplier_daily,
    table,
)
from panelwright.functions.scalars import position
from panelwright.functions.sketches import column_sketches
from panelwright.operators import evaluation as ev
from panelwright.operators import features as ft
from panelwright.operators import indicators as ind
from panelwright.operators import models as md
from panelwright.operators import quality as dq
from panelwright.operators import recurrences as rec
from panelwright.operators import splits as sp
from panelwright.plans import jobs
from panelwright.plans.stages import PanelElasticNet, PanelFeatures
from panelwright.session import materialize, shared_folder
from panelwright.sources.artifacts import load_artifacts
from panelwright.sources.readers import explode_payloads, load_panel
from panelwright.sources.writers import read_written, write_metrics, write_panel
from panelwright.spec import FeatureSpec, ModelSpec, PanelSpec, ServingSpec, SplitSpec, StrategySpec, as_panel
from panelwright.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]

BASE = list(SUPPLIER.features)
HOLDOUT_FROM = "2000-01-01 00:00:00"
SPLIT = SplitSpec(n_splits=5, test_size=100, gap=5)
STRATEGY = StrategySpec()
#: Small enough to cut every event type into blocks at the smallest scale.
SMALL_BLOCK = 100


#: Columns of rates, far below 1, which are compared with eight digits.
SMALL_COLUMNS = ("tax", "excess_return")


#: Numbers of units up to which a value is rounded by arithmetic.
UNITS = 1e11


def rounded(df: DataFrame, digits: int = 4, **per_column: int) -> DataFrame:
    """Round every DOUBLE column.

    Averages of cents often end in an exact 5; the small shift moves those off the rounding boundary,
    where the order of a sum would decide. Adding 0.0 turns -0.0 into 0.0.
    """

    def to(name: str):
        d = per_column.get(name, max(digits, 8) if name.startswith(SMALL_COLUMNS) else digits)
        shifted = F.col(name) + F.lit(10.0 ** -(d + 4))
        # Units below this are exact in a double; only greater values need Spark's decimal numbers.
        units = shifted * F.lit(10.0**d)
        whole = F.rint(units) / F.lit(10.0**d)
        return (F.when(F.abs(units) < UNITS, whole).otherwise(F.round(shifted, d)) + F.lit(0.0)).alias(name)

    return df.select(
        *[
            to(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _supplier(spark: SparkSession, sf: str) -> DataFrame:
    return as_panel(supplier_daily(spark, sf), SUPPLIER)


def _supplier_table(spark: SparkSession, sf: str) -> DataFrame:
    """The panel as a table, for operators that fit before they transform and so read it again."""
    return materialize(_supplier(spark, sf), "panel")


# -- projection and winsorising -------------------------------------------------------------------


def panel_project(spark, sf):
    return rounded(_supplier(spark, sf))


def winsorize_bounds(spark, sf):
    bounds = ft.winsor_bounds(_supplier_table(spark, sf), [*BASE, SUPPLIER.target])
    rows = [(c, low, high) for c, (low, high) in bounds.items()]
    return rounded(spark.createDataFrame(rows, "feature string, lower double, upper double"))


def winsorize_panel(spark, sf):
    panel = _supplier_table(spark, sf)
    return rounded(ft.winsorize(panel, ft.winsor_bounds(panel, [*BASE, SUPPLIER.target])))


# -- lags, rolling statistics ---------------------------------------------------------------------


def lag_features(spark, sf):
    return rounded(ft.add_lags(_supplier(spark, sf), SUPPLIER, BASE, FeatureSpec()))


def rolling_stats(spark, sf):
    return rounded(ft.add_rolling(_supplier(spark, sf), SUPPLIER, BASE, FeatureSpec()), 3)


def event_history(spark, sf):
    return rounded(ft.add_history(events_raw(spark, sf), EVENTS, ["value"], FeatureSpec()))


def event_history_hot_keys(spark, sf):
    """Five keys hold everything, so each is cut into blocks with a halo."""
    features = FeatureSpec(rows_per_block=SMALL_BLOCK)
    return rounded(ft.add_history(events_by_type(spark, sf), EVENTS, ["value"], features))


# -- impute and scale -----------------------------------------------------------------------------


def _impute(strategy: str) -> Query:
    def query(spark, sf):
        panel = _supplier_table(spark, sf)
        statistics = ft.fit_columns(panel, BASE, FeatureSpec(imputation=strategy))
        return rounded(ft.apply_columns(panel, statistics, scaled=False))

    return query


def standard_scale(spark, sf):
    panel = _supplier_table(spark, sf)
    statistics = ft.fit_columns(panel, BASE, FeatureSpec(imputation="mean"))
    return rounded(ft.apply_columns(panel, statistics))


def feature_matrix(spark, sf):
    matrix, _ = ft.FeatureEstimator(SUPPLIER).fit_transform(_supplier_table(spark, sf))
    return rounded(matrix)


def feature_matrix_from_schema(spark, sf):
    """No feature is named: all numeric columns without a role are features, in the order of the schema."""
    panel = supplier_daily(spark, sf).drop("forecast")
    matrix, _ = ft.FeatureEstimator(PanelSpec(target=SUPPLIER.target)).fit_transform(panel)
    return rounded(matrix)


def feature_statistics(spark, sf):
    model = ft.FeatureEstimator(SUPPLIER).fit(_supplier_table(spark, sf))
    return rounded(model.statistics_table(spark).select("*", F.col("ord").cast("long").alias("position")).drop("ord"))


def _history_and_holdout(spark, sf) -> tuple[DataFrame, DataFrame]:
    panel = _supplier_table(spark, sf)
    at = sp.date_literal(panel, SUPPLIER, HOLDOUT_FROM)
    return panel.where(F.col("date") < at), panel.where(F.col("date") >= at)


def feature_transform_holdout(spark, sf):
    history, holdout = _history_and_holdout(spark, sf)
    return rounded(ft.FeatureEstimator(SUPPLIER).fit(history).transform(holdout))


def feature_transform_fitted_bounds(spark, sf):
    history, holdout = _history_and_holdout(spark, sf)
    spec = FeatureSpec(bounds="fitted", imputation="mean")
    return rounded(ft.FeatureEstimator(SUPPLIER, spec).fit(history).transform(holdout))


def min_max_scale(spark, sf):
    panel = _supplier_table(spark, sf)
    return rounded(dq.min_max_scale(panel, BASE))


def forward_fill(spark, sf):
    return rounded(rec.forward_fill(_supplier(spark, sf), SUPPLIER, ["tax"]))


# -- windows of time and folds --------------------------------------------------------------------


def trailing_window(spark, sf):
    return sp.trailing_window(events_raw(spark, sf), EVENTS, 21)


def walk_forward_bounds(spark, sf):
    panel = priority_daily(spark, sf)
    folds = sp.walk_forward_folds(panel, PRIORITY, SPLIT)
    return sp.folds_table(panel, PRIORITY, folds)


def walk_forward_bounds_instants(spark, sf):
    panel = events_raw(spark, sf)
    folds = sp.walk_forward_folds(panel, EVENTS, SplitSpec(n_splits=3, test_size=150, gap=10))
    return sp.folds_table(panel, EVENTS, folds)


def walk_forward_assign(spark, sf):
    panel = priority_daily(spark, sf)
    folds = sp.walk_forward_folds(panel, PRIORITY, SPLIT)
    return sp.assign_folds(panel.select("symbol", "date"), PRIORITY, folds)


# -- positions and evaluation ---------------------------------------------------------------------


def _sized(spark, sf) -> DataFrame:
    return supplier_daily(spark, sf).select(
        "symbol", "date", "excess_return", position("forecast", STRATEGY).alias("position")
    )


def _flows(spark, sf) -> DataFrame:
    return _sized(spark, sf).select(
        "symbol", "date", ev.pnl("position", "excess_return").alias("pnl")
    )


def clip_positions(spark, sf):
    return rounded(_sized(spark, sf))


def turnover_positions(spark, sf):
    held = position("forecast", STRATEGY, previous=0.5)
    return rounded(supplier_daily(spark, sf).select("symbol", "date", held.alias("position")))


def turnover_from_previous(spark, sf):
    """The previous position is a column: the target position one row before."""
    panel = _sized(spark, sf)
    lagged = ind.over_keys(
        panel, SUPPLIER, 1, lambda d, w: d.select("*", w.lag("position").alias("previous"))
    )
    held = F.coalesce("previous", F.lit(0.0))
    return rounded(
        lagged.select("symbol", "date", position("position", STRATEGY, held).alias("position"))
    )


def equity_curve_pooled(spark, sf):
    flows = materialize(_flows(spark, sf), "flows")
    curve = ev.equity_curve(flows, SUPPLIER, "pnl")
    return rounded(curve.select("symbol", "date", "equity", "peak"), 6)


def equity_curve_by_symbol(spark, sf):
    curve = ev.equity_curve(_flows(spark, sf), SUPPLIER, "pnl", by="symbol")
    return rounded(curve.select("symbol", "date", "equity", "peak"), 6)


def equity_curve_hot_keys(spark, sf):
    """Running sum of event values per type, over blocks of each type."""
    events = events_by_type(spark, sf).select("symbol", "date", "event_id", "value")
    curve = ev.equity_curve(events, EVENTS, "value", by="symbol", rows_per_block=SMALL_BLOCK)
    return rounded(curve.select("event_id", "equity", "peak"), 2)


def drawdown_curve(spark, sf):
    curve = ev.equity_curve(_flows(spark, sf), SUPPLIER, "pnl", by="symbol")
    return rounded(curve.select("symbol", "date", "drawdown"))


def sharpe_by_symbol(spark, sf):
    return rounded(ev.penalised_sharpe(_flows(spark, sf), "pnl", by="symbol"), 6)


def sharpe_pooled(spark, sf):
    return rounded(ev.penalised_sharpe(_flows(spark, sf), "pnl"), 6)


def hit_rate(spark, sf):
    return rounded(ev.hit_rate(_flows(spark, sf), "pnl", by="symbol"), 6)


def strategy_report(spark, sf):
    sized = materialize(_sized(spark, sf), "sized")
    return rounded(
        ev.strategy_report(sized, SUPPLIER, "position", "excess_return", STRATEGY)
    )


def strategy_report_by_symbol(spark, sf):
    return rounded(
        ev.strategy_report(
            _sized(spark, sf), SUPPLIER, "position", "excess_return", STRATEGY, by="symbol"
        )
    )


def rmse_mean_model(spark, sf):
    panel = supplier_daily(spark, sf).select("excess_return")
    mean = panel.agg(F.avg("excess_return").alias("prediction"))
    return rounded(
        ev.rmse(panel.crossJoin(F.broadcast(mean)), "excess_return", "prediction"), 8
    )


def tail_risk(spark, sf):
    return rounded(dq.tail_risk(_flows(spark, sf), "pnl"), 6)


# -- indicators -----------------------------------------------------------------------------------


def _prices(spark, sf) -> DataFrame:
    return priority_daily(spark, sf).select("symbol", "date", "close")


def first_difference(spark, sf):
    return rounded(ind.first_difference(_prices(spark, sf), PRIORITY, "close"))


def sma(spark, sf):
    return rounded(ind.simple_moving_average(_prices(spark, sf), PRIORITY, "close"), 3)


def sma_long(spark, sf):
    windows = (5, 10, 21, 63, 126, 252)
    return rounded(ind.simple_moving_average(_prices(spark, sf), PRIORITY, "close", windows), 3)


def volume_averages(spark, sf):
    panel = priority_daily(spark, sf).select("symbol", "date", "volume")
    return rounded(
        ind.simple_moving_average(panel, PRIORITY, "volume", (5, 21), prefix="volume_ma"), 5
    )


def bollinger(spark, sf):
    return rounded(ind.bollinger_bands(_prices(spark, sf), PRIORITY, "close"), 3)


def rsi(spark, sf):
    return rounded(ind.rsi(_prices(spark, sf), PRIORITY, "close"))


def rsi_many(spark, sf):
    return rounded(ind.rsi(_prices(spark, sf), PRIORITY, "close", (14, 21)))


def technical_indicators(spark, sf):
    return rounded(ind.technical_indicators(_prices(spark, sf), PRIORITY), 3)


def event_indicators(spark, sf):
    """The same indicators over the daily closing value of each event type."""
    panel = event_type_daily(spark, sf).select("symbol", "date", "close")
    return rounded(ind.technical_indicators(panel, EVENT_TYPE), 3)


def pct_change(spark, sf):
    return rounded(ind.percent_change(_prices(spark, sf), PRIORITY, "close"))


def volatility(spark, sf):
    return rounded(ind.volatility(_prices(spark, sf), PRIORITY, "close"))


def compound_return(spark, sf):
    panel = _supplier(spark, sf).select("symbol", "date", "excess_return")
    return rounded(ind.compound_return(panel, SUPPLIER, "excess_return", 21))


def rolling_sharpe(spark, sf):
    panel = _supplier(spark, sf).select("symbol", "date", "excess_return")
    return rounded(ind.rolling_sharpe(panel, SUPPLIER, "excess_return", 21))


def macd(spark, sf):
    return rounded(rec.macd(_prices(spark, sf), PRIORITY), 3)


def macd_gaps(spark, sf):
    """MACD of a column with NULLs: rows without a value repeat the row before."""
    return rounded(rec.macd(_supplier(spark, sf).select("symbol", "date", "tax"), SUPPLIER, "tax"), 8)


def time_features(spark, sf):
    return ind.time_features(priority_daily(spark, sf).select("symbol", "date"), PRIORITY)


# -- quality and profile --------------------------------------------------------------------------


def dq_duplicates(spark, sf):
    """Supplier and ship date do not identify a line item."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("date")
    )
    return dq.duplicate_keys(lines, SUPPLIER)


def dq_gaps(spark, sf):
    return dq.date_gaps(_supplier(spark, sf), SUPPLIER, min_days=7)


def dq_nulls(spark, sf):
    return dq.null_counts(_supplier(spark, sf), [*BASE, SUPPLIER.target])


def dq_observed(spark, sf):
    """The counts of a quality report that come with the write of a panel, without a scan of their own."""
    columns = [*BASE, SUPPLIER.target]
    watched, seen = dq.observed(_supplier(spark, sf), SUPPLIER, columns)
    write_panel(watched, _scratch(spark, "watched"), SUPPLIER)
    return dq.observed_report(spark, seen, columns)


def dq_types(spark, sf):
    """Columns whose type is not the expected one, and columns that are not there."""
    expected = T.StructType.fromDDL("date timestamp_ntz, symbol string, close double, volume int, open double")
    found = dq.type_mismatches(priority_daily(spark, sf), expected)
    return spark.createDataFrame(found, "column_name string, expected string, actual string")


def dq_outliers(spark, sf):
    return dq.outlier_counts(_supplier_table(spark, sf), BASE)


def profile(spark, sf):
    return rounded(dq.profile(_supplier_table(spark, sf), BASE))


def autocorr(spark, sf):
    return rounded(dq.autocorrelation(_prices(spark, sf), PRIORITY, "close"))


def drift(spark, sf):
    return rounded(dq.drift(_supplier(spark, sf), SUPPLIER, BASE, HOLDOUT_FROM))


# -- sources and sinks ----------------------------------------------------------------------------


def payload_explode(spark, sf):
    """Events packed into JSON records of at most 1,024 rows, one array per field, and unpacked."""
    packed = (
        table(spark, sf, "events")
        .groupBy(F.floor(F.col("event_id") / 1024).alias("record"))
        .agg(F.collect_list(F.struct("event_id", "user_id", "ts", "value")).alias("rows"))
        .select(
            F.to_json(
                F.struct(
                    F.col("rows.event_id").alias("event_id"),
                    F.col("rows.user_id").alias("symbol"),
                    F.transform("rows.ts", lambda t: t.cast("string")).alias("date"),
                    F.col("rows.value").alias("value"),
                )
            ).alias("payload")
        )
    )
    fields = {"event_id": "bigint", "symbol": "bigint", "date": "string", "value": "double"}
    return explode_payloads(packed, "payload", fields)


def csv_roundtrip(spark, sf):
    path = _scratch(spark, "csv")
    priority_daily(spark, sf).write.option("header", True).csv(path)
    schema = "date timestamp_ntz, symbol string, close double, volume bigint"
    return rounded(load_panel(spark, path, PRIORITY, schema=schema))


def csv_inferred(spark, sf):
    """The same without a schema: types are inferred and the date is parsed."""
    path = _scratch(spark, "csv")
    priority_daily(spark, sf).write.option("header", True).csv(path)
    panel = load_panel(spark, path, PRIORITY)
    return rounded(panel.select("date", "symbol", "close", F.col("volume").cast("long").alias("volume")))


def parquet_roundtrip(spark, sf):
    path = _scratch(spark, "panel")
    write_panel(priority_daily(spark, sf), path, PRIORITY)
    return rounded(read_written(spark, path))


def json_metrics_sink(spark, sf):
    path = _scratch(spark, "metrics")
    write_metrics(
        ev.penalised_sharpe(_flows(spark, sf), "pnl").crossJoin(
            ev.hit_rate(_flows(spark, sf), "pnl")
        ),
        path,
    )
    read = spark.read.schema("competition_sharpe double, hit_rate double").json(path)
    return rounded(read, 6)


# -- models and jobs ------------------------------------------------------------------------------


def backtest_fixed_linear(spark, sf):
    """Holdout features through a forecast with given coefficients, sized and evaluated."""
    history, holdout = _history_and_holdout(spark, sf)
    features = ft.FeatureEstimator(SUPPLIER).fit(history).transform(holdout)
    forecast = (
        F.lit(0.8) + 0.5 * F.col("qty") - 0.25 * F.col("price_lag_1") + 0.4 * F.col("tax_roll_mean_5")
    )
    sized = materialize(
        features.select(
            "symbol", "date", "excess_return", position(forecast, STRATEGY).alias("position")
        ),
        "positions",
    )
    return rounded(ev.strategy_report(sized, SUPPLIER, "position", "excess_return", STRATEGY))


def _training(spark, sf) -> tuple[DataFrame, list[str]]:
    matrix, model = ft.FeatureEstimator(SUPPLIER).fit_transform(_supplier_table(spark, sf))
    return matrix, model.fitted_columns


LIGHT = ModelSpec("elastic_net", {"alpha": 1e-4, "l1_ratio": 0.5})


def elastic_net_single(spark, sf):
    """One feature, where the optimum is the soft-thresholded covariance in closed form."""
    matrix, _ = _training(spark, sf)
    trained = md.train_model(LIGHT, matrix, ["tax"], SUPPLIER.target)
    return rounded(md.feature_weights(spark, trained), 6)


def elastic_net_coefficients(spark, sf):
    matrix, names = _training(spark, sf)
    trained = md.train_model(LIGHT, matrix, names, SUPPLIER.target)
    return rounded(md.feature_weights(spark, trained), 7)


def elastic_net_kkt(spark, sf):
    matrix, names = _training(spark, sf)
    trained = md.train_model(LIGHT, matrix, names, SUPPLIER.target)
    gaps = md.optimality_gaps(matrix, trained, SUPPLIER.target, 1e-4, 0.5)
    return gaps.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(F.col("gap") > 1e-6).alias("n_violations"),
    )


GBT = ModelSpec("gbt", {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.1})


def gbt_predict(spark, sf):
    matrix, names = _training(spark, sf)
    trained = md.train_model(GBT, matrix, names, SUPPLIER.target)
    return trained.predict(matrix.select("symbol", "date", *names)).select(
        "symbol", "date", "prediction"
    )


def gbt_importance(spark, sf):
    matrix, names = _training(spark, sf)
    trained = md.train_model(GBT, matrix, names, SUPPLIER.target)
    return md.feature_weights(spark, trained)


def gbt_stump(spark, sf):
    """One tree with one split on the day of the week, where the best split is a plain search."""
    day = (F.weekday("date") * F.lit(1.0)).alias("day_of_week")
    rows = materialize(_supplier(spark, sf).select(day, SUPPLIER.target), "days")
    stump = ModelSpec("gbt", {"n_estimators": 1, "max_depth": 1})
    trained = md.train_model(stump, rows, ["day_of_week"], SUPPLIER.target)
    return rounded(trained.predict(rows.select("day_of_week").distinct()), 10)


def train_job(spark, sf):
    """A light penalty, under which most features have a weight."""
    trained = jobs.train(supplier_daily(spark, sf), SUPPLIER, _scratch(spark, "train"), model=LIGHT)
    row = [(len(trained.features), trained.rmse)]
    return rounded(spark.createDataFrame(row, "n_features bigint, rmse double"), 8)


def backtest_job(spark, sf):
    history, holdout = _history_and_holdout(spark, sf)
    out = _scratch(spark, "train")
    jobs.train(history, SUPPLIER, out, model=LIGHT)
    return rounded(jobs.backtest(holdout, f"{out}/artifacts"), 6)


def score_job(spark, sf):
    history, holdout = _history_and_holdout(spark, sf)
    out = _scratch(spark, "train")
    jobs.train(history, SUPPLIER, out, model=LIGHT)
    return rounded(jobs.score(holdout, f"{out}/artifacts"), 6)


def score_job_full_history(spark, sf):
    """Features built before the window is cut."""
    history, holdout = _history_and_holdout(spark, sf)
    out = _scratch(spark, "train")
    jobs.train(history, SUPPLIER, out, model=LIGHT)
    return rounded(jobs.score(holdout, f"{out}/artifacts", ServingSpec(history="full")), 6)


def ml_pipeline_forecast(spark, sf):
    """Features and elastic net as stages of one pipeline: fitted on history, saved, loaded, applied to the holdout."""
    history, holdout = _history_and_holdout(spark, sf)
    out = _scratch(spark, "pipeline")
    net = PanelElasticNet(labelCol=SUPPLIER.target, alpha=LIGHT.params["alpha"], l1Ratio=LIGHT.params["l1_ratio"])
    fitted = Pipeline(stages=[PanelFeatures(labelCol=SUPPLIER.target, featureCols=BASE), net]).fit(history)
    fitted.write().overwrite().save(out)
    scored = PipelineModel.load(out).transform(holdout)
    return rounded(scored.select("date", "symbol", "prediction"), 6)


def payload_forecast(spark, sf):
    """The holdout as one JSON record for each symbol, through to the forecasts of the trailing window."""
    history, holdout = _history_and_holdout(spark, sf)
    out = _scratch(spark, "train")
    jobs.train(history, SUPPLIER, out, model=LIGHT)
    packed = (
        holdout.groupBy(F.col("symbol").alias("record"))
        .agg(F.sort_array(F.collect_list(F.struct("date", "symbol", *BASE))).alias("rows"))
        .select(
            F.to_json(
                F.struct(
                    F.transform("rows.date", lambda t: t.cast("string")).alias("date"),
                    *[F.col(f"rows.{c}").alias(c) for c in ("symbol", *BASE)],
                )
            ).alias("payload")
        )
    )
    fields = {"date": "string", "symbol": "bigint", **{c: "double" for c in BASE}}
    return rounded(jobs.score_payloads(packed, "payload", f"{out}/artifacts", fields), 6)


def streaming_scores(spark, sf):
    """The holdout as a stream that runs until it has read all, after a seed of the history."""
    history, holdout = _history_and_holdout(spark, sf)
    out, base = _scratch(spark, "train"), _scratch(spark, "stream")
    jobs.train(history, SUPPLIER, out, model=LIGHT)
    scoring.seed_history(history, f"{base}/history")
    holdout.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(holdout.schema).parquet(f"{base}/in")
    query = scoring.start_scoring(
        stream,
        load_artifacts(spark, f"{out}/artifacts"),
        f"{base}/history",
        f"{base}/scores",
        f"{base}/checkpoint",
        available_now=True,
    )
    query.awaitTermination()
    return rounded(scoring.read_scores(spark, f"{base}/scores").select("date", "symbol", "prediction"), 5)


def walk_forward_job(spark, sf):
    """Five folds with all lags and windows, and a penalty that leaves weights."""
    report = jobs.walk_forward(supplier_daily(spark, sf).drop("forecast"), SUPPLIER, SPLIT, models=[LIGHT])
    return rounded(report.select("fold_id", "train_rmse", "valid_rmse", "competition_sharpe", "total_return", "hit_rate"), 5)


#: Grid of the search: the light penalty and its neighbours.
ALPHAS, L1_RATIOS = (1e-4, 2e-4, 5e-4, 1e-3, 2e-3), (0.2, 0.5, 0.8)


def parameter_search(spark, sf):
    """Five folds, fifteen penalties."""
    found = jobs.search(supplier_daily(spark, sf).drop("forecast"), SUPPLIER, SPLIT, ALPHAS, L1_RATIOS)
    kept = found.select(F.format_number("alpha", 5).alias("alpha"), F.format_number("l1_ratio", 1).alias("l1_ratio"), "mean_sharpe", "mean_rmse", "n_folds")
    return rounded(kept, 5)


def winsorize_bounds_approx(spark, sf):
    """Whether the ranks of sketched quantiles are within the error that their sketch states, and how small
    that is."""
    panel, shares, rows = _supplier_table(spark, sf), (0.01, 0.25, 0.5, 0.99), []
    columns = [*BASE, SUPPLIER.target]
    sketches = column_sketches(panel, columns, 512)
    answers = {c: sketches[c].quantiles(shares) for c in columns}
    ranks = panel.agg(*[f(F.col(c), a).alias(f"{c}{i}{k}") for c in columns for i, a in enumerate(answers[c]) for k, f in enumerate(
        (lambda x, a: F.count_if(x < a), lambda x, a: F.count_if(x <= a))
    )]).first()
    for c in columns:
        wanted = [s * (sketches[c].rows - 1) for s in shares]
        near = [max(0, ranks[f"{c}{i}0"] - w, w - ranks[f"{c}{i}1"] + 1) <= sketches[c].error + 1 for i, w in enumerate(wanted)]
        rows.append((c, sketches[c].rows, all(near), sketches[c].error <= 0.02 * sketches[c].rows))
    return spark.createDataFrame(rows, "feature string, n_values long, within_error boolean, error_small boolean")


def boosted_trees(spark, sf):
    """The library's default ensemble of histogram trees on all features, cut to ten trees."""
    matrix, names = _training(spark, sf)
    trained = md.train_model(ModelSpec("lightgbm", {"n_estimators": 10}), matrix, names, SUPPLIER.target)
    return trained.predict(matrix.select("symbol", "date", *names)).select("symbol", "date", "prediction")


def boosted_stumps(spark, sf):
    """Three trees of two leaves with L1 and L2 terms on the calendar, where a plain search is short."""
    day, month = (F.weekday("date") * F.lit(1.0)).alias("day"), (F.month("date") * F.lit(1.0)).alias("month")
    rows = materialize(_supplier(spark, sf).select(day, month, SUPPLIER.target), "calendar")
    spec = ModelSpec("lightgbm", {"n_estimators": 3, "num_leaves": 2, "learning_rate": 0.5, "reg_alpha": 0.05, "reg_lambda": 2.0})
    trained = md.train_model(spec, rows, ["day", "month"], SUPPLIER.target)
    return rounded(trained.predict(rows.select("day", "month").distinct()), 8)


def all_queries() -> dict[str, Query]:
    plain: Sequence[Query] = (
        feature_matrix,
        feature_matrix_from_schema,
        panel_project,
        winsorize_bounds,
        winsorize_panel,
        lag_features,
        rolling_stats,
        event_history,
        event_history_hot_keys,
        standard_scale,
        feature_statistics,
        feature_transform_holdout,
        feature_transform_fitted_bounds,
        min_max_scale,
        forward_fill,
        trailing_window,
        walk_forward_bounds,
        walk_forward_bounds_instants,
        walk_forward_assign,
        clip_positions,
        turnover_positions,
        turnover_from_previous,
        equity_curve_pooled,
        equity_curve_by_symbol,
        equity_curve_hot_keys,
        drawdown_curve,
        sharpe_by_symbol,
        sharpe_pooled,
        hit_rate,
        strategy_report,
        strategy_report_by_symbol,
        rmse_mean_model,
        tail_risk,
        first_difference,
        sma,
        sma_long,
        volume_averages,
        bollinger,
        rsi,
        rsi_many,
        technical_indicators,
        event_indicators,
        pct_change,
        volatility,
        compound_return,
        rolling_sharpe,
        macd,
        macd_gaps,
        time_features,
        dq_duplicates,
        dq_gaps,
        dq_nulls,
        dq_observed,
        dq_types,
        dq_outliers,
        profile,
        autocorr,
        drift,
        payload_explode,
        csv_roundtrip,
        csv_inferred,
        parquet_roundtrip,
        json_metrics_sink,
        backtest_fixed_linear,
        elastic_net_single,
        elastic_net_coefficients,
        elastic_net_kkt,
        gbt_predict,
        gbt_importance,
        gbt_stump,
        train_job,
        backtest_job,
        score_job,
        score_job_full_history,
        ml_pipeline_forecast,
        payload_forecast,
        streaming_scores,
        walk_forward_job,
        parameter_search,
        winsorize_bounds_approx,
        boosted_trees,
        boosted_stumps,
    )
    found = {q.__name__: q for q in plain}
    for key, strategy in (
        ("impute_median", "median"),
        ("impute_mean", "mean"),
        ("impute_mode", "most_frequent"),
        ("impute_constant", "constant"),
    ):
        found[key] = _impute(strategy)
    return found
