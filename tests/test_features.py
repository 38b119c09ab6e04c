import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import features as ft
from panelwright.operators.indicators import technical_indicators
from panelwright.spec import FeatureSpec, PanelSpec, as_panel, require_columns

PANEL = PanelSpec(target="target")
INSTANT = dataclasses.replace(PANEL, grain="instant")
SMALL = FeatureSpec(lags=(1, 3), rolling_windows=(2, 5))


def by_key(df):
    return df.toPandas().sort_values(["symbol", "date"], na_position="last").reset_index(drop=True)


def spread(window):
    present = window[~np.isnan(window)]
    return present.std(ddof=1) if len(present) > 1 else np.nan


def expected_history(frame, columns, spec):
    """The same features by pandas: group-wise shift and rolling with one required value."""
    out = frame.sort_values(["symbol", "date"]).reset_index(drop=True)
    for k in spec.lags:
        for c in columns:
            out[f"{c}_lag_{k}"] = out.groupby("symbol")[c].shift(k)
    for w in spec.rolling_windows:
        for c in columns:
            rolled = out.groupby("symbol")[c].rolling(w, min_periods=1)
            out[f"{c}_roll_mean_{w}"] = rolled.mean().reset_index(level=0, drop=True)
            # pandas' own rolling deviation drifts with the running sum; take each window by itself.
            out[f"{c}_roll_std_{w}"] = rolled.apply(spread, raw=True).reset_index(level=0, drop=True)
    return out


def assert_same(got, want):
    pd.testing.assert_frame_equal(
        got[sorted(got.columns)], want[sorted(want.columns)], check_dtype=False, rtol=1e-9, atol=1e-9
    )


def test_history_matches_pandas(walk):
    frame, df = walk
    got = ft.add_history(as_panel(df, PANEL), PANEL, ["close", "volume"], SMALL)
    assert_same(by_key(got), expected_history(frame, ["close", "volume"], SMALL))


@pytest.mark.parametrize("block", [5, 7, 50, 399])
def test_cut_keys_give_the_same_history(walk, block):
    frame, df = walk
    spec = dataclasses.replace(SMALL, rows_per_block=block)
    got = ft.add_history(as_panel(df, INSTANT), INSTANT, ["close", "volume"], spec)
    assert got.count() == len(frame)
    assert_same(by_key(got), expected_history(frame, ["close", "volume"], SMALL))


def test_cut_keys_with_bursts_inside_a_day(rows):
    """Many rows share a day, an hour and a minute, so finer buckets are needed."""
    data = [("a", i, float(i % 7)) for i in range(300)] + [("b", 0, 1.0), (None, 5, 2.0), (None, 6, 3.0)]
    df = rows("symbol string, at long, x double", data).select(
        F.timestamp_micros(F.col("at") * 3000).cast("timestamp_ntz").alias("date"), "symbol", "x"
    )
    spec = PanelSpec(grain="instant", features=("x",))
    cut = ft.add_history(df, spec, ["x"], FeatureSpec((1, 4), (3,), rows_per_block=20))
    whole = ft.add_history(df, spec, ["x"], FeatureSpec((1, 4), (3,)))
    assert_same(by_key(cut), by_key(whole))


@pytest.mark.parametrize("block", [10, 10_000])
def test_cut_keys_indicators(walk, block):
    _, df = walk
    got = by_key(technical_indicators(df.select("date", "symbol", "close"), INSTANT, rows_per_block=block))
    want = by_key(technical_indicators(df.select("date", "symbol", "close"), PANEL))
    assert_same(got, want)


def test_null_key_gets_no_history(rows):
    df = rows("date date, symbol string, x double", [(None, None, 1.0)] * 2).withColumn(
        "date", F.current_date()
    )
    got = ft.add_history(df, PanelSpec(features=("x",)), ["x"], SMALL).toPandas()
    assert len(got) == 2
    assert got.drop(columns=["date", "symbol", "x"]).isna().all().all()


def test_single_row_key(walk):
    _, df = walk
    row = ft.add_history(as_panel(df, PANEL), PANEL, ["close"], SMALL).where("symbol = 'C'").first()
    assert row["close_lag_1"] is None
    assert row["close_roll_mean_5"] == row["close"]
    assert row["close_roll_std_5"] is None


def test_one_exchange_one_window(walk):
    _, df = walk
    plan = ft.add_history(as_panel(df, PANEL), PANEL, ["close", "volume"], FeatureSpec())
    text = plan._jdf.queryExecution().sparkPlan().toString()
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1
    assert text.count("Window [") == 1


def test_constant_column_scales_to_zero(rows):
    df = rows("x double", [(5.0,)] * 4)
    statistics = ft.fit_columns(df, ["x"], FeatureSpec())
    assert {r["x"] for r in ft.apply_columns(df, statistics).collect()} == {0.0}


def test_all_null_column_is_named(rows):
    df = rows("x double, y double", [(1.0, None), (2.0, None)])
    with pytest.raises(ValueError, match=r"\['y'\]"):
        ft.fit_columns(df, ["x", "y"], FeatureSpec())
    constant = ft.fit_columns(df, ["x", "y"], FeatureSpec(imputation="constant"))
    assert constant["y"].impute_value == 0.0


@pytest.mark.parametrize(
    "strategy, fill", [("most_frequent", 1.0), ("median", 1.5), ("mean", 1.5), ("constant", 0.0)]
)
def test_fill_values(rows, strategy, fill):
    df = rows("x double", [(1.0,), (1.0,), (2.0,), (2.0,), (None,)])
    found = ft.fit_columns(df, ["x"], FeatureSpec(imputation=strategy))["x"]
    filled = np.array([1.0, 1.0, 2.0, 2.0, fill])
    assert found.impute_value == fill
    assert (found.mean, found.std) == pytest.approx((filled.mean(), filled.std()))


def test_unknown_strategy():
    with pytest.raises(ValueError, match="forward"):
        FeatureSpec(imputation="forward")


def test_output_order_and_overwrite(walk):
    _, df = walk
    matrix, model = ft.FeatureEstimator(PANEL, SMALL).fit_transform(df)
    assert matrix.columns == ["date", "symbol", "target", *model.fitted_columns]
    assert model.fitted_columns[:6] == [
        "close", "volume", "close_lag_1", "volume_lag_1", "close_lag_3", "volume_lag_3",
    ]
    assert model.fitted_columns[6:8] == ["close_roll_mean_2", "close_roll_std_2"]
    pdf = matrix.toPandas()
    assert not pdf.isna().any().any()
    assert np.allclose(pdf[model.fitted_columns].mean(), 0.0, atol=1e-9)
    assert np.allclose(pdf[model.fitted_columns].std(ddof=0), 1.0)


def test_transform_of_training_data_is_fit_transform(walk, spark, tmp_path):
    _, df = walk
    matrix, model = ft.FeatureEstimator(PANEL, SMALL).fit_transform(df)
    assert_same(by_key(model.transform(df)), by_key(matrix))
    model.save(spark, str(tmp_path / "model"))
    loaded = ft.FeatureModel.load(spark, str(tmp_path / "model"))
    assert loaded == model
    assert_same(by_key(loaded.transform(df.repartition(7))), by_key(matrix))


def test_transform_without_target(walk):
    _, df = walk
    _, model = ft.FeatureEstimator(PANEL, SMALL).fit_transform(df)
    assert "target" not in model.transform(df.drop("target")).columns


def test_target_is_winsorised(walk):
    frame, df = walk
    matrix, _ = ft.FeatureEstimator(PANEL, SMALL).fit_transform(df)
    low, high = frame["target"].quantile([0.01, 0.99])
    got = matrix.agg(F.min("target"), F.max("target")).first()
    assert tuple(got) == pytest.approx((low, high))
    untouched = dataclasses.replace(SMALL, winsorize_target=False)
    matrix, _ = ft.FeatureEstimator(PANEL, untouched).fit_transform(df)
    assert matrix.agg(F.max("target")).first()[0] == pytest.approx(frame["target"].max())


def test_batch_and_fitted_bounds_differ(walk):
    _, df = walk
    late = df.where("date >= '2020-06-01'")
    fitted = dataclasses.replace(SMALL, bounds="fitted")
    batch = ft.FeatureEstimator(PANEL, SMALL).fit(df).transform(late)
    kept = ft.FeatureEstimator(PANEL, fitted).fit(df).transform(late)
    assert batch.agg(F.max("close")).first() != kept.agg(F.max("close")).first()


def test_nan_becomes_null_and_missing_columns_are_sorted(rows):
    df = rows("date date, symbol string, x double, n int", [(None, "a", float("nan"), 3)])
    clean = as_panel(df, PanelSpec()).first()
    assert clean["x"] is None and clean["n"] == 3.0
    with pytest.raises(ValueError, match=r"\['a', 'z'\]"):
        require_columns(df, ["z", "a", "x"])
