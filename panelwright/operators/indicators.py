"""Technical indicators per key; every average needs a full window unless stated otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalars import NEAR_ZERO, relative_strength
from panelwright.operators.segments import KeyWindow, over_keys
from panelwright.spec import ROWS_PER_BLOCK, PanelSpec


def first_difference(
    df: DataFrame, spec: PanelSpec, column: str, name: str = "diff", *, rows_per_block=ROWS_PER_BLOCK
) -> DataFrame:
    return over_keys(
        df,
        spec,
        1,
        lambda d, w: d.select("*", (F.col(column) - w.lag(column)).alias(name)),
        rows_per_block,
    )


def simple_moving_average(
    df: DataFrame,
    spec: PanelSpec,
    column: str,
    windows: Sequence[int] = (20, 50),
    prefix: str = "SMA",
    *,
    rows_per_block=ROWS_PER_BLOCK,
) -> DataFrame:
    def build(d: DataFrame, w: KeyWindow) -> DataFrame:
        return d.select(
            "*", *[w.full_trailing(F.avg, column, n).alias(f"{prefix}_{n}") for n in windows]
        )

    return over_keys(df, spec, max(windows) - 1, build, rows_per_block)


def _bollinger(w: KeyWindow, column: str, window: int, width: float) -> list[Column]:
    middle = w.full_trailing(F.avg, column, window)
    spread = F.lit(float(width)) * w.full_trailing(F.stddev_samp, column, window)
    return [(middle + spread).alias("BB_upper"), (middle - spread).alias("BB_lower")]


def bollinger_bands(
    df: DataFrame,
    spec: PanelSpec,
    column: str,
    window: int = 20,
    width: float = 2.0,
    *,
    rows_per_block=ROWS_PER_BLOCK,
) -> DataFrame:
    return over_keys(
        df,
        spec,
        window - 1,
        lambda d, w: d.select("*", *_bollinger(w, column, window, width)),
        rows_per_block,
    )


def _gain(change: str) -> Column:
    # A missing change (first row of a key) counts as neither gain nor loss.
    return F.when(F.col(change) > 0.0, F.col(change)).otherwise(0.0)


def _loss(change: str) -> Column:
    return F.when(F.col(change) < 0.0, -F.col(change)).otherwise(0.0)


def _rsi(w: KeyWindow, change: str, window: int) -> Column:
    gain = w.full_trailing(F.avg, _gain(change), window)
    loss = w.full_trailing(F.avg, _loss(change), window)
    return relative_strength(gain, loss)


def rsi(
    df: DataFrame,
    spec: PanelSpec,
    column: str,
    windows: Sequence[int] = (14,),
    *,
    rows_per_block=ROWS_PER_BLOCK,
) -> DataFrame:
    """Relative strength index with simple averages; one window is named ``RSI``, more ``RSI_n``."""

    def build(d: DataFrame, w: KeyWindow) -> DataFrame:
        changed = d.select("*", (F.col(column) - w.lag(column)).alias("_change"))
        names = ["RSI"] if len(windows) == 1 else [f"RSI_{n}" for n in windows]
        return changed.select(
            *d.columns, *[_rsi(w, "_change", n).alias(m) for n, m in zip(windows, names)]
        )

    return over_keys(df, spec, max(windows), build, rows_per_block)


def technical_indicators(
    df: DataFrame, spec: PanelSpec, column: str = "close", *, rows_per_block=ROWS_PER_BLOCK
) -> DataFrame:
    """SMA 20 and 50, Bollinger bands and RSI 14 over one exchange and one sort."""

    def build(d: DataFrame, w: KeyWindow) -> DataFrame:
        changed = d.select("*", (F.col(column) - w.lag(column)).alias("_change"))
        return changed.select(
            *d.columns,
            *[w.full_trailing(F.avg, column, n).alias(f"SMA_{n}") for n in (20, 50)],
            *_bollinger(w, column, 20, 2.0),
            _rsi(w, "_change", 14).alias("RSI"),
        )

    return over_keys(df, spec, 49, build, rows_per_block)


def percent_change(
    df: DataFrame,
    spec: PanelSpec,
    column: str,
    rows: int = 1,
    name: str = "pct_change",
    *,
    rows_per_block=ROWS_PER_BLOCK,
) -> DataFrame:
    """Relative change against ``rows`` rows before; NULL where that value is 0."""
    return over_keys(
        df,
        spec,
        rows,
        lambda d, w: d.select(
            "*", (F.try_divide(F.col(column), w.lag(column, rows)) - 1.0).alias(name)
        ),
        rows_per_block,
    )


def volatility(
    df: DataFrame,
    spec: PanelSpec,
    column: str,
    windows: Sequence[int] = (5, 21, 63),
    *,
    rows_per_block=ROWS_PER_BLOCK,
) -> DataFrame:
    """Sample deviation of one-row returns over full windows."""

    def build(d: DataFrame, w: KeyWindow) -> DataFrame:
        returns = d.select(
            "*", (F.try_divide(F.col(column), w.lag(column)) - 1.0).alias("_return")
        )
        return returns.select(
            *d.columns,
            *[w.full_trailing(F.stddev_samp, "_return", n).alias(f"volatility_{n}") for n in windows],
        )

    return over_keys(df, spec, max(windows), build, rows_per_block)


def compound_return(
    df: DataFrame,
    spec: PanelSpec,
    returns: str,
    window: int,
    name: str = "compound_return",
    *,
    rows_per_block=ROWS_PER_BLOCK,
) -> DataFrame:
    """Return compounded over a full window; NULL where a return of -100% or less is in it."""
    growth = F.when(F.col(returns) > -1.0, F.log1p(returns))
    return over_keys(
        df,
        spec,
        window - 1,
        lambda d, w: d.select("*", F.expm1(w.full_trailing(F.sum, growth, window)).alias(name)),
        rows_per_block,
    )


def rolling_sharpe(
    df: DataFrame,
    spec: PanelSpec,
    returns: str,
    window: int = 63,
    name: str = "rolling_sharpe",
    *,
    rows_per_block=ROWS_PER_BLOCK,
) -> DataFrame:
    """Mean over population deviation in a full window, 0 where the deviation vanishes."""

    def build(d: DataFrame, w: KeyWindow) -> DataFrame:
        mean = w.full_trailing(F.avg, returns, window)
        spread = w.full_trailing(F.stddev_pop, returns, window)
        return d.select(
            "*",
            F.when(spread <= F.lit(NEAR_ZERO), 0.0)
            .otherwise(F.try_divide(mean, spread))
            .alias(name),
        )

    return over_keys(df, spec, window - 1, build, rows_per_block)


def time_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Calendar parts of the date as BIGINT; Monday is day 0."""
    day = F.col(spec.date)
    return df.select(
        "*",
        F.weekday(day).cast("long").alias("day_of_week"),
        F.dayofmonth(day).cast("long").alias("day_of_month"),
        F.month(day).cast("long").alias("month"),
        F.quarter(day).cast("long").alias("quarter"),
    )
