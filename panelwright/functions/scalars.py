"""Column expressions; everything here stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.spec import StrategySpec

#: Absolute tolerance under which a volatility counts as zero (fixed value).
NEAR_ZERO = 1e-8


def as_column(value: Column | str | float) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def clip(x: Column | str, low: Column | float | None, high: Column | float | None) -> Column:
    """Two-sided clip that keeps NULL; a ``None`` bound leaves that side open."""
    x = as_column(x)
    bounded = x
    if low is not None:
        bounded = F.greatest(bounded, as_column(low))
    if high is not None:
        bounded = F.least(bounded, as_column(high))
    # least/greatest skip NULL, so without the guard a NULL would become a bound.
    return F.when(x.isNotNull(), bounded)


def near_zero(x: Column | str) -> Column:
    return F.abs(as_column(x)) <= F.lit(NEAR_ZERO)


def position(
    prediction: Column | str, strategy: StrategySpec, previous: Column | str | float | None = None
) -> Column:
    """Leverage-bounded position, damped towards ``previous`` by the turnover penalty if given."""
    low, high = strategy.leverage_min, strategy.leverage_max
    wanted = clip(prediction, low, high)
    if previous is None:
        return wanted
    held = as_column(previous)
    change = wanted - held
    damped = held + change * F.exp(F.abs(change) * F.lit(-strategy.turnover_penalty))
    return clip(damped, low, high)


def drawdown(equity: Column | str, peak: Column | str) -> Column:
    """``equity / peak - 1`` with the zero-peak cases spelled out: NULL at 0/0, -inf below it."""
    equity, peak = as_column(equity), as_column(peak)
    return (
        F.when(peak != 0.0, F.try_divide(equity, peak) - 1.0)
        .when(equity < 0.0, F.lit(float("-inf")))
    )


def relative_strength(gain: Column | str, loss: Column | str) -> Column:
    """RSI of average gain and loss: 100 without losses, NULL on a flat stretch."""
    gain, loss = as_column(gain), as_column(loss)
    index = 100.0 - 100.0 / (1.0 + F.try_divide(gain, loss))
    return F.when(loss != 0.0, index).when(gain > 0.0, F.lit(100.0))


def sharpe(mean: Column, volatility: Column, penalty: float) -> Column:
    """Mean over volatility minus ``penalty * volatility``; 0 where volatility vanishes."""
    return F.when(near_zero(volatility), F.lit(0.0)).otherwise(
        F.try_divide(mean, volatility) - F.lit(float(penalty)) * volatility
    )


def days_before(day: Column, days: int) -> Column:
    return day - F.make_dt_interval(days=F.lit(int(days)))
