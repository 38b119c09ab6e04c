"""Backtest metrics: pnl, equity curve, drawdown, penalised Sharpe, hit rate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.scalars import as_column, drawdown, sharpe
from panelwright.operators.segments import HALO, LOOKUP_BROADCAST_ROWS, PART, instant_micros, segment
from panelwright.session import materialize
from panelwright.spec import ROWS_PER_BLOCK, PanelSpec, StrategySpec

_LOCAL, _LOCAL_PEAK, _LOCAL_GAPS = "_local", "_local_peak", "_local_gaps"


def pnl(position: Column | str, target: Column | str) -> Column:
    return as_column(position) * as_column(target)


def equity_curve(
    df: DataFrame,
    spec: PanelSpec,
    value: str,
    *,
    by: str | None = None,
    runs: Sequence[str] = (),
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ``equity`` (running sum of ``value``), ``peak`` (its running maximum) and ``drawdown``.

    ``by=None`` runs over all rows in (date, key) order, ``by=spec.key`` over each key. Either way the
    scan is blocked: running sums inside bounded blocks, then one row per block gives what each block
    starts from. No task ever sees more than a block. From the first NULL on, equity is NULL. ``runs``
    names columns that tell several pooled curves of one table apart.
    """
    if by not in (None, spec.key):
        raise ValueError(f"by must be None or {spec.key!r}")
    if by is None:
        blocked = _pooled_blocks(df, spec, rows_per_block)
        return _scan(blocked, [*runs], [spec.date, spec.key, *spec.tiebreak], value, df.columns)
    segmented, cut = segment(df, spec, 0, rows_per_block)
    if cut:
        segmented = segmented.where(~F.col(HALO)).drop(HALO)
    return _scan(segmented, [by], spec.order, value, df.columns, cut=cut)


def _pooled_blocks(df: DataFrame, spec: PanelSpec, rows_per_block: int) -> DataFrame:
    """Blocks in date order: calendar days, or ranges of (date, key) where a day is too long."""
    micros_a_day = F.lit(86_400_000_000)
    at = instant_micros(df, spec.date)
    day = (at - F.pmod(at, micros_a_day)).alias(PART)
    longest = df.groupBy(day).count().agg(F.max("count"), F.sum("count")).first()
    if (longest[0] or 0) <= rows_per_block:
        return df.select("*", day)
    n_blocks = math.ceil(longest[1] / rows_per_block)
    ranged = df.repartitionByRange(n_blocks, spec.date, spec.key, *spec.tiebreak)
    # Written out, because a recomputed range shuffle may cut the ranges elsewhere.
    return materialize(
        ranged.select("*", F.spark_partition_id().cast("long").alias(PART)), "ranges"
    )


def _scan(
    blocked: DataFrame, keys: list[str], order: list[str], value: str, columns, cut: bool = True
) -> DataFrame:
    upto = W.partitionBy(*keys, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    missing = F.when(F.col(value).isNull(), 1).otherwise(0)
    local = blocked.select(
        "*",
        F.sum(value).over(upto).alias(_LOCAL),
        F.sum(missing).over(upto).alias(_LOCAL_GAPS),
    ).select("*", F.max(_LOCAL).over(upto).alias(_LOCAL_PEAK))
    keyed = F.lit(True)
    for key in keys:
        keyed = keyed & F.col(key).isNotNull()
    if not cut:
        equity = F.when(keyed & (F.col(_LOCAL_GAPS) == 0), F.col(_LOCAL))
        return _with_drawdown(local, columns, equity, F.col(_LOCAL_PEAK))

    # Read twice below, so sort and window once.
    local = materialize(local, "local-curve")
    per_block = local.groupBy(*keys, PART).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("_sum"),
        F.max(_LOCAL).alias("_block_peak"),
        F.max(_LOCAL_GAPS).alias("_gaps"),
    )
    # One row per block: days or ranges when pooled, the blocks of one key otherwise.
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    starts = per_block.select(
        *keys,
        PART,
        "_block_peak",
        F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_offset"),
        F.coalesce(F.sum("_gaps").over(before), F.lit(0)).alias("_gaps_before"),
    ).select(
        *keys,
        PART,
        "_offset",
        "_gaps_before",
        F.max(F.col("_offset") + F.col("_block_peak")).over(before).alias("_peak_before"),
    )
    starts = materialize(starts, "block-starts")
    joined = local.join(F.broadcast(starts) if starts.count() <= LOOKUP_BROADCAST_ROWS else starts, [*keys, PART], "left")
    unbroken = F.col(_LOCAL_GAPS) + F.col("_gaps_before") == 0
    equity = F.when(keyed & unbroken, F.col("_offset") + F.col(_LOCAL))
    peak = F.greatest(F.col("_peak_before"), F.col("_offset") + F.col(_LOCAL_PEAK))
    return _with_drawdown(joined, columns, equity, peak)


def _with_drawdown(df: DataFrame, columns, equity: Column, peak: Column) -> DataFrame:
    whole = df.select(*columns, equity.alias("equity"), peak.alias("peak"))
    return whole.select(
        *columns,
        "equity",
        F.when(F.col("equity").isNotNull(), F.col("peak")).alias("peak"),
        drawdown("equity", "peak").alias("drawdown"),
    )


def return_metrics(value: str, penalty: float) -> dict[str, Column]:
    """Aggregates over a pnl column; a NULL anywhere makes Sharpe and total return NULL."""
    whole = F.count_if(F.col(value).isNull()) == 0
    return {
        "competition_sharpe": F.when(
            whole, sharpe(F.avg(value), F.stddev_pop(value), penalty)
        ),
        "total_return": F.when(whole, F.sum(value)),
        "hit_rate": F.avg(F.when(F.col(value) > 0.0, 1.0).otherwise(0.0)),
    }


def penalised_sharpe(
    df: DataFrame, value: str, *, penalty: float = 0.01, by: str | None = None
) -> DataFrame:
    metric = return_metrics(value, penalty)["competition_sharpe"].alias("competition_sharpe")
    return df.groupBy(by).agg(metric) if by else df.agg(metric)


def hit_rate(df: DataFrame, value: str, *, by: str | None = None) -> DataFrame:
    metric = return_metrics(value, 0.0)["hit_rate"].alias("hit_rate")
    return df.groupBy(by).agg(metric) if by else df.agg(metric)


def strategy_report(
    df: DataFrame,
    spec: PanelSpec,
    position: str,
    target: str,
    strategy: StrategySpec = StrategySpec(),
    *,
    by: str | None = None,
    runs: Sequence[str] = (),
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Sharpe (penalised by the volatility cap), total return, worst drawdown and hit rate; with ``runs``
    a row for each of several pooled curves of one table."""
    needed = [*runs, spec.date, spec.key, *spec.tiebreak]
    flows = df.select(*needed, pnl(position, target).alias("pnl"))
    curve = equity_curve(flows, spec, "pnl", by=by, runs=runs, rows_per_block=rows_per_block)
    metrics = return_metrics("pnl", strategy.volatility_cap)
    metrics["max_drawdown"] = F.min("drawdown")
    order = ["competition_sharpe", "total_return", "max_drawdown", "hit_rate"]
    aggregates = [metrics[m].alias(m) for m in order]
    keys = [by] if by else [*runs]
    return curve.groupBy(*keys).agg(*aggregates) if keys else curve.agg(*aggregates)


def rmse(df: DataFrame, target: str, prediction: str, runs: Sequence[str] = ()) -> DataFrame:
    error = F.col(target) - F.col(prediction)
    root = F.sqrt(F.avg(error * error)).alias("rmse")
    return df.groupBy(*runs).agg(root) if runs else df.agg(root)
