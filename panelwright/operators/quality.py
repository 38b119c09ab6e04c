"""Data-quality and profile reports over a panel."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.quantiles import exact_quantiles
from panelwright.operators.features import winsor_bounds
from panelwright.operators.segments import over_keys
from panelwright.spec import ROWS_PER_BLOCK, PanelSpec


def duplicate_keys(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """(key, date) pairs that occur more than once."""
    return (
        df.groupBy(spec.key, spec.date)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def assert_daily(df: DataFrame, spec: PanelSpec) -> None:
    """Check the promise of ``grain="day"``: one row per key and calendar day."""
    day = F.to_date(spec.date)
    clash = (
        df.where(F.col(spec.key).isNotNull())
        .groupBy(spec.key, day.alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .first()
    )
    if clash is not None:
        raise ValueError(f"Key {clash[0]!r} has {clash['n']} rows on {clash['day']}")


def date_gaps(
    df: DataFrame, spec: PanelSpec, min_days: int = 2, *, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Rows at least ``min_days`` calendar days after the previous row of their key."""
    built = over_keys(
        df.select(spec.key, *spec.order),
        spec,
        1,
        lambda d, w: d.select("*", w.lag(spec.date).alias("previous")),
        rows_per_block,
    )
    days = F.datediff(spec.date, "previous").cast("long")
    return built.select(spec.key, spec.date, days.alias("gap_days")).where(
        F.col("gap_days") >= min_days
    )


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of rows and of NULLs, from one aggregation."""
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *counts)
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.col("_rows").alias("n_rows"), F.col(c).alias("n_null"))
        for c in columns
    ]
    return wide.select(F.inline(F.array(*pairs)))


def observed(df: DataFrame, spec: PanelSpec, columns: Sequence[str]) -> tuple[DataFrame, Observation]:
    """``df`` with an observation of its rows, dates, NULLs and non-finite values; whatever action runs on
    it next, a write say, fills the observation without another scan."""
    seen = Observation(f"quality-{uuid.uuid4().hex}")
    counts = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in columns]
    for c in columns:
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            odd = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        else:
            odd = F.lit(False)
        counts.append(F.count_if(odd).alias(f"odd {c}"))
    dates = [f(F.col(spec.date)).cast("string").alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *dates, *counts), seen


def observed_report(spark: SparkSession, seen: Observation, columns: Sequence[str]) -> DataFrame:
    """The observation as one row per column; waits for the action that fills it."""
    found = seen.get
    rows = [(c, found["rows"], found[f"null {c}"], found[f"odd {c}"], found["first"], found["last"]) for c in columns]
    return spark.createDataFrame(
        rows, "feature string, n_rows long, n_null long, n_not_finite long, first_date string, last_date string"
    )


def outlier_counts(
    df: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99
) -> DataFrame:
    """Values outside the winsor bounds per column."""
    bounds = winsor_bounds(df, columns, lower, upper)
    wide = df.agg(
        *[
            F.count_if((F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high))).alias(c)
            for c, (low, high) in bounds.items()
            if low is not None
        ]
    )
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_outliers")) for c in wide.columns
    ]
    return wide.select(F.inline(F.array(*pairs)))


def type_mismatches(df: DataFrame, expected: T.StructType) -> list[tuple[str, str, str]]:
    """(column, expected type, actual type or "missing"); reads the schema only."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wanted = [(f.name, f.dataType.simpleString()) for f in expected.fields]
    return [(n, t, actual.get(n, "missing")) for n, t in wanted if actual.get(n) != t]


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing share, mean, deviation, extremes and quartiles per column."""
    quartiles = exact_quantiles(df, {c: (0.25, 0.5, 0.75) for c in columns})
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.count(c).alias("n"),
                F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias("missing_share"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                *[
                    F.lit(v).cast("double").alias(name)
                    for name, v in zip(("q25", "median", "q75"), quartiles[c])
                ],
                F.max(c).alias("max"),
            ).alias(c)
            for c in columns
        ],
    )
    return wide.select(F.inline(F.array(*columns)))


def autocorrelation(
    df: DataFrame,
    spec: PanelSpec,
    column: str,
    lags: Sequence[int] = (1, 5),
    *,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Correlation with the value ``k`` rows before, per key; NULL where it is undefined."""
    built = over_keys(
        df.select(spec.key, *spec.order, column),
        spec,
        max(lags),
        lambda d, w: d.select("*", *[w.lag(column, k).alias(f"_lag_{k}") for k in lags]),
        rows_per_block,
    ).where(F.col(spec.key).isNotNull())
    return built.groupBy(spec.key).agg(
        *[F.corr(column, f"_lag_{k}").alias(f"autocorr_{k}") for k in lags]
    )


def drift(df: DataFrame, spec: PanelSpec, columns: Sequence[str], split_at: str) -> DataFrame:
    """Means before and from ``split_at`` on, and their gap in units of the earlier deviation."""
    late = F.col(spec.date) >= F.lit(split_at).cast(df.schema[spec.date].dataType)
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(F.when(~late, F.col(c))).alias("mean_before"),
                F.avg(F.when(late, F.col(c))).alias("mean_after"),
                F.stddev_pop(F.when(~late, F.col(c))).alias("std_before"),
            ).alias(c)
            for c in columns
        ]
    ).select(F.inline(F.array(*columns)))
    gap = F.col("mean_after") - F.col("mean_before")
    return wide.select(
        "feature",
        "mean_before",
        "mean_after",
        F.when(F.col("std_before") != 0.0, F.try_divide(gap, F.col("std_before"))).alias("drift"),
    )


def tail_risk(df: DataFrame, value: str, level: float = 0.05) -> DataFrame:
    """Value at risk (the ``level`` quantile of pnl) and the mean of what lies at or below it."""
    var = exact_quantiles(df, {value: (level,)})[value][0]
    threshold = F.lit(var).cast("double")
    return df.agg(
        F.first(threshold).alias("value_at_risk"),
        F.avg(F.when(F.col(value) <= threshold, F.col(value))).alias("expected_shortfall"),
    )


def min_max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns mapped onto [0, 1] by their extremes; a constant column becomes 0."""
    row = df.agg(
        *[F.min(c).alias(f"low{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"high{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        low, high = row[f"low{i}"], row[f"high{i}"]
        if low is not None:
            scaled[c] = ((F.col(c) - F.lit(low)) / F.lit((high - low) or 1.0)).alias(c)
    return df.select(*[scaled.get(c, F.col(c)) for c in df.columns])
