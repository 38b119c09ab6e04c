"""Feature matrix: winsorise, lag, roll, impute, scale, with reusable fitted statistics."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.partials import joined_batches, made_of, maker_of
from panelwright.functions.quantiles import exact_quantiles, long_form, summarize
from panelwright.functions.scalars import clip
from panelwright.functions.sketches import approximate_quantiles
from panelwright.operators.segments import HALO, KeyWindow, over_keys
from panelwright.session import materialize
from panelwright.spec import STORED_PART, FeatureSpec, PanelSpec, as_panel

Bounds = dict[str, tuple[float | None, float | None]]

#: Relative spread under which a column counts as constant (fixed value).
CONSTANT_SPREAD = 1e-12

#: Bytes of a row group of stored features, the least a task can read: readers may hold a row at several times its size.
ROW_GROUP_BYTES = 32 << 20

STATISTICS_SCHEMA = (
    "feature string, ord int, lower double, upper double, impute_value double, mean double, std double"
)


# -- winsorise ------------------------------------------------------------------------------------


def winsor_bounds(
    df: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99, method: str = "exact"
) -> Bounds:
    """Two quantiles per column over the whole frame (all keys together).

    ``exact`` ones are interpolated and take a scan for each counting round, ``approx`` ones are values of
    the column from a sketch of one scan, whose rank error is bounded.
    """
    if method not in ("exact", "approx"):
        raise ValueError(f"Unsupported quantile method: {method}")
    wanted = {c: (lower, upper) for c in columns}
    quantiles = exact_quantiles(df, wanted) if method == "exact" else approximate_quantiles(df, wanted)
    return {c: (low, high) for c, (low, high) in quantiles.items()}


def winsorize(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Clip columns to literal bounds: a projection, no join."""
    return df.select(
        *[clip(c, *bounds[c]).alias(c) if c in bounds else F.col(c) for c in df.columns]
    )


# -- lags and rolling statistics ------------------------------------------------------------------


def lag_columns(window: KeyWindow, columns: Sequence[str], lags: Sequence[int]) -> list[Column]:
    return [window.lag(c, k).alias(f"{c}_lag_{k}") for k in lags for c in columns]


def rolling_columns(
    window: KeyWindow, columns: Sequence[str], windows: Sequence[int]
) -> list[Column]:
    """Mean and sample deviation of the non-null values among the last rows (at least one)."""
    return [
        window.trailing(aggregate(c), w).alias(f"{c}_roll_{name}_{w}")
        for w in windows
        for c in columns
        for name, aggregate in (("mean", F.avg), ("std", F.stddev_samp))
    ]


def add_lags(df: DataFrame, spec: PanelSpec, columns, features: FeatureSpec) -> DataFrame:
    return over_keys(
        df,
        spec,
        max(features.lags),
        lambda d, w: d.select("*", *lag_columns(w, columns, features.lags)),
        features.rows_per_block,
    )


def add_rolling(df: DataFrame, spec: PanelSpec, columns, features: FeatureSpec) -> DataFrame:
    return over_keys(
        df,
        spec,
        max(features.rolling_windows) - 1,
        lambda d, w: d.select("*", *rolling_columns(w, columns, features.rolling_windows)),
        features.rows_per_block,
    )


def add_history(
    df: DataFrame, spec: PanelSpec, columns, features: FeatureSpec, *, pruned: bool = True
) -> DataFrame:
    """Lags and rolling statistics together: one exchange, one sort, one window operator.

    ``pruned=False`` is for readers of all columns, which must be DOUBLE: the window then numbers the rows only,
    and the statistics are made of Arrow batches, at a tenth of the time. The values are the same.
    """

    def native(d: DataFrame, w: KeyWindow) -> DataFrame:
        lags = lag_columns(w, columns, features.lags)
        return d.select("*", *lags, *rolling_columns(w, columns, features.rolling_windows))

    numbered: list[DataFrame] = []

    def batched(d: DataFrame, w: KeyWindow) -> DataFrame:
        added = [n for n in features.feature_names(columns) if n not in columns]
        schema = T.StructType([*d.schema.fields, *(T.StructField(n, T.DoubleType()) for n in added)])
        numbered.append(d.select("*", w.place().alias(_PLACE)))
        return numbered[0].mapInArrow(_history_of(list(columns), features, schema.names), schema)

    history = over_keys(df, spec, features.lookback, native if pruned else batched, features.rows_per_block)
    if pruned or HALO in numbered[0].columns:
        return history

    def made(names: Sequence[str]):
        """The rows with what ``names`` are made of, and what makes them."""
        read = [c for c in numbered[0].columns if c in columns or c in names]
        return numbered[0].select(*read, _PLACE), _history_of(list(columns), features, list(names))

    return made_of(history, made)


_PLACE = "_place"
#: Rows whose features are made at once.
_ROWS_AT_ONCE = 1 << 15


def _history_of(columns: list[str], features: FeatureSpec, names: list[str]):
    """A ``mapInArrow`` function for the sorted rows of a key window, numbered from 1 within their key.

    Of the rows before a batch only the last ones that a feature can reach are kept. Sums and squared distances
    grow from the oldest row of a frame to the newest, as those of Spark's aggregates do.
    """
    reach = features.lookback

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails = {c: (np.zeros(reach), np.zeros(reach, bool)) for c in columns}
        for batch in joined_batches(batches, _ROWS_AT_ONCE):
            n, place = len(batch), batch.column(_PLACE).fill_null(0).to_numpy()
            made: dict[str, pa.Array] = {}
            for c in columns:
                column = batch.column(c)
                x = np.concatenate([tails[c][0], column.fill_null(0.0).to_numpy()])
                present = np.concatenate([tails[c][1], column.is_valid().to_numpy(zero_copy_only=False)])
                tails[c] = x[len(x) - reach :], present[len(x) - reach :]
                early = _Early(x, present, place, reach, longest)
                for k in features.lags:
                    if f"{c}_lag_{k}" in wanted:
                        seen = present[reach - k : reach - k + n] & (place > k)
                        made[f"{c}_lag_{k}"] = pa.array(x[reach - k : reach - k + n], mask=~seen)
                for w in features.rolling_windows:
                    if wanted & {f"{c}_roll_mean_{w}", f"{c}_roll_std_{w}"}:
                        mean, std = _trailing(x, present, early, reach, n, w)
                        made[f"{c}_roll_mean_{w}"], made[f"{c}_roll_std_{w}"] = mean, std
            whole = [made[name] if name in made else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(whole, names)

    wanted, longest = set(names), max(features.rolling_windows, default=1)
    return run


class _Early:
    """Count, sum and squared distances of the rows of a key up to each of its first ones, whose frames the start of
    the key cuts. They are the same for all frames, and each comes of the row before it."""

    def __init__(self, x, present, place, reach: int, longest: int):
        self.places, self.at = place, np.flatnonzero(place < longest)
        self.place = place[self.at]
        self.facts = tuple(np.zeros(len(self.at)) for _ in range(3))
        self.tame = bool(np.abs(x).max(initial=0.0) < _TAME)
        keyed = np.flatnonzero(self.place > 0)
        if not self.tame or not len(keyed):
            return
        # The rows of one key follow each other; a key may have begun before the batch, within reach.
        own = self.place[keyed]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(self.at[keyed]) != 1) | (np.diff(own) != 1)]))
        last = own[np.concatenate([first[1:] - 1, [len(own) - 1]])]
        start = self.at[keyed][first] - own[first] + 1 + reach
        offset, skipped = keyed[first], own[first] - 1
        count, total, mean, squares = (np.zeros(len(first)) for _ in range(4))
        for k in range(int(last.max())):
            live = k < last
            at = np.where(live, start + k, 0)
            seen = present[at] & live
            value = np.where(seen, x[at], 0.0)
            count += seen
            total += value
            gap = np.where(seen, value - mean, 0.0)
            step = gap / np.maximum(count, 1.0)
            mean += step
            squares += gap * (gap - step)
            kept = live & (k >= skipped)
            to = (offset + k - skipped)[kept]
            for fact, held in zip(self.facts, (count, total, squares), strict=True):
                fact[to] = held[kept]


def _trailing(x, present, early: _Early, reach: int, n: int, rows: int) -> tuple[pa.Array, pa.Array]:
    """Mean and sample deviation over the last ``rows`` rows of each of ``n`` rows, which begin at ``reach``.

    Frames that the start of their key cuts are added up apart from the others, which need no masks.
    """
    count, total, squares = (np.zeros(n) for _ in range(3))
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        if early.tame:
            lacking = not present[reach - rows + 1 :].all()
            _grown(x, present.astype(float) if lacking else None, reach, rows, count, total, squares)
            cut = early.place < rows
            for whole, part in zip((count, total, squares), early.facts, strict=True):
                whole[early.at[cut]] = part[cut]
        else:
            _grown_masked(x, present, early.places, reach, rows, count, total, squares)
        return pa.array(total / count, mask=count < 1), pa.array(np.sqrt(squares / (count - 1.0)), mask=count < 2)


#: Values below this have finite squares, which may be multiplied by 0 to leave them out.
_TAME = 1e150


def _grown(x, weights, reach: int, rows: int, count, total, squares) -> None:
    """Sums and squared distances of uncut frames, from the oldest row to the newest; ``weights`` are 0 for missing
    values, which are 0 in ``x``, and None if there are none."""
    n = len(total)
    mean, gap, step, divisor = (np.zeros(n) for _ in range(4))
    for k in range(rows - 1, -1, -1):
        own = x[reach - k : reach - k + n]
        np.add(total, own, out=total)
        np.subtract(own, mean, out=gap)
        if weights is None:
            np.divide(gap, float(rows - k), out=step)
        else:
            present = weights[reach - k : reach - k + n]
            np.add(count, present, out=count)
            np.multiply(gap, present, out=gap)
            np.divide(gap, np.maximum(count, 1.0, out=divisor), out=step)
        np.add(mean, step, out=mean)
        np.subtract(gap, step, out=step)
        np.multiply(gap, step, out=step)
        np.add(squares, step, out=squares)
    if weights is None:
        count[:] = rows


def _grown_masked(x, present, place, reach: int, rows: int, count, total, squares) -> None:
    """The same for frames of any values, cut by the start of their key."""
    n = len(total)
    mean = np.zeros(n)
    for k in range(rows - 1, -1, -1):
        own = x[reach - k : reach - k + n]
        seen = present[reach - k : reach - k + n] & (place > k)
        count += seen
        total += np.where(seen, own, 0.0)
        gap = np.where(seen, own - mean, 0.0)
        step = gap / np.maximum(count, 1.0)
        mean += step
        squares += gap * (gap - step)


# -- impute and scale -----------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnStatistics:
    """Fill value and scale of one feature; ``std`` is already safe to divide by."""

    impute_value: float
    mean: float = 0.0
    std: float = 1.0

    def apply(self, name: str, scaled: bool) -> Column:
        filled = F.coalesce(F.col(name), F.lit(self.impute_value))
        if scaled:
            filled = (filled - F.lit(self.mean)) / F.lit(self.std)
        return filled.alias(name)


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Most frequent value per column, the smallest on a tie.

    Values are counted in long form, so a frequent value is pre-aggregated in the map tasks and no
    reducer holds all values of a column.
    """
    values = long_form(df, columns).toDF("c", "v").where(F.col("v").isNotNull())
    rows = (
        values.groupBy("c", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("c")
        .agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))
        .collect()
    )
    found = {columns[r["c"]]: r["mode"] for r in rows}
    return {c: found.get(c) for c in columns}


def fit_columns(
    df: DataFrame, columns: Sequence[str], features: FeatureSpec
) -> dict[str, ColumnStatistics]:
    """Imputer and scaler statistics.

    The scaler sees imputed values, so its moments follow from those of the present values, their
    number and the fill value; no pass over imputed data is needed.
    """
    columns = list(columns)
    summaries = summarize(df, columns, moments=True)
    if features.imputation == "median":
        halves = {c: (0.5,) for c in columns}
        if features.quantiles == "approx":
            quantiles = approximate_quantiles(df, halves)
        else:
            quantiles = exact_quantiles(df, halves, summaries)
        fills = {c: q[0] for c, q in quantiles.items()}
    elif features.imputation == "mean":
        fills = {c: s.mean for c, s in summaries.items()}
    elif features.imputation == "constant":
        fills = {c: 0.0 for c in columns}
    else:
        fills = column_modes(df, columns)
    empty = [c for c in columns if fills[c] is None]
    if empty:
        raise ValueError(f"Columns without any value cannot be imputed: {empty}")

    found = {}
    for c, s in summaries.items():
        mean, variance = s.mean or 0.0, s.variance or 0.0
        missing, rows = s.rows - s.values, max(1, s.rows)
        if missing:
            joint = (s.values * mean + missing * fills[c]) / rows
            variance = (
                s.values * (variance + (mean - joint) ** 2) + missing * (fills[c] - joint) ** 2
            ) / rows
            mean = joint
        std = variance**0.5
        if std <= CONSTANT_SPREAD * max(1.0, abs(mean)):
            std = 1.0
        found[c] = ColumnStatistics(fills[c], mean, std)
    return found


def apply_columns(
    df: DataFrame, statistics: Mapping[str, ColumnStatistics], *, scaled: bool = True
) -> DataFrame:
    """Fill and scale in place, in one projection."""
    return df.select(
        *[
            statistics[c].apply(c, scaled) if c in statistics else F.col(c)
            for c in df.columns
        ]
    )


def _applied_after(function, statistics: Mapping[str, ColumnStatistics], scaled: bool):
    """What :func:`apply_columns` does, on the Arrow batches that ``function`` makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in function(batches):
            columns = []
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                if name in statistics:
                    s = statistics[name]
                    values = column.fill_null(s.impute_value).to_numpy(zero_copy_only=False)
                    column = pa.array((values - s.mean) / s.std if scaled else values)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


# -- estimator and model --------------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureEstimator:
    panel: PanelSpec
    features: FeatureSpec = FeatureSpec()

    def fit(self, df: DataFrame) -> FeatureModel:
        return self.fit_transform(df)[1]

    def fit_transform(self, df: DataFrame) -> tuple[DataFrame, FeatureModel]:
        """The scaled feature matrix of ``df`` and the statistics it was scaled with.

        The windowed frame is written once: its statistics and the final projection both read it. That of a
        bucketed panel is many times as wide as the panel and needs no exchange, so it is windowed again
        by each reader instead.
        """
        panel = as_panel(df, self.panel)
        base = self.panel.feature_columns(df)
        bounds = batch_bounds(panel, self.panel, base, self.features)
        history = add_history(winsorize(panel, bounds), self.panel, base, self.features, pruned=False)
        if STORED_PART not in panel.columns:
            history = materialize(history, "history", **{"parquet.block.size": str(ROW_GROUP_BYTES)})
        names = self.features.feature_names(base)
        statistics = fit_columns(history, names, self.features)
        model = FeatureModel(self.panel, self.features, tuple(base), bounds, statistics)
        return model.scale(history), model


def batch_bounds(panel: DataFrame, spec: PanelSpec, base, features: FeatureSpec) -> Bounds:
    columns = list(base)
    if spec.target and features.winsorize_target and spec.target in panel.columns:
        columns.append(spec.target)
    return winsor_bounds(panel, columns, features.winsor_lower, features.winsor_upper, features.quantiles)


@dataclass(frozen=True)
class FeatureModel:
    """Fitted statistics; ``transform`` applies them to another frame of the same layout."""

    panel: PanelSpec
    features: FeatureSpec
    base_features: tuple[str, ...]
    bounds: Bounds
    statistics: dict[str, ColumnStatistics]

    @property
    def fitted_columns(self) -> list[str]:
        return self.features.feature_names(self.base_features)

    def transform(
        self, df: DataFrame, carry: Sequence[str] = (), features: Sequence[str] | None = None
    ) -> DataFrame:
        """Scaled features of ``df`` with the stored fill values and scales.

        ``features`` names base features to build instead of all fitted ones, in their order here.

        Winsor bounds come from ``df`` itself unless the spec says ``bounds="fitted"``. The target
        may be absent. Columns in ``carry`` pass through.
        """
        if features is not None:
            unknown = sorted(set(features) - set(self.base_features))
            if unknown:
                raise ValueError(f"Not among the fitted features: {unknown}")
            names = self.features.feature_names(features)
            kept = {c: s for c, s in self.statistics.items() if c in names}
            part = dataclasses.replace(self, base_features=tuple(features), statistics=kept)
            return part.transform(df, carry)
        panel, spec = self._project(df, carry)
        return self.scale(add_history(panel, spec, self.base_features, self.features))

    def _project(self, df: DataFrame, carry: Sequence[str]) -> tuple[DataFrame, PanelSpec]:
        known = self.panel.target if self.panel.target in df.columns else None
        spec = PanelSpec(
            self.panel.date,
            self.panel.key,
            known,
            self.panel.tiebreak,
            self.panel.grain,
            self.base_features,
        )
        panel = as_panel(df, spec, carry)
        if self.features.bounds == "fitted":
            bounds = {c: b for c, b in self.bounds.items() if c in panel.columns}
        else:
            bounds = batch_bounds(panel, spec, self.base_features, self.features)
        return winsorize(panel, bounds), spec

    def scale(self, history: DataFrame) -> DataFrame:
        scaled = self.features.scaler == "standard"
        matrix, maker = apply_columns(history, self.statistics, scaled=scaled), maker_of(history)
        if maker is None:
            return matrix

        def made(names: Sequence[str]):
            source, function = maker(names)
            return source, _applied_after(function, {c: s for c, s in self.statistics.items() if c in names}, scaled)

        return made_of(matrix, made)

    def statistics_table(self, spark: SparkSession) -> DataFrame:
        """One row per winsorised or fitted column, in output order."""
        names = [*self.fitted_columns, *[c for c in self.bounds if c not in self.statistics]]
        rows = []
        for i, name in enumerate(names):
            s = self.statistics.get(name)
            low, high = self.bounds.get(name, (None, None))
            fitted = (s.impute_value, s.mean, s.std) if s else (None, None, None)
            rows.append((name, i, low, high, *fitted))
        return spark.createDataFrame(rows, STATISTICS_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.statistics_table(spark).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/statistics"
        )
        layout = {
            "panel": asdict(self.panel),
            "features": asdict(self.features),
            "base_features": list(self.base_features),
        }
        spark.createDataFrame([(json.dumps(layout, sort_keys=True),)], "value string").coalesce(
            1
        ).write.mode("overwrite").text(f"{path}/layout")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        layout = json.loads(spark.read.text(f"{path}/layout").first()[0])
        panel, features = dict(layout["panel"]), dict(layout["features"])
        panel["tiebreak"] = tuple(panel["tiebreak"])
        if panel["features"] is not None:
            panel["features"] = tuple(panel["features"])
        features["lags"] = tuple(features["lags"])
        features["rolling_windows"] = tuple(features["rolling_windows"])
        # One row per column of the feature matrix: bounded by its width.
        rows = spark.read.parquet(f"{path}/statistics").orderBy("ord").collect()
        return cls(
            PanelSpec(**panel),
            FeatureSpec(**features),
            tuple(layout["base_features"]),
            {r["feature"]: (r["lower"], r["upper"]) for r in rows if r["lower"] is not None},
            {
                r["feature"]: ColumnStatistics(r["impute_value"], r["mean"], r["std"])
                for r in rows
                if r["impute_value"] is not None
            },
        )
