"""Parameter objects shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows one task is asked to sort and window at most; longer keys are cut into blocks.
ROWS_PER_BLOCK = 2_000_000

#: Column of a bucketed panel that parts the rows without a key; no feature.
STORED_PART = "_stored_part"


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of a panel.

    ``grain="day"`` states that there is one row per key and calendar day. The calendar then bounds
    every key (36,525 rows a century), so a key always fits one task. ``grain="instant"`` promises
    nothing about the length of a key; operators measure it and cut long keys into blocks.
    """

    date: str = "date"
    key: str = "symbol"
    target: str | None = None
    tiebreak: tuple[str, ...] = ()
    grain: str = "day"
    features: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.grain not in ("day", "instant"):
            raise ValueError(f"grain must be 'day' or 'instant', not {self.grain!r}")

    @property
    def order(self) -> list[str]:
        return [self.date, *self.tiebreak]

    @property
    def roles(self) -> list[str]:
        return [self.date, self.key, *self.tiebreak, *([self.target] if self.target else [])]

    def feature_columns(self, df: DataFrame) -> list[str]:
        """Numeric columns without a role, in source order; a schema lookup, no job."""
        if self.features is not None:
            require_columns(df, self.features)
            return list(self.features)
        return [
            f.name
            for f in df.schema.fields
            if f.name not in (*self.roles, STORED_PART) and isinstance(f.dataType, T.NumericType)
        ]


@dataclass(frozen=True)
class FeatureSpec:
    """Feature engineering parameters; the defaults are fixed values."""

    lags: tuple[int, ...] = (1, 5, 21)
    rolling_windows: tuple[int, ...] = (5, 21, 63)
    winsor_lower: float = 0.01
    winsor_upper: float = 0.99
    imputation: str = "median"
    scaler: str = "standard"
    winsorize_target: bool = True
    #: "batch" recomputes winsor bounds on every frame, "fitted" reuses those of the training frame.
    bounds: str = "batch"
    rows_per_block: int = ROWS_PER_BLOCK
    #: "exact" quantiles are interpolated, "approx" ones come from one scan with a bounded rank error.
    quantiles: str = "exact"

    def __post_init__(self) -> None:
        if self.imputation not in ("median", "mean", "most_frequent", "constant"):
            raise ValueError(f"Unsupported imputation strategy: {self.imputation}")
        if self.bounds not in ("batch", "fitted"):
            raise ValueError(f"Unsupported bounds mode: {self.bounds}")
        if self.quantiles not in ("exact", "approx"):
            raise ValueError(f"Unsupported quantile method: {self.quantiles}")

    @property
    def lookback(self) -> int:
        """Preceding rows of a key that a feature of the current row can depend on."""
        return max([0, *self.lags, *(w - 1 for w in self.rolling_windows)])

    def feature_names(self, base: Sequence[str]) -> list[str]:
        """Names in output order: base, lags (lag outer), rolling (window outer, mean before std)."""
        lags = [f"{c}_lag_{k}" for k in self.lags for c in base]
        rolls = [
            f"{c}_roll_{stat}_{w}"
            for w in self.rolling_windows
            for c in base
            for stat in ("mean", "std")
        ]
        return [*base, *lags, *rolls]


@dataclass(frozen=True)
class SplitSpec:
    """Walk-forward split: ``n_splits`` validation blocks of ``test_size`` dates after a gap (fixed values)."""

    n_splits: int = 5
    test_size: int = 20
    gap: int = 5
    max_train_days: int | None = None


@dataclass(frozen=True)
class ModelSpec:
    """Model kind and parameters; the default penalty is a fixed value."""

    type: str = "elastic_net"
    params: dict[str, Any] = field(default_factory=lambda: {"alpha": 0.5, "l1_ratio": 0.5})
    seed: int = 42


@dataclass(frozen=True)
class StrategySpec:
    """Position limits, turnover penalty and volatility cap (fixed values)."""

    leverage_min: float = 0.0
    leverage_max: float = 2.0
    turnover_penalty: float = 0.05
    volatility_cap: float = 0.03


@dataclass(frozen=True)
class ServingSpec:
    """Days of the inference window (fixed value) and what is cut to it."""

    feature_window_days: int = 21
    #: "trimmed" cuts history before building features, "full" builds features first.
    history: str = "trimmed"

    def __post_init__(self) -> None:
        if self.history not in ("trimmed", "full"):
            raise ValueError(f"Unsupported history mode: {self.history}")


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    """Raise ``ValueError`` naming, sorted, every required column that is absent."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def clean_double(name: str, data_type: T.DataType) -> Column:
    """The column as DOUBLE with NaN turned into NULL, since Spark aggregates let NaN win."""
    c = F.col(name)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    return c.cast("double").alias(name)


def as_panel(df: DataFrame, spec: PanelSpec, carry: Sequence[str] = ()) -> DataFrame:
    """Role columns plus numeric features, all measures DOUBLE and NaN-free, in one projection.

    ``carry`` names further columns that pass through untouched.
    """
    require_columns(df, [*spec.roles, *carry])
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = [spec.date, spec.key, *spec.tiebreak, *carry]
    if STORED_PART in df.columns and spec.grain == "day":
        keys.append(STORED_PART)
    measures = [*([spec.target] if spec.target else []), *spec.feature_columns(df)]
    return df.select(*keys, *[clean_double(c, types[c]) for c in measures if c not in carry])
