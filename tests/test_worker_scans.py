"""Scans of features: made, summed up and counted in one Python worker, with the values of plain loops."""

import math

import numpy as np
import pyarrow as pa
import pytest

from panelwright.functions import quantiles as q
from panelwright.operators import features as ft
from panelwright.plans import jobs
from panelwright.spec import FeatureSpec, ModelSpec, PanelSpec, SplitSpec

SPEC = FeatureSpec(lags=(1, 4), rolling_windows=(2, 5, 9))


def test_walk_forward_moves_no_features(walk, monkeypatch):
    """No Arrow function but that of the windows meets features that another one made."""
    read, frame = [], type(walk[1])
    plain = frame.mapInArrow

    def recorded(self, function, schema, *args, **options):
        read.append(self.columns)
        return plain(self, function, schema, *args, **options)

    monkeypatch.setattr(frame, "mapInArrow", recorded)
    features, split = FeatureSpec(lags=(1,), rolling_windows=(3,)), SplitSpec(n_splits=2, test_size=20, gap=2)
    report = jobs.walk_forward(walk[1], PanelSpec(target="target"), split, features, [ModelSpec("elastic_net", {"alpha": 1e-3})])
    assert report.count() == 2
    assert len(read) > 6 and not [columns for columns in read if any("_lag_" in c or "_roll_" in c for c in columns)]


def plain_history(keys, x, place):
    """Count, sum and squared distances, row by row from the oldest; None for a missing value."""
    out = {}
    for k in SPEC.lags:
        out[f"x_lag_{k}"] = [x[i - k] if p > k else None for i, p in enumerate(place)]
    for w in SPEC.rolling_windows:
        means, stds = [], []
        for i, p in enumerate(place):
            n, total, mean, squares = 0.0, 0.0, 0.0, 0.0
            for v in x[i - min(p, w) + 1 : i + 1] if p else []:
                if v is not None:
                    n, total, gap = n + 1, total + v, v - mean
                    mean += gap / n
                    squares += gap * (gap - gap / n)
            means.append(total / n if n else None)
            stds.append(math.sqrt(squares / (n - 1)) if n > 1 else None)
        out[f"x_roll_mean_{w}"], out[f"x_roll_std_{w}"] = means, stds
    return out


@pytest.mark.parametrize("size", [1, 4, 13, 1000])
@pytest.mark.parametrize("gaps", [0.0, 0.3])
@pytest.mark.parametrize("great", [1.0, 1e200])
def test_history_is_that_of_plain_loops(monkeypatch, size, gaps, great):
    monkeypatch.setattr(ft, "_ROWS_AT_ONCE", size, raising=False)
    draw = np.random.default_rng(size)
    lengths = [1, 30, 0, 3, 1, 1, 12, 2, 44]  # 0: five rows without a key
    place = np.concatenate([np.arange(1, n + 1) if n else np.zeros(5, int) for n in lengths]).tolist()
    keys = np.repeat(np.arange(len(lengths)), [n or 5 for n in lengths])
    x = [None if draw.random() < gaps else float(v * great) for v in draw.normal(size=len(place)) * 10.0 ** draw.integers(-3, 4, len(place))]
    want = plain_history(keys, x, place)
    table = pa.table({"x": pa.array(x, pa.float64()), "_place": pa.array([p or None for p in place], pa.int32())})
    made = ft._history_of(["x"], SPEC, ["x", *want])(iter(table.to_batches(max_chunksize=size)))
    found = pa.Table.from_batches(list(made)).to_pydict()
    assert found.pop("x") == x
    for name, column in want.items():
        if great == 1.0 or "std" not in name:
            assert found[name] == column, name


def test_summaries_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1.0, None, -inf), (2.0, None, 3.0), (None, None, inf), (7.0, None, nan), (-4.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    found = q.summarize(df, ["a", "b", "c"], moments=True)
    assert found["a"] == q.Summary(5, 4, 1.5, 15.25, -4.0, 7.0)
    assert found["b"] == q.Summary(5, 0, None, None, None, None)
    c = found["c"]
    assert (c.rows, c.values, c.low, c.high, c.below, c.above) == (5, 4, 3.0, 3.0, 1, 1) and math.isnan(c.mean)
    assert q.summarize(df.limit(0), ["a"])["a"] == q.Summary()
