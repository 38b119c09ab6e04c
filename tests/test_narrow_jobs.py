"""Jobs on a daily panel store the panel and what leaves them, not the features in between."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.catalog.queries import rounded
from panelwright.operators import boosting as bo
from panelwright.operators import features as ft
from panelwright.plans import jobs
from panelwright.spec import FeatureSpec, ModelSpec, PanelSpec, SplitSpec

PANEL = PanelSpec(target="target")
SMALL = FeatureSpec(lags=(1,), rolling_windows=(3,))
GRID = [ModelSpec("elastic_net", {"alpha": a, "l1_ratio": 0.5}) for a in (1e-3, 1e-2)]
SPLIT = SplitSpec(n_splits=2, test_size=20, gap=2)


@pytest.fixture
def stored(monkeypatch):
    """Label and columns of every table that a job or the feature estimator stores."""
    kept, plain = [], ft.materialize

    def recorded(df, label="step"):
        kept.append((label, df.columns))
        return plain(df, label)

    monkeypatch.setattr(ft, "materialize", recorded)
    monkeypatch.setattr(jobs, "materialize", recorded)
    return kept


def test_walk_forward_stores_no_features(walk, stored):
    report = jobs.walk_forward(walk[1], PANEL, SPLIT, SMALL, GRID)
    assert report.count() == 4
    assert not [label for label, columns in stored if any("_lag_" in c or "_roll_" in c for c in columns)]
    scored = [columns for label, columns in stored if label == "scored"]
    assert scored == [["date", "symbol", "target", "prediction_0", "prediction_1"]] * 2


def test_models_of_many_passes_read_a_stored_matrix(walk, stored):
    trees = ModelSpec("lightgbm", {"n_estimators": 1, "num_leaves": 2})
    jobs.walk_forward(walk[1], PANEL, SPLIT, SMALL, [trees]).count()
    assert [label for label, _ in stored].count("train") == 2


def test_training_matrix_is_the_one_wide_table(walk, stored, tmp_path, monkeypatch):
    plans, plain = {}, jobs.write_panel

    def recorded(df, path, *args, **options):
        plans[path.split("/")[-1]] = df._jdf.queryExecution().executedPlan().toString(), options.get("gather", True)
        plain(df, path, *args, **options)

    monkeypatch.setattr(jobs, "write_panel", recorded)
    jobs.train(walk[1], PANEL, str(tmp_path), SMALL, GRID[0])
    plan, gathered = plans["feature_matrix"]
    assert "Exchange" not in plan and not gathered
    assert "history" not in [label for label, _ in stored]


@pytest.mark.parametrize("rows", [0, 1, 70_000])
def test_packed_rows_come_back(rows):
    bins = np.random.default_rng(3).integers(0, 60_000, (rows, 5)).astype(np.uint16)
    batch = pa.RecordBatch.from_arrays([bo._packed(bins)], ["bins"])
    assert np.array_equal(bo._bins_of(batch, 5), bins)
    if rows > 9:
        assert np.array_equal(bo._bins_of(batch.slice(3, 6), 5), bins[3:9])
    parts = [batch.slice(i, 1000) for i in range(0, rows, 1000)]
    joined = list(bo._gathered(iter(parts)))
    assert len(joined) <= 3 and all(len(b) <= bo.BATCH_ROWS for b in joined)
    assert np.array_equal(np.concatenate([bo._bins_of(b, 5) for b in joined] or [bins]), bins)


def test_leaves_of_rows():
    tree = bo.Tree()
    first = tree.split(0, 1, 4, 1.0)
    second = tree.split(first + 1, 0, 7, 1.0)
    bins = np.random.default_rng(4).integers(0, 10, (20_000, 2)).astype(np.uint16)
    want = [first if b <= 4 else second + (a > 7) for a, b in bins.tolist()]
    assert tree.leaf_of(bins).tolist() == want
    assert bo.Tree().leaf_of(bins).tolist() == [0] * len(bins)
    assert tree.leaf_of(bins[:0]).tolist() == []


@pytest.mark.parametrize("digits", [2, 4, 8])
def test_rounding_by_arithmetic_is_that_of_spark(spark, digits):
    draw = np.random.default_rng(6)
    values = np.concatenate([draw.normal(size=3000) * 10.0 ** draw.integers(-9, 18, 3000), draw.integers(-9999, 9999, 2000) / 10.0 ** (digits + 1), [0.0, -0.0, 1e300, -5e-324]])
    data = [(float(v),) for v in values] + [(None,), (math.nan,), (math.inf,), (-math.inf,)]
    df = spark.createDataFrame(data, "x double")
    shifted = F.col("x") + F.lit(10.0 ** -(digits + 4))
    old = df.select("x", (F.round(shifted, digits) + F.lit(0.0)).alias("old"))
    pairs = rounded(old.select(F.col("x"), F.col("old").cast("string")), digits).collect()
    assert len(pairs) == len(data)
    assert [p for p in pairs if repr(p["x"]) != ("None" if p["old"] is None else repr(float(p["old"])).lower())] == []
    plan = rounded(df, digits)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rint" in plan
