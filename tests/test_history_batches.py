"""Features made of Arrow batches are those of the key windows, across batches, keys, NULLs and blocks."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import features as ft
from panelwright.spec import FeatureSpec, PanelSpec

SPEC = FeatureSpec(lags=(1, 3), rolling_windows=(2, 7))


@pytest.fixture
def ragged(spark):
    draw = np.random.default_rng(5)
    rows = []
    for key, length in (("A", 40), ("B", 1), ("C", 25), (None, 6), ("D", 9)):
        for i in range(length):
            x = None if draw.random() < 0.2 else float(draw.normal() * 1e6) if key != "D" else 0.1
            rows.append((datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), key, i, x, float(i) if i % 11 else float("inf")))
    return spark.createDataFrame(rows, "date timestamp_ntz, symbol string, id long, x double, y double")


def values(df):
    names = [c for c in df.columns if "lag" in c or "roll" in c]
    rows = df.orderBy(F.col("symbol").asc_nulls_first(), "date").select("symbol", "id", *names).collect()
    return [tuple("nan" if isinstance(v, float) and v != v else v for v in r) for r in rows]


@pytest.mark.parametrize("grain, block", [("day", 2_000_000), ("instant", 10)])
@pytest.mark.parametrize("batch", ["4", "10000"])
def test_batches_equal_windows(spark, ragged, grain, block, batch):
    panel = PanelSpec(grain=grain, features=("x", "y"))
    spec = FeatureSpec(SPEC.lags, SPEC.rolling_windows, rows_per_block=block)
    native = ft.add_history(ragged, panel, ["x", "y"], spec)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        made = ft.add_history(ragged, panel, ["x", "y"], spec, pruned=False)
        assert made.columns == native.columns and made.schema.simpleString() == native.schema.simpleString()
        assert values(made) == values(native)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fitting_makes_no_sliding_frames(spark, ragged):
    """Each row of a frame was an update of each statistic, 534 of them for a row of three features."""
    panel = PanelSpec(features=("x",))
    plan = ft.add_history(ragged, panel, ["x"], FeatureSpec(), pruned=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev_samp" not in plan and "row_number" in plan
