"""Boosted trees read their blocks a few at a time, and of two children the smaller one."""

import numpy as np
import pytest

from panelwright.operators import boosting as bo
from panelwright.operators.features import FeatureEstimator
from panelwright.plans import jobs
from panelwright.session import at_most
from panelwright.spec import FeatureSpec, PanelSpec, as_panel

BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(9)
    rows = [(float(a), float(b), float(np.sin(a) + (b > 3) + 0.1 * e)) for a, b, e in zip(draw.integers(0, 30, 900), draw.integers(0, 9, 900), draw.normal(size=900))]
    return spark.createDataFrame(rows, "a double, b double, y double").repartition(3)


def test_blocks_are_read_a_few_at_a_time(spark, table, monkeypatch):
    """Spark's 4,096 rows of a reader and 10,000 of an Arrow batch would be GB of blocks."""
    seen, stored, grow, plain = [], [], bo._grow, bo.materialize
    monkeypatch.setattr(bo, "_grow", lambda *a: seen.append((int(spark.conf.get(BYTES)), int(spark.conf.get(BATCH)))) or grow(*a))
    monkeypatch.setattr(bo, "materialize", lambda df, label: stored.append(plain(df, label)) or stored[-1])
    before = spark.conf.get(BYTES, None), spark.conf.get(BATCH, None)
    bo.boost(table, ["a", "b"], "y", bo.BoostingSpec(n_estimators=2, num_leaves=3))
    assert (spark.conf.get(BYTES, None), spark.conf.get(BATCH, None)) == before
    block = bo.BLOCK_ROWS * (8 + 8 + 2)
    assert len(seen) == 2 and all(most <= 64 << 20 and rows * block <= 64 << 20 for most, rows in seen)
    # A byte for a bin, none for the number of a row that no sample asks for.
    sizes = stored[0].selectExpr("sum(length(key))", "sum(length(y))", "sum(length(bins))").first()
    assert tuple(sizes) == (0, 8 * 900, 2 * 900)
    bo.boost(table, ["a", "b"], "y", bo.BoostingSpec(n_estimators=1, num_leaves=3, subsample=0.5))
    assert stored[-1].selectExpr("sum(length(key))").first()[0] == 8 * 900


def test_limits_of_overlapping_blocks(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    first, second = (at_most(spark, spark__sql__parquet__columnarReaderBatchSize=n) for n in (500, 64))
    before = spark.conf.get(name)
    first.__enter__(), second.__enter__()
    assert spark.conf.get(name) == "64"
    first.__exit__(None, None, None)
    assert spark.conf.get(name) == "64"
    second.__exit__(None, None, None)
    assert spark.conf.get(name) == before
    spark.conf.set(name, "32")
    try:
        with pytest.raises(ValueError), at_most(spark, spark__sql__parquet__columnarReaderBatchSize=64):
            assert spark.conf.get(name) == "32"
            raise ValueError
        assert spark.conf.get(name) == "32"
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("changes", [{}, {"max_depth": 3}, {"subsample": 0.7, "colsample_bytree": 0.5}, {"reg_alpha": 1.0, "reg_lambda": 2.0}])
def test_trees_of_smaller_children_are_those_of_all(table, monkeypatch, changes):
    """Histograms kept by the driver, and none kept: the same trees, with half the leaves read after the first one."""
    spec = bo.BoostingSpec(n_estimators=3, num_leaves=9, min_child_samples=5, **changes)
    read, histograms = [], bo._histograms
    monkeypatch.setattr(bo, "_histograms", lambda *a: read.append(len(a[4])) or histograms(*a))
    kept, error = bo.boost(table, ["a", "b"], "y", spec)
    half = read[:]
    read.clear()
    monkeypatch.setattr(bo, "HELD_BYTES", 0)
    assert bo.boost(table, ["a", "b"], "y", spec) == (kept, error)
    assert len(half) == len(read) and sum(2 * n - (n == 1 and i == 0) for i, n in enumerate(half)) >= sum(read) > sum(half)


def test_rows_of_other_leaves_are_left_out():
    tree = bo.Tree()
    first = tree.split(0, 0, 4, 1.0)
    second = tree.split(first + 1, 1, 2, 1.0)
    bins = np.random.default_rng(2).integers(0, 10, (500, 2)).astype(np.uint8)
    whole = tree.leaf_of(bins)
    assert np.array_equal(tree.leaf_of(bins, [second]) == second, whole == second)
    assert not (tree.leaf_of(bins, [second]) == first).any()


def test_trees_on_a_bucketed_panel_read_no_stored_features(spark, walk, tmp_path, monkeypatch):
    """The features go from the worker that makes them into sketches and blocks, and the trees are those of a stored matrix."""
    read, frame = [], type(walk[1])
    plain = frame.mapInArrow

    def recorded(self, function, schema, *args, **options):
        read.append(self.columns)
        return plain(self, function, schema, *args, **options)

    monkeypatch.setattr(frame, "mapInArrow", recorded)
    panel = PanelSpec(target="target")
    table = jobs.bucketed(as_panel(walk[1], panel), panel)
    matrix, model = FeatureEstimator(panel, FeatureSpec(lags=(1,), rolling_windows=(3,))).fit_transform(table)
    names, spec = model.fitted_columns, bo.BoostingSpec(n_estimators=2, num_leaves=5)
    fit, error = bo.boost(matrix, names, "target", spec)
    assert len(read) > 4 and not [columns for columns in read if any("_lag_" in c or "_roll_" in c for c in columns)]
    matrix.write.parquet(str(tmp_path / "matrix"))
    again, same_error = bo.boost(spark.read.parquet(str(tmp_path / "matrix")), names, "target", spec)
    assert fit == again and error == pytest.approx(same_error, rel=1e-9)
