import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.operators import splits as sp
from panelwright.spec import PanelSpec, SplitSpec

PANEL = PanelSpec()


def days(rows, n, kind="date"):
    return rows("i int", [(i,) for i in range(n)]).select(
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).cast(kind).alias("date"),
        F.lit("a").alias("symbol"),
    )


@pytest.mark.parametrize("kind, grain", [("date", "day"), ("timestamp_ntz", "day"), ("timestamp_ntz", "instant")])
def test_fold_positions(rows, kind, grain):
    spec = PanelSpec(grain=grain)
    df = days(rows, 20, kind)
    folds = sp.walk_forward_folds(df.union(df), spec, SplitSpec(n_splits=2, test_size=5, gap=2))
    ranks = [(f.train_end_rank, f.valid_start_rank, f.valid_end_rank) for f in folds]
    assert ranks == [(8, 11, 15), (13, 16, 20)]
    assert folds[0].train_end.startswith("2020-01-08") and folds[1].valid_end.startswith("2020-01-20")
    assigned = sp.assign_folds(df, spec, folds).groupBy("fold_id", "role").count().collect()
    assert {(r[0], r[1]): r[2] for r in assigned} == {
        (0, "train"): 8, (0, "valid"): 5, (1, "train"): 13, (1, "valid"): 5,
    }
    assert sp.fold_filter(df, spec, folds[1], "valid").count() == 5
    assert sp.folds_table(df, spec, folds).schema["train_end"].dataType.simpleString() == kind


def test_no_fold_at_all_when_the_first_does_not_fit(rows):
    with pytest.raises(ValueError, match="leave no training date"):
        sp.walk_forward_folds(days(rows, 10), PANEL, SplitSpec(3, 3, 1))
    with pytest.raises(ValueError, match="n_splits"):
        sp.fold_ranks(10, SplitSpec(0, 3, 1))


def test_limited_training_days(rows):
    folds = sp.walk_forward_folds(days(rows, 20), PANEL, SplitSpec(2, 5, 2, max_train_days=6))
    assert [(f.train_start_rank, f.train_end_rank) for f in folds] == [(3, 8), (8, 13)]
    assert sp.fold_filter(days(rows, 20), PANEL, folds[0], "train").count() == 6


@pytest.mark.parametrize("kind", ["date", "timestamp_ntz", "timestamp"])
def test_trailing_window(rows, kind):
    got = sp.trailing_window(days(rows, 31, kind), PANEL, 21)
    assert got.count() == 22
    assert sp.trailing_window(days(rows, 0, kind), PANEL, 21).count() == 0


def test_cutoff_is_pushed_down(rows, tmp_path, spark):
    path = str(tmp_path / "t")
    days(rows, 31, "timestamp_ntz").write.parquet(path)
    plan = sp.trailing_window(spark.read.parquet(path), PANEL, 21)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2020-01-10" in text
    assert plan.agg(F.min("date")).first()[0] == dt.datetime(2020, 1, 10)


def test_days_with_times_of_day(rows):
    """Keys of a daily panel have their own times of day; a fold ends with its last day, not at midnight."""
    days_ = [(d, k) for d in range(20) for k in range(3)]
    df = rows("i int, symbol int", days_).select(
        (F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("symbol") * 7)).alias("date"),
        F.col("symbol").cast("string").alias("symbol"),
    )
    folds = sp.walk_forward_folds(df, PANEL, SplitSpec(n_splits=2, test_size=5, gap=2))
    assert [(f.train_end_rank, f.valid_start_rank, f.valid_end_rank) for f in folds] == [(8, 11, 15), (13, 16, 20)]
    got = sp.assign_folds(df, PANEL, folds).groupBy("fold_id", "role").count().collect()
    assert {(r.fold_id, r.role): r["count"] for r in got} == {(0, "train"): 24, (0, "valid"): 15, (1, "train"): 39, (1, "valid"): 15}
    for fold in folds:
        assert sp.fold_filter(df, PANEL, fold, "train").count() == 3 * fold.train_end_rank
        assert sp.fold_filter(df, PANEL, fold, "valid").count() == 15
