"""Keyed state of a stream: bounded cost, late rows, replays, errors."""

import dataclasses
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.plans import jobs
from panelwright.sources.artifacts import load_artifacts
from panelwright.spec import FeatureSpec, ModelSpec, PanelSpec
from panelwright.streaming import scoring
from panelwright.streaming.state import KeyedState

PANEL = PanelSpec(target="target", features=("x",))
FEATURES = FeatureSpec(lags=(1, 2), rolling_windows=(3,))
SCHEMA = "date timestamp_ntz, symbol string, x double, target double"
START = dt.datetime(2024, 1, 1)


def panel_rows(keys, days, seed=1):
    rng = np.random.default_rng(seed)
    return [(START + dt.timedelta(days=d), k, float(rng.normal()), float(rng.normal() / 50)) for d in days for k in keys]


@pytest.fixture(scope="module")
def artifacts(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("model"))
    rows = spark.createDataFrame(panel_rows("ABCD", range(60)), SCHEMA)
    jobs.train(rows, PANEL, out, FEATURES, ModelSpec("elastic_net", {"alpha": 1e-5, "l1_ratio": 0.5}))
    return load_artifacts(spark, f"{out}/artifacts")


def whole_scores(artifacts, df):
    fitted = dataclasses.replace(artifacts.features, features=dataclasses.replace(FEATURES, bounds="fitted"))
    return {(r.symbol, r.date): r.prediction for r in artifacts.predict(fitted.transform(df)).collect()}


def last_scores(spark, path):
    got = scoring.read_scores(spark, path, PANEL).collect()
    assert len({(r.symbol, r.date) for r in got}) == len(got)
    return {(r.symbol, r.date): r.prediction for r in got}


def test_cost_of_a_batch_does_not_grow(spark, artifacts, tmp_path):
    """Every batch brings a day of two of forty keys; files and rows it reads stay the same."""
    keys = [f"K{i}" for i in range(40)]
    path, out = str(tmp_path / "state"), str(tmp_path / "scores")
    scoring.seed_history(spark.createDataFrame(panel_rows(keys, range(30)), SCHEMA), path)
    handle = scoring.score_batches(artifacts, path, out, late_days=3, n_buckets=16)
    state = KeyedState(path, PANEL, FEATURES.lookback, 3, 16)
    files, held, everything = [], [], spark.createDataFrame(panel_rows(keys, range(30)), SCHEMA)
    for n in range(7):
        batch = spark.createDataFrame(panel_rows(keys[:2], [30 + n], seed=n), SCHEMA)
        everything = everything.union(batch)
        handle(batch, n)
        kept = state.read(spark, state.manifest(spark, n), state.buckets_of(batch), batch.schema)
        files.append(len(kept.inputFiles()))
        held.append(kept.count())
        assert kept.groupBy("symbol").count().agg(F.max("count")).first()[0] <= 3 + 1 + FEATURES.lookback
    assert files[1:] == [files[1]] * 6 and held[1:] == [held[1]] * 6
    versions = state.latest(spark).versions
    assert sum(v == scoring.SEED for v in versions.values()) >= 10  # buckets of other keys were never touched
    want = whole_scores(artifacts, everything)
    got = last_scores(spark, out)
    assert len(got) == 14 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
    left = [p.name for p in (tmp_path / "state" / "manifest").iterdir()]
    assert sorted(left) == ["batch=5", "batch=6"]


def test_late_row_rescores_the_rows_whose_windows_hold_it(spark, artifacts, tmp_path):
    rows = panel_rows("AB", range(20))
    late = [r for r in rows if r[1] == "A" and r[0] == START + dt.timedelta(days=12)]
    path, out = str(tmp_path / "state"), str(tmp_path / "scores")
    handle = scoring.score_batches(artifacts, path, out, late_days=10)
    handle(spark.createDataFrame([r for r in rows if r not in late], SCHEMA), 0)
    handle(spark.createDataFrame(late, SCHEMA), 1)
    again = scoring.read_scores(spark, out).where("batch = 1").orderBy("date").collect()
    assert [(r.symbol, (r.date - START).days) for r in again] == [("A", 12 + i) for i in range(1 + FEATURES.lookback)]
    want, got = whole_scores(artifacts, spark.createDataFrame(rows, SCHEMA)), last_scores(spark, out)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_replayed_batches_and_keyless_rows(spark, artifacts, tmp_path):
    rows = panel_rows("ABC", range(12)) + [(START + dt.timedelta(days=d), None, 1.0, 0.0) for d in range(3)]
    path, out = str(tmp_path / "state"), str(tmp_path / "scores")
    handle = scoring.score_batches(artifacts, path, out, n_buckets=4)
    parts = [[r for r in rows if lo <= (r[0] - START).days < lo + 4] for lo in (0, 4, 8)]
    for n, part in enumerate(parts):
        handle(spark.createDataFrame(part, SCHEMA), n)
        first = sorted(map(str, scoring.read_scores(spark, out).where(f"batch = {n}").collect()))
        handle(spark.createDataFrame(part, SCHEMA), n)  # after a crash
        assert sorted(map(str, scoring.read_scores(spark, out).where(f"batch = {n}").collect())) == first
    handle(spark.createDataFrame([], SCHEMA), 3)  # an empty batch carries the state on
    handle(spark.createDataFrame(panel_rows("A", [12]), SCHEMA), 4)
    want = whole_scores(artifacts, spark.createDataFrame(rows + panel_rows("A", [12]), SCHEMA))
    got = last_scores(spark, out)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_a_state_that_does_not_fit_is_an_error(spark, artifacts, tmp_path):
    path, out = str(tmp_path / "state"), str(tmp_path / "scores")
    scoring.seed_history(spark.createDataFrame(panel_rows("A", range(5)), SCHEMA).drop("x"), path)
    with pytest.raises(Exception, match="x"):
        scoring.score_batches(artifacts, path, out)(spark.createDataFrame(panel_rows("A", [6]), SCHEMA), 0)
    good = str(tmp_path / "good")
    scoring.score_batches(artifacts, good, out)(spark.createDataFrame(panel_rows("A", [6]), SCHEMA), 0)
    with pytest.raises(ValueError, match="buckets"):
        scoring.score_batches(artifacts, good, out, n_buckets=8)(spark.createDataFrame(panel_rows("A", [7]), SCHEMA), 1)


def test_instants_with_a_hot_key(spark, artifacts, tmp_path):
    """The features of a long key are built in blocks; ties are ordered by the tiebreak."""
    panel = PanelSpec(target="target", features=("x",), grain="instant", tiebreak=("n",))
    spec = dataclasses.replace(FEATURES, rows_per_block=20)
    model = dataclasses.replace(artifacts.features, panel=panel, features=spec)
    hot = dataclasses.replace(artifacts, features=model)
    rng = np.random.default_rng(5)
    rows = [(START + dt.timedelta(seconds=int(i) // 2), "hot" if i % 3 else f"k{i % 4}", float(rng.normal()), 0.0, i) for i in range(200)]
    schema = SCHEMA + ", n int"
    path, out = str(tmp_path / "state"), str(tmp_path / "scores")
    handle = scoring.score_batches(hot, path, out, late_days=0)
    for n in range(4):
        handle(spark.createDataFrame(rows[50 * n : 50 * n + 50], schema), n)
    fitted = dataclasses.replace(model, features=dataclasses.replace(spec, bounds="fitted"))
    want = {r.n: r.prediction for r in hot.predict(fitted.transform(spark.createDataFrame(rows, schema))).collect()}
    got = {r.n: r.prediction for r in scoring.read_scores(spark, out, panel).collect()}
    assert got == pytest.approx(want, abs=1e-12)
