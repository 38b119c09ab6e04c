import dataclasses
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import models as md
from panelwright.operators.features import FeatureEstimator
from panelwright.plans import jobs
from panelwright.sources.artifacts import load_artifacts
from panelwright.sources.readers import explode_payloads, load_panel, read_csv
from panelwright.sources.writers import read_written, write_metrics, write_panel
from panelwright.spec import (
    FeatureSpec,
    ModelSpec,
    PanelSpec,
    ServingSpec,
    SplitSpec,
    StrategySpec,
)
from panelwright.streaming import scoring

PANEL = PanelSpec(target="target")
SMALL = FeatureSpec(lags=(1,), rolling_windows=(3,))
LIGHT = ModelSpec("elastic_net", {"alpha": 1e-3, "l1_ratio": 0.5})


def coordinate_descent(x, y, alpha, l1_ratio, rounds=3000):
    """Elastic net on columns divided by their population deviation; an independent solver."""
    x = x / x.std(axis=0)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    n, p = x.shape
    w = np.zeros(p)
    for _ in range(rounds):
        for j in range(p):
            rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (
                xc[:, j] @ xc[:, j] / n + alpha * (1 - l1_ratio)
            )
    return w


@pytest.mark.parametrize("solver", ["moments", "l-bfgs"])
@pytest.mark.parametrize("alpha, l1_ratio", [(0.5, 0.5), (0.05, 0.9), (0.0, 0.5)])
def test_elastic_net_matches_coordinate_descent(spark, alpha, l1_ratio, solver):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) * [1.0, 2.0, 0.5, 3.0] + 1.0
    y = x @ [1.0, -0.7, 0.0, 0.1] + rng.normal(scale=0.3, size=300)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], [*names, "y"])
    trained = md.train_model(
        ModelSpec("elastic_net", {"alpha": alpha, "l1_ratio": l1_ratio, "solver": solver}), df, names, "y"
    )
    want = coordinate_descent(x, y, alpha, l1_ratio)
    weights, intercept = md.linear_weights(trained.pipeline)
    assert np.allclose([weights[n] for n in names] * x.std(axis=0), want, atol=1e-6)
    fitted = x @ [weights[n] for n in names] + intercept
    assert trained.rmse == pytest.approx(np.sqrt(((y - fitted) ** 2).mean()))
    by_column = trained.predict(df).select("prediction").toPandas()["prediction"]
    assert np.allclose(fitted, by_column)
    assert md.optimality_gaps(df, trained, "y", alpha, l1_ratio).agg(F.max("gap")).first()[0] < 1e-6


def test_parameters_are_not_ignored(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "x double, y double")
    for kind, params in (
        ("gbt", {"num_leaves": 31}), ("gbt", {"max_depth": -1}), ("gbt", {"max_depth": 31}), ("gbt", {"reg_alpha": 1.0}),
        ("elastic_net", {"alhpa": 1.0}), ("elastic_net", {"solver": "magic"}),
    ):
        with pytest.raises(ValueError):
            md.train_model(ModelSpec(kind, params), df, ["x"], "y")


def test_wide_linear_model(spark):
    names = [f"f{i}" for i in range(2000)]
    df = spark.createDataFrame([tuple(float(i % 7) for i in range(2000))], ", ".join(f"{n} double" for n in names))
    weights = tuple(0.5 + i for i in range(2000))
    got = md.predict(md.LinearFit(tuple(names), weights, (1.0,) * 2000, 3.0), df).select("prediction").first()[0]
    assert got == pytest.approx(3.0 + sum(w * (i % 7) for i, w in enumerate(weights)))


def test_nulls_are_refused_in_training(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "x double, y double")
    with pytest.raises(ValueError, match="NULL"):
        md.train_model(ModelSpec(), df, ["x"], "y")


def test_unknown_model(spark):
    with pytest.raises(ValueError, match="forest"):
        md.build_model(ModelSpec("forest"), spark.range(1), ["id"], "id")


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    rng = np.random.default_rng(7)
    data = []
    for s in ("A", "B", "C"):
        x = rng.normal(size=200).cumsum()
        for i in range(200):
            volume = float(rng.integers(1, 9))
            target = 0.8 + 0.2 * (volume - 4.5) + 0.1 * rng.normal()
            data.append((i, s, float(x[i]), volume, float(target)))
    df = spark.createDataFrame(data, "i int, symbol string, close double, volume double, target double")
    df = df.select(
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).cast("timestamp_ntz").alias("date"),
        "symbol", "close", "volume", "target",
    )
    out = str(tmp_path_factory.mktemp("train"))
    split = F.lit("2020-05-30").cast("timestamp_ntz")
    history, holdout = df.where(F.col("date") < split), df.where(F.col("date") >= split)
    return out, jobs.train(history, PANEL, out, SMALL, LIGHT), history, holdout


def test_train_leaves_its_artifacts(spark, trained):
    out, model, history, _ = trained
    assert read_written(spark, f"{out}/processed/feature_matrix").count() == history.count()
    assert read_written(spark, f"{out}/processed/cleaned_train").count() == history.count()
    metrics = spark.read.json(f"{out}/artifacts/metadata/training_statistics").first()
    assert metrics["training"]["rmse"] == model.rmse
    names = spark.read.json(f"{out}/artifacts/metadata/feature_list").first()["features"]
    assert names == list(model.features)
    assert model.rmse < history.agg(F.stddev_pop("target")).first()[0]


def test_backtest_and_scores(spark, trained):
    out, _, _, holdout = trained
    report = jobs.backtest(holdout, f"{out}/artifacts").first()
    held = jobs.positions(holdout, load_artifacts(spark, f"{out}/artifacts"), StrategySpec()).toPandas()
    held = held.sort_values(["date", "symbol"])
    pnl = held["position"] * held["target"]
    equity = pnl.cumsum()
    assert held["position"].gt(0).any() and held["position"].between(0, 2).all()
    assert report["total_return"] == pytest.approx(equity.iloc[-1])
    assert report["hit_rate"] == pytest.approx((pnl > 0).mean())
    assert report["max_drawdown"] == pytest.approx((equity / equity.cummax() - 1).min())
    by_key = jobs.backtest(holdout, f"{out}/artifacts", by="symbol")
    assert by_key.agg(F.sum("total_return")).first()[0] == pytest.approx(report["total_return"])
    trimmed = jobs.score(holdout, f"{out}/artifacts")
    full = jobs.score(holdout, f"{out}/artifacts", ServingSpec(history="full"))
    assert trimmed.columns == ["date", "symbol", "prediction"]
    assert trimmed.count() == full.count() == 3 * 22
    assert jobs.score(holdout.drop("target"), f"{out}/artifacts").count() == 3 * 22


def test_missing_artifacts(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="train first"):
        load_artifacts(spark, str(tmp_path / "none"))


def test_unused_features_are_not_computed(spark, trained):
    """With every weight at zero the forecast needs no window at all."""
    _, _, history, holdout = trained
    matrix, features = FeatureEstimator(PANEL, SMALL).fit_transform(history)
    heavy = md.train_model(ModelSpec("elastic_net", {"alpha": 50.0}), matrix, features.fitted_columns, "target")
    plan = heavy.predict(features.transform(holdout)).select("date", "symbol", "prediction")
    assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_search_over_folds(trained):
    _, _, history, _ = trained
    best = jobs.search(history, PANEL, SplitSpec(1, 20, 2), [1e-3, 50.0], [0.5], SMALL)
    rows = best.collect()
    assert {r["alpha"] for r in rows} == {1e-3, 50.0} and all(r["n_folds"] == 1 for r in rows)


def test_boosted_trees(trained):
    _, _, history, _ = trained
    matrix, features = FeatureEstimator(PANEL, SMALL).fit_transform(history)
    spec = ModelSpec("lightgbm", {"n_estimators": 3, "max_depth": 2})
    model = md.train_model(spec, matrix, features.fitted_columns, "target")
    assert model.predict(matrix).columns[-1] == "prediction"
    assert model.rmse < history.agg(F.stddev_pop("target")).first()[0]


def test_payload_rows_and_errors(rows):
    fields = {"date": "string", "symbol": "string", "close": "double"}
    good = {"date": ["2020-01-01", "2020-01-02 03:04:05.000006"], "symbol": ["a", "b"], "close": [1.0, None]}
    got = explode_payloads(rows("payload string", [(json.dumps(good),)]), "payload", fields).collect()
    assert len(got) == 2 and got[1]["date"].microsecond == 6 and got[1]["close"] is None
    for bad in ({**good, "close": [1.0]}, {"date": good["date"]}):
        with pytest.raises(Exception, match="differ in length"):
            explode_payloads(rows("payload string", [(json.dumps(bad),)]), "payload", fields).collect()


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text("date,symbol,close,target\n2020-01-01,a,1.5,0.1\n2020-01-02,a,,NaN\n")
    df = load_panel(spark, str(path), PANEL)
    assert df.schema["date"].dataType.simpleString() in ("date", "timestamp_ntz")
    assert [r["close"] for r in df.orderBy("date").collect()] == [1.5, None]
    assert df.where("target IS NULL").count() == 1
    with pytest.raises(ValueError, match=r"\['excess'\]"):
        load_panel(spark, str(path), PanelSpec(target="excess"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_csv(spark, str(tmp_path / "absent.csv"))


def test_metrics_keep_sorted_keys(spark, rows, tmp_path):
    path = str(tmp_path / "m")
    write_metrics(rows("b double, a double", [(1.0, None)]), path)
    line = spark.read.text(path).first()[0]
    assert line == '{"a":null,"b":1.0}'


def test_written_panel_prunes_by_bucket(spark, trained, tmp_path):
    _, _, history, _ = trained
    path = str(tmp_path / "panel")
    write_panel(history, path, PANEL, bucket="month")
    one = spark.read.parquet(path).where("date_bucket = '2020-02'")
    assert one.count() == 3 * 29
    assert "PartitionFilters: [isnotnull(date_bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_streaming_with_sparse_keys_and_no_seed(spark, trained, tmp_path):
    """Weeks lie between the rows of a key, and no history exists before the first batch."""
    out, _, history, _ = trained
    artifacts = load_artifacts(spark, f"{out}/artifacts")
    base, source = str(tmp_path), str(tmp_path / "in")
    weekly = history.where("dayofweek(date) = 2 or symbol = 'B'")
    dates = [r[0] for r in weekly.select("date").distinct().orderBy("date").collect()]
    for lo, hi in ((0, 20), (20, 25), (25, len(dates))):
        part = weekly.where(F.col("date").isin(dates[lo:hi]))
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(weekly.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = scoring.start_scoring(
        stream, artifacts, f"{base}/history", f"{base}/scores", f"{base}/checkpoint", available_now=True
    )
    query.awaitTermination()
    fitted = dataclasses.replace(artifacts.features, features=dataclasses.replace(SMALL, bounds="fitted"))
    whole = artifacts.predict(fitted.transform(weekly)).withColumnRenamed("prediction", "want")
    joined = scoring.read_scores(spark, f"{base}/scores").join(whole, ["date", "symbol"])
    assert joined.count() == weekly.count() > 100
    assert joined.where(F.abs(F.col("prediction") - F.col("want")) > 1e-9).count() == 0
    scoring.compact_history(spark, f"{base}/history", PANEL, SMALL.lookback, f"{base}/compact")
    kept = spark.read.parquet(f"{base}/compact").groupBy("symbol").count().collect()
    assert all(r["count"] <= SMALL.lookback for r in kept)


def test_transform_of_a_feature_subset(spark, trained):
    out, _, _, holdout = trained
    model = load_artifacts(spark, f"{out}/artifacts").features
    one = model.base_features[0]
    got = model.transform(holdout, features=[one])
    whole = model.transform(holdout)
    names = [c for c in whole.columns if c in ("date", "symbol", "target") or c in model.features.feature_names([one])]
    assert got.columns == names
    assert got.exceptAll(whole.select(*names)).count() == 0
    with pytest.raises(ValueError, match="absent"):
        model.transform(holdout, features=["absent"])


def test_streaming_scores_equal_batch_scores(spark, trained, tmp_path):
    out, _, history, holdout = trained
    artifacts = load_artifacts(spark, f"{out}/artifacts")
    base, source = str(tmp_path), str(tmp_path / "in")
    scoring.seed_history(history, f"{base}/history")
    cut = F.lit("2020-06-20").cast("timestamp_ntz")
    # The last row comes twice; the repeat must not be scored again.
    holdout.where(F.col("date") < cut).coalesce(1).write.parquet(source)
    late = holdout.where(F.col("date") >= cut)
    late.union(late.limit(1)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(holdout.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = scoring.start_scoring(
        stream, artifacts, f"{base}/history", f"{base}/scores", f"{base}/checkpoint", available_now=True
    )
    query.awaitTermination()
    got = scoring.read_scores(spark, f"{base}/scores")
    assert got.count() == holdout.count()
    fitted = dataclasses.replace(
        artifacts.features, features=dataclasses.replace(SMALL, bounds="fitted")
    )
    whole = artifacts.predict(fitted.transform(history.union(holdout)))
    joined = got.join(whole.withColumnRenamed("prediction", "want"), ["date", "symbol"])
    assert joined.where(F.abs(F.col("prediction") - F.col("want")) > 1e-9).count() == 0
    assert joined.count() == holdout.count()


def test_path_equals_single_fits(spark):
    """Warm starts and active sets change nothing in the solution."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 12)) @ rng.normal(size=(12, 12))
    y = x[:, 0] - 0.5 * x[:, 3] + 0.2 * rng.normal(size=200)
    names = [f"f{i}" for i in range(12)]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], [*names, "y"])
    m = md.moments(df, names, "y")
    alphas = [1e-3, 0.3, 1e-2, 0.1, 0.3]
    for alpha, (fit, rmse) in zip(alphas, md.elastic_net_path(m, alphas, 0.7), strict=True):
        assert np.allclose(np.array(fit.weights) * x.std(axis=0), coordinate_descent(x, y, alpha, 0.7, 20_000), atol=1e-6)
        assert rmse == pytest.approx(np.sqrt(((y - fit.intercept - x @ fit.weights) ** 2).mean()))
    assert md.elastic_net_path(m, [0.3], 0.7)[0][0].weights == pytest.approx(md.coordinate_descent(m, 0.3, 0.7)[0].weights)


def test_training_leaves_a_quality_report(spark, trained):
    out, _, history, _ = trained
    got = {r.feature: r for r in spark.read.json(f"{out}/artifacts/metadata/quality").collect()}
    assert set(got) == {"target", "close", "volume"}
    assert all((r.n_rows, r.n_null, r.n_not_finite) == (history.count(), 0, 0) for r in got.values())
    assert got["close"].first_date == str(history.agg(F.min("date")).first()[0])
