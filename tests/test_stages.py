"""Stages of ``pyspark.ml`` pipelines: fitted, saved, loaded, searched."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from panelwright.operators import models as md
from panelwright.operators.features import FeatureEstimator
from panelwright.operators.splits import block_folds
from panelwright.plans import stages
from panelwright.plans.stages import PanelBoostedTrees, PanelElasticNet, PanelFeatures, StrategyEvaluator
from panelwright.spec import FeatureSpec, ModelSpec, PanelSpec

PANEL = PanelSpec(target="target", features=("close", "volume"))
SMALL = FeatureSpec(lags=(1,), rolling_windows=(3,))


def features(**more):
    return PanelFeatures(labelCol="target", featureCols=["close", "volume"], lags=[1], rollingWindows=[3], **more)


def sorted_rows(df):
    return df.orderBy("symbol", "date").toPandas()


def test_pipeline_equals_the_functions(spark, walk, tmp_path):
    frame, panel = walk
    early, late = panel.where(F.col("date") < "2020-09-01"), panel.where(F.col("date") >= "2020-09-01")
    fitted = Pipeline(stages=[features(), PanelElasticNet(labelCol="target", alpha=1e-4)]).fit(early)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    fitted.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages]
    assert loaded.stages[0].getOrDefault("rollingWindows") == [3]

    matrix, model = FeatureEstimator(PANEL, SMALL).fit_transform(early)
    spec = ModelSpec("elastic_net", {"alpha": 1e-4, "l1_ratio": 0.5})
    trained = md.train_model(spec, matrix, model.fitted_columns, "target")
    want = sorted_rows(trained.predict(model.transform(late)))
    assert len(want) > 100 and want["prediction"].std() > 0
    for one in (fitted, loaded):
        got = sorted_rows(one.transform(late))
        assert list(got.columns) == list(want.columns)
        assert np.allclose(got["prediction"], want["prediction"], atol=1e-12)
    assert fitted.stages[1].rmse == pytest.approx(trained.rmse)
    # Rows to score need no target.
    assert np.allclose(sorted_rows(loaded.transform(late.drop("target")))["prediction"], want["prediction"])


def test_stages_keep_their_parameters(spark, tmp_path):
    made = [
        features(imputation="mean", quantiles="approx", carryCols=["forecast"], grain="instant", tiebreakCols=["id"]),
        PanelElasticNet(alpha=0.1, l1Ratio=0.9, predictionCol="p"),
        PanelBoostedTrees(numLeaves=7, regAlpha=0.5),
    ]
    Pipeline(stages=made).write().overwrite().save(str(tmp_path / "p"))
    back = Pipeline.load(str(tmp_path / "p")).getStages()
    assert [{p.name: v for p, v in s.extractParamMap().items()} for s in back] == [
        {p.name: v for p, v in s.extractParamMap().items()} for s in made
    ]
    assert back[0].features() == FeatureSpec((1,), (3,), imputation="mean", quantiles="approx")
    assert back[0].panel() == PanelSpec(target="target", tiebreak=("id",), grain="instant", features=("close", "volume"))
    assert back[2].spec().params["num_leaves"] == 7 and back[2].spec().params["reg_alpha"] == 0.5
    with pytest.raises(AttributeError):
        PanelElasticNet(penalty=1.0)
    with pytest.raises(ValueError, match="labelCol"):
        PanelElasticNet().fit(spark.range(3))


def test_defaults_are_those_of_the_specifications():
    assert PanelFeatures().features() == FeatureSpec()
    assert PanelFeatures().panel() == PanelSpec()
    assert PanelElasticNet().spec().params == ModelSpec().params


def test_training_frame_is_windowed_once(spark, walk):
    _, panel = walk
    model = features().fit(panel)
    again = model.transform(panel)
    assert "Window" not in again._jdf.queryExecution().optimizedPlan().toString()
    other = model.transform(panel.select("*"))
    assert "Window" in other._jdf.queryExecution().optimizedPlan().toString()
    a, b = sorted_rows(again), sorted_rows(other)
    assert list(a.columns) == list(b.columns) and np.allclose(a.iloc[:, 2:], b.iloc[:, 2:])


def test_carried_columns(spark, walk):
    _, panel = walk
    got = features(carryCols=["note"]).fit(panel.withColumn("note", F.lit("x"))).transform(panel.withColumn("note", F.lit("y")))
    assert {r.note for r in got.select("note").distinct().collect()} == {"y"}


def test_cross_validator_searches_pipelines(spark, walk):
    """Every fold by hand: features and net fitted on the other blocks of dates."""
    _, panel = walk
    folded = block_folds(panel, PANEL, 2)
    net = PanelElasticNet(labelCol="target", featureCols=SMALL.feature_names(PANEL.features))
    grid = ParamGridBuilder().addGrid(net.alpha, [1e-4, 10.0]).build()
    judge = RegressionEvaluator(labelCol="target", predictionCol="prediction", metricName="rmse")
    search = CrossValidator(
        estimator=Pipeline(stages=[features(), net]), estimatorParamMaps=grid, evaluator=judge, numFolds=2, foldCol="fold"
    )
    found = search.fit(folded)
    want = []
    for alpha in (1e-4, 10.0):
        errors = []
        for fold in range(2):
            matrix, model = FeatureEstimator(PANEL, SMALL).fit_transform(folded.where(F.col("fold") != fold))
            spec = ModelSpec("elastic_net", {"alpha": alpha, "l1_ratio": 0.5})
            trained = md.train_model(spec, matrix, model.fitted_columns, "target")
            errors.append(judge.evaluate(trained.predict(model.transform(folded.where(F.col("fold") == fold)))))
        want.append(np.mean(errors))
    assert np.allclose(found.avgMetrics, want)
    assert found.bestModel.stages[1].fitted.features == tuple(SMALL.feature_names(PANEL.features))


def test_grid_shares_one_scan(spark, walk, monkeypatch):
    _, panel = walk
    matrix, model = FeatureEstimator(PANEL, SMALL).fit_transform(panel)
    net = PanelElasticNet(labelCol="target", featureCols=model.fitted_columns)
    grid = ParamGridBuilder().addGrid(net.alpha, [1e-3, 1e-4]).addGrid(net.l1Ratio, [0.2, 0.8]).build()
    single = [net.copy(extra).fit(matrix).fitted for extra in grid]
    scans = []
    monkeypatch.setattr(md, "moments", lambda *a, real=md.moments: scans.append(1) or real(*a))
    shared = dict(net.fitMultiple(matrix, grid))
    assert len(scans) == 1 and sorted(shared) == [0, 1, 2, 3]
    for i, one in enumerate(single):
        assert np.allclose(shared[i].fitted.weights, one.weights, atol=1e-10)


def test_boosted_trees_and_evaluator(spark, walk, tmp_path):
    _, panel = walk
    matrix = features().fit(panel).transform(panel)
    names = SMALL.feature_names(PANEL.features)
    trees = PanelBoostedTrees(labelCol="target", featureCols=names, nEstimators=3, numLeaves=4).fit(matrix)
    trees.save(str(tmp_path / "t"))
    scored = stages.PanelForecastModel.load(str(tmp_path / "t")).transform(matrix)
    assert sorted_rows(scored).equals(sorted_rows(trees.transform(matrix)))
    judge = StrategyEvaluator(labelCol="target", metricName="total_return", leverageMin=-1.0, leverageMax=1.0)
    rows = scored.toPandas()
    want = (rows["prediction"].clip(-1, 1) * rows["target"]).sum()
    assert judge.evaluate(scored) == pytest.approx(want) and judge.isLargerBetter()
    assert np.isnan(judge.evaluate(scored.limit(0)))


def test_block_folds(spark, rows):
    days = [(f"2024-01-{d:02d}", k) for d in range(1, 8) for k in ("a", "b")] + [(None, "c")]
    df = rows("date string, symbol string", days).withColumn("date", F.to_date("date"))
    got = {(str(r.date), r.symbol): r.fold for r in block_folds(df, PanelSpec(), 3).collect()}
    assert [got[f"2024-01-{d:02d}", "b"] for d in range(1, 8)] == [0, 0, 1, 1, 2, 2, 2]
    assert got["None", "c"] == 0
    with pytest.raises(ValueError, match="7 dates"):
        block_folds(df, PanelSpec(), 8)
