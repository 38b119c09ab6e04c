"""Histogram trees against a plain implementation that looks at every row for every split."""

import dataclasses
import math

import numpy as np
import pytest

from panelwright.operators import boosting as bo
from panelwright.operators import models as md
from panelwright.sources.artifacts import load_artifacts, save_artifacts
from panelwright.spec import FeatureSpec, ModelSpec, PanelSpec

CONFIGURED = {
    "num_leaves": 31, "max_depth": -1, "learning_rate": 0.05, "n_estimators": 12, "min_child_samples": 20,
    "subsample": 0.8, "colsample_bytree": 0.8, "reg_alpha": 0.1, "reg_lambda": 0.1, "random_state": 42,
}


def score(g, n, spec):
    less = math.copysign(max(abs(g) - spec.reg_alpha, 0), g)
    return less * less / (n + spec.reg_lambda) if n else 0.0


def plain_tree(x, g, features, spec):
    """One tree as nested dictionaries, grown best first; x holds the values, g the gradients."""
    def candidate(rows):
        best = None
        for f in features:
            for cut in np.unique(np.nan_to_num(x[rows, f], nan=-np.inf))[:-1]:
                left = rows[~(x[rows, f] > cut)]
                right = rows[x[rows, f] > cut]
                if min(len(left), len(right)) < max(1, spec.min_child_samples):
                    continue
                gain = score(g[left].sum(), len(left), spec) + score(g[right].sum(), len(right), spec) - score(g[rows].sum(), len(rows), spec)
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, cut, left, right)
        return best

    def leaf(rows, depth):
        less = math.copysign(max(abs(g[rows].sum()) - spec.reg_alpha, 0), g[rows].sum())
        return {"rows": rows, "depth": depth, "value": -spec.learning_rate * less / (len(rows) + spec.reg_lambda), "best": None if 0 < spec.max_depth <= depth else candidate(rows)}

    leaves = [leaf(np.arange(len(g)), 0)]
    while len(leaves) < spec.num_leaves:
        able = [x for x in leaves if x["best"]]
        if not able:
            break
        top = max(able, key=lambda x: x["best"][0])
        leaves = [x for x in leaves if x is not top] + [leaf(r, top["depth"] + 1) for r in top["best"][3:]]
    out = np.zeros(len(g))
    for x_ in leaves:
        out[x_["rows"]] = x_["value"]
    return out, len(leaves)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(12)
    x = np.column_stack([rng.integers(0, 25, 700), rng.integers(0, 9, 700) / 4, rng.integers(-30, 30, 700), np.full(700, 2.0)]).astype(float)
    x[rng.random(700) < 0.1, 1] = np.nan
    y = np.sin(x[:, 0]) + 0.3 * np.nan_to_num(x[:, 1]) * (x[:, 2] > 4) + 0.2 * rng.normal(size=700)
    rows = [(*(None if np.isnan(v) else float(v) for v in r), float(t)) for r, t in zip(x, y, strict=True)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, d double, y double").repartition(5)


@pytest.mark.parametrize(
    "changes",
    [{}, {"num_leaves": 4}, {"max_depth": 2}, {"reg_alpha": 3.0, "reg_lambda": 5.0}, {"min_child_samples": 1, "num_leaves": 40, "learning_rate": 0.5}],
)
def test_three_trees_equal_a_plain_search(table, changes):
    x, y, df = table
    spec = dataclasses.replace(bo.BoostingSpec(n_estimators=3, num_leaves=12), **changes)
    fit, rmse = bo.boost(df, ["a", "b", "c", "d"], "y", spec)
    columns = list(x.T)
    assert fit.base == pytest.approx(y.mean()) and [len(e) for e in fit.edges] == [24, 8, len(np.unique(x[:, 2])) - 1, 0]
    want = np.full(len(y), fit.base)
    bins = bo.bin_numbers(columns, fit.edges)
    for tree in fit.trees:
        step, n_leaves = plain_tree(x, want - y, range(4), spec)
        assert sum(f < 0 for f in tree.feature) == n_leaves
        assert np.allclose(np.array(tree.value)[tree.leaf_of(bins)], step, atol=1e-7)
        want += step
    got = {(r.a, r.b, r.c): r.prediction for r in bo.predict_boosted(fit, df).collect()}
    assert all(got[x[i, 0], None if np.isnan(x[i, 1]) else x[i, 1], x[i, 2]] == pytest.approx(want[i], abs=1e-6) for i in range(len(y)))
    assert rmse == pytest.approx(np.sqrt(((y - want) ** 2).mean()), abs=1e-7)


def test_trees_do_not_depend_on_the_partitions(table):
    _, _, df = table
    spec = bo.BoostingSpec(n_estimators=4, num_leaves=8)
    one, two = (bo.boost(df.repartition(n), ["a", "b", "c"], "y", spec)[0] for n in (1, 13))
    assert one == two


def test_configured_parameters(table, spark, tmp_path):
    _, y, df = table
    trained = md.train_model(ModelSpec("lightgbm", CONFIGURED), df, ["a", "b", "c", "d"], "y")
    assert len(trained.pipeline.trees) == 12 and trained.rmse < 0.75 * y.std()
    weights = {r.feature: r.weight for r in md.feature_weights(spark, trained).collect()}
    assert sum(weights.values()) == pytest.approx(1) and weights["d"] == 0 and weights["a"] > weights["b"]
    with pytest.raises(ValueError, match="leaves"):
        md.train_model(ModelSpec("lightgbm", {"leaves": 3}), df, ["a"], "y")
    with pytest.raises(ValueError, match="num_leaves"):
        md.train_model(ModelSpec("lgbm", {"num_leaves": 1}), df, ["a"], "y")
    with pytest.raises(ValueError, match="target"):
        md.train_model(ModelSpec("lightgbm", CONFIGURED), df, ["a"], "b")


def test_subsets_of_rows_and_features(table):
    _, _, df = table
    spec = bo.BoostingSpec(n_estimators=6, num_leaves=6, subsample=0.5, colsample_bytree=0.5)
    fit, _ = bo.boost(df, ["a", "b", "c", "d"], "y", spec)
    used = [{f for f in t.feature if f >= 0} for t in fit.trees]
    assert all(len(u) <= 2 for u in used) and len(set(map(frozenset, used))) > 1
    keys = np.arange(20_000)
    shares = [bo._sampled(keys, t, spec) for t in range(3)]
    assert all(abs(s.mean() - 0.5) < 0.02 for s in shares) and abs((shares[0] & shares[1]).mean() - 0.25) < 0.02


def test_quantile_bins_of_many_values(spark):
    rng = np.random.default_rng(1)
    values = rng.lognormal(size=20_000)
    df = spark.createDataFrame([(float(v), float(v > 3)) for v in values], "v double, y double")
    fit, rmse = bo.boost(df, ["v"], "y", bo.BoostingSpec(n_estimators=1, num_leaves=2, learning_rate=1.0, max_bin=64))
    assert len(fit.edges[0]) <= 64 and rmse < 0.1


def test_boosted_artifacts_roundtrip(spark, tmp_path, walk):
    from panelwright.operators.features import FeatureEstimator

    _, panel = walk
    matrix, model = FeatureEstimator(PanelSpec(target="target"), FeatureSpec(lags=(1,), rolling_windows=(3,))).fit_transform(panel)
    trained = md.train_model(ModelSpec("lightgbm", {"n_estimators": 2}), matrix, model.fitted_columns, "target")
    save_artifacts(spark, str(tmp_path), model, trained.pipeline)
    assert load_artifacts(spark, str(tmp_path)).pipeline == trained.pipeline


@pytest.mark.parametrize("rows", [1, bo.BLOCK_ROWS, 3 * bo.BATCH_ROWS + 5])
@pytest.mark.parametrize("n_bins", [200, 60_000])
def test_rows_come_back_from_blocks(rows, n_bins):
    draw = np.random.default_rng(rows)
    keys, y, score = np.arange(rows), draw.normal(size=rows), draw.normal(size=rows)
    bins = draw.integers(0, n_bins, (rows, 3)).astype(np.uint16)
    stored = bo._in_blocks(keys, y, score, bins)
    assert len(stored) == -(-rows // bo.BLOCK_ROWS)
    parts = [stored.slice(i, 2) for i in range(0, len(stored), 2)]
    found = list(bo._gathered_blocks(iter(parts), 3, n_bins))
    assert all(len(f[0]) <= bo.BATCH_ROWS for f in found)
    for place, want in enumerate((keys, y, score, bins.T)):
        assert np.array_equal(np.concatenate([f[place] for f in found], axis=-1), want)


def test_passes_read_blocks(spark, tmp_path, monkeypatch):
    stored = []
    plain = bo.materialize
    monkeypatch.setattr(bo, "materialize", lambda df, label: stored.append(plain(df, label)) or stored[-1])
    frame = spark.range(0, 20_000, 1, 1).selectExpr("cast(id % 7 as double) a", "cast(id % 5 as double) b", "cast(id % 7 + id % 3 as double) y")
    fit, error = bo.boost(frame, ["a", "b"], "y", bo.BoostingSpec(n_estimators=12, num_leaves=4))
    assert [t.count() for t in stored] == [3, 3]
    scored = bo.predict_boosted(fit, frame).selectExpr("sqrt(avg((y - prediction) * (y - prediction)))").first()[0]
    assert error == pytest.approx(scored, rel=1e-9)
