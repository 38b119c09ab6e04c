import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelwright.functions import quantiles as q


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@pytest.fixture
def small_limits(monkeypatch):
    """Forces counting rounds on small inputs."""
    monkeypatch.setattr(q, "FETCH_LIMIT", 3)
    monkeypatch.setattr(q, "BINS", 4)


def test_winsor_example(spark):
    found = q.exact_quantiles(frame(spark, range(1, 11)), {"x": (0.01, 0.99)})["x"]
    assert found == pytest.approx([1.09, 9.91], abs=1e-12)


def test_empty_column(spark):
    assert q.exact_quantiles(frame(spark, [None, None]), {"x": (0.5,)})["x"] == [None]
    assert q.exact_quantiles(frame(spark, []), {"x": (0.25, 0.5)})["x"] == [None, None]


@pytest.mark.parametrize(
    "values",
    [
        [5.0] * 40,
        [0.0] * 30 + [float(i) for i in range(30)],
        [10.0**k for k in range(-200, 200, 9)],
        [-1.7e308, -1.0, 0.0, 2.0, 1.7e308],
        [1e-320, 2e-320, 3e-320, 5e-320, 9e-320, 1.0],
        list(np.random.default_rng(1).normal(size=500)),
        [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0, 1.0 + 2**-52, 2.0],
    ],
)
def test_rounds_agree_with_numpy(spark, small_limits, values):
    values = list(values)
    random.Random(0).shuffle(values)
    ps = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    found = q.exact_quantiles(frame(spark, [*values, None]), {"x": ps})["x"]
    ordered = sorted(values)
    for p, got in zip(ps, found):
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        want = low if low == high else low + (high - low) * (at - math.floor(at))
        assert got == want


def test_infinities_take_the_end_ranks(spark, small_limits):
    inf = float("inf")
    values = [-inf, -inf, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, inf]
    found = q.order_statistics(frame(spark, values), {"x": list(range(10))})
    assert [found["x", r] for r in range(10)] == values


def test_rank_out_of_range(spark):
    with pytest.raises(ValueError, match="no rank 3"):
        q.order_statistics(frame(spark, [1, 2, 3]), {"x": [3]})


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.floats(0, 1))
def test_any_values(spark, values, p):
    found = q.exact_quantiles(frame(spark, values), {"x": (p,)})["x"][0]
    assert found == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


def test_moments_in_the_same_pass(spark):
    s = q.summarize(frame(spark, [1, 2, 3, 4, None]), ["x"], moments=True)["x"]
    assert (s.rows, s.values, s.low, s.high, s.mean, s.variance) == (5, 4, 1.0, 4.0, 2.5, 1.25)


def test_heavy_tail_takes_few_rounds(spark, monkeypatch):
    """Values over hundreds of orders of magnitude; equal widths alone take dozens of rounds."""
    monkeypatch.setattr(q, "FETCH_LIMIT", 3)
    rounds = []
    refine = q._refine
    monkeypatch.setattr(q, "_refine", lambda df, brackets: rounds.append(1) or refine(df, brackets))
    rng = np.random.default_rng(4)
    values = np.exp(rng.standard_cauchy(2000).clip(-300, 300)) * rng.choice([-1, 1], 2000)
    found = q.exact_quantiles(frame(spark, values.tolist()), {"x": (0.01, 0.3, 0.5, 0.99)})["x"]
    assert np.allclose(found, np.quantile(values, (0.01, 0.3, 0.5, 0.99)), rtol=1e-12)
    assert len(rounds) <= 7
