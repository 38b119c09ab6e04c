"""Merged summaries: sketches with their rank error, moments over several levels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.functions import partials
from panelwright.functions.sketches import QuantileSketch, approximate_quantiles, column_sketches, merge_sketches
from panelwright.operators import models as md
from panelwright.operators.features import winsor_bounds


def rank_error(values, answer, share):
    """Distance of the wanted rank from the ranks that the answer has."""
    wanted = share * (len(values) - 1)
    low, high = (values < answer).sum(), (values <= answer).sum() - 1
    return max(0, low - wanted, wanted - high)


@given(st.integers(0, 2**32 - 1), st.integers(1, 6), st.sampled_from([4, 16, 64]), st.booleans())
@settings(max_examples=80, deadline=None)
def test_rank_error_is_bounded(seed, n_parts, size, ties):
    rng = np.random.default_rng(seed)
    parts = [np.round(rng.lognormal(0, 3, rng.integers(0, 900)), 0 if ties else 9) for _ in range(n_parts)]
    payloads = []
    for part in parts:
        sketch = QuantileSketch(size)
        for piece in np.array_split(np.sort(part) if seed % 2 else part, 3):
            sketch.add(piece)
        payloads.append(sketch.to_bytes())
    total = QuantileSketch.from_bytes(merge_sketches(payloads))
    values = np.concatenate(parts)
    assert total.rows == len(values) == sum(len(x) << h for h, x in enumerate(total.levels))
    shares = [0, 0.01, 0.25, 0.5, 0.9, 0.99, 1]
    answers = total.quantiles(shares)
    if not len(values):
        assert answers == [None] * 7
        return
    assert all(rank_error(values, a, s) <= total.error + 1 for a, s in zip(answers, shares, strict=True))
    levels = max(1, np.log2(max(2, len(values) / size)) + 2)
    assert total.error <= 2 * levels * len(values) / size + n_parts
    assert answers[0] == values.min() and answers[-1] == values.max()


def test_column_sketches(spark, rows):
    data = [(float(i % 977), None if i % 5 else float(i), float("nan") if i % 2 else 1.0) for i in range(20_000)]
    df = rows("a double, b double, c double", data).repartition(7)
    found = column_sketches(df, ["a", "b", "c"], 256)
    assert [found[c].rows for c in "abc"] == [20_000, 4_000, 10_000]
    values = np.array([x[0] for x in data])
    for share, answer in zip((0.01, 0.99), approximate_quantiles(df, {"a": (0.01, 0.99)}, 256)["a"], strict=True):
        assert rank_error(values, answer, share) <= found["a"].error + 1 < 0.05 * len(values)
    assert approximate_quantiles(df.limit(0), {"a": (0.5,)}) == {"a": [None]}
    low, high = winsor_bounds(df, ["a"], method="approx")["a"]
    exact = winsor_bounds(df, ["a"])["a"]
    assert low == pytest.approx(exact[0], abs=1) and high == pytest.approx(exact[1], abs=1)
    with pytest.raises(ValueError, match="method"):
        winsor_bounds(df, ["a"], method="guess")


def test_partials_are_merged_over_levels(rows, monkeypatch):
    """Thirty tasks and four partials a group: three levels, and no group with more."""
    monkeypatch.setattr(partials, "FAN_IN", 4)
    df = rows("x double, y double, z double", [(float(i), float(i * i % 17), 3.0) for i in range(600)]).repartition(30)

    def build(batches):
        n = sum(len(b) for b in batches)
        return [(0, np.array([n, 1], np.int64).tobytes()), (7, np.array([2 * n, 1], np.int64).tobytes())]

    def add(payloads):
        if len(payloads) > 4:
            raise AssertionError("too many partials in one group")
        return partials.add_integers(payloads)

    found = partials.merged(df.mapInArrow(partials.per_task(build), partials.PARTIALS_DDL), add).collect()
    assert {r.place: np.frombuffer(r.payload, np.int64).tolist() for r in found} == {0: [600, 30], 7: [1200, 30]}


def test_moments_merge_over_blocks_and_folds(spark, rows, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 9)) * 10.0 ** rng.integers(-1, 4, 9) + 1e3 * rng.normal(size=9)
    names = [f"c{i}" for i in range(9)]
    df = rows(", ".join(f"{n} double" for n in names), [tuple(map(float, r)) for r in x]).repartition(11)
    monkeypatch.setattr(md, "BLOCK_BYTES", 150)  # two rows of the matrix
    whole = md.moment_sums(df, names)
    assert whole.n == 900 and np.allclose(whole.means, x.mean(axis=0), rtol=1e-12)
    centred = x - x.mean(axis=0)
    assert np.allclose(whole.products, centred.T @ centred, rtol=1e-9, atol=1e-9 * np.sqrt(np.outer(x.var(0), x.var(0))) * 900)
    halves = [md.moment_sums(df.where(c), names) for c in ("c0 < 0", "not c0 < 0")]
    both = halves[0].merge(halves[1])
    assert both.n == 900 and np.allclose(both.products, whole.products, rtol=1e-9)
    empty = md.moment_sums(df.limit(0), names)
    assert empty.n == 0 and (empty.merge(whole).products == whole.products).all()
