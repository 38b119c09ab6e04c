"""Vector codes: the tree against all distances, the operator against plain loops."""

import collections
import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import vector_codes


def brute_nearest(points, queries):
    square = ((queries[:, None, :] - points[None]) ** 2).sum(axis=2)
    return square.argmin(axis=1), square.min(axis=1)  # the first of equal ones


@given(st.integers(0, 2**32 - 1), st.integers(1, 90), st.integers(1, 5), st.sampled_from([1, 2, 5, 400, 1 << 24]))
@settings(max_examples=150, deadline=None)
def test_tree_finds_the_nearest_entry_and_the_lowest_index_of_ties(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    points, queries = (rng.integers(-spread, spread + 1, (m, width)) for m in (n, 200))
    queries[:50] = points[rng.integers(0, n, 50)]
    code, square, _ = vector_codes.nearest(vector_codes.build(points), queries)
    want = brute_nearest(points, queries)
    assert (code == want[0]).all() and (square == want[1]).all()


def test_tree_leaves_subtrees_out():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (8, 4))
    points = np.repeat(centres, 8, axis=0) + rng.integers(-60, 60, (64, 4))
    queries = np.repeat(centres, 100, axis=0) + rng.integers(-60, 60, (800, 4))
    code, _, work = vector_codes.nearest(vector_codes.build(points), queries)
    assert (code == brute_nearest(points, queries)[0]).all() and work < 0.6 * 64 * 800


def brute_codes(rows):
    """rows: (vec_id, vector, label); parts compared one by one with Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ids = sorted({r[0] for r in kept if r[0] is not None})
    least = {i: min(r[1] for r in kept if r[0] == i) for i in ids}
    length = len(least[ids[0]]) if ids else 0
    if not length or length % 16:
        return [(i, None, None, None) for i, _, _ in kept], hashlib.sha256(b"").hexdigest()
    first = [min(r[1] for r in kept if r[0] == i and len(r[1]) == length) for i in ids if any(r[0] == i and len(r[1]) == length for r in kept)][:64]
    width = length // 16
    cut = lambda v: [[math.floor(256 * x) for x in v[p * width : (p + 1) * width]] for p in range(16)]
    books = [[cut(v)[p] for v in first] for p in range(16)]
    parts = [cut(r[1]) if len(r[1]) == length else None for r in kept]

    def assign(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        groups = collections.defaultdict(list)
        for x in filter(None, parts):
            for p in range(16):
                groups[p, assign(x[p], p)[1]].append(x[p])
        for (p, k), own in groups.items():
            books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [x and [assign(x[p], p) for p in range(16)] for x in parts]
    errors = [x and sum(s for s, _ in x) for x in found]
    by_label = collections.defaultdict(list)
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]].append(e)
    total = {k: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in by_label.items()}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], x and "".join(f"{k:02x}" for _, k in x), e, total[r[2]]) for r, x, e in zip(kept, found, errors, strict=True)], digest


SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, part int, vector int"


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    got = vector_codes.compress(docs).collect()
    want, digest = brute_codes(rows)
    assert collections.Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == collections.Counter(want)
    assert {r.codebooks_sha256 for r in got} <= {digest}


def test_vector_codes_awkward(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(size=32)], [None, 1, 2][i % 3]) for i in rng.permutation(150)]
    rows += [(200, None, 1), (3, [float("nan")] * 32, 1), (201, [None] * 32, 1), (202, [float("inf")] * 32, None), (None, [0.5] * 32, 9)]
    rows += [rows[0], rows[1], (5, [-3.0] * 32, 4), (0, [9.0] * 31, 1), (300, [], 7), (301, [1.0] * 16, None)]
    check(spark, rows)
    check(spark, rows[:20])  # fewer rows than entries
    check(spark, [(1, [0.25] * 16, None)] * 5)
    check(spark, [(i, [1.0] * 20, None) for i in range(3)])  # no multiple of 16
    check(spark, [(None, [1.0] * 16, 1)])


def test_vector_codes_of_one_hot_vector_and_label(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [0.5] * 16 if i % 3 else [float(x) for x in rng.normal(size=16)], 1 if i % 2 else i) for i in range(400)]
    check(spark, rows)


def test_vector_codes_of_nothing(spark):
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, None, 1, "", 1, 1, 1)], SCHEMA)
    assert vector_codes.compress(none).count() == 0


def test_vector_codes_refuse_components_that_are_too_large(spark):
    rows = spark.createDataFrame([(1, [1e300] * 16, 1, "", 1, 1, 1)], SCHEMA)
    with pytest.raises(Exception, match="magnitude"):
        vector_codes.compress(rows).count()
