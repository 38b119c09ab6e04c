"""The metric-space join against all pairs that share a shingle."""

import collections
import re

import numpy as np
import pytest

from panelwright.llm import jaccard_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct, by = {}, collections.defaultdict(set)
    for i, s in enumerate(sets):
        if s and s in distinct:
            parent[find(i)] = find(distinct[s])
        elif s:
            distinct[s] = i
    for s, i in distinct.items():
        seen = collections.Counter(j for x in s for j in by[x])
        for j, both in seen.items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for x in s:
            by[x].add(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return collections.Counter((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows))


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = collections.Counter(map(tuple, jaccard_join.components(df).collect()))
    assert got == brute_components(rows)
    return got


def changed(rng, words, most):
    words = list(words)
    for at in rng.integers(0, len(words), rng.integers(0, most + 1)):
        words[at] = f"x{rng.integers(0, 500)}"
    return " ".join(words)


def mixture(rng, n):
    """Near copies of a few texts at all distances, texts made of shared passages, texts of their own."""
    bases = [[f"b{b}w{i}" for i in range(120)] for b in range(4)]
    passages = [[f"p{p}w{i}" for i in range(40)] for p in range(6)]
    rows = [" ".join(b) for b in bases[:2]]
    for i in range(n):
        rows.append(changed(rng, bases[i % 4], 2 + 3 * (i % 4)))
        if i % 3 == 0:
            rows.append(" ".join(w for p in rng.permutation(6)[:4] for w in passages[p]))
        if i % 2 == 0:
            rows.append(" ".join([*(f"o{i}w{j}" for j in range(40)), *passages[0], *passages[1]]))
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]


def test_documents(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert any(i != c for i, _, c in got)


def test_awkward(awkward, copies, empty):
    check(awkward)
    check(awkward.withColumn("rid", awkward.score).withColumn("hash", awkward.row).unionByName(awkward, allowMissingColumns=True))
    check(copies)
    assert jaccard_join.components(empty).count() == 0


@pytest.mark.parametrize("group_codes, leaf", [(500_000, 24), (3_000, 4)])
def test_groups_of_all_distances(spark, monkeypatch, group_codes, leaf):
    monkeypatch.setattr(jaccard_join, "GROUP_CODES", group_codes)
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "CHUNK_BYTES", 30_000)
    monkeypatch.setattr(jaccard_join, "RANGE_CODES", 500)
    rng = np.random.default_rng(11)
    rows = mixture(rng, 160)
    rows += [(None, rows[5][1]), (None, "only here and nowhere else"), (rows[3][0], "the same id with another text"), (rows[9][0], rows[9][1])]
    rows += [(5000 + i, rows[7][1].replace(" ", " " * (1 + i % 40), 1)) for i in range(80)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))


def test_one_row_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 20)
    rows = [(None, "a row without an id that is there again and again")] * 300 + [(i, f"text number {i % 90} of some") for i in range(400)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))


def test_regions_hold_every_near_pair():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 50))).astype("<u8") for _ in range(150)]
    sets += [np.setdiff1d(s, rng.choice(s, 1)) for s in sets if len(s) > 12]
    region = jaccard_join.Region(np.arange(len(sets)), np.arange(len(sets)), np.zeros(len(sets)), [s.tobytes() for s in sets])
    own = np.arange(len(sets))
    flat, bounds = region.gather(own)
    away = np.array([1 - (b := region.shared(i, flat, bounds)) / (region.sizes[i] + region.sizes - b) for i in own])
    masks = jaccard_join.regions(away[:12])
    near = [(i, j) for i, j in np.argwhere(away <= jaccard_join.RADIUS) if i < j]
    assert len(near) > 30 and all(any(m[i] and m[j] for m in masks) for i, j in near)
    assert min(m.sum() for m in masks) < len(sets)


def test_footers_do_not_join_texts(spark, monkeypatch):
    """Texts with a long common passage are proved to be alone; none of their sets is kept."""
    footer = " ".join(f"f{i}" for i in range(60))
    rows = [(i, " ".join(f"t{i}w{j}" for j in range(40)) + " " + footer) for i in range(300)]
    kept = []
    real = jaccard_join.region_links
    monkeypatch.setattr(jaccard_join, "region_links", lambda m, s: kept.append(m.count()) or real(m, s))
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept == [0]
