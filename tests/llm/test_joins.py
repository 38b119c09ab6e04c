"""Operators with joins: near duplicates, language model; and the pipeline."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from panelwright.llm import katz, minhash_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sets, {i: find(i) for i in sets}


def check_components(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    sets, want = brute_components(rows)
    got = minhash_join.components(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
            assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_documents(spark):
    check_components(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_near_duplicates_awkward(awkward, empty, copies):
    check_components(awkward)
    check_components(copies)
    assert minhash_join.components(empty).count() == 0
    assert minhash_join.deduplicate(empty).columns == empty.columns
    assert minhash_join.deduplicate(awkward).columns == awkward.columns


def test_near_copies_of_one_text_at_all_distances(spark, monkeypatch):
    """Hundreds of changed copies, some of which are linked only through others; small chunks."""
    monkeypatch.setattr(minhash_join, "CHUNK_MEMBERS", 40)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(350):
        text = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 9)):
            text[at] = f"x{rng.integers(0, 30)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"u{i}-{j}" for j in range(30))) for i in range(50)]
    check_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_connected_long_chain(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500)]
    got = {r.rep: r.label for r in minhash_join.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 500 for i in (500, 501, 502)}


def brute_katz(rows):
    texts = [(i, words_of(t) + ["</s>"]) for i, t in rows]
    train = [t for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    one, two = (katz.discounts(collections.Counter(x.values())) for x in (c, pairs))
    less = lambda r, shares: min(shares.get(r, 1.0) * r, r - katz.LEAST)
    p = {w: less(r, one) / n for w, r in c.items()}
    unknown = 1 - sum(p.values()) if c else 1.0
    seen = collections.defaultdict(dict)
    for (h, w), r in pairs.items():
        if r >= katz.CUTOFF:
            seen[h][w] = less(r, two) / c[h if h != "<s>" else "</s>"]
    backoff = {h: (1 - sum(q.values())) / (1 - sum(p[w] for w in q)) for h, q in seen.items()}
    for h, q in seen.items():  # every history is a distribution
        assert sum(q.values()) + backoff[h] * (sum(x for w, x in p.items() if w not in q) + unknown) == pytest.approx(1)
    want = []
    for i, t in texts:
        score = sum(math.log10(seen[h][w] if w in seen.get(h, {}) else backoff.get(h, 1) * p.get(w, unknown)) for h, w in zip(["<s>", *t], t, strict=False))
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        want.append((i, held, len(t), sum(w in c for w in t), n, base, score))
    return want


def test_katz(spark, awkward, empty):
    for df in (awkward, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), empty):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        key = lambda r: (r[0] is not None, r[0] or 0, round(r[-1], 6))
        got = sorted(map(tuple, katz.score(df).collect()), key=key)
        want = sorted(brute_katz(rows), key=key)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        for g, w in zip(got, want, strict=True):
            assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_katz_keeps_pairs_seen_once(spark):
    """"b a" occurs once in training; a held-out text with it is scored by its discounted count."""
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1][:6]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    texts = ["a b", "a b", "b a", "c d", "a c", "d d"]
    rows = [*zip(train, texts, strict=True), (held, "b a")]
    got = {r.doc_id: r.score for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = collections.Counter(w for t in texts for w in (*t.split(), "</s>"))
    pairs = collections.Counter(p for t in texts for p in zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True))
    assert words["b"] == 3 and pairs["b", "a"] == 1 and pairs["a", "</s>"] == 1 and pairs["<s>", "b"] == 1
    shares = katz.discounts(collections.Counter(pairs.values()))
    once = min(shares[1], 1 - katz.LEAST)
    want = np.log10([once / len(texts), once / words["b"], once / words["a"]]).sum()
    assert got[held] == pytest.approx(want, rel=1e-9)


def test_katz_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(katz, "GROUP_USES", 2000)
    monkeypatch.setattr(katz, "GROUP_TOKENS", 8000)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    chunks = katz.tokenize(df)
    corpus, answers = katz.count_words(chunks)
    model = katz.train(corpus, katz.number_chunks(chunks, answers))
    assert corpus.groups > 2 < model.groups == model.parts.count()
    # After any history the seen words and the weighted rest add up to 1.
    p_word = {r.number: r.p_word for r in corpus.words.collect()}
    n_before = {r.number: r.n for r in corpus.words.collect()} | {katz.BEGIN: corpus.n_starts}
    pairs, weights = collections.defaultdict(dict), {}
    for r in model.rows().collect():
        if r.word == katz.WEIGHT:
            weights[r.before] = 10**r.value
        else:
            pairs[r.before][r.word] = katz.discounted(np.array([r.value]), model.shares)[0]
    assert weights.keys() == pairs.keys()
    for before, seen in pairs.items():
        rest = 1 - sum(p_word[w] for w in seen)
        assert sum(seen.values()) / n_before[before] + weights[before] * rest == pytest.approx(1, rel=1e-9)
    want = {r[0]: r[-1] for r in brute_katz([(r.doc_id, r.text) for r in df.collect()])}
    got = {r.doc_id: r.score for r in katz.score(df).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_katz_spreads_a_hot_history():
    row = {"tokens": katz._squeeze(np.arange(2001)), "lengths": [2001]}
    even = katz._Known(row | {"words": katz._squeeze(np.arange(1, 2002), np.ones(2001, np.int64))}, 16, 1)
    assert len(even.segments) == 16
    numbers = np.array([5, *[x for w in range(10, 1010) for x in (w, 5)]])
    row["words"] = katz._squeeze(numbers, np.array([10**8, *[x for _ in range(1000) for x in (1, 10**8)]]))
    hot = katz._Known(row, 16, 1)
    sizes = [sum(hot.before[hot.first[hot.order[a:b]]] == 5) for _, a, b in hot.segments]
    assert sum(sizes) == 1000 and max(sizes) < 120


@pytest.mark.parametrize("high", [1, 255, 256, 2**40, 2**62])
def test_squeezed_columns_open_again(high):
    rng = np.random.default_rng(high)
    for n in (0, 1, 1000):
        columns = [rng.integers(0, high, n), np.zeros(n, np.int64)]
        for x, y in zip(columns, katz._opened(katz._squeeze(*columns)), strict=True):
            assert (x == y).all()


def test_katz_without_training(spark):
    docs = spark.createDataFrame([(4, "a b")], "doc_id long, text string")
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    docs = docs.selectExpr(f"cast({held} as long) doc_id", "text")
    got = katz.score(docs).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.score) == (3, 0, 0, 0.0)


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, left, sf_dir)
        assert kept.columns == docs.columns
        assert kept.exceptAll(left).count() == 0
        left = spark.createDataFrame(kept.collect(), docs.schema)
    texts = [r.text.translate(LOWER) for r in left.collect()]
    assert len(texts) == len(set(texts)) > 100
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in left.collect()}


def test_pipeline_of_nothing(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
