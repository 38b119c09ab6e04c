"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents of the label table, taken without their labels, are
the unlabelled ones, so that the share of positives in the table is their class prior. The prior corrects
the risk: the negative part is the unlabelled risk minus the prior's share of the positive one, and when it
falls below zero the step goes back up (non-negative estimator). Several linear numpy classifiers, each
without another part of the unlabelled documents, see hashed words and word beginnings of whole texts.
Their mean log-odds give the score; they are linear, so one vector of mean weights is enough.

Features are those that positives hold more often. The bias is set so that the mean probability over the
unlabelled documents is the prior, and not above it: a text without features scores the prior at most,
however few documents there are. Near copies of one text count once on both sides.

Fitted on a bounded sample of labelled rows (``MAX_POSITIVE`` and ``MAX_UNLABELLED`` documents, chosen by a
hash of the id); every document is scored.

Defined results: a null or empty text has no feature and gets the score of the bias alone. Without any
positive example every score is the prior, without any label 0. Null ids are scored, never held out and
never learned from; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import PieceCache, Pieces, batch_of, bucket, mix, text_rows, text_slices, texts_of, whole_rows

BUCKETS = 1 << 20
#: Word beginnings of these lengths are features beside the whole word.
PREFIXES = (4, 5, 6)
#: Bounds of the fitting sample, in documents.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
CLASSIFIERS = 3
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3


def _buckets(words: list[str]) -> list[bytes]:
    import xxhash

    out = []
    for word in words:
        keys = [f"{word} ", *(word[:n] for n in PREFIXES if len(word) > n)] if word else []
        out.append(np.array([xxhash.xxh3_64_intdigest(k.encode()) % BUCKETS for k in keys], np.uint32).tobytes())
    return out


FEATURES = PieceCache(_buckets, np.uint32)


def text_features(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct buckets of each text."""
    import pyarrow.compute as pc

    letters = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")
    words = Pieces(pc.split_pattern(letters, " "))
    packed = FEATURES.packed(words.distinct)
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    flat, starts = np.frombuffer(b"".join(packed), np.uint32), np.cumsum(sizes) - sizes
    for i in range(len(words)):
        own = np.unique(words.codes[words.bounds[i] : words.bounds[i + 1]])
        n = sizes[own]
        places = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield np.unique(flat[places])


@dataclass(frozen=True)
class Classifier:
    """Weights of the buckets that count, by ascending bucket; the log-odds are their sum and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, features: np.ndarray) -> float:
        if not len(self.buckets):
            return self.bias
        at = np.searchsorted(self.buckets, features)
        at[at == len(self.buckets)] = 0
        return self.bias + float(self.weights[at[self.buckets[at] == features]].sum())


def _rows(lists: list[np.ndarray], buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the features that are among ``buckets``."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    value = np.concatenate(lists) if lists else np.zeros(0, np.uint32)
    at = np.minimum(np.searchsorted(buckets, value), len(buckets) - 1)
    held = buckets[at] == value
    return row[held], at[held]


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: float = 8.0) -> np.ndarray:
    """Buckets that positives hold more often, by a log-likelihood ratio of at least ``least``."""
    buckets, p = np.unique(np.concatenate(positive), return_counts=True)
    u = np.bincount(_rows(unlabelled, buckets)[1], minlength=len(buckets))
    share = len(positive) / (len(positive) + len(unlabelled))
    expected_p, expected_u = (p + u) * share, (p + u) * (1 - share)
    ratio = 2 * (p * np.log(p / expected_p) + u * np.log(np.maximum(u, 1) / np.maximum(expected_u, 1e-9)))
    return buckets[(p > expected_p) & (ratio >= least)]


def risk(theta: np.ndarray, positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], prior: float) -> tuple[float, float, np.ndarray]:
    """The positive part of the risk, its negative part, and the gradient the estimator follows.

    ``theta`` holds the weights and the bias; the sides are row and column numbers of the features held,
    and the number of rows. Losses are logistic.
    """
    (pr, pc, n_p), (ur, uc, n_u), m = positive, unlabelled, len(theta) - 1
    zp, zu = (np.bincount(r, theta[:-1][c], n) + theta[-1] for r, c, n in (positive, unlabelled))
    sp, su = _probability(zp), _probability(zu)
    pull = lambda rows, columns, slope: np.append(np.bincount(columns, slope[rows], m), slope.sum())
    gained = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    down = pull(ur, uc, su / n_u) - prior * pull(pr, pc, sp / n_p)
    return gained, negative, prior * pull(pr, pc, (sp - 1) / n_p) + down if negative >= 0 else -down


def _probability(odds):
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def matching_bias(odds: np.ndarray, prior: float) -> float:
    """What to add to log-odds so that their mean probability is the prior."""
    low, high = -60.0, 60.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if _probability(odds + middle).mean() < prior else (low, middle)
    return (low + high) / 2


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400, rate: float = 0.1, decay: float = 3e-4, patience: int = 40) -> Classifier:
    """One classifier by the non-negative risk estimator, full batches and Adam.

    Ends ``patience`` steps after the last gain in the risk, whose best weights are kept.
    """
    start = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    buckets = telling(positive, unlabelled) if positive and unlabelled else np.zeros(0, np.uint32)
    if not len(buckets):
        return Classifier(buckets, np.zeros(0), start)
    sides = [(*_rows(x, buckets), len(x)) for x in (positive, unlabelled)]
    theta = np.append(np.zeros(len(buckets)), start)
    first, second, best, least, at = np.zeros(len(theta)), np.zeros(len(theta)), theta, np.inf, 0
    for step in range(1, rounds + 1):
        gained, negative, gradient = risk(theta, *sides, prior)
        total = gained + max(negative, 0.0) + decay / 2 * float((theta[:-1] ** 2).sum())
        if total < least - 1e-6:
            best, least, at = theta.copy(), total, step
        if step - at > patience:
            break
        gradient[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = best[:-1]
    odds = np.bincount(sides[1][0], weights[sides[1][1]], len(unlabelled))
    return Classifier(buckets, weights, min(start, matching_bias(odds, prior)))


def mean_of(models: list[Classifier]) -> Classifier:
    """The classifier of the mean log-odds; those without features only count if there are no others."""
    models = [m for m in models if len(m.buckets)] or models
    buckets, place = np.unique(np.concatenate([m.buckets for m in models]), return_inverse=True)
    weights = np.bincount(place, np.concatenate([m.weights for m in models]), len(buckets)) / len(models)
    return Classifier(buckets, weights, float(np.mean([m.bias for m in models])))


def _extract(only: np.ndarray | None):
    schema = pa.schema([("features", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column("text")):
                out = {"features": [], "low": [], "high": []}
                for x in text_features(texts):
                    codes = x.astype(np.uint64)
                    out["low"].append(int(mix(codes).min()) >> 1 if len(x) else 0)
                    out["high"].append(int(mix(codes + np.uint64(1 << 40)).min()) >> 1 if len(x) else 0)
                    if only is not None:
                        x = x[only[np.minimum(np.searchsorted(only, x), len(only) - 1)] == x]
                    out["features"].append(x.astype("<u4").tobytes())
                yield batch_of(schema, out)

    return run


def _collect(docs: DataFrame, only: np.ndarray | None = None) -> list[np.ndarray]:
    """The features of a bounded sample, among ``only`` if given; of texts with two equal min-hashes of all
    their features, which are near copies, the one with the longest list."""
    rows = docs.select("text").mapInArrow(_extract(only), "features binary, low long, high long").toArrow()
    found: dict[tuple[int, int], bytes] = {}
    for packed, low, high in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
        found[low, high] = max(found.get((low, high), b""), packed, key=lambda x: (len(x), x))
    return [np.frombuffer(found[k], "<u4") for k in sorted(found)]


def _share(id_col: str, bound: int, n: int) -> Column:
    """A hash of the id picks about ``bound`` of ``n`` rows, all if there are not more."""
    if n <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) < int(bound / n * (1 << 30))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """Fit on rows of ``labels`` outside the held-out fold: the positives, and all of them unlabelled."""
    rows = text_rows(docs, id_col, text_col).filter(F.col("doc_id").isNotNull())
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (bucket("doc_id", FOLDS) != HELD_OUT))
    n_known, n_positive = known.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = n_positive / n_known if n_known else 0.0

    def chosen(some: DataFrame, bound: int, n: int) -> DataFrame:
        ids = some.select("doc_id").distinct().filter(_share("doc_id", bound, n))  # about ``bound`` ids
        return rows.join(F.broadcast(ids), "doc_id", "left_semi")

    positive = _collect(chosen(known.filter("label = 1"), MAX_POSITIVE, n_positive))
    if not positive:
        return fit([], [], prior)
    unlabelled = _collect(chosen(known, MAX_UNLABELLED, n_known), np.unique(np.concatenate(positive)))
    parts = ([x for j, x in enumerate(unlabelled) if j % CLASSIFIERS != i] for i in range(CLASSIFIERS))
    return mean_of([fit(positive, part, prior) for part in parts])


def _scorer(model: Classifier, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (x for texts in text_slices(texts_of(batch, text_col)) for x in text_features(texts))
            scores = _probability(np.array([model.log_odds(x) for x in found], float))
            kept = batch.schema.names[0]  # the row or the id
            yield pa.RecordBatch.from_arrays([batch.column(kept), pa.array(scores, pa.float64())], [kept, "score"])

    return run


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    found = text_rows(docs, id_col, text_col).mapInArrow(_scorer(model, "text"), "doc_id long, score double")
    held = bucket("doc_id", FOLDS) == HELD_OUT
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the threshold."""
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())])
    return whole_rows(docs).mapInArrow(_scorer(model, text_col), schema).filter(F.col("score") < THRESHOLD).select("row.*")
