"""Column summaries and exact quantiles over tables of any size.

``percentile`` keeps every distinct value of a column in one reducer. Here a column is narrowed down
instead: values are counted in equal-width bins, the bin that holds the wanted rank is cut into bins
again, and so on until the value is known. A bracket that equal widths hardly narrow down (a heavy tail)
is cut into bins of equal width of the logarithm once, after which its values are of one magnitude: the
number of rounds does not grow with the spread. Every round is one scan in which tasks count Arrow batches column
by column; what moves is bins times columns, never values. All columns go through a round together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.partials import gathered, on_doubles

#: Bins per bracket and round.
BINS = 4096
#: Bins of all brackets of a round (24 bytes each), unless that leaves a bracket less than 256.
ROUND_BINS = 1 << 19
#: Values that are fetched as they are (8 bytes each) instead of being counted in bins once more.
FETCH_LIMIT = 2_000_000

_ID, _VALUE = "_id", "_value"


@dataclass(frozen=True)
class Summary:
    """One column: rows, values (rows that are not NULL), moments, finite extremes, infinities."""

    rows: int = 0
    values: int = 0
    mean: float | None = None
    variance: float | None = None
    low: float | None = None
    high: float | None = None
    below: int = 0
    above: int = 0


@dataclass
class _Bracket:
    """Values of ``column`` in ``[low, high]``, the first of them at rank ``start``."""

    column: str
    low: float
    high: float
    start: int
    count: int
    ranks: set[int] = field(default_factory=set)
    #: Whether the next bins are of equal width of the logarithm, and whether such bins came before.
    by_magnitude: bool = False
    of_one_magnitude: bool = False


def long_form(df: DataFrame, values: Sequence[Column | str]) -> DataFrame:
    """One row per row and expression: its position and its value."""
    return df.select(F.posexplode(F.array(*values)).alias(_ID, _VALUE))


def summarize(
    df: DataFrame, columns: Sequence[str], *, moments: bool = False
) -> dict[str, Summary]:
    """Summaries of DOUBLE columns in one pass; ``moments`` adds mean and population variance."""
    width = len(columns)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterable[tuple[int, bytes]]:
        total = None
        for batch in batches:
            own = np.array([_facts(c, moments) for c in batch.columns])
            total = own if total is None else _joined(total, own)
        return [] if total is None else [(0, total.tobytes())]

    def merge(payloads: list[bytes]) -> bytes:
        parts = [np.frombuffer(x).reshape(width, -1) for x in payloads]
        # Neighbours two by two, so that rounding grows with the logarithm of their number.
        while len(parts) > 1:
            parts = [_joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0].tobytes()

    if not width:
        return {}
    # One row comes back.
    found = gathered(on_doubles(df, columns, build), merge)
    if not found:
        return {c: Summary() for c in columns}
    return {c: _summary(x, moments) for c, x in zip(columns, np.frombuffer(found[0]).reshape(width, -1).tolist())}


def _facts(column: pa.Array, moments: bool) -> tuple[float, ...]:
    """Rows, values, infinities, finite extremes, sum, mean and centred square sum."""
    v = column.drop_null().to_numpy(zero_copy_only=False)
    finite, below, above = v, 0, 0
    if not np.isfinite(v).all():
        finite, below, above = v[np.isfinite(v)], int((v == -np.inf).sum()), int((v == np.inf).sum())
    low, high = finite.min(initial=np.inf), finite.max(initial=-np.inf)
    total = mean = squares = 0.0
    if moments and len(v):
        with np.errstate(invalid="ignore", over="ignore"):
            total = v.sum()
            mean = total / len(v)
            gap = v - mean
            squares = gap @ gap
    return len(column), len(v), below, above, low, high, total, mean, squares


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The facts of both; columns by facts."""
    out = a + b
    out[:, 4], out[:, 5] = np.minimum(a[:, 4], b[:, 4]), np.maximum(a[:, 5], b[:, 5])
    n, m = a[:, 1], b[:, 1]
    some = np.maximum(n + m, 1.0)
    with np.errstate(invalid="ignore", over="ignore"):
        gap = np.where((n > 0) & (m > 0), b[:, 7] - a[:, 7], 0.0)
        out[:, 7] = np.where(n > 0, a[:, 7], b[:, 7]) + gap * (m / some)
        out[:, 8] += gap * gap * (n / some * m)
    return out


def _summary(facts: list[float], moments: bool) -> Summary:
    rows, values, below, above = map(int, facts[:4])
    low, high = (facts[4], facts[5]) if facts[4] <= facts[5] else (None, None)
    mean, variance = (facts[6] / values, facts[8] / values) if moments and values else (None, None)
    return Summary(rows, values, mean, variance, low, high, below, above)


def exact_quantiles(
    df: DataFrame,
    probabilities: Mapping[str, Sequence[float]],
    summaries: Mapping[str, Summary] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per DOUBLE column, NULL skipped; None for an empty column.

    ``summaries`` of the same frame save a pass.
    """
    if not probabilities:
        return {}
    if summaries is None:
        summaries = summarize(df, list(probabilities))
    positions = {
        c: [p * (summaries[c].values - 1) for p in ps if summaries[c].values]
        for c, ps in probabilities.items()
    }
    ranks = {
        c: sorted({r for at in positions[c] for r in (math.floor(at), math.ceil(at))})
        for c in probabilities
    }
    values = order_statistics(df, ranks, summaries)

    def interpolated(c: str, at: float) -> float:
        low, high = values[c, math.floor(at)], values[c, math.ceil(at)]
        return low if low == high else low + (high - low) * (at - math.floor(at))

    return {
        c: [interpolated(c, at) for at in positions[c]] or [None] * len(ps)
        for c, ps in probabilities.items()
    }


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    summaries: Mapping[str, Summary] | None = None,
) -> dict[tuple[str, int], float]:
    """``(column, rank) -> value`` at 0-based positions of the sorted values, without sorting."""
    if summaries is None:
        summaries = summarize(df, list(ranks))
    known: dict[tuple[str, int], float] = {}
    brackets = []
    for c, wanted in ranks.items():
        s = summaries[c]
        finite = s.values - s.below - s.above
        for r in wanted:
            if not 0 <= r < s.values:
                raise ValueError(f"Column {c!r} has no rank {r} among {s.values} values")
            if r < s.below:
                known[c, r] = float("-inf")
            elif r >= s.below + finite:
                known[c, r] = float("inf")
        open_ = {r for r in wanted if (c, r) not in known}
        if open_:
            brackets.append(_Bracket(c, s.low, s.high, s.below, finite, open_))
    brackets = _settle(brackets, known)
    while brackets:
        if sum(b.count for b in brackets) <= FETCH_LIMIT:
            _fetch(df, brackets, known)
            break
        brackets = _settle(_refine(df, brackets), known)
    return known


def _settle(brackets: list[_Bracket], known: dict[tuple[str, int], float]) -> list[_Bracket]:
    """Read off the ranks that are the ends of a bracket; keep the brackets with others left."""
    kept = []
    for b in brackets:
        for r in list(b.ranks):
            if b.low == b.high or r == b.start:
                known[b.column, r] = b.low
            elif r == b.start + b.count - 1:
                known[b.column, r] = b.high
            else:
                continue
            b.ranks.discard(r)
        if b.ranks:
            kept.append(b)
    return kept


def _columns_of(brackets: list[_Bracket]) -> list[str]:
    return list(dict.fromkeys(b.column for b in brackets))


def _inside(batches: Iterator[pa.RecordBatch], brackets: list[_Bracket], columns: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """The values in each bracket, batch by batch."""
    for batch in batches:
        held = {c: x.drop_null().to_numpy(zero_copy_only=False) for c, x in zip(columns, batch.columns, strict=True)}
        for i, b in enumerate(brackets):
            v = held[b.column]
            v = v[(v >= b.low) & (v <= b.high)]
            if len(v):
                yield i, v


#: Magnitudes below this count as zero in bins of the logarithm.
_LEAST = 1e-300
#: A round that leaves more than this share of a bracket is followed by bins of the logarithm.
_SLOW = 0.125


def _magnitude(v: np.ndarray) -> np.ndarray:
    """A number that grows with ``v`` and with the logarithm of its distance from 0."""
    size = np.log(np.maximum(np.abs(v), _LEAST)) - math.log(_LEAST)
    return np.where(np.abs(v) <= _LEAST, 0.0, np.sign(v) * size)


def _magnitude_of(x: float) -> float:
    return 0.0 if abs(x) <= _LEAST else math.copysign(math.log(abs(x)) - math.log(_LEAST), x)


def _refine(df: DataFrame, brackets: list[_Bracket]) -> list[_Bracket]:
    """One counting round: the bins of each bracket that hold a wanted rank."""
    for b in brackets:
        b.by_magnitude = b.by_magnitude and _magnitude_of(b.low) < _magnitude_of(b.high)
    # Halved where the span itself would overflow.
    halves = [0.5 if math.isinf(b.high - b.low) and not b.by_magnitude else 1.0 for b in brackets]
    ends = [
        (_magnitude_of(b.low), _magnitude_of(b.high)) if b.by_magnitude else (b.low * h, b.high * h)
        for b, h in zip(brackets, halves)
    ]
    columns, stretched = _columns_of(brackets), [b.by_magnitude for b in brackets]
    n_bins = min(BINS, max(256, ROUND_BINS // len(brackets)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterable[tuple[int, bytes]]:
        counts: dict[int, list[np.ndarray]] = {}
        for i, v in _inside(batches, brackets, columns):
            if i not in counts:
                counts[i] = [np.zeros(n_bins, np.int64), np.full(n_bins, np.inf), np.full(n_bins, -np.inf)]
            (a, z), number = ends[i], counts[i]
            value = _magnitude(v) if stretched[i] else v * halves[i]
            bin_ = np.clip(np.floor((value - a) / (z - a) * n_bins), 0, n_bins - 1).astype(np.int64)
            number[0] += np.bincount(bin_, minlength=n_bins)
            np.minimum.at(number[1], bin_, v)
            np.maximum.at(number[2], bin_, v)
        return [(i, b"".join(x.tobytes() for x in number)) for i, number in counts.items()]

    def merge(payloads: list[bytes]) -> bytes:
        parts = [(np.frombuffer(x, np.int64, n_bins), np.frombuffer(x, float, offset=8 * n_bins).reshape(2, -1)) for x in payloads]
        ends = [f.reduce([e[k] for _, e in parts]) for k, f in enumerate((np.minimum, np.maximum))]
        return b"".join(x.tobytes() for x in (sum(n for n, _ in parts), *ends))

    # A row for each bracket comes back.
    counted = gathered(on_doubles(df, columns, build), merge)
    found: list[_Bracket] = []
    by_bracket: list[list] = [[] for _ in brackets]
    for i, payload in counted.items():
        number, (lows, highs) = np.frombuffer(payload, np.int64, n_bins), np.frombuffer(payload, float, offset=8 * n_bins).reshape(2, -1)
        by_bracket[i] = [
            {"count": int(number[k]), "low": float(lows[k]), "high": float(highs[k])} for k in np.flatnonzero(number)
        ]
    for b, bins in zip(brackets, by_bracket):
        start = b.start
        for r in bins:
            inside = {x for x in b.ranks if start <= x < start + r["count"]}
            if inside:
                slow = r["count"] > _SLOW * b.count and not (b.by_magnitude or b.of_one_magnitude)
                seen = b.by_magnitude or b.of_one_magnitude
                found.append(_Bracket(b.column, r["low"], r["high"], start, r["count"], inside, slow, seen))
            start += r["count"]
    return found


def _fetch(df: DataFrame, brackets: list[_Bracket], known: dict[tuple[str, int], float]) -> None:
    """Read the few values left, at most FETCH_LIMIT, and take the wanted ones."""
    columns = _columns_of(brackets)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterable[tuple[int, bytes]]:
        held: dict[int, list[np.ndarray]] = {}
        for i, v in _inside(batches, brackets, columns):
            held.setdefault(i, []).append(v)
        return [(i, np.concatenate(parts).tobytes()) for i, parts in held.items()]

    left: list[list[np.ndarray]] = [[np.zeros(0)] for _ in brackets]
    for r in on_doubles(df, columns, build).collect():
        left[r["place"]].append(np.frombuffer(r["payload"]))
    for b, parts in zip(brackets, left):
        values = np.sort(np.concatenate(parts))
        for r in b.ranks:
            known[b.column, r] = float(values[r - b.start])
