"""A mergeable quantile sketch that knows how wrong it can be.

Level h holds values that each stand for 2^h rows. A level with ``size`` values or more is sorted, every
other value moves up and the rest is dropped, alternately the odd and the even ones. One such step changes
no rank by more than 2^h; the sketch adds these up, so that its ``error`` bounds the rank error of every
answer, whatever the order of rows and merges. For n rows the bound stays below n log2(n / size) / size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelwright.functions.partials import merged, on_doubles

#: Values of a level; the rank error is then 0.3 % at most for 10^12 rows.
SIZE = 8192


class QuantileSketch:
    def __init__(self, size: int = SIZE):
        if size < 2:
            raise ValueError(f"A sketch needs two values a level or more, not {size}")
        self.size, self.levels, self.odd, self.rows, self.error = size, [np.zeros(0)], [0], 0, 0
        self.low, self.high = np.inf, -np.inf

    def add(self, values: np.ndarray) -> None:
        """Take in finite values."""
        if len(values):
            self.rows += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self._push(0, values.astype(float))

    def merge(self, other: QuantileSketch) -> None:
        self.rows, self.error = self.rows + other.rows, self.error + other.error
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        for h, values in enumerate(other.levels):
            self._push(h, values)

    def _push(self, h: int, values: np.ndarray) -> None:
        while len(self.levels) <= h:
            self.levels.append(np.zeros(0))
            self.odd.append(0)
        held = np.concatenate([self.levels[h], values])
        if len(held) < self.size:
            self.levels[h] = held
            return
        held.sort()
        left = len(held) % 2  # the greatest value stays if their number is odd
        self.levels[h] = held[len(held) - left :]
        self.odd[h], start = 1 - self.odd[h], self.odd[h]
        self.error += 1 << h
        self._push(h + 1, held[start : len(held) - left : 2])

    def _ranked(self) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(self.levels)
        weights = np.repeat([1 << h for h in range(len(self.levels))], [len(x) for x in self.levels])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def quantiles(self, shares: Sequence[float]) -> list[float | None]:
        """Values whose ranks differ from ``share * (rows - 1)`` by ``error`` at most, None without rows."""
        if not self.rows:
            return [None] * len(shares)
        values, ends = self._ranked()
        out = []
        for share in shares:
            wanted = share * (self.rows - 1)
            at = int(np.searchsorted(ends, wanted, "right"))
            out.append(float(values[min(at, len(values) - 1)]))
            if wanted <= 0 or wanted >= self.rows - 1:
                out[-1] = self.low if wanted <= 0 else self.high
        return out

    def to_bytes(self) -> bytes:
        head = np.array([self.size, self.rows, self.error, len(self.levels), *(len(x) for x in self.levels), *self.odd], np.int64)
        return head.tobytes() + np.concatenate([[self.low, self.high], *self.levels]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuantileSketch:
        size, rows, error, n = np.frombuffer(data, np.int64, 4).tolist()
        sketch = cls(size)
        head = np.frombuffer(data, np.int64, 4 + 2 * n)
        sizes, sketch.odd, sketch.rows, sketch.error = head[4 : 4 + n], head[4 + n :].tolist(), rows, error
        floats = np.frombuffer(data, np.float64, offset=head.nbytes)
        sketch.low, sketch.high = floats[:2].tolist()
        sketch.levels = [x.copy() for x in np.split(floats[2:], np.cumsum(sizes)[:-1])]
        return sketch


def merge_sketches(payloads: list[bytes]) -> bytes:
    total = QuantileSketch.from_bytes(payloads[0])
    for x in payloads[1:]:
        total.merge(QuantileSketch.from_bytes(x))
    return total.to_bytes()


def column_sketches(df: DataFrame, columns: Sequence[str], size: int = SIZE) -> dict[str, QuantileSketch]:
    """One scan: a sketch of each column's finite values. The driver gets ``size`` values for each level."""
    n = len(columns)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterable[tuple[int, bytes]]:
        sketches = [QuantileSketch(size) for _ in range(n)]
        for batch in batches:
            for sketch, column in zip(sketches, batch.columns, strict=True):
                values = column.drop_null().to_numpy(zero_copy_only=False)
                sketch.add(values[np.isfinite(values)])
        return [(i, s.to_bytes()) for i, s in enumerate(sketches)]

    rows = merged(on_doubles(df, columns, build), merge_sketches).collect()
    found = {columns[r["place"]]: QuantileSketch.from_bytes(r["payload"]) for r in rows}
    return {c: found.get(c) or QuantileSketch(size) for c in columns}


def approximate_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], size: int = SIZE) -> dict[str, list[float | None]]:
    """Per column the values at the given shares, each within the sketch's rank error."""
    sketches = column_sketches(df, list(wanted), size)
    return {c: sketches[c].quantiles(shares) for c, shares in wanted.items()}
