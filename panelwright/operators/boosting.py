"""Gradient-boosted regression trees: histograms, leaf-wise growth, second-order gains with L1 and L2 terms.

The features are cut into at most ``max_bin`` bins at quantiles of one sketch scan and packed, a byte
for each feature (two above 256 bins), into a table of blocks of rows that all passes read, a few blocks at a time. A pass builds, for every open leaf at once, the sums of
gradients and the counts (squared loss: the second derivative is 1) of both children it would get; tasks add
up their own rows, and the sums are merged over levels. Gradients are whole numbers of a fixed unit, so that
the sums, and with them the trees, do not depend on how the rows are partitioned.

A tree grows best first: the open leaf with the greatest gain is split until there are ``num_leaves``. Since
a split changes no other leaf, the children of all open leaves are measured in the same pass, and a tree
takes about as many passes as it is deep. Ties go to the lower leaf, feature and bin. NULL and NaN go left.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.partials import PARTIALS_DDL, add_integers, doubles_of, map_doubles, merged, per_task
from panelwright.functions.sketches import column_sketches
from panelwright.session import at_most, materialize

PREDICTION = "prediction"
#: Trees after which the scores of all rows are written again.
REFRESH = 10
#: Trees times rows that are scored in each pass until the scores are written again, at three trees or more.
REFRESH_ROWS = 1 << 23
#: Bytes of a batch that is sent to Python, and blocks that a reader of their table holds: blocks are long rows, of
#: which Spark's usual numbers are hundreds of MB.
BATCH_BYTES, BLOCKS_AT_ONCE = 16 << 20, 64
#: Bytes of the histograms of all leaves up to which the driver keeps them.
HELD_BYTES = 256 << 20
#: Features of one merged payload.
BLOCK = 16
#: Rows summed at once: sums of so many whole numbers below 2^36 are exact in a double.
BATCH_ROWS = 1 << 16
#: Rows of a block, which is one row of the table that the passes read.
BLOCK_ROWS = 1 << 13
_UNITS = 36


@dataclass(frozen=True)
class BoostingSpec:
    """Parameters under their usual names and with their usual defaults (fixed values)."""

    n_estimators: int = 100
    num_leaves: int = 31
    #: Unlimited if not positive.
    max_depth: int = -1
    learning_rate: float = 0.1
    min_child_samples: int = 20
    #: Share of the rows and of the features that a tree sees.
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 0.0
    random_state: int = 42
    max_bin: int = 255

    def __post_init__(self) -> None:
        if self.num_leaves < 2 or self.n_estimators < 1 or not 2 <= self.max_bin <= 65_535:
            raise ValueError("num_leaves must be 2 or more, n_estimators 1 or more, max_bin 2 to 65,535")
        if not (0 < self.subsample <= 1 and 0 < self.colsample_bytree <= 1):
            raise ValueError("subsample and colsample_bytree are shares above 0 and up to 1")
        if min(self.reg_alpha, self.reg_lambda, self.min_child_samples) < 0 or self.learning_rate <= 0:
            raise ValueError("Penalties and min_child_samples must not be negative, learning_rate must be positive")


@dataclass
class Tree:
    """Nodes by number: the feature and bin of inner ones (rows up to the bin go left), the value of leaves."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, gain: float) -> int:
        """Give ``node`` two children; the number of the left one, the right one follows."""
        first = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, bin_, first, gain
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.value, 0.0), (self.gain, 0.0)):
            column += [empty, empty]
        return first

    def leaf_of(self, bins: np.ndarray, only: Sequence[int] | None = None) -> np.ndarray:
        """The leaf of each row of bin numbers (rows by features); rows in none of the leaves ``only`` may be left at the root.

        A node parts its own rows only, by one column: ``bins`` is read fastest if its columns are contiguous.
        """
        node = np.zeros(len(bins), np.int64)
        leads = [only is None or at in only for at in range(len(self.feature))]
        for at in reversed(range(len(leads))):  # children have higher numbers
            if self.feature[at] >= 0:
                leads[at] = leads[self.left[at]] or leads[self.left[at] + 1]
        waiting: list[tuple[int, np.ndarray | None]] = [(0, None)]  # all rows start at the root
        while waiting:
            at, rows = waiting.pop()
            if not leads[at]:
                continue
            feature = self.feature[at]
            if feature < 0:
                node[slice(None) if rows is None else rows] = at
                continue
            column = bins[:, feature]
            right = (column if rows is None else column[rows]) > self.bin[at]
            parts = (np.flatnonzero(~right), np.flatnonzero(right)) if rows is None else (rows[~right], rows[right])
            waiting += [(self.left[at] + i, part) for i, part in enumerate(parts) if len(part)]
        return node


@dataclass(frozen=True)
class BoostedFit:
    """A fitted ensemble: the mean it starts from, the bin edges of each feature, the trees."""

    features: tuple[str, ...]
    base: float
    edges: tuple[tuple[float, ...], ...]
    trees: tuple[Tree, ...]

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "base": self.base, "edges": self.edges, "trees": [asdict(t) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> BoostedFit:
        d = json.loads(text)
        return cls(tuple(d["features"]), d["base"], tuple(map(tuple, d["edges"])), tuple(Tree(**t) for t in d["trees"]))

    def importances(self) -> dict[str, float]:
        """Share of each feature in the total gain."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += g
        return dict(zip(self.features, (total / (total.sum() or 1.0)).tolist()))

    def score(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.leaf_of(bins)]
        return out


def bin_numbers(columns: Sequence[np.ndarray], edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin of each value: the number of edges below it; 0 for a missing one. Rows by features."""
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint16, order="F")
    for j, (values, own) in enumerate(zip(columns, edges)):
        out[:, j] = np.where(np.isnan(values), 0, np.searchsorted(np.array(own), values, "left"))
    return out


def bin_edges(df: DataFrame, features: Sequence[str], max_bin: int) -> tuple[tuple[float, ...], ...]:
    """Up to ``max_bin - 1`` edges for each feature, values of the column, from one scan."""
    edges = []
    for sketch in column_sketches(df, features).values():
        if sketch.error == 0:
            distinct = np.unique(np.concatenate(sketch.levels)).tolist()
        else:
            distinct = []
        if not 0 < len(distinct) <= max_bin:
            shares = [i / max_bin for i in range(1, max_bin)]
            distinct = sorted({x for x in sketch.quantiles(shares) if x is not None} | ({sketch.high} if sketch.rows else set()))
        edges.append(tuple(distinct[:-1]))
    return tuple(edges)


# -- gains ----------------------------------------------------------------------------------------


def _shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_score(g, n, spec: BoostingSpec):
    """What a leaf with the sums g and n takes off the loss, twice."""
    return _shrunk(g, spec.reg_alpha) ** 2 / (n + spec.reg_lambda + 1e-300)


def leaf_value(g: float, n: int, spec: BoostingSpec) -> float:
    return float(-spec.learning_rate * _shrunk(g, spec.reg_alpha) / (n + spec.reg_lambda)) if n else 0.0


def best_split(sums: np.ndarray, counts: np.ndarray, unit: float, spec: BoostingSpec) -> tuple[float, int, int, int, int] | None:
    """Gain, feature, bin, and sums of the left side; ``sums`` and ``counts`` are integers, features by bins."""
    g, n = sums.cumsum(axis=1), counts.cumsum(axis=1)
    total, rows = g[:, -1:], n[:, -1:]
    least = max(1, spec.min_child_samples)
    gain = leaf_score(g * unit, n, spec) + leaf_score((total - g) * unit, rows - n, spec) - leaf_score(total * unit, rows, spec)
    gain = np.where((n >= least) & (rows - n >= least), gain, 0.0)
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b, int(g[f, b]), int(n[f, b])) if gain[f, b] > 0 else None


# -- passes ---------------------------------------------------------------------------------------


@dataclass
class _Leaf:
    """An open leaf: its integer sums, depth, and the split it would get."""

    node: int
    depth: int
    g: int
    n: int
    best: tuple[float, int, int, int, int] | None = None
    #: Sums and counts, features by bins, where the driver keeps them.
    cells: np.ndarray | None = None


def _bins_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The packed rows as they lie in the batch: all are of one length."""
    packed, size = batch.column("bins"), 2 * width
    kind = np.int64 if pa.types.is_large_binary(packed.type) else np.int32
    start = int(np.frombuffer(packed.buffers()[1], kind)[packed.offset]) if len(packed) else 0
    data = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[start : start + size * len(packed)]
    return np.frombuffer(data.tobytes(), np.uint16).reshape(-1, width)


def _packed(bins: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    size = bins.itemsize * bins.shape[1]
    ends = np.arange(len(bins) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(bins).tobytes())])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``BATCH_ROWS``; adding to a histogram costs as much for a few rows as for many."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= BATCH_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(BATCH_ROWS)
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(BATCH_ROWS)


#: A block of rows: the bytes of their keys, targets, scores, and bin numbers feature by feature. Spark handles a
#: block at the cost of a row.
_BLOCK = pa.schema([(c, pa.binary()) for c in ("key", "y", "score", "bins")])
_BLOCK_DDL = "key binary, y binary, score binary, bins binary"


def _in_blocks(keys: np.ndarray, y: np.ndarray, score: np.ndarray, bins: np.ndarray) -> pa.RecordBatch:
    """Blocks of the given rows (``bins``: rows by features)."""
    cuts = [slice(i, i + BLOCK_ROWS) for i in range(0, len(y), BLOCK_ROWS)]
    columns = [pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in (keys, y, score)]
    packed = [_packed(np.ascontiguousarray(bins[c].T).reshape(1, -1)) for c in cuts]
    return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays(packed)], schema=_BLOCK)


def _views(column: pa.Array) -> list[np.ndarray]:
    """The bytes of each value as they lie in the column."""
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1] if len(column) else []
    data = np.frombuffer(data or b"", np.uint8)
    return [data[a:z] for a, z in zip(at, at[1:])]


def _blocks(batch: pa.RecordBatch, width: int, n_bins: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Keys, targets, scores and bin numbers (features by rows) of each block."""
    kind = np.uint8 if n_bins <= 256 else np.uint16
    columns = [_views(batch.column(c)) for c in ("key", "y", "score", "bins")]
    for key, y, score, packed in zip(*columns, strict=True):
        y = y.view(float)
        stored = np.uint8 if len(packed) == width * len(y) else np.uint16
        yield key.view(np.int64), y, score.view(float), packed.view(stored).reshape(width, -1).astype(kind, copy=False)


def _gathered_blocks(batches: Iterator[pa.RecordBatch], width: int, n_bins: int) -> Iterator[list[np.ndarray]]:
    """Blocks put together, up to ``BATCH_ROWS`` rows."""
    held, rows = [], 0
    for batch in batches:
        for block in _blocks(batch, width, n_bins):
            if rows + len(block[1]) > BATCH_ROWS:
                yield [np.concatenate(c, axis=-1) for c in zip(*held)]
                held, rows = [], 0
            held.append(block)
            rows += len(block[1])
    if held:
        yield [np.concatenate(c, axis=-1) for c in zip(*held)]


def _sampled(keys: np.ndarray, tree: int, spec: BoostingSpec) -> np.ndarray:
    """Whether the tree sees a row: a hash of the row's number and the tree's."""
    x = keys.astype(np.uint64) + np.uint64((spec.random_state * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)).astype(float) / 2.0**53 < spec.subsample


def _histograms(rows: DataFrame, fit: BoostedFit, done: int, tree: Tree, open_: list[int], used: list[int], unit: float, number: int, spec: BoostingSpec, slots: int) -> tuple[DataFrame, list[list[int]], int]:
    """The sums and counts of the ``used`` features in the leaves ``open_`` of ``tree``, a payload for each leaf and block of
    features; these blocks, and the number of bins."""
    width, n_bins = len(fit.features), max(len(e) for e in fit.edges) + 1
    blocks = [used[i : i + BLOCK] for i in range(0, len(used), BLOCK)]
    later = fit.trees[done:]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterable[tuple[int, bytes]]:
        number_of = np.full(len(tree.feature), -1)
        number_of[open_] = np.arange(len(open_))
        total = np.zeros((len(open_), len(used), n_bins, 2), np.int64)
        cells = len(open_) * n_bins
        for keys, y, score, bins in _gathered_blocks(batches, width, n_bins):
            leaf = number_of[tree.leaf_of(bins.T, open_)]
            seen = leaf >= 0
            if spec.subsample < 1:
                seen &= _sampled(keys, number, spec)
            # Only rows in open leaves need a gradient.
            seen = np.flatnonzero(seen)
            if len(seen) < len(leaf):
                bins = bins.take(seen, axis=1)
            leaf, y, score = leaf[seen], y[seen], score[seen]
            for t in later:
                score += np.array(t.value)[t.leaf_of(bins.T)]
            g = np.rint((score - y) / unit)
            first = leaf * n_bins
            for j, f in enumerate(used):
                cell = first + bins[f]
                total[:, j, :, 0] += np.bincount(cell, g, cells).astype(np.int64).reshape(-1, n_bins)
                total[:, j, :, 1] += np.bincount(cell, minlength=cells).reshape(-1, n_bins)
        for i in range(len(open_)):
            for k in range(len(blocks)):
                yield i * len(blocks) + k, total[i, k * BLOCK : (k + 1) * BLOCK].tobytes()

    return merged(rows.mapInArrow(per_task(build), PARTIALS_DDL), add_integers, slots), blocks, n_bins


def _best_splits(found: DataFrame, blocks: list[list[int]], n_bins: int, unit: float, spec: BoostingSpec) -> list[tuple]:
    """The best split of each leaf in each block of features: (leaf, gain, feature, bin, left sum, left rows, sum, rows)."""
    schema = pa.schema([("leaf", pa.int32()), ("gain", pa.float64()), *((c, pa.int64()) for c in ("feature", "bin", "left_g", "left_n", "g", "n"))])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, payload in zip(batch.column("place").to_pylist(), batch.column("payload").to_pylist()):
                i, k = divmod(at, len(blocks))
                sums = np.frombuffer(payload, np.int64).reshape(-1, n_bins, 2)
                own = (int(sums[0, :, 0].sum()), int(sums[0, :, 1].sum()))
                best = best_split(sums[:, :, 0], sums[:, :, 1], unit, spec) or (0.0, 0, 0, 0, 0)
                out.append((i, best[0], blocks[k][best[1]], best[2], best[3], best[4], *own))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    # A row for each leaf and block of features.
    ddl = "leaf int, gain double, feature long, bin long, left_g long, left_n long, g long, n long"
    return [tuple(r) for r in found.mapInArrow(choose, ddl).collect()]


def _cells(found: DataFrame, blocks: list[list[int]], n_bins: int) -> dict[int, np.ndarray]:
    """The sums and counts of each leaf, features by bins by two."""
    payloads = {r["place"]: r["payload"] for r in found.collect()}
    parts = {at: np.frombuffer(payload, np.int64).reshape(-1, n_bins, 2) for at, payload in payloads.items()}
    return {i: np.concatenate([parts[i * len(blocks) + k] for k in range(len(blocks))]) for i in {at // len(blocks) for at in parts}}


def _grow(rows: DataFrame, fit: BoostedFit, done: int, number: int, unit: float, spec: BoostingSpec, slots: int) -> Tree:
    """One tree on the gradients of the ensemble so far; the scores in ``rows`` hold its first ``done`` trees."""
    width = len(fit.features)
    n_used = max(1, round(width * spec.colsample_bytree))
    used = sorted(np.random.default_rng([spec.random_state, number]).choice(width, n_used, replace=False).tolist())
    tree, leaves = Tree(), {}

    n_bins = max(len(e) for e in fit.edges) + 1
    held = 16 * len(used) * n_bins * 2 * spec.num_leaves <= HELD_BYTES

    def measure(grown: Tree, nodes: Mapping[int, int], parents: Mapping[int, _Leaf]) -> dict[int, _Leaf]:
        """The leaves ``nodes`` (with their depths) of ``grown`` with their best splits; ``parents`` are those of the left
        leaves. Where the driver keeps histograms, only the smaller child is read: the other is what the parent has left."""
        deep = {node: spec.max_depth > 0 and depth >= spec.max_depth for node, depth in nodes.items()}
        out: dict[int, _Leaf] = {}
        if not held:
            order = sorted(nodes)
            for i, gain, feature, cut, left_g, left_n, g, n in _best_splits(*_histograms(rows, fit, done, grown, order, used, unit, number, spec, slots), unit, spec):
                leaf = out.setdefault(order[i], _Leaf(order[i], nodes[order[i]], g, n))
                if gain > 0 and not deep[leaf.node] and (leaf.best is None or (-gain, feature) < (-leaf.best[0], leaf.best[1])):
                    leaf.best = (gain, feature, cut, left_g, left_n)
            return out
        smaller = {left: left if 2 * x.best[4] <= x.n else left + 1 for left, x in parents.items()}
        order = sorted(smaller.values()) or sorted(nodes)
        found = _cells(*_histograms(rows, fit, done, grown, order, used, unit, number, spec, slots))
        cells = {order[i]: c for i, c in found.items()}
        for left, x in parents.items():
            cells[2 * left + 1 - smaller[left]] = x.cells - cells[smaller[left]]
        for node, c in cells.items():
            g, n = c[0].sum(axis=0).tolist()
            out[node] = _Leaf(node, nodes[node], g, n, None if deep[node] else best_split(c[:, :, 0], c[:, :, 1], unit, spec), c)
            if out[node].best:
                gain, feature, *split = out[node].best
                out[node].best = (gain, used[feature], *split)
        return out

    leaves = measure(tree, {0: 0}, {})
    ahead: dict[int, tuple[_Leaf, _Leaf]] = {}  # children that an open leaf would get
    n_leaves = 1
    while n_leaves < spec.num_leaves:
        able = sorted((x for x in leaves.values() if x.best), key=lambda x: (-x.best[0], x.node))
        if not able:
            break
        leaf = able[0]
        # The last splits need no children with splits of their own.
        if leaf.node not in ahead and n_leaves + 1 < spec.num_leaves:
            grown, nodes, firsts = Tree(*(list(c) for c in (tree.feature, tree.bin, tree.left, tree.value, tree.gain))), {}, {}
            for x in [x for x in able if x.node not in ahead][: spec.num_leaves - n_leaves]:
                firsts[x.node] = grown.split(x.node, x.best[1], x.best[2], x.best[0])
                nodes |= {firsts[x.node]: x.depth + 1, firsts[x.node] + 1: x.depth + 1}
            found = measure(grown, nodes, {firsts[x.node]: x for x in able if x.node in firsts})
            ahead |= {parent: (found[a], found[a + 1]) for parent, a in firsts.items()}
        gain, feature, cut, left_g, left_n = leaf.best
        first = tree.split(leaf.node, feature, cut, gain)
        left, right = ahead.pop(leaf.node, None) or (_Leaf(0, 0, left_g, left_n), _Leaf(0, 0, leaf.g - left_g, leaf.n - left_n))
        left.node, right.node = first, first + 1
        del leaves[leaf.node]
        leaves |= {first: left, first + 1: right}
        n_leaves += 1
    for x in leaves.values():
        tree.value[x.node] = leaf_value(x.g * unit, x.n, spec)
    return tree


def boost(df: DataFrame, features: Sequence[str], target: str, spec: BoostingSpec = BoostingSpec()) -> tuple[BoostedFit, float]:
    """The ensemble and its error on the rows it was fitted on. Rows need a target; features may be missing."""
    with at_most(df.sparkSession, spark__sql__execution__arrow__maxBytesPerBatch=BATCH_BYTES):
        return _boost(df, list(features), target, spec)


def _boost(df: DataFrame, features: list[str], target: str, spec: BoostingSpec) -> tuple[BoostedFit, float]:
    y = F.col(target).cast("double")
    n, mean, low, high, bad = doubles_of(df, [target]).agg(F.count(y), F.avg(y), F.min(y), F.max(y), F.count_if(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))).first()
    if bad or not n:
        raise ValueError(f"Training needs rows, and a finite target in each: {bad} of {target!r} are not")
    # Ten digits: the last ones of a mean depend on the order of the rows.
    fit = BoostedFit(tuple(features), float(f"{mean:.10g}"), bin_edges(df, features, spec.max_bin), ())
    kind = np.uint8 if max(map(len, fit.edges), default=0) < 256 else np.uint16

    # Only samples need to know a row.
    sampled = spec.subsample < 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(iter(batches)):
            own, *columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[sampled:]]
            keys = batch.column(0).to_numpy() if sampled else np.zeros(0, np.int64)
            bins = bin_numbers(columns, fit.edges).astype(kind, copy=False)
            yield _in_blocks(keys, own, np.full(len(batch), fit.base), bins)

    if sampled:
        wide = df.select(F.monotonically_increasing_id().alias("key"), y.alias("y"), *[F.col(c).cast("double") for c in features])
        packed = wide.mapInArrow(pack, _BLOCK_DDL)
    else:
        packed = map_doubles(df, [target, *features], pack, _BLOCK_DDL)
    rows = materialize(packed, "bins")
    with at_most(df.sparkSession, spark__sql__parquet__columnarReaderBatchSize=BLOCKS_AT_ONCE):
        slots = rows.rdd.getNumPartitions()  # a scan
        bound, done = max(abs(low - fit.base), abs(high - fit.base), 1e-300), 0
        for number in range(spec.n_estimators):
            unit = 2.0 ** (np.ceil(np.log2(bound)) - min(_UNITS, 61 - np.ceil(np.log2(n + 1))))
            tree = _grow(rows, fit, done, number, unit, spec, slots)
            fit = BoostedFit(fit.features, fit.base, fit.edges, (*fit.trees, tree))
            bound += max(abs(v) for v in tree.value)
            later = len(fit.trees) - done
            if (later >= REFRESH or later >= 3 and later * n >= REFRESH_ROWS) and number + 1 < spec.n_estimators:
                rows, done = materialize(_rescored(rows, fit, done), "scores"), len(fit.trees)
                slots = rows.rdd.getNumPartitions()
        return fit, _error(_rescored(rows, fit, done))


def _rescored(rows: DataFrame, fit: BoostedFit, done: int) -> DataFrame:
    """The blocks with the scores of all trees; theirs hold the first ``done``."""
    width, later, n_bins = len(fit.features), fit.trees[done:], max(len(e) for e in fit.edges) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for _, _, score, bins in _blocks(batch, width, n_bins):
                for t in later:
                    score = score + np.array(t.value)[t.leaf_of(bins.T)]
                scores.append(score.tobytes())
            columns = [batch.column("key"), batch.column("y"), pa.array(scores, pa.binary()), batch.column("bins")]
            yield pa.RecordBatch.from_arrays(columns, _BLOCK.names)

    return rows.mapInArrow(run, _BLOCK_DDL)


def _error(rows: DataFrame) -> float:
    """The root mean squared error of the scores in the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = [np.frombuffer(y) - np.frombuffer(s) for y, s in zip(batch.column("y").to_pylist(), batch.column("score").to_pylist())]
            columns = [pa.array([len(g) for g in gaps], pa.int64()), pa.array([float(g @ g) for g in gaps], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["n", "squares"])

    squares = rows.select("y", "score").mapInArrow(run, "n long, squares double")
    return squares.agg(F.sqrt(F.sum("squares") / F.sum("n"))).first()[0]


def predict_boosted(fit: BoostedFit, df: DataFrame) -> DataFrame:
    """``df`` with a ``prediction`` column, by Arrow batches of the features."""

    def forecast(*columns):
        import pandas as pd

        values = [c.to_numpy(dtype=float, na_value=np.nan) for c in columns]
        return pd.Series(fit.score(bin_numbers(values, fit.edges)))

    function = F.pandas_udf(forecast, "double")
    return df.select("*", function(*[F.col(c).cast("double") for c in fit.features]).alias(PREDICTION))
