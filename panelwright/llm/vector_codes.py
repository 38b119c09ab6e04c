"""Vector code compression: product codes, nearest entries found by geometric near-neighbour access trees.

Every component becomes the integer floor(256 x). A vector is cut into ``PARTS`` equal parts, each coded by
the nearest entry of its position's codebook (squared Euclidean distance in integers, ties to the lower
index). Codebooks start as the parts of the smallest ids; a round assigns all parts and replaces each entry
by the floor of the mean of its parts. One Arrow pass for a round: a task sums its own parts, and only sums
for each entry are shuffled.

The entries of a codebook form a GNAT. A node picks split points far from each other, gives every other
entry to its nearest split, and stores for each (split, child) the range of distances from the split to the
child's entries. A query knows its distances to the splits; a child whose range keeps a strictly greater
distance than the best one known, by the triangle inequality with any split, is left out whole. Ranges are
rounded outwards and query distances both ways, so that rounding never excludes an entry, and what remains
is decided by integer distances: equal ones go to the lower index.

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped. The length
of vectors is that of the kept one with the smallest id (equal ids: the smallest vector); rows of any other
length, and all rows if it is not a positive multiple of ``PARTS``, get a null code and error and take part
in nothing else. An id starts one entry however often it occurs, a null id none. Fewer ids give fewer
entries; without any id all codes are null. Components of a magnitude above 2^17 are refused. Labels
that are null count together. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import batch_of, joined_by_key, prepare, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest magnitude of an integer component: squared distances of 1,024 components then fit 62 bits.
LARGEST = 1 << 25
#: Splits of a node, and entries below which a node is a plain list.
SPLITS, LEAF = 6, 8
#: Relative error allowed to a square root and a sum of two; a double's is below 1e-15.
SLACK = 1e-9


@dataclass
class Gnat:
    """The tree over some entries of one codebook."""

    #: Entries and their indices, ascending.
    points: np.ndarray
    index: np.ndarray
    #: Places of the split points; without any the node is a leaf.
    splits: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    children: list[Gnat | None] = field(default_factory=list)
    #: Least and greatest distance from split i to the entries of child j.
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _squares(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, exact in 64-bit integers."""
    out = np.zeros((len(queries), len(points)), np.int64)
    for k in range(points.shape[1]):
        gap = queries[:, k, None] - points[None, :, k]
        out += gap * gap
    return out


def build(points: np.ndarray, index: np.ndarray | None = None) -> Gnat:
    """A tree over ``points`` (n, width); equal points may occur."""
    index = np.arange(len(points)) if index is None else index
    node = Gnat(points, index)
    if len(points) <= LEAF:
        return node
    square = _squares(points, points)
    splits = [int(square.sum(axis=1).argmax())]
    while len(splits) < SPLITS:
        away = square[splits].min(axis=0)
        if not away.max():
            break
        splits.append(int(away.argmax()))
    if len(splits) < 2:
        return node  # all points are equal
    home = square[splits].argmin(axis=0)
    home[splits] = -1  # splits are compared with every query
    node.splits = np.array(splits)
    shape = (len(splits), len(splits))
    node.low, node.high = np.full(shape, np.inf), np.full(shape, -np.inf)
    for j in range(len(splits)):
        own = np.flatnonzero(home == j)
        node.children.append(build(points[own], index[own]) if len(own) else None)
        if len(own):
            away = np.sqrt(square[np.ix_(splits, own)].astype(float))
            node.low[:, j], node.high[:, j] = away.min(axis=1) * (1 - SLACK), away.max(axis=1) * (1 + SLACK)
    return node


def _offer(best: np.ndarray, code: np.ndarray, rows: np.ndarray, found: np.ndarray, index: np.ndarray) -> None:
    """Take over nearer entries, and equally near ones of a lower index, for the queries ``rows``."""
    least = found.min(axis=1)
    lowest = np.where(found == least[:, None], index[None, :], np.iinfo(np.int64).max).min(axis=1)
    better = (least < best[rows]) | ((least == best[rows]) & (lowest < code[rows]))
    best[rows[better]], code[rows[better]] = least[better], lowest[better]


def _search(node: Gnat, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, code: np.ndarray) -> int:
    """Search the tree for the queries ``rows``; the number of distances computed."""
    if not len(node.splits):
        _offer(best, code, rows, _squares(queries[rows], node.points), node.index)
        return len(rows) * len(node.points)
    found = _squares(queries[rows], node.points[node.splits])
    _offer(best, code, rows, found, node.index[node.splits])
    work = found.size
    away, nearest = np.sqrt(found.astype(float)), found.argmin(axis=1)
    # A query enters the child of its nearest split first, so that the others meet a small radius.
    for first in (True, False):
        for j, child in enumerate(node.children):
            if child is None:
                continue
            due = (nearest == j) if first else (nearest != j)
            if not first:
                radius = np.sqrt(best[rows].astype(float)) * (1 + SLACK)
                for i in range(len(node.splits)):
                    # Equality stays: an equally near entry of a lower index may be there.
                    due &= away[:, i] * (1 - SLACK) - node.high[i, j] <= radius
                    due &= node.low[i, j] - away[:, i] * (1 + SLACK) <= radius
            if due.any():
                work += _search(child, queries, rows[due], best, code)
    return work


def nearest(tree: Gnat, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of and squared distance to the nearest point of each query, and the distances computed."""
    best = np.full(len(queries), np.iinfo(np.int64).max)
    code = np.full(len(queries), np.iinfo(np.int64).max)
    work = _search(tree, queries, np.arange(len(queries)), best, code) if len(queries) else 0
    return code, best, work


def _integers(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of that length, and their integer components."""
    import pyarrow.compute as pc

    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    place = np.flatnonzero(sizes == length)
    flat = vectors.take(pa.array(place)).flatten().to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(over="ignore"):
        whole = np.floor(flat * SCALE)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"A component has a magnitude above {LARGEST // SCALE}")
    return place, whole.astype(np.int64).reshape(-1, length)


def _assign(trees: list[Gnat], integers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The parts at each position, their codes and squared distances."""
    width = integers.shape[1] // len(trees)
    for p, tree in enumerate(trees):
        part = np.ascontiguousarray(integers[:, p * width : (p + 1) * width])
        yield part, *nearest(tree, part)[:2]


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])


def _sum_parts(books: list[np.ndarray], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build(b) for b in books]
        n_entries, width = len(books[0]), length // PARTS
        total, n = np.zeros((PARTS, n_entries, width), np.int64), np.zeros((PARTS, n_entries), np.int64)
        for batch in batches:
            integers = _integers(batch.column("vector"), length)[1]
            for p, (part, code, _) in enumerate(_assign(trees, integers)):
                np.add.at(total[p], code, part)
                n[p] += np.bincount(code, minlength=n_entries)
        p, e, k = np.nonzero(np.repeat(n[:, :, None] > 0, width, axis=2))
        yield batch_of(_SUMS, {"part": p.astype(np.int32), "entry": e.astype(np.int32), "place": k.astype(np.int32), "total": total[p, e, k], "n": n[p, e]})

    return run


_CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def _code(books: list[np.ndarray], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build(b) for b in books]
        for batch in batches:
            place, integers = _integers(batch.column("vector"), length)
            codes, errors = np.zeros((len(place), PARTS), np.uint8), np.zeros(len(place), np.int64)
            for p, (_, code, square) in enumerate(_assign(trees, integers)):
                codes[:, p] = code
                errors += square
            text, error = np.full(len(batch), None, object), np.zeros(len(batch), np.int64)
            text[place], error[place] = [row.tobytes().hex() for row in codes], errors
            missing = pa.array(error, pa.int64(), mask=text == None)  # noqa: E711
            yield batch_of(_CODED, {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": pa.array(text, pa.string()), "error": missing})

    return run


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, vector, label`` of the rows without null or non-finite components."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vector").isNotNull() & ~bad)


def first_codebooks(kept: DataFrame, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the smallest ids' vectors, for each position; none if no vector can be cut."""
    least = kept.filter("vec_id is not null").select("vec_id", "vector")
    head = least.orderBy("vec_id", "vector").first()
    if head is None or not head.vector or len(head.vector) % PARTS:
        return []
    same = least.filter(F.size("vector") == len(head.vector))
    last = same.select("vec_id").distinct().orderBy("vec_id").limit(entries).agg(F.max("vec_id")).first()[0]
    chosen = same.filter(F.col("vec_id") <= last).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = [r.vector for r in chosen.orderBy("vec_id").collect()]  # ENTRIES vectors
    _, integers = _integers(pa.array(rows, pa.list_(pa.float64())), len(head.vector))
    return np.split(integers, PARTS, axis=1)


def train(kept: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The codebooks after the rounds."""
    books = first_codebooks(kept, entries)
    for _ in range(rounds if books else 0):
        length = PARTS * books[0].shape[1]
        sums = kept.select("vector").mapInArrow(_sum_parts(books, length), "part int, entry int, place int, total long, n long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in sums.collect():  # one row for each component of each entry
            books[r.part][r.entry, r.place] = r.total // r.n
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every kept row."""
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    books = train(kept)
    if books:
        coded = kept.mapInArrow(_code(books, PARTS * books[0].shape[1]), "vec_id long, label string, code string, error long")
    else:
        coded = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = written(coded.withColumn("group", F.struct("label")), "codes")
    errors = coded.groupBy("group").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("error").alias("label_error"))
    found = joined_by_key(coded, errors, "group", "n_rows")
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
