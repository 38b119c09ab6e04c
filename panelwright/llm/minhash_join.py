"""Near duplicates by an inverted join of MinHash signature coordinates, confirmed on full shingle sets.

1. Each text becomes its set of hashed five-word shingles and a signature of ``COORDINATES`` minima.
   Texts with equal sets form a class, represented by the smallest id.
2. Classes are posted under each (coordinate, value). Pairs above ``MATCHES`` equal coordinates share
   one of the ``COORDINATES - MATCHES + 1`` rarest postings of both, so only those are kept (prefix),
   and the frequent ones are skipped.
3. In each posting all members meet its smallest one; collisions are counted on the signatures, and each
   member's best such pair is confirmed on the full sets. Linked classes get a common label.
4. Postings that still hold different labels are joined to candidate groups. A group is cut into chunks
   sorted by label; two chunks meet in one task, which compares all their sets with different labels
   exactly and returns links that span what it found. Chunks that share one label never meet, so a group
   of thousands of copies costs little, and no link between different labels is lost.
5. Links are contracted to components; a component is named by its smallest id.

The one approximation is the signature: a pair of similarity 0.75 stays below ``MATCHES`` with a
probability of 8e-6, a pair of 0.8 with 2e-7 (binomial).

Defined results: a null, empty or blank text has no shingles, is its own component and is kept. A row
without an id is left alone: component null, kept. Rows that share an id and a set are one class; rows
that share an id with different texts are each judged by their own text. Other columns are ignored by
``components`` and kept by ``deduplicate``. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import batch_of, mix, prepare, shingle_codes, spaced_words, text_rows, text_slices, word_codes, written

WIDTH = 5
COORDINATES = 32
MATCHES = 13
#: Similarity of linked documents, in hundredths.
PERCENT = 75
#: About how many members or shingles a chunk has at most.
CHUNK_MEMBERS, CHUNK_SHINGLES = 1024, 600_000

_FACTORS = np.random.default_rng(20240607).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle codes of each text, words lower-cased (A-Z only)."""
    import pyarrow.compute as pc

    words = spaced_words(pc.ascii_lower(texts))
    codes = word_codes(words)
    for i in range(len(words)):
        yield np.unique(shingle_codes(codes[words.bounds[i] : words.bounds[i + 1]], width))


def signature(codes: np.ndarray) -> np.ndarray:
    return np.array([(codes * f).min() for f in _FACTORS], np.uint64).view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])


def _digest(packed: bytes) -> bytes | None:
    return hashlib.blake2b(packed, digest_size=16).digest() if packed else None


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for texts in text_slices(batch.column("text")):
                for codes in shingle_sets(texts, width):
                    sizes.append(len(codes))
                    digests.append(_digest(codes.tobytes()))
                    signatures.append(signature(mix(codes)).tobytes() if len(codes) else None)
            yield batch_of(_SIGNED, {"doc_id": batch.column("doc_id"), "n_shingles": sizes, "digest": digests, "signature": signatures})

    return run


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("place", pa.int32()), ("value", pa.int64()), ("rep", pa.int64())])
    for batch in batches:
        reps = batch.column("rep").to_numpy()
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.int64)
        places = np.tile(np.arange(COORDINATES, dtype=np.int32), len(reps))
        yield batch_of(schema, {"place": places, "value": values, "rep": np.repeat(reps, COORDINATES)})


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("matches", pa.int32())])
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.int64).reshape(-1, COORDINATES) for n in ("sig_a", "sig_b"))
        yield batch_of(schema, {"a": batch.column("a"), "b": batch.column("b"), "matches": (one == two).sum(axis=1)})


def _similar(one: np.ndarray, two: np.ndarray) -> bool:
    small, large = sorted((len(one), len(two)))
    if 100 * small < PERCENT * large:
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= PERCENT * (small + large - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        ones, twos = (batch.column(n) for n in ("set_a", "set_b"))
        good = [i for i in range(len(batch)) if _similar(np.frombuffer(ones[i].as_buffer(), np.uint64), np.frombuffer(twos[i].as_buffer(), np.uint64))]
        picked = pa.array(good, pa.int64())
        yield batch_of(schema, {"a": batch.column("a").take(picked), "b": batch.column("b").take(picked)})


def _set_rows(width: int):
    schema = pa.schema([("rep", pa.int64()), ("digest", pa.binary()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text")):
                codes = [x.tobytes() for x in shingle_sets(texts, width)]
                digests = [_digest(x) for x in codes]
                yield batch_of(schema, {"rep": batch.column("doc_id").slice(at, len(texts)), "digest": digests, "codes": codes})
                at += len(texts)

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weight of the rows before each one in its sorted partition."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        weights = batch.column("weight").to_numpy()
        ends = at + np.cumsum(weights)
        extra = [pa.array(np.full(len(batch), part), pa.int32()), pa.array(ends - weights, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "ahead"])
        at = int(ends[-1]) if len(ends) else at


def _overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of the first list with each of the second."""
    if len(rows) * len(columns) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in columns] for a in rows])
    both = np.intersect1d(np.unique(np.concatenate(rows)), np.unique(np.concatenate(columns)), assume_unique=True)
    total = np.zeros((len(rows), len(columns)), np.float32)

    def part(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        dense = np.zeros((len(sets), len(some)), np.float32)
        for i, x in enumerate(sets):
            at = np.searchsorted(some, x)
            at[at == len(some)] = 0
            dense[i, at[some[at] == x]] = 1
        return dense

    for i in range(0, len(both), 8192):
        some = both[i : i + 8192]
        total += part(rows, some) @ part(columns, some).T
    return np.rint(total).astype(np.int64)


def _meet(table: pa.Table) -> pa.Table:
    """Links that join the labels of two chunks (or of one chunk with itself)."""
    rows = table.sort_by([("group", "ascending"), ("rep", "ascending")])
    reps, groups, labels, sides = (rows.column(n).to_numpy() for n in ("rep", "group", "label", "side"))
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("codes").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    one_chunk = len(set(sides.tolist())) == 1
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    edges = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, int)
    for first, end in zip(edges, np.append(edges[1:], len(groups)), strict=True):
        own = np.arange(first, end)
        left, right = (own, own) if one_chunk else (own[sides[own] == 0], own[sides[own] == 1])
        if not len(left) or not len(right) or len(np.unique(labels[own])) < 2:
            continue
        n, m = sizes[left][:, None], sizes[right][None, :]
        due = (labels[left][:, None] != labels[right][None, :]) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
        if not due.any():
            continue
        both = _overlaps([sets[i] for i in left], [sets[i] for i in right])
        for i, j in np.argwhere(due & (100 * both >= PERCENT * (n + m - both))):
            a, b = root(int(labels[left[i]])), root(int(labels[right[j]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((int(reps[left[i]]), int(reps[right[j]])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``rep, label`` for every end of a link (columns a and b); the label is the component's smallest id.

    Each round every node moves to the neighbour (or itself) with the smallest hash of that round; the
    links between the places moved to remain. The moves are then followed in order.
    """
    edges = written(links.select("a", "b").filter("a != b").distinct(), "links")
    place = None
    for i in range(max_rounds):
        if edges.isEmpty():
            break
        ends = edges.union(edges.select("b", "a"))
        key = lambda c: F.struct(F.xxhash64(F.lit(i), c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        moves = ends.groupBy("a").agg(F.min(key("b")).alias("best"))
        moves = moves.select(F.col("a").alias("node"), F.least(F.col("best"), key("a"))["v"].alias("to"))
        moves = written(moves, "moves")
        one = moves.select(F.col("node").alias("a"), F.col("to").alias("x"))
        two = moves.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = edges.join(one, "a").join(two, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = written(edges.distinct(), "links")
        if place is None:
            place = moves.select(F.col("node").alias("rep"), "to")
        else:
            place = place.join(moves.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
            place = place.select("rep", F.coalesce("next", "to").alias("to"))
        place = written(place, "places")
    else:
        raise RuntimeError("Components did not settle")
    if place is None:
        return edges.select(F.col("a").alias("rep"), F.col("b").alias("label"))
    names = place.groupBy("to").agg(F.min("rep").alias("label"))
    return written(place.join(names, "to").select("rep", "label"), "labels")


def links(classes: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Confirmed links (``a, b``) that connect all similar classes (``rep, n, signature``)."""
    posted = classes.select("rep", "signature").mapInArrow(_post, "place int, value long, rep long")
    shared = posted.groupBy("place", "value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held = posted.join(shared, ["place", "value"])
    # Postings with one member are the rarest and lead nowhere; the rest of the prefix is taken in order.
    order = Window.partitionBy("rep").orderBy("df", "place")
    held = held.withColumn("rank", F.row_number().over(order)).withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("rep")))
    prefix = written(held.filter(f"rank <= held - {MATCHES} + 1").select("place", "value", "rep"), "postings")

    lead = prefix.groupBy("place", "value").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = prefix.join(lead, ["place", "value"])
    pairs = met.filter("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    signed = lambda c: classes.select(F.col("rep").alias(c), F.col("signature").alias(f"sig_{c}"))
    counted = pairs.join(signed("a"), "a").join(signed("b"), "b").mapInArrow(_matches, "a long, b long, matches int")
    counted = written(counted.filter(F.col("matches") >= MATCHES), "pairs")
    best = counted.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a")).select("a", "b")
    best = written(best, "best")

    used = met.select("rep").distinct()
    texts = text_rows(docs).join(used.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    sets = texts.mapInArrow(_set_rows(width), "rep long, digest binary, codes binary")
    # The digest tells a representative from other rows with its id; copies of it are one set.
    sets = written(sets.dropDuplicates(["rep", "digest"]).join(classes.select("rep", "digest"), ["rep", "digest"], "left_semi").select("rep", "codes"), "sets")
    of = lambda c: sets.select(F.col("rep").alias(c), F.col("codes").alias(f"set_{c}"))
    first = best.join(of("b"), "b").join(of("a"), "a").mapInArrow(_confirm, "a long, b long")
    first = written(first, "first")

    labels = connected(first)
    named = met.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = named.groupBy("place", "value").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.first("lead").alias("lead"), F.max("rep").alias("last"), F.first("size").alias("size"))
    # A posting of two whose pair was confirmed or refuted above needs no second look.
    mixed = mixed.filter("low != high").join(best.select(F.col("a").alias("lead"), F.col("b").alias("last"), F.lit(True).alias("seen")), ["lead", "last"], "left")
    mixed = mixed.filter("not (size = 2 and seen is not null)").select("place", "value")
    open_ends = written(met.join(mixed, ["place", "value"]).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "open")
    members = connected(open_ends).withColumnRenamed("label", "group")
    members = members.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")).join(classes.select("rep", "n"), "rep")
    keys = ["group", "label", "n", "rep"]
    # A member weighs its shingles, or its share of a full chunk; chunks are cut by the running weight.
    weight = F.greatest("n", F.lit(CHUNK_SHINGLES // CHUNK_MEMBERS)).cast("long")
    ranged = members.select("rep", "group", "label", "n", weight.alias("weight")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = written(ranged.mapInArrow(_running, "rep long, group long, label long, n long, weight long, part int, ahead long"), "running")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("weight").alias("total"))  # one row for each partition
    totals = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))
    chunk = F.floor((F.col("start") + F.col("ahead")) / CHUNK_SHINGLES).cast("long")
    chunked = written(ranged.join(totals, "part").select("rep", "group", "label", "n", chunk.alias("chunk")), "chunks")

    parts = chunked.groupBy("group", "chunk").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    left, right = (parts.select("group", *(F.col(c).alias(f"{c}_{s}") for c in ("chunk", "low", "high", "least", "most"))) for s in ("l", "r"))
    blocks = left.join(right, "group").filter("chunk_l <= chunk_r and not (low_l = high_l and low_r = high_r and low_l = low_r)")
    blocks = blocks.filter(f"100 * most_l >= {PERCENT} * least_r and 100 * most_r >= {PERCENT} * least_l")
    blocks = blocks.select("chunk_l", "chunk_r").distinct()
    sides = blocks.select("chunk_l", "chunk_r", F.col("chunk_l").alias("chunk"), F.lit(0).alias("side"))
    sides = sides.union(blocks.filter("chunk_l != chunk_r").select("chunk_l", "chunk_r", F.col("chunk_r").alias("chunk"), F.lit(1).alias("side")))
    loaded = sides.join(chunked, "chunk").join(sets.select("rep", "codes"), "rep")
    loaded = loaded.select("chunk_l", "chunk_r", "side", "rep", "group", "label", "codes")
    second = loaded.groupBy("chunk_l", "chunk_r").applyInArrow(_meet, "a long, b long")
    return first.union(written(second, "second"))


def components(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    rows = text_rows(docs, id_col, text_col)
    signed = rows.mapInArrow(_sign(width), "doc_id long, n_shingles long, digest binary, signature binary")
    signed = written(signed, "signed")
    known = signed.filter("doc_id is not null and digest is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = written(classes, "classes")
    label = connected(links(classes, rows, width))
    named = classes.select("digest", "rep").join(label, "rep", "left").select("digest", F.coalesce("label", "rep").alias("label"))
    found = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are named as their component, with all their columns."""
    prepare(docs.sparkSession)
    stay = components(docs, WIDTH, id_col, text_col).filter("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    keyed = docs.select(F.struct("*").alias("__row"), docs[id_col].cast("long").alias("__id"))
    alone = keyed.filter("__id is null")
    return keyed.join(stay, "__id", "left_semi").unionByName(alone).select("__row.*")
