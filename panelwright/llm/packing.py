"""Packing documents into fixed-length sequences as a cutting-stock problem.

Documents are encoded; each is cut into full sequences and a remainder. Remainders are counted by length
class, and column generation solves the linear program over cutting patterns: a knapsack dynamic
program over the classes prices new patterns with the dual values. Patterns are rounded down, what is
left gets greedy patterns, and the documents, ranked within their class, are dealt to the patterns'
places. One document in ``FILL_SHARE``, and more of the short ones, is kept out as filler: these, one after the other, are cut to
fill the gaps that classes and patterns leave, then make up full sequences, of which the last is padded.

What reaches the driver is the histogram (``LENGTH / QUANTUM`` classes) and totals. Ranks and stream
positions are running counts within a partition plus one offset for each partition and class.

Defined results: a null or empty text is its end id. Rows are packed one by one, also those with null or
repeated ids. Other columns are ignored; no rows give no rows. If fillers run out, gaps stay padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.bpe import ENCODE_BYTES, encoder
from panelwright.llm.common import batch_of, bucket, text_rows, text_slices, written

LENGTH = 4096
#: Lengths are classed in steps of this many tokens.
QUANTUM = 16
#: One document of so many fills gaps, and of short ones as many as hold what rounding loses on the others:
#: ``LOST`` tokens for each, against about one token for ``TOKEN_CHARACTERS``.
FILL_SHARE = 16
LOST, TOKEN_CHARACTERS = 10, 6
#: Sequences, and positions of the filler stream, in a block of the running totals.
SEQUENCE_BLOCK, STREAM_BLOCK = 4096, 1 << 16

_CODED = pa.schema(
    [
        ("part", pa.int64()),
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("full_before", pa.int64()),
        ("full_crcs", pa.list_(pa.int64())),
        ("rest", pa.int64()),
        ("rest_crc", pa.int64()),
        ("class", pa.int64()),
        ("class_before", pa.int64()),
        ("fill_before", pa.int64()),
        ("fill_ids", pa.binary()),
    ]
)
_CODED_DDL = (
    "part long, row long, doc_id long, doc_tokens long, full_before long, full_crcs array<long>, rest long, "
    "rest_crc long, class long, class_before long, fill_before long, fill_ids binary"
)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _code(vocabulary: str, end_id: int, length: int, quantum: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, part = encoder(vocabulary), TaskContext.get().partitionId()
        row = full = filled = 0
        ranks = np.zeros(length // quantum + 2, np.int64)
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text"), ENCODE_BYTES):
                out: dict[str, list] = {n: [] for n in _CODED.names}
                ids, bounds = tool.encode(texts)
                for i in range(len(texts)):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint16(end_id))
                    whole, rest = divmod(len(own), length)
                    fills = batch.column("fills")[at + i].as_py()
                    if fills:
                        whole = rest = 0
                    kind = -(-rest // quantum)
                    crcs = [_crc(own[k * length : (k + 1) * length]) for k in range(whole)]
                    rest_crc = _crc(own[whole * length :]) if rest else None
                    values = (
                        part, row, batch.column("doc_id")[at + i].as_py(), len(own), full, crcs, rest, rest_crc,
                        kind, int(ranks[kind]), filled, own.tobytes() if fills else None,
                    )
                    for name, value in zip(_CODED.names, values, strict=True):
                        out[name].append(value)
                    row, full = row + 1, full + whole
                    ranks[kind] += 1
                    filled += len(own) if fills else 0
                yield batch_of(_CODED, out)
                at += len(texts)

    return run


def _price(weights: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack over the classes (weights ascend)."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = np.searchsorted(weights, room, "right")
        best[room] = best[room - 1]
        if n:
            offers = best[room - weights[:n]] + values[:n]
            i = int(np.argmax(offers))
            if offers[i] > best[room] + 1e-12:
                best[room], taken[room] = offers[i], i
    pattern, room = np.zeros(len(weights), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= weights[taken[room]]
    return float(best[capacity]), pattern


def cutting_patterns(weights: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Patterns (places for each class) and how often each is used; together they hold all demand.

    The revised simplex method starts from one pattern for each class. Stopping early only costs padding.
    """
    m = len(weights)
    if m == 0:
        return []
    columns = np.diag(capacity // weights)
    inverse = np.diag(1.0 / np.diag(columns))
    used = inverse @ demand
    for _ in range(rounds):
        value, pattern = _price(weights, np.maximum(inverse.sum(axis=0), 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ pattern
        rising = step > 1e-9
        if not rising.any():
            break
        ratio = np.full(m, np.inf)
        ratio[rising] = used[rising] / step[rising]
        out = int(np.argmin(ratio))
        used -= ratio[out] * step
        used[out] = ratio[out]
        used = np.maximum(used, 0)
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        columns[:, out] = pattern
    found, left = [], demand.astype(np.int64).copy()
    for i in np.argsort(-used, kind="stable"):
        held = columns[:, i] > 0
        times = int(min(np.floor(used[i] + 1e-6), (left[held] // columns[held, i]).min()))
        if times > 0:
            found.append((columns[:, i].copy(), times))
            left -= times * columns[:, i]
    while left.any():  # the largest that fit, as often as there are enough
        pattern, room = np.zeros(m, np.int64), capacity
        for i in range(m - 1, -1, -1):
            pattern[i] = min(left[i], room // weights[i])
            room -= pattern[i] * weights[i]
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        found.append((pattern, times))
        left -= times * pattern
    return found


def _places(patterns: list[tuple[np.ndarray, int]], weights: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """For each class and pattern: class, first and last rank, places in a sequence, first sequence."""
    rows, ranks, sequence = [], np.zeros(len(weights), np.int64), 0
    for pattern, times in patterns:
        for i in np.flatnonzero(pattern):
            places = int(pattern[i]) * times
            rows.append((int(weights[i]), int(ranks[i]), int(ranks[i]) + places - 1, int(pattern[i]), sequence))
            ranks[i] += places
        sequence += times
    return rows


def _before(key: str, *more: str):
    return Window.partitionBy(*more).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(value: str, window) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, length: int = LENGTH, quantum: int = QUANTUM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    if length % quantum:
        raise ValueError("quantum must divide length")
    spark = docs.sparkSession
    tokens = F.length("text") / F.lit(TOKEN_CHARACTERS) + 1
    short = bucket("doc_id", 1024) < 1024 * LOST / (tokens + LOST)
    few = LOST / (tokens + LOST) > 1 / FILL_SHARE
    rows = text_rows(docs, id_col, text_col).withColumn("fills", (bucket("doc_id", FILL_SHARE) == 0) | (few & short))
    coded = written(rows.mapInArrow(_code(vocabulary, end_id, length, quantum), _CODED_DDL), "coded")

    # Totals of each partition, and where its full sequences and its part of the filler stream begin.
    fill_size = F.when(F.col("fill_ids").isNotNull(), F.col("doc_tokens")).otherwise(F.lit(0))
    parts = coded.groupBy("part").agg(F.sum(F.size("full_crcs")).alias("n_full"), F.sum(fill_size).alias("n_fill"))
    parts = parts.select("part", _sum_before("n_full", _before("part")).alias("full_base"), _sum_before("n_fill", _before("part")).alias("fill_base"), "n_full", "n_fill")
    parts = written(parts, "parts")
    n_full = parts.agg(F.coalesce(F.sum("n_full"), F.lit(0))).first()[0]

    kinds = coded.filter("class > 0").groupBy("part", "class").agg(F.count(F.lit(1)).alias("n"))
    kinds = written(kinds.select("part", "class", "n", _sum_before("n", _before("part", "class")).alias("class_base")), "kinds")
    histogram = sorted((r["class"], r["n"]) for r in kinds.groupBy("class").agg(F.sum("n").alias("n")).collect())
    weights = np.array([k for k, _ in histogram], np.int64)
    patterns = cutting_patterns(weights, np.array([n for _, n in histogram], np.int64), length // quantum)
    n_packed = sum(times for _, times in patterns)

    # At most one row for each class and pattern, both bounded by length / quantum.
    places = spark.createDataFrame(_places(patterns, weights), "class long, rank_lo long, rank_hi long, per long, sequence long")
    rank = F.col("class_base") + F.col("class_before")
    rests = coded.filter("class > 0").select("part", "row", "doc_id", "doc_tokens", "rest", "rest_crc", "class", "class_before").join(kinds.drop("n"), ["part", "class"])
    rests = rests.withColumn("rank", rank).join(F.broadcast(places), "class").filter("rank between rank_lo and rank_hi")
    rests = rests.withColumn("sequence_id", F.expr(f"{n_full} + sequence + (rank - rank_lo) div per"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "part", "row")
    rests = rests.withColumn("offset", _sum_before("rest", inside.rowsBetween(Window.unboundedPreceding, -1)))
    rests = rests.withColumn("held", F.sum("rest").over(Window.partitionBy("sequence_id")))
    rests = written(rests.select("doc_id", "doc_tokens", "rest", "rest_crc", "sequence_id", "offset", "held"), "rests")

    # Gaps side by side: the stream position of each is its block's total before it plus a running sum.
    gaps = rests.filter(f"offset = 0 and held < {length}").select("sequence_id", "held", (F.lit(length) - F.col("held")).alias("gap"), F.expr(f"sequence_id div {SEQUENCE_BLOCK}").alias("block"))
    blocks = gaps.groupBy("block").agg(F.sum("gap").alias("n"))
    n_gap = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = blocks.select("block", _sum_before("n", _before("block")).alias("base"))
    gaps = gaps.join(blocks, "block").withColumn("gap_start", F.col("base") + _sum_before("gap", _before("sequence_id", "block")))

    fills = coded.filter(F.col("fill_ids").isNotNull()).join(parts.select("part", "fill_base"), "part")
    fills = fills.select("part", "row", "doc_id", "doc_tokens", "fill_ids", (F.col("fill_base") + F.col("fill_before")).alias("lo"))
    spans = fills.select("part", "row", "lo", (F.col("lo") + F.col("doc_tokens")).alias("hi"))

    def blocked(df: DataFrame, first: str, end: str) -> DataFrame:
        steps = F.expr(f"explode(sequence({first} div {STREAM_BLOCK}, ({end} - 1) div {STREAM_BLOCK}))")
        return df.withColumn("stream_block", steps)

    into = blocked(spans.filter(F.col("lo") < n_gap), "lo", f"least(hi, {n_gap})")
    holes = blocked(gaps.withColumn("gap_end", F.col("gap_start") + F.col("gap")), "gap_start", "gap_end")
    met = into.join(holes, "stream_block").filter("gap_start < hi and gap_end > lo")
    met = met.withColumn("cut", F.expr("greatest(gap_start, lo)")).withColumn("cut_end", F.expr("least(gap_end, hi)"))
    met = met.filter(f"stream_block = cut div {STREAM_BLOCK}")  # an overlap of two blocks is met twice
    small = met.select("part", "row", F.expr("cut - lo").alias("start"), F.expr("cut_end - cut").alias("length"), "sequence_id", F.expr("held + cut - gap_start").alias("offset"))

    over = spans.filter(F.col("hi") > n_gap).withColumn("cut", F.expr(f"greatest(lo, {n_gap})"))
    over = over.withColumn("k", F.expr(f"explode(sequence((cut - {n_gap}) div {length}, (hi - 1 - {n_gap}) div {length}))"))
    over = over.withColumn("one", F.expr(f"greatest(cut, {n_gap} + k * {length})")).withColumn("two", F.expr(f"least(hi, {n_gap} + (k + 1) * {length})"))
    large = over.select("part", "row", F.expr("one - lo").alias("start"), F.expr("two - one").alias("length"), (F.lit(n_full + n_packed) + F.col("k")).alias("sequence_id"), F.expr(f"one - {n_gap} - k * {length}").alias("offset"))

    cuts = small.unionByName(large).groupBy("part", "row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    filled = fills.drop("lo").join(cuts, ["part", "row"]).mapInArrow(_cut, _PIECES_DDL)

    full = coded.filter(F.size("full_crcs") > 0).join(parts.select("part", "full_base"), "part")
    full = full.select("doc_id", "doc_tokens", (F.col("full_base") + F.col("full_before")).alias("first"), F.posexplode("full_crcs").alias("k", "crc"))
    full = full.select("doc_id", (F.col("k") * F.lit(length).cast("long")).alias("start"), F.lit(length).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rests.select("doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return full.unionByName(rest).unionByName(filled)


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_PIECES_DDL = ", ".join(f"{n} long" for n in _PIECES.names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the fillers with their checksums."""
    for batch in batches:
        out: dict[str, list] = {n: [] for n in _PIECES.names}
        for doc_id, tokens, packed, cuts in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "doc_tokens", "fill_ids", "cuts")), strict=True):
            ids = np.frombuffer(packed, np.uint16)
            for c in cuts:
                crc = _crc(ids[c["start"] : c["start"] + c["length"]])
                for name, value in zip(_PIECES.names, (doc_id, c["start"], c["length"], crc, tokens, c["sequence_id"], c["offset"]), strict=True):
                    out[name].append(value)
        yield batch_of(_PIECES, out)
