"""Token files: ids of documents in ascending order, kept as Re-Pair grammars that open anywhere.

Documents are range-partitioned and sorted by id. Each partition is cut into shards of whole documents.
Within a shard, rounds count all adjacent symbol pairs, replace the frequent ones by new symbols and go
on until a round no longer pays. A shard holds its rules, the expansion length of each rule and the
remaining symbols; a range of ids is found by the running sum of the lengths and only the symbols it
touches are expanded. Shards are rows of a parquet table, written through Spark's commit protocol, so
that a lost executor leaves no half-written file.

Defined results: a null or empty text is the end id alone. Rows without an id come first; rows with the
same id keep the order of their texts. Other columns are ignored; no rows give an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.bpe import ENCODE_BYTES, encoder
from panelwright.llm.common import batch_of, text_rows, text_slices

#: Ids after which a shard is closed; one document is never split.
SHARD_IDS = 1 << 20
#: A pair is replaced if a round finds it this often.
MIN_COUNT = 16
#: New symbols in one round, and the share of symbols a round must save for another one to follow.
ROUND_RULES, ROUND_GAIN = 2048, 0.03
SYMBOLS = 1 << 16

_SHARD = pa.schema(
    [
        ("part", pa.int64()),
        ("shard", pa.int64()),
        ("part_start", pa.int64()),
        ("n_ids", pa.int64()),
        ("base", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_lengths", pa.list_(pa.int64())),
        ("rules", pa.binary()),
        ("rule_lengths", pa.binary()),
        ("symbols", pa.binary()),
    ]
)
_SHARD_DDL = (
    "part long, shard long, part_start long, n_ids long, base int, doc_ids array<long>, "
    "doc_lengths array<long>, rules binary, rule_lengths binary, symbols binary"
)


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (two symbols each, 16 bit), their expansion lengths, and the symbols left.

    Symbols below ``base`` are ids, symbol ``base + i`` is rule ``i``. Pairs of one round are replaced at
    once; where occurrences overlap, every second one from the left goes first.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    n_rules = 0
    lengths = np.ones(SYMBOLS, np.int64)
    while len(seq) > 1:
        pairs = seq[:-1] << np.uint32(16) | seq[1:]
        ranked = np.sort(pairs)
        edges = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        counts = np.diff(np.append(edges, len(ranked)))
        often = np.flatnonzero(counts >= MIN_COUNT)
        room = min(ROUND_RULES, SYMBOLS - base - n_rules, len(often))
        if room <= 0:
            break
        often = often[np.argsort(-counts[often], kind="stable")[:room]]
        chosen = np.sort(ranked[edges[often]])
        # The rule of a pair, by the numbers of its symbols among the left and the right ones of all rules.
        a, b = chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)
        left, right = np.zeros(SYMBOLS, np.int32), np.zeros(SYMBOLS, np.int32)
        lefts, rights = np.unique(a), np.unique(b)
        left[lefts], right[rights] = np.arange(1, len(lefts) + 1), np.arange(1, len(rights) + 1)
        rule_of = np.full((len(lefts) + 1) * (len(rights) + 1), -1, np.int16)
        rule_of[left[a] * (len(rights) + 1) + right[b]] = np.arange(room)
        places = seq.astype(np.intp)
        rule = rule_of.take(left[places[:-1]] * (len(rights) + 1) + right[places[1:]])
        at = np.flatnonzero(rule >= 0)
        # The places at an even distance from the first one of their run.
        first = np.append(True, np.diff(at) != 1)
        at = np.compress((np.maximum.accumulate(at * first) ^ at) & 1 == 0, at)
        before = len(seq)
        seq[at] = base + n_rules + rule[at].astype(np.int64)
        keep = np.ones(before, bool)
        keep[at + 1] = False
        seq = seq.take(np.flatnonzero(keep))
        lengths[base + n_rules : base + n_rules + room] = lengths[a] + lengths[b]
        rules.append(np.column_stack((a, b)))
        n_rules += room
        if before - len(seq) < ROUND_GAIN * before:
            break
    table = np.concatenate(rules) if rules else np.zeros((0, 2))
    return table.astype("<u2"), lengths[base : base + n_rules].astype("<u4"), seq.astype("<u2")


class Shard:
    """A stored shard, opened for reading any range of its ids."""

    def __init__(self, base: int, rules: bytes, rule_lengths: bytes, symbols: bytes):
        table = np.frombuffer(rules, "<u2").reshape(-1, 2).astype(np.int64)
        self.symbols = np.frombuffer(symbols, "<u2").astype(np.int64)
        self.lengths = np.ones(base + len(table), np.int64)
        self.lengths[base:] = np.frombuffer(rule_lengths, "<u4")
        self.starts = np.cumsum(self.lengths) - self.lengths
        #: Expansions of all symbols, one after the other; a rule only uses symbols before it.
        self.flat = np.zeros(int(self.lengths.sum()), np.uint32)
        self.flat[:base] = np.arange(base)
        # Rules that only use symbols before the first of them are expanded at once, as those of a round do.
        newest, done = np.maximum.accumulate(table.max(axis=1, initial=0)), 0
        while done < len(table):
            stop = int(np.searchsorted(newest, base + done, "left"))
            at, end = self.starts[base + done], self.starts[base + stop - 1] + self.lengths[base + stop - 1]
            self.flat[at:end] = self._expanded(table[done:stop].ravel())
            done = stop
        self.ends = np.cumsum(self.lengths[self.symbols])

    def _expanded(self, used: np.ndarray) -> np.ndarray:
        sizes = self.lengths[used]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[used] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def read(self, start: int, length: int) -> np.ndarray:
        """The ids from ``start`` on."""
        if length <= 0:
            return np.zeros(0, np.uint32)
        one = int(np.searchsorted(self.ends, start, "right"))
        two = int(np.searchsorted(self.ends, start + length, "left"))
        out = self._expanded(self.symbols[one : two + 1])
        skip = start - (int(self.ends[one - 1]) if one else 0)
        return out[skip : skip + length]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shards of all documents to the folder ``path``; ``part`` and ``shard`` give their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, part = encoder(vocabulary), TaskContext.get().partitionId()
        base = tool.tokenizer.get_vocab_size()
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        shard = done = size = 0

        def close() -> pa.RecordBatch:
            rules, rule_lengths, symbols = compress(np.concatenate(held), base)
            row = (part, shard, done, size, base, doc_ids, lengths, rules.tobytes(), rule_lengths.tobytes(), symbols.tobytes())
            return batch_of(_SHARD, {n: [x] for n, x in zip(_SHARD.names, row, strict=True)})

        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text"), ENCODE_BYTES):
                ids, bounds = tool.encode(texts)
                own, n = batch.column("doc_id").slice(at, len(texts)).to_pylist(), np.diff(bounds) + 1
                ids, ends = np.insert(ids, bounds[1:], end_id), np.cumsum(n)
                first = begin = 0
                while first < len(own):
                    # The document that fills the shard is its last one.
                    last = min(int(np.searchsorted(ends, begin + SHARD_IDS - size)) + 1, len(own))
                    end = int(ends[last - 1])
                    held.append(ids[begin:end])
                    doc_ids += own[first:last]
                    lengths += n[first:last].tolist()
                    size += end - begin
                    first, begin = last, end
                    if size >= SHARD_IDS:
                        yield close()
                        shard, done, size = shard + 1, done + size, 0
                        held, doc_ids, lengths = [], [], []
                at += len(texts)
        if held:
            yield close()

    rows = text_rows(docs, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _SHARD_DDL).write.parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """Documents of the stored shards: ``doc_id``, ``start``, ``n_tokens``, ``ids`` (binary, u32)."""
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    return _decoded(shards, schema, lambda ids: ids.tobytes(), "ids binary")


def read_digests(shards: DataFrame) -> DataFrame:
    """As ``read_documents``, with ``ids_crc32`` instead of the ids."""
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return _decoded(shards, schema, zlib.crc32, "ids_crc32 long")


def _decoded(shards: DataFrame, schema: pa.Schema, last, last_ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                shard = Shard(row["base"], row["rules"], row["rule_lengths"], row["symbols"])
                lengths = np.array(row["doc_lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                ids = shard.read(0, row["n_ids"]).astype("<u4")
                values = [last(ids[s : s + n]) for s, n in zip(starts.tolist(), row["doc_lengths"], strict=True)]
                out = {"part": [row["part"]] * len(lengths), "doc_id": row["doc_ids"], "start": starts + row["part_start"], "n_tokens": lengths}
                yield batch_of(schema, out | {schema.names[-1]: values})

    # The starts of the partitions: one row for each partition that wrote shards.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    rows = shards.mapInArrow(run, f"part long, doc_id long, start long, n_tokens long, {last_ddl}")
    return rows.join(bases, "part").select("doc_id", (F.col("start") + F.col("part_base")).alias("start"), "n_tokens", schema.names[-1])
