"""Quality rules as a ledger: each rule is evaluated once, its failure is one bit.

``ledger`` measures every text and stores the measurements with the bits of all rules it fails.
``apply_policy`` turns the bits into a verdict by a mask, so that a new policy needs no second look at
the texts, and ``ablation`` reports for each rule what the policy would keep without it.

Defined results: a null or empty text has no words and fails ``few_words``. Null ids and repeated rows
are judged row by row. An empty table gives an empty ledger. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import spaced_words, text_rows, text_slices, texts_of, whole_rows, word_codes

#: Characters that count as symbols (fixed value).
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "longest_word",
)
_MEASURED = [T.StructField(m, T.LongType()) for m in MEASURES]
_KEEP_SYMBOLS = bytes(x for x in range(256) if x not in SYMBOLS)
_KEEP_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)


def _same_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """A number for each window of ``width`` (a power of two) words; equal numbers, equal windows."""
    ids = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < width:
        joined = ids[: len(ids) - step] * len(codes) + ids[step:]
        ids = np.unique(joined, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return ids


def repeated_words(codes: np.ndarray, width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that are found twice or more, the first one included."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    ranked = np.sort(total)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0  # equal windows have equal sums
    ids = _same_codes(codes, width)
    twice = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(codes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _line_measures(raw: bytes) -> tuple[int, int]:
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(lines), len(lines) - len(set(lines))


def _measure_texts(texts: pa.Array) -> Iterator[tuple[int, ...]]:
    """The measurements of each text, in the order of ``MEASURES``."""
    words = spaced_words(texts)
    sizes = np.fromiter(map(len, words.distinct), np.int64, len(words.distinct))
    codes = word_codes(words)
    for i, text in enumerate(texts.to_pylist()):
        own = slice(*words.bounds[i : i + 2])
        raw, chars = text.encode(), sizes[words.codes[own]]
        n_lines, dup = _line_measures(raw)
        yield (
            len(chars),
            int(chars.sum()),
            len(raw.translate(None, _KEEP_SYMBOLS)),
            dup,
            repeated_words(codes[own]),
            n_lines,
            len(raw.translate(None, _KEEP_UPPER)),
            int(chars.max(initial=0)),
        )


def _measure(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [m for texts in text_slices(texts_of(batch, text_col)) for m in _measure_texts(texts)]
            table = np.array(found, np.int64).reshape(-1, len(MEASURES))
            kept = batch.schema.names[0]  # the row or the id
            yield pa.RecordBatch.from_arrays([batch.column(kept), *map(pa.array, table.T)], [kept, *MEASURES])

    return run


@dataclass(frozen=True)
class Rule:
    """One rule; its bit in the ledger is its place in ``RULES``."""

    name: str
    fails: Column


def rules() -> tuple[Rule, ...]:
    """All rules, in the order of their bits. Ratios are tested without division."""
    c = F.col
    return (
        Rule("few_words", c("n_words") < 20),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 30 * c("n_words")),
        Rule("symbols", 100 * c("n_symbols") > 20 * c("n_words")),
        Rule("duplicate_lines", 100 * c("n_dup_lines") > 50 * c("n_lines")),
        Rule("capitals", 100 * c("n_upper") > 50 * c("word_chars")),
        Rule("long_words", c("word_chars") > 40 * c("n_words")),
        Rule("short_words", c("word_chars") < 2 * c("n_words")),
    )


#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "capitals", "long_words", "short_words"),
}


def mask(names: tuple[str, ...] | str) -> int:
    """The bits of the named rules, or of a policy."""
    names = POLICIES[names] if isinstance(names, str) else names
    places = {r.name: i for i, r in enumerate(rules())}
    return sum(1 << places[n] for n in names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its measurements and ``failed_bits``."""
    return _with_bits(text_rows(docs, id_col, text_col).mapInArrow(_measure("text"), T.StructType([T.StructField("doc_id", T.LongType()), *_MEASURED])))


def keep_good(docs: DataFrame, policy: tuple[str, ...] | str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the policy keeps."""
    book = _with_bits(whole_rows(docs).mapInArrow(_measure(text_col), T.StructType([T.StructField("row", docs.schema), *_MEASURED])))
    return apply_policy(book, policy).filter("kept").select("row.*")


def _with_bits(measured: DataFrame) -> DataFrame:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def apply_policy(book: DataFrame, policy: tuple[str, ...] | str = "v1") -> DataFrame:
    """Adds ``kept``: no rule of the policy fails."""
    return book.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(book: DataFrame, policy: tuple[str, ...] | str = "v1") -> DataFrame:
    """For each rule of the policy: documents that fail it, fail only it, and are kept without it."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    whole = mask(names)
    failed = F.col("failed_bits").bitwiseAND(F.lit(whole))
    per_mask = book.groupBy(failed.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).cast("long").alias("bit")) for n in names)))
    rows = per_mask.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_only"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
        F.sum("n").alias("n_docs"),
    )
