"""Interaction of five document filters: what each removes alone, in every order, and on average.

1. One Arrow pass measures every whole text: the conditions A to D become bits 0 to 3.
2. E by an existential self-join. Rows are joined left-semi to the texts that occur more than once, on the
   hash of the text, the whole text and a smaller id. Only texts whose hash occurs twice or more take part,
   and they are reduced to one row with the smallest id before they are shuffled. Hashes of more than one
   in ``HOT_SHARE`` rows (fewer than that many) are dealt over ``SALTS`` tasks, with their one text in each.
3. The ids found are united with those that fail the other filters, their bits are joined by a bitwise OR,
   and the combinations of bits are counted for each part.
4. Each of the 120 orders needs, for each step, the filter and the set of filters before it: 80 such pairs
   are counted for each part and dealt to the orders. In the Shapley value a document that fails k filters
   is removed by each of them in 120 / k orders.

Defined results: a null text counts as empty, a null part as the empty string. Rows without an id never
fail E and mark nobody. Rows that share an id are judged by their own text. Of several labels of one id a
1 wins; labels without an id or value count for nothing. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import batch_of, prepare, spaced_words, text_slices, written

FILTERS = "ABCDE"
#: Bit of each filter.
BITS = {name: 1 << i for i, name in enumerate(FILTERS)}
#: Least number of words; least share of distinct words and largest of capitals, in hundredths (fixed values).
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
#: Characters that filter D looks for (fixed value).
MARKS = b"#$%&*|"
#: Hashes with more than one in so many rows are hot, and each is dealt over so many tasks.
HOT_SHARE, SALTS = 1000, 256

_NOT_CAPITALS = bytes(x for x in range(256) if not 65 <= x <= 90)
_NOT_MARKS = bytes(x for x in range(256) if x not in MARKS)
_CONTINUED = bytes(range(0x80, 0xC0))


def text_bits(texts: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    words = spaced_words(texts)
    n_words = np.diff(words.bounds)
    owner = np.repeat(np.arange(len(texts)), n_words)
    # One number for each (text, word); equal numbers, equal words of one text.
    pairs = np.unique(owner * max(1, len(words.distinct)) + words.codes)
    distinct = np.bincount(pairs // max(1, len(words.distinct)), minlength=len(texts))
    bits = np.where(n_words < MIN_WORDS, BITS["A"], 0) | np.where(100 * distinct < MIN_DISTINCT * n_words, BITS["B"], 0)
    for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        capitals, points = len(text.translate(None, _NOT_CAPITALS)), len(text.translate(None, _CONTINUED))
        if 100 * capitals > MAX_CAPITALS * points:
            bits[i] |= BITS["C"]
        if text.translate(None, _NOT_MARKS):
            bits[i] |= BITS["D"]
    return bits


_MEASURED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("hash", pa.int64()), ("bits", pa.int32())])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [text_bits(texts) for texts in text_slices(batch.column("text"))]
        kept = {name: batch.column(name) for name in ("doc_id", "part", "hash")}
        yield batch_of(_MEASURED, kept | {"bits": np.concatenate(bits) if bits else np.zeros(0)})


def _later_copies(rows: DataFrame, measured: DataFrame) -> DataFrame:
    """``doc_id, part, hash`` of the rows whose text a smaller id has, too."""
    known = measured.filter("doc_id is not null")
    counts = known.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = written(counts, "repeated")
    total = measured.count()
    # Fewer than HOT_SHARE hashes can each have more than one in HOT_SHARE rows.
    hot = counts.filter(F.col("n") * HOT_SHARE > total).select("hash", F.lit(True).alias("hot"))
    again = rows.filter("doc_id is not null").join(counts.select("hash"), "hash", "left_semi")
    firsts = again.groupBy("hash", "text").agg(F.min("doc_id").alias("first"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    firsts = firsts.join(F.broadcast(hot), "hash", "left").select("hash", "text", "first", F.explode(salts).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(SALTS))).otherwise(F.lit(0))
    left = again.join(F.broadcast(hot), "hash", "left").withColumn("salt", salt.cast("int"))
    same = [left[c] == firsts[c] for c in ("hash", "salt", "text")]
    return left.join(firsts, [*same, firsts["first"] < left["doc_id"]], "left_semi").select("doc_id", "part", "hash")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, bits, n``: the filters that rows fail; n rows of one id and part with equal bits."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), part.alias("part"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    measured = rows.mapInArrow(_measure, "doc_id long, part string, hash long, bits int")
    measured = written(measured, "measured")
    marked = _later_copies(rows, measured).withColumns({"bits": F.lit(BITS["E"]), "n": F.lit(0)})
    united = measured.withColumn("n", F.lit(1)).unionByName(marked)
    # Rows with equal id, part and text fail the same filters.
    named = united.filter("doc_id is not null").groupBy("doc_id", "part", "hash")
    joined = named.agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n")).drop("hash")
    nameless = measured.filter("doc_id is null").select("doc_id", "part", "bits", F.lit(1).cast("long").alias("n"))
    combined = joined.unionByName(nameless).groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    return combined


def combinations(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part, bits, n, good, toxic``: rows of each combination of failures, and those with a label 1."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    nameless = failed.filter("doc_id is null").select("part", "bits", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    named = failed.filter("doc_id is not null").join(known, "doc_id", "left").select("part", "bits", "n", "good", "toxic")
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0)))
    return named.unionByName(nameless).groupBy("part", "bits").agg(F.sum("n").alias("n"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))


def _orders() -> list[tuple[str, int, int, int]]:
    """Order, step, bits of the filters before the step and bit of its filter, for all orders."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            rows.append(("".join(order), step, before, BITS[name]))
            before |= BITS[name]
    return rows


def interactions(counted: DataFrame) -> DataFrame:
    """One row for each part, order and step."""
    orders = _orders()
    pairs = sorted({(before, bit) for _, _, before, bit in orders})
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("before"), F.lit(b).alias("bit")) for a, b in pairs)))
    rows = counted.select("*", each.alias("pair")).select("*", "pair.*")
    earlier, fails = F.col("bits").bitwiseAND(F.col("before")) != 0, F.col("bits").bitwiseAND(F.col("bit")) != 0
    total = lambda test, of="n": F.sum(F.when(test, F.col(of)).otherwise(F.lit(0)))
    failed = F.bit_count("bits")
    steps = rows.groupBy("part", "before", "bit").agg(
        total(~earlier & ~fails).alias("kept"),
        total(~earlier & fails).alias("removed"),
        total(earlier & fails).alias("redundant"),
        total(F.col("bits") == F.col("bit")).alias("unique_fails"),
        total(~earlier & fails, "good").alias("good_lost"),
        total(~earlier & fails, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * (F.lit(len({o for o, *_ in orders})) / F.greatest(failed, F.lit(1))).cast("long")).otherwise(F.lit(0))).alias("shapley"),
    )
    table = counted.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, bit int")
    return steps.join(F.broadcast(table), ["before", "bit"]).drop("before", "bit")  # 600 rows


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The table of :func:`interactions` for all rows of ``docs``."""
    return interactions(combinations(failures(docs, id_col, text_col, part_col), labels, id_col))
