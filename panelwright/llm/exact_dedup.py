"""Exact duplicates by sorting the contents.

Texts are lower-cased (A-Z only). Sampled splitters range-partition the rows by the first bytes of the
normalised text, its digest and the id; Spark's external sort then puts equal texts side by side, and
whole texts of neighbours are compared. Since the id is part of the splitters, a text with very many
copies spreads over as many partitions as it needs; its runs at partition edges (two for each
partition) are added up by digest afterwards.

Defined results: a null text counts as empty, and all empty texts are equal. A null id is smaller than
any other. Of rows that repeat both text and id one stays. Other columns are ignored by ``groups``
and kept by ``deduplicate``. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import batch_of, prepare, text_rows, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text in a splitter, so that what the sampling brings to the driver is bounded.
SPLITTER_BYTES = 32
_NO_ID = np.iinfo(np.int64).min
_RUNS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_sha256", pa.string()),
        ("run_keep", pa.int64()),
        ("run_size", pa.int64()),
        ("copy", pa.int64()),
        ("edge", pa.bool_()),
        ("lead", pa.bool_()),
    ]
)
_RUNS_DDL = "doc_id long, text_sha256 string, run_keep long, run_size long, copy long, edge boolean, lead boolean"


def _normalised(text):
    return F.translate(text, UPPER, LOWER)


def _runs(keep: str):
    """Runs of equal texts in one sorted partition; only ids of the open run are held."""
    best = np.maximum if keep == "largest" else np.minimum

    def known(ids: np.ndarray) -> pa.Array:
        return pa.array(ids, pa.int64(), mask=ids == _NO_ID)

    def closed(ids: np.ndarray, shas: list[str], starts: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, len(ids)))
        run = np.repeat(np.arange(len(starts)), sizes)
        if keep == "largest":
            chosen = best.reduceat(ids, starts)
        else:  # a missing id only stays if there is no other
            chosen = best.reduceat(np.where(ids == _NO_ID, np.iinfo(np.int64).max, ids), starts)
            chosen = np.where(np.maximum.reduceat(ids, starts) == _NO_ID, _NO_ID, chosen)
        lead = np.zeros(len(ids), bool)
        lead[starts] = True
        fresh = lead | np.append(True, ids[1:] != ids[:-1])
        begun = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
        return batch_of(
            _RUNS,
            {
                "doc_id": known(ids),
                "text_sha256": pa.array(shas).take(pa.array(run)),
                "run_keep": known(chosen[run]),
                "run_size": sizes[run],
                "copy": np.arange(len(ids)) - begun,
                "edge": edges[run],
                "lead": lead,
            },
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held, sha, text, at_edge = np.zeros(0, np.int64), None, None, True
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            texts, shas = batch.column("normal"), batch.column("text_sha256")
            new = np.ones(len(batch), bool)
            new[0] = text is None or texts[0].as_py() != text
            if len(batch) > 1:
                new[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            if len(starts) == 0:
                held = np.append(held, ids)
                continue
            if text is not None:
                yield closed(np.append(held, ids[: starts[0]]), [sha], np.array([0]), np.array([at_edge]))
                at_edge = False
            if len(starts) > 1:
                whole = slice(starts[0], starts[-1])
                edges = np.zeros(len(starts) - 1, bool)
                edges[0] = at_edge
                yield closed(ids[whole], [shas[int(i)].as_py() for i in starts[:-1]], starts[:-1] - starts[0], edges)
                at_edge = False
            last = int(starts[-1])
            held, sha, text = ids[last:].copy(), shas[last].as_py(), texts[last].as_py()
        if text is not None:
            yield closed(held, [sha], np.array([0]), np.array([True]))

    return run


def groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` names the id that stays: ``smallest`` or ``largest``.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    rows = text_rows(docs, id_col, text_col).select("doc_id", _normalised(F.col("text")).alias("normal"))
    keyed = rows.select("doc_id", "normal", F.sha2(F.col("normal"), 256).alias("text_sha256"))
    order = [F.substring("normal", 1, SPLITTER_BYTES), F.col("text_sha256"), F.col("doc_id")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = written(ranged.mapInArrow(_runs(keep), _RUNS_DDL), "runs")
    best = F.max if keep == "largest" else F.min
    # Two rows for each partition at most.
    edges = runs.filter("edge and lead").groupBy("text_sha256").agg(best("run_keep").alias("edge_keep"), F.sum("run_size").alias("edge_size"))
    edges = edges.withColumn("edge", F.lit(True))
    whole = runs.join(F.broadcast(edges), ["text_sha256", "edge"], "left")
    keep_id = F.when(F.col("edge"), F.col("edge_keep")).otherwise(F.col("run_keep"))
    size = F.when(F.col("edge"), F.col("edge_size")).otherwise(F.col("run_size"))
    return whole.select(
        "doc_id",
        keep_id.alias("keep_id"),
        size.alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & (F.col("copy") == 0)).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    prepare(docs.sparkSession)
    stay = groups(docs, keep, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("__row"), docs[id_col].cast("long").alias("__id"), F.sha2(_normalised(text), 256).alias("__sha"))
    same = keyed["__id"].eqNullSafe(stay["__id"]) & (keyed["__sha"] == stay["__sha"])
    one = F.row_number().over(Window.partitionBy("__sha", "__id").orderBy(F.lit(0)))
    found = keyed.join(stay, same, "left_semi").withColumn("__copy", one).filter("__copy = 1")
    return found.select("__row.*")
