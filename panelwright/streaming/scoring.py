"""Streaming scoring: each micro-batch joins the kept rows of its keys and is scored once.

A row that comes late is scored, and so are again the rows of its key whose windows hold it.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelwright.operators.segments import over_keys
from panelwright.plans.jobs import positions
from panelwright.sources.artifacts import Artifacts
from panelwright.spec import PanelSpec, StrategySpec
from panelwright.streaming.state import KeyedState, Manifest, path_exists

BATCH, NEW, DUE, EVENT_TIME = "batch", "_new", "_due", "_event_time"
#: The number of the batch that stands for the rows known before the stream.
SEED = -1


def deduplicated(stream: DataFrame, panel: PanelSpec, late_days: int) -> DataFrame:
    """Drop repeats of a (key, date) row that arrive within the watermark."""
    # A watermark needs TIMESTAMP, while panel dates may be DATE or TIMESTAMP_NTZ.
    timed = stream.withColumn(EVENT_TIME, F.col(panel.date).cast("timestamp"))
    return (
        timed.withWatermark(EVENT_TIME, f"{late_days} days")
        .dropDuplicatesWithinWatermark([panel.key, *panel.order])
        .drop(EVENT_TIME)
    )


def seed_history(history: DataFrame, path: str) -> None:
    """Rows known before the stream starts; the first batch turns them into keyed state."""
    history.write.mode("overwrite").parquet(f"{path}/{BATCH}={SEED}")


def earlier_state(state: KeyedState, spark: SparkSession, batch_id: int, like: DataFrame) -> Manifest | None:
    """The state a batch starts from: that of the batch before, the seed for the first one, or none."""
    found = state.manifest(spark, batch_id - 1)
    seed = f"{state.path}/{BATCH}={SEED}"
    if found is not None or batch_id > 0 or not path_exists(spark, seed):
        return found
    rows = spark.read.parquet(seed).select(*like.columns)
    state.write(SEED, rows, state.buckets_of(rows), None)
    return state.manifest(spark, SEED)


def compact_history(spark: SparkSession, path: str, panel: PanelSpec, lookback: int, out: str, n_buckets: int = 64) -> None:
    """Write the last ``lookback`` rows of each key of the state at ``path`` as the seed of the next run of
    a stopped stream whose batches only bring later dates."""
    state = KeyedState(path, panel, lookback, 0, n_buckets)
    found = state.latest(spark)
    if found is None or not found.versions:
        raise ValueError(f"There is no state at {path}")
    schema = spark.read.parquet(state._rows_path(*next((v, b) for b, v in found.versions.items()))).schema
    rows = dataclasses.replace(state, lookback=max(0, lookback - 1)).tail(state.read(spark, found, found.versions, schema))
    seed_history(rows, out)


def score_batches(
    artifacts: Artifacts,
    history_path: str,
    out_path: str,
    *,
    strategy: StrategySpec = StrategySpec(),
    late_days: int = 21,
    n_buckets: int = 64,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function.

    Row-based windows are not defined on a stream, so each batch is united with the kept rows of its keys
    (:class:`KeyedState`), however long ago they were. Scored are the rows of the batch and the kept ones
    that follow one of them within ``lookback`` rows, whose windows have changed. Without a seed the first
    batch stands alone. Winsor bounds are the fitted ones: bounds of a micro-batch would depend on how the
    stream was cut. Scores go to a folder named after the batch and are overwritten when it is replayed;
    :func:`read_scores` takes the last score of a row.
    """
    fitted = dataclasses.replace(
        artifacts.features,
        features=dataclasses.replace(artifacts.features.features, bounds="fitted"),
    )
    artifacts = dataclasses.replace(artifacts, features=fitted)
    panel, lookback = fitted.panel, fitted.features.lookback
    state = KeyedState(history_path, panel, lookback, late_days, n_buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            state.forget(spark, batch_id - 1)
            before = earlier_state(state, spark, batch_id, batch)
            buckets = state.buckets_of(batch)
            held = state.read(spark, before, buckets, batch.schema) if before else batch.limit(0)
            if not batch.isEmpty():
                keys = batch.select(panel.key).distinct()
                known = held.join(keys, panel.key, "left_semi").select(*batch.columns, F.lit(False).alias(NEW))
                united = known.unionByName(batch.select("*", F.lit(True).alias(NEW)))
                changed = F.max(F.col(NEW).cast("int"))
                flagged = over_keys(
                    united,
                    panel,
                    lookback,
                    lambda d, w: d.select("*", w.trailing(changed, lookback + 1).alias(DUE)),
                    fitted.features.rows_per_block,
                )
                due = flagged.withColumn(DUE, F.col(NEW) | F.coalesce(F.col(DUE) == 1, F.lit(False))).drop(NEW)
                scored = positions(due, artifacts, strategy, carry=[DUE]).where(DUE).drop(DUE)
                scored.write.mode("overwrite").parquet(f"{out_path}/{BATCH}={batch_id}")
            state.write(batch_id, held.unionByName(batch), buckets, before)
        finally:
            batch.unpersist()

    return handle


def start_scoring(
    stream: DataFrame,
    artifacts: Artifacts,
    history_path: str,
    out_path: str,
    checkpoint: str,
    *,
    late_days: int = 21,
    strategy: StrategySpec = StrategySpec(),
    available_now: bool = False,
    n_buckets: int = 64,
) -> StreamingQuery:
    """Start the query; its checkpoint belongs in the shared folder next to the tables."""
    handle = score_batches(
        artifacts, history_path, out_path, strategy=strategy, late_days=late_days, n_buckets=n_buckets
    )
    writer = (
        deduplicated(stream, artifacts.features.panel, late_days)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_scores(spark: SparkSession, out_path: str, panel: PanelSpec | None = None) -> DataFrame:
    """All scores with their batch; with a ``panel`` only the last one of each row."""
    scores = spark.read.option("basePath", out_path).parquet(f"{out_path}/{BATCH}=*")
    if panel is None:
        return scores
    row = [panel.key, *panel.order]
    values = [c for c in scores.columns if c not in row]
    last = scores.groupBy(*row).agg(F.max_by(F.struct(*values), BATCH).alias("_last"))
    return last.select(*[F.col(c) if c in row else F.col(f"_last.{c}").alias(c) for c in scores.columns])
