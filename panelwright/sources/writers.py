"""Sinks: partitioned parquet and JSON metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.spec import PanelSpec

BUCKET = "date_bucket"


def write_panel(
    df: DataFrame, path: str, panel: PanelSpec, *, bucket: str = "year", mode: str = "overwrite", gather: bool = True
) -> None:
    """Parquet partitioned by a date bucket, sorted by key and date inside each file.

    The rebalance hint gathers a bucket into few files and splits one that is too large, whatever key
    fills it; unlike a range partitioning it does not compute its input once more for sampling. Without
    ``gather`` there is no exchange, and each task writes a file for each bucket it has rows of.
    """
    part = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[bucket]
    bucketed = df.select("*", F.date_format(panel.date, part).alias(BUCKET))
    (
        (bucketed.hint("rebalance", BUCKET) if gather else bucketed)
        .sortWithinPartitions(BUCKET, panel.key, *panel.order)
        .write.mode(mode)
        .partitionBy(BUCKET)
        .parquet(path)
    )


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """A table written by :func:`write_panel`, without its bucket column."""
    return spark.read.parquet(path).drop(BUCKET)


def write_metrics(df: DataFrame, path: str) -> None:
    """A small metrics table as JSON lines with sorted keys; NULL fields are kept."""
    ordered = df.select(*sorted(df.columns))
    ordered.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_values(spark: SparkSession, values: Mapping[str, float | None], path: str) -> None:
    names = sorted(values)
    schema = ", ".join(f"`{n}` double" for n in names)
    write_metrics(spark.createDataFrame([tuple(values[n] for n in names)], schema), path)
