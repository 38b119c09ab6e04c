"""Panels derived from the order, line item and event tables.

Money and rates have two decimals, so they are summed as whole cents: sums are then exact in any
order, and every panel cell is the same on every engine and for every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.session import compiled
from panelwright.sources.readers import read_parquet
from panelwright.spec import PanelSpec

SUPPLIER = PanelSpec(target="excess_return", features=("qty", "price", "tax"))
PRIORITY = PanelSpec(features=("close", "volume"))
EVENTS = PanelSpec(tiebreak=("event_id",), grain="instant", features=("value",))
EVENT_TYPE = PanelSpec(features=("close", "volume"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(compiled(spark), f"{sf_dir}/{name}.parquet")


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100.0).cast("long")


def supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and ship date; ``tax`` has gaps, ``forecast`` is a stand-in prediction."""
    n = F.col("n").cast("double")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("l_quantity").alias("qty"),
            F.sum(_cents("l_extendedprice")).alias("price_cents"),
            F.sum(_cents("l_tax")).alias("tax_cents"),
            F.count_if(F.col("l_tax") != 0.0).cast("double").alias("n_taxed"),
            F.sum(_cents("l_discount")).alias("discount_cents"),
        )
        .select(
            "date",
            "symbol",
            "qty",
            (F.col("price_cents") / (n * 100.0)).alias("price"),
            F.try_divide(F.col("tax_cents").cast("double"), F.col("n_taxed") * 100.0).alias("tax"),
            ((F.col("discount_cents") - F.col("tax_cents")) / (n * 100.0)).alias("excess_return"),
            (F.col("discount_cents") * 40 / (n * 100.0) - 1.0).alias("forecast"),
        )
    )


def priority_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order priority and order date."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("date"))
        .agg(F.sum(_cents("o_totalprice")).alias("cents"), F.count(F.lit(1)).alias("volume"))
        .select(
            "date",
            "symbol",
            (F.col("cents") / (F.col("volume").cast("double") * 100.0)).alias("close"),
            "volume",
        )
    )


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single events per user at their own instant: keys of no known length."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("date"), F.col("user_id").alias("symbol"), "event_id", "value"
    )


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single events per event type: five keys share all rows, so every key is a hot one."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("date"), F.col("event_type").alias("symbol"), "event_id", "value"
    )


def event_type_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing value and number of events per event type and day."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("symbol"),
            F.col("ts").cast("date").cast("timestamp_ntz").alias("date"),
        )
        .agg(
            F.max_by("value", F.struct("ts", "event_id")).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .select("date", "symbol", "close", "volume")
    )
