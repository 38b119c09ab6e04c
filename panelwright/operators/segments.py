"""Per-key windows that stay balanced when one key holds a large share of all rows.

A window sorts a whole key in one task. Keys of a daily panel are bounded by the calendar; keys of any
other panel are counted first, and those above ``rows_per_block`` are cut along time into blocks. Each
block also receives the ``lookback`` rows before it (its halo), so a trailing row frame sees the same
rows as without the cut; halo rows are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.session import materialize
from panelwright.spec import ROWS_PER_BLOCK, STORED_PART, PanelSpec

PART, HALO = "_part", "_halo"
_BUCKET, _TARGETS = "_bucket", "_targets"
#: Rows of the block lookup that are still broadcast (about 50 bytes each).
LOOKUP_BROADCAST_ROWS = 1_000_000
#: Bucket widths tried in turn, in microseconds: day, hour, minute, second, millisecond, microsecond.
BUCKET_WIDTHS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)


class KeyWindow:
    """Column builders over one key window; rows without a key get NULL."""

    def __init__(self, spec: PanelSpec):
        self.key = F.col(spec.key)
        self.ordered: WindowSpec = W.partitionBy(spec.key, PART).orderBy(*spec.order)

    def _keyed(self, value: Column) -> Column:
        return F.when(self.key.isNotNull(), value)

    def lag(self, column: Column | str, rows: int = 1) -> Column:
        return self._keyed(F.lag(column, rows).over(self.ordered))

    def place(self) -> Column:
        """The number of the row within its group, from 1."""
        return self._keyed(F.row_number().over(self.ordered))

    def trailing(self, aggregate: Column, rows: int) -> Column:
        """``aggregate`` over the last ``rows`` rows including the current one."""
        return self._keyed(aggregate.over(self.ordered.rowsBetween(-(rows - 1), 0)))

    def full_trailing(self, aggregate: Callable[[Column], Column], column: Column | str, rows: int):
        """Like :meth:`trailing`, but NULL unless the frame holds ``rows`` non-null values."""
        column = F.col(column) if isinstance(column, str) else column
        frame = self.ordered.rowsBetween(-(rows - 1), 0)
        return self._keyed(
            F.when(F.count(column).over(frame) == rows, aggregate(column).over(frame))
        )


def over_keys(
    df: DataFrame,
    spec: PanelSpec,
    lookback: int,
    build: Callable[[DataFrame, KeyWindow], DataFrame],
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Apply ``build``, which adds trailing-frame columns of at most ``lookback`` rows, to every key."""
    segmented, has_halo = segment(df, spec, lookback, rows_per_block)
    built = build(segmented, KeyWindow(spec))
    if has_halo:
        built = built.where(~F.col(HALO)).drop(HALO)
    return built.drop(PART)


def segment(
    df: DataFrame, spec: PanelSpec, lookback: int, rows_per_block: int = ROWS_PER_BLOCK
) -> tuple[DataFrame, bool]:
    """Add ``_part``, which together with the key names a bounded group of rows.

    Rows without a key are spread by a hash: they belong together in no operator. A bucketed panel brings
    the column along, so that its windows need no exchange.
    """
    if STORED_PART in df.columns:
        others = [c for c in df.columns if c != STORED_PART]
        if spec.grain == "day":
            return df.select(*others, F.col(STORED_PART).alias(PART)), False
        df = df.select(*others)
    keyless = F.xxhash64(*spec.order)
    if spec.grain == "instant":
        lookup = _block_lookup(df, spec, lookback, max(rows_per_block, lookback, 1))
        if lookup is not None:
            return _with_blocks(df, spec, keyless, *lookup), True
    part = F.when(F.col(spec.key).isNull(), keyless).otherwise(F.lit(0).cast("long"))
    return df.select("*", part.alias(PART)), False


def instant_micros(df: DataFrame, column: str) -> Column:
    """A date or timestamp column as BIGINT microseconds since the epoch."""
    if isinstance(df.schema[column].dataType, T.DateType):
        return F.unix_date(column).cast("long") * F.lit(BUCKET_WIDTHS[0])
    return F.unix_micros(F.col(column).cast("timestamp"))


def _bucket(df: DataFrame, spec: PanelSpec, width: int) -> Column:
    at = instant_micros(df, spec.date)
    return at - F.pmod(at, F.lit(width))


def _block_lookup(
    df: DataFrame, spec: PanelSpec, lookback: int, size: int
) -> tuple[DataFrame, int] | None:
    """(key, bucket) -> blocks a row goes to, for hot keys only; None where there are none."""
    key = spec.key
    # At most total / size keys are hot, so this table is small whatever the number of keys.
    hot = materialize(
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > size)
        .select(key),
        "hot-keys",
    )
    n_hot = hot.count()
    if n_hot == 0:
        return None
    hot_rows = df.select(*dict.fromkeys([key, spec.date])).join(
        F.broadcast(hot) if n_hot <= LOOKUP_BROADCAST_ROWS else hot, key, "left_semi"
    )
    for width in BUCKET_WIDTHS:
        counts = materialize(
            hot_rows.groupBy(key, _bucket(df, spec, width).alias(_BUCKET)).agg(
                F.count(F.lit(1)).alias("_n")
            ),
            "bucket-counts",
        )
        if counts.agg(F.max("_n")).first()[0] <= size:
            break

    by_bucket = W.partitionBy(key).orderBy(_BUCKET)
    buckets = (
        counts.select("*", F.sum("_n").over(by_bucket).alias("_end"))
        .select("*", (F.col("_end") - F.col("_n")).alias("_begin"))
        .select("*", F.floor(F.col("_begin") / F.lit(size)).cast("long").alias("_block"))
    )
    by_block = W.partitionBy(key).orderBy("_block")
    starts = (
        buckets.groupBy(key, "_block")
        .agg(F.min("_begin").alias("_start"))
        .select(
            key,
            "_block",
            *[F.lead("_block", i).over(by_block).alias(f"_block{i}") for i in (1, 2)],
            *[F.lead("_start", i).over(by_block).alias(f"_start{i}") for i in (1, 2)],
        )
    )

    def target(block: str, halo: bool) -> Column:
        return F.struct(F.col(block).alias(PART), F.lit(halo).alias(HALO))

    # A block starts at most once per `size` rows and lookback <= size, so a row is in the halo of
    # no more than the next two blocks.
    halos = [
        F.when(F.col(f"_start{i}") - F.col("_end") < lookback, target(f"_block{i}", True))
        for i in (1, 2)
    ]
    lookup = materialize(
        buckets.join(starts, [key, "_block"]).select(
            key,
            _BUCKET,
            F.filter(F.array(target("_block", False), *halos), lambda t: t.isNotNull()).alias(
                _TARGETS
            ),
        ),
        "block-lookup",
    )
    return lookup, width


def _with_blocks(
    df: DataFrame, spec: PanelSpec, keyless: Column, lookup: DataFrame, width: int
) -> DataFrame:
    if lookup.count() <= LOOKUP_BROADCAST_ROWS:
        lookup = F.broadcast(lookup)
    columns = [F.col(c) for c in df.columns]
    own = F.when(F.col(spec.key).isNull(), keyless).otherwise(F.lit(0).cast("long"))
    alone = F.array(F.struct(own.alias(PART), F.lit(False).alias(HALO)))
    return (
        df.select("*", _bucket(df, spec, width).alias(_BUCKET))
        .join(lookup, [spec.key, _BUCKET], "left")
        .select(*columns, F.inline(F.coalesce(F.col(_TARGETS), alone)))
    )
