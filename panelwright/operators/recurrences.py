"""Exponential averages, forward fill: operators whose value depends on the whole past of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators.segments import HALO, PART, KeyWindow, segment
from panelwright.session import materialize
from panelwright.spec import ROWS_PER_BLOCK, PanelSpec

#: Values per run of the blocked recurrence, and runs (or blocks of runs) that are scanned as one list.
RUN = 128


def number_rows(
    df: DataFrame,
    spec: PanelSpec,
    name: str = "_row",
    *,
    counting: str | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """0-based position of each row within its key; long keys are numbered block by block.

    With ``counting`` only rows with a value in that column count: other rows repeat the position
    before them, -1 if there is none.
    """
    segmented, cut = segment(df, spec, 0, rows_per_block)
    if cut:
        segmented = segmented.where(~F.col(HALO)).drop(HALO)
    inside = W.partitionBy(spec.key, PART).orderBy(*spec.order)
    counted = F.lit(1) if counting is None else F.col(counting)
    running = F.count(counted).over(inside.rowsBetween(W.unboundedPreceding, 0))
    position = running.cast("long") - 1
    if not cut:
        return segmented.select("*", position.alias(name)).drop(PART)
    sizes = segmented.groupBy(spec.key, PART).agg(F.count(counted).alias("_n"))
    before = W.partitionBy(spec.key).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        spec.key, PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        segmented.select("*", position.alias(name))
        .join(offsets, [spec.key, PART], "left")
        .select(*df.columns, (F.col(name) + F.coalesce("_before", F.lit(0))).alias(name))
    )


def exponential_averages(
    numbered: DataFrame, spec: PanelSpec, averages: dict[str, tuple[str, int]], row: str = "_row"
) -> DataFrame:
    """Add ``name -> (column, span)`` averages: ``e[t] = a x[t] + (1-a) e[t-1]``, ``e[0] = x[0]``,
    ``a = 2 / (span + 1)``, without a Python function.

    A row without a value repeats the average before it, and the first value starts it; rows without a
    key get NULL. ``numbered`` carries the position among the values of each key
    (:func:`number_rows` with ``counting``); all averaged columns have their values in the same rows.

    The recurrence is linear: runs of 128 values are summed on their own with powers of ``1-a``, and
    what the runs before left over is added. What they left follows the same recurrence, so it is found
    by the same blocks of 128, level by level, whatever the length of the key. Nothing is cut off.
    """
    keep = {name: 1.0 - 2.0 / (span + 1.0) for name, (_, span) in averages.items()}
    at = F.pmod(F.col(row), F.lit(RUN)).cast("double")
    # Rows that share a position hold one value between them; the frame takes all of them.
    upto = W.partitionBy(spec.key, "_run").orderBy(row).rangeBetween(W.unboundedPreceding, 0)
    keyless = F.xxhash64(*spec.order)
    run = F.when(F.col(spec.key).isNull(), keyless).otherwise(F.floor(F.col(row) / RUN).cast("long"))

    def own(name: str, column: str):
        k = F.lit(keep[name])
        if keep[name] == 0.0:
            return F.last(column, ignorenulls=True).over(upto).alias(f"_own_{name}")
        weight = F.when(F.col(row) == 0, 1.0).otherwise(1.0 - k)
        scaled = F.sum(weight * F.col(column) / F.pow(k, at)).over(upto)
        return (scaled * F.pow(k, at)).alias(f"_own_{name}")

    local = materialize(
        numbered.select("*", run.alias("_run")).select(
            "*", *[own(name, column) for name, (column, _) in averages.items()]
        ),
        "averages",
    )
    valued = local.where(F.col(spec.key).isNotNull() & (F.col(row) >= 0))
    ends = valued.groupBy(spec.key, F.col("_run").alias("_at")).agg(
        *[F.max_by(f"_own_{name}", row).alias(name) for name in averages]
    )
    carried = _carries(ends, spec.key, {name: k**RUN for name, k in keep.items()})
    carried = carried.select(
        spec.key, F.col("_at").alias("_run"), *[F.col(n).alias(f"_carry_{n}") for n in averages]
    )
    known = F.col(spec.key).isNotNull() & (F.col(row) >= 0)
    return local.join(carried, [spec.key, "_run"], "left").select(
        *numbered.columns,
        *[
            F.when(
                known,
                F.col(f"_own_{n}") + F.col(f"_carry_{n}") * F.pow(F.lit(keep[n]), at + 1.0),
            ).alias(n)
            for n in averages
        ],
    )


def _carries(ends: DataFrame, key: str, decays: dict[str, float]) -> DataFrame:
    """What reaches each place ``_at`` (0, 1, 2, ... within a key) from the places before it:
    ``carry[0] = 0``, ``carry[i+1] = end[i] + decay * carry[i]`` for each column of ``decays``."""
    ends = materialize(ends, "run-ends")
    longest = ends.agg(F.max("_at")).first()[0] or 0
    block = F.floor(F.col("_at") / RUN).cast("long").alias("_block")
    inside = W.partitionBy(key, "_block").orderBy("_at")

    def scanned(name: str, last: int):
        gathered = F.collect_list(name).over(inside.rowsBetween(W.unboundedPreceding, last))
        return F.aggregate(gathered, F.lit(0.0), _decayed(decays[name]))

    local = ends.select("*", block).select(
        key, "_at", "_block", *[scanned(n, -1).alias(n) for n in decays],
        *[scanned(n, 0).alias(f"_end_{n}") for n in decays],
    )
    if longest < RUN:
        return local.select(key, "_at", *decays)
    local = materialize(local, "carries")
    blocks = local.groupBy(key, F.col("_block").alias("_at")).agg(
        *[F.max_by(f"_end_{n}", "_at").alias(n) for n in decays]
    )
    above = _carries(blocks, key, {n: d**RUN for n, d in decays.items()})
    above = above.select(key, F.col("_at").alias("_block"), *[F.col(n).alias(f"_above_{n}") for n in decays])
    place = F.pmod(F.col("_at"), F.lit(RUN)).cast("double")
    return local.join(above, [key, "_block"]).select(
        key,
        "_at",
        *[(F.col(n) + F.col(f"_above_{n}") * F.pow(F.lit(d), place)).alias(n) for n, d in decays.items()],
    )


def _decayed(decay: float):
    return lambda total, end: total * F.lit(decay) + end


def macd(
    df: DataFrame,
    spec: PanelSpec,
    column: str = "close",
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    *,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Difference of two exponential averages, its own average and the gap between them.

    A row without a value repeats all three of the row before; before the first value they are NULL.
    """
    rows = number_rows(df, spec, counting=column, rows_per_block=rows_per_block)
    rows = exponential_averages(rows, spec, {"_fast": (column, fast), "_slow": (column, slow)})
    gap = F.col("_fast") - F.col("_slow")
    valued = F.when(F.col(column).isNotNull(), gap)
    rows = rows.select(*df.columns, "_row", gap.alias("MACD"), valued.alias("_valued"))
    rows = exponential_averages(rows, spec, {"MACD_signal": ("_valued", signal)})
    return rows.select(
        *df.columns,
        "MACD",
        "MACD_signal",
        (F.col("MACD") - F.col("MACD_signal")).alias("MACD_hist"),
    )


def forward_fill(
    df: DataFrame, spec: PanelSpec, columns: list[str], *, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Last known value of the key; blocks of a long key start from the last value before them."""
    segmented, cut = segment(df, spec, 0, rows_per_block)
    if cut:
        segmented = segmented.where(~F.col(HALO)).drop(HALO)
    upto = KeyWindow(spec).ordered.rowsBetween(W.unboundedPreceding, 0)
    keyed = F.col(spec.key).isNotNull()

    def known(c: str, window):
        return F.last(c, ignorenulls=True).over(window)

    filled = segmented.select(
        *[
            F.when(keyed, known(c, upto)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in segmented.columns
        ]
    )
    if not cut:
        return filled.drop(PART)
    filled = materialize(filled, "filled")
    ends = filled.groupBy(spec.key, PART).agg(
        *[F.max_by(c, F.struct(*spec.order)).alias(f"_end_{c}") for c in columns]
    )
    before = W.partitionBy(spec.key).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        spec.key, PART, *[known(f"_end_{c}", before).alias(f"_before_{c}") for c in columns]
    )
    return filled.join(carried, [spec.key, PART], "left").select(
        *[
            F.coalesce(c, f"_before_{c}").alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )
