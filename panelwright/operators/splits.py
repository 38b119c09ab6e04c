"""Walk-forward splits and the trailing inference window."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.quantiles import order_statistics, summarize
from panelwright.operators.segments import instant_micros
from panelwright.session import materialize
from panelwright.spec import PanelSpec, SplitSpec


@dataclass(frozen=True)
class Fold:
    """1-based date ranks and the dates at them; dates are text so that no precision is lost."""

    fold_id: int
    train_start_rank: int
    train_end_rank: int
    valid_start_rank: int
    valid_end_rank: int
    train_start: str
    train_end: str
    valid_start: str
    valid_end: str


def fold_ranks(n_dates: int, split: SplitSpec) -> list[tuple[int, int, int, int]]:
    """First and last rank of training and of validation per fold, counted back from the last date."""
    if split.n_splits < 1:
        raise ValueError(f"A walk-forward split takes one fold or more, not n_splits={split.n_splits}")
    first_valid = n_dates - split.n_splits * split.test_size
    # Fold 0 has the shortest history; if it does not fit there is no split at all.
    if first_valid - split.gap <= 0:
        raise ValueError(
            f"{n_dates} dates leave no training date for the first of {split.n_splits} folds of "
            f"{split.test_size} dates after a gap of {split.gap}"
        )
    ranks = []
    for fold in range(split.n_splits):
        before = first_valid + fold * split.test_size
        train_end = before - split.gap
        train_start = 1 if split.max_train_days is None else train_end - split.max_train_days + 1
        ranks.append((max(1, train_start), train_end, before + 1, before + split.test_size))
    return ranks


def date_ranks(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Distinct calendar days of a daily panel with their 1-based rank; at most 36,525 rows a century,
    whatever times of day the rows have."""
    day = F.to_date(spec.date).cast(df.schema[spec.date].dataType).alias(spec.date)
    return (
        df.select(day)
        .where(F.col(spec.date).isNotNull())
        .distinct()
        .select(spec.date, F.row_number().over(W.orderBy(spec.date)).cast("long").alias("rank"))
    )


def walk_forward_folds(df: DataFrame, spec: PanelSpec, split: SplitSpec) -> list[Fold]:
    """Fold boundaries as dates. Only the boundary dates reach the driver."""
    ranks, at = _boundary_dates(df, spec, lambda n: fold_ranks(n, split))
    return [Fold(fold, *r, *[at[x] for x in r]) for fold, r in enumerate(ranks)]


def _boundary_dates(
    df: DataFrame, spec: PanelSpec, ranks_of: Callable[[int], list[tuple[int, ...]]]
) -> tuple[list[tuple[int, ...]], dict[int, str]]:
    """The ranks that ``ranks_of`` wants of so many dates, and the dates at these ranks."""
    if spec.grain == "day":
        ranked = date_ranks(df, spec).persist()
        try:
            ranks = ranks_of(ranked.count())
            wanted = {r for fold in ranks for r in fold}
            found = ranked.where(F.col("rank").isin(*wanted)).select(
                "rank", F.col(spec.date).cast("string").alias("date")
            )
            return ranks, {r["rank"]: r["date"] for r in found.collect()}
        finally:
            ranked.unpersist()
    # Distinct instants may be as many as rows: select the few wanted ranks without ranking all.
    instants = materialize(
        df.where(F.col(spec.date).isNotNull())
        .select(instant_micros(df, spec.date).cast("double").alias("at"))
        .distinct(),
        "instants",
    )
    summaries = summarize(instants, ["at"])
    ranks = ranks_of(summaries["at"].values)
    wanted = sorted({r - 1 for fold in ranks for r in fold})
    values = order_statistics(instants, {"at": wanted}, summaries)
    rows = df.sparkSession.createDataFrame(
        [(r + 1, int(v)) for (_, r), v in values.items()], "rank long, at long"
    )
    text = F.timestamp_micros("at").cast(df.schema[spec.date].dataType).cast("string")
    return ranks, {r["rank"]: r["date"] for r in rows.select("rank", text.alias("date")).collect()}


def date_literal(df: DataFrame, spec: PanelSpec, text: str) -> Column:
    """A literal of the date column's own type, so that comparisons reach the scan."""
    return F.lit(text).cast(df.schema[spec.date].dataType)


def _upto(df: DataFrame, spec: PanelSpec, text: str) -> Column:
    """Not after a fold's last date: the whole day in a daily panel, that instant in any other."""
    kind = df.schema[spec.date].dataType
    if spec.grain == "day" and not isinstance(kind, T.DateType):
        return F.col(spec.date) < (date_literal(df, spec, text) + F.make_dt_interval(days=F.lit(1))).cast(kind)
    return F.col(spec.date) <= date_literal(df, spec, text)


def fold_filter(df: DataFrame, spec: PanelSpec, fold: Fold, role: str) -> DataFrame:
    """Rows of one side of one fold: a range filter that prunes files and row groups."""
    date = F.col(spec.date)
    if role == "train":
        kept = _upto(df, spec, fold.train_end)
        if fold.train_start_rank > 1:
            kept = kept & (date >= date_literal(df, spec, fold.train_start))
        return df.where(kept)
    return df.where((date >= date_literal(df, spec, fold.valid_start)) & _upto(df, spec, fold.valid_end))


def assign_folds(df: DataFrame, spec: PanelSpec, folds: list[Fold]) -> DataFrame:
    """Rows with ``fold_id`` and ``role``, once per fold they take part in; no join, no shuffle."""
    date = F.col(spec.date)

    def part(fold: Fold, role: str, inside: Column) -> Column:
        return F.when(
            inside, F.struct(F.lit(fold.fold_id).cast("long").alias("fold_id"), F.lit(role).alias("role"))
        )

    parts = []
    for fold in folds:
        train = _upto(df, spec, fold.train_end)
        if fold.train_start_rank > 1:
            train = train & (date >= date_literal(df, spec, fold.train_start))
        valid = (date >= date_literal(df, spec, fold.valid_start)) & _upto(df, spec, fold.valid_end)
        parts += [part(fold, "train", train), part(fold, "valid", valid)]
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return df.select("*", F.inline(kept))


def block_folds(df: DataFrame, spec: PanelSpec, n: int, name: str = "fold") -> DataFrame:
    """Add ``name``, the number from 0 of one of ``n`` runs of consecutive dates of about equal length, as the fold
    column of a cross-validator. Rows without a date are in fold 0."""

    def last_ranks(dates: int) -> list[tuple[int, ...]]:
        if not 2 <= n <= dates:
            raise ValueError(f"{n} folds need 2 folds or more and a date in each; there are {dates} dates")
        return [(dates * i // n,) for i in range(1, n)]

    ranks, at = _boundary_dates(df, spec, last_ranks)
    later = [F.when(~_upto(df, spec, at[r]), 1).otherwise(0) for (r,) in ranks]
    return df.select("*", reduce(lambda a, b: a + b, later).cast("int").alias(name))


def folds_table(df: DataFrame, spec: PanelSpec, folds: list[Fold]) -> DataFrame:
    """The folds as a DataFrame with dates in the panel's own type."""
    kind = df.schema[spec.date].dataType
    schema = T.StructType(
        [T.StructField("fold_id", T.LongType())]
        + [T.StructField(c, T.LongType()) for c in _RANKS]
        + [T.StructField(c, T.StringType()) for c in _DATES]
    )
    rows = [tuple(getattr(f, c) for c in ("fold_id", *_RANKS, *_DATES)) for f in folds]
    table = df.sparkSession.createDataFrame(rows, schema)
    return table.select("fold_id", *_RANKS, *[F.col(c).cast(kind).alias(c) for c in _DATES])


_RANKS = ("train_start_rank", "train_end_rank", "valid_start_rank", "valid_end_rank")
_DATES = ("train_start", "train_end", "valid_start", "valid_end")


def trailing_window(df: DataFrame, spec: PanelSpec, days: int) -> DataFrame:
    """Rows of the last ``days`` calendar days before the latest date of all keys, inclusive.

    The cutoff is found first and then filtered as a literal, so it is pushed down to the scan.
    """
    latest = F.max(spec.date)
    if isinstance(df.schema[spec.date].dataType, T.DateType):
        cutoff = F.date_sub(latest, days)
    else:
        cutoff = latest - F.make_dt_interval(days=F.lit(days))
    text = df.agg(cutoff.cast("string")).first()[0]
    if text is None:
        return df.where(F.lit(False))
    return df.where(F.col(spec.date) >= date_literal(df, spec, text))
