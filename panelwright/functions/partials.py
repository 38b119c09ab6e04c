"""Summaries that tasks build for themselves and that are merged over several levels.

A task emits its summaries as rows (place, slot, payload): what is summarised, which task it came from, and
the bytes. On each level at most ``FAN_IN`` payloads of one place meet in one group, whatever the number of
tasks was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.session import materialize

#: Payloads that one group merges at most.
FAN_IN = 64
PARTIALS = pa.schema([("place", pa.int64()), ("slot", pa.int64()), ("payload", pa.binary())])
PARTIALS_DDL = "place long, slot long, payload binary"


def per_task(build: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple[int, bytes]]]):
    """A ``mapInArrow`` function: ``build`` sees all batches of a task and returns (place, payload) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId()
        for place, payload in build(batches):
            columns = [pa.array([place], pa.int64()), pa.array([slot], pa.int64()), pa.array([payload], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=PARTIALS)

    return run


def merged(partials: DataFrame, merge: Callable[[list[bytes]], bytes], slots: int | None = None) -> DataFrame:
    """``place, payload`` with all payloads of a place merged; ``merge`` takes them in the order of their slots.

    ``slots`` is the number of tasks if it is known; otherwise the partials are written and counted.
    """
    if slots is None:
        partials = materialize(partials, "partials")
        slots = 1 + (partials.agg(F.max("slot")).first()[0] or 0)

    def level(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        payload = merge(table.column("payload").to_pylist())
        slot = table.column("slot")[0].as_py() // FAN_IN
        return pa.table([table.column("place")[:1], pa.array([slot], pa.int64()), pa.array([payload], pa.binary())], schema=PARTIALS)

    while True:
        partials = partials.groupBy("place", F.floor(F.col("slot") / FAN_IN)).applyInArrow(level, PARTIALS_DDL)
        slots = -(-slots // FAN_IN)
        if slots <= 1:
            return partials.select("place", "payload")


def gathered(partials: DataFrame, merge: Callable[[list[bytes]], bytes]) -> dict[int, bytes]:
    """What :func:`merged` gives, on the driver and in one job: two levels, then the payloads that are left."""

    def level(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        payload = merge(table.column("payload").to_pylist())
        slot = table.column("slot")[0].as_py() // FAN_IN
        return pa.table([table.column("place")[:1], pa.array([slot], pa.int64()), pa.array([payload], pa.binary())], schema=PARTIALS)

    for _ in range(2):
        partials = partials.groupBy("place", F.floor(F.col("slot") / FAN_IN)).applyInArrow(level, PARTIALS_DDL)
    left: dict[int, list[bytes]] = {}
    for place, _, payload in sorted(partials.collect()):
        left.setdefault(place, []).append(bytes(payload))
    return {place: merge(payloads) if len(payloads) > 1 else payloads[0] for place, payloads in left.items()}


#: A function from batches to batches, as ``mapInArrow`` takes it.
Batches = Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]
#: What makes the wanted columns of a frame: the frame to read and the function to run on its batches.
Maker = Callable[[Sequence[str]], tuple[DataFrame, Batches]]
_MADE: WeakKeyDictionary[DataFrame, Maker] = WeakKeyDictionary()


def joined_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of ``rows`` at least and one with the rest."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=n)
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=n)


def made_of(df: DataFrame, maker: Maker) -> DataFrame:
    """``df``, whose columns ``maker`` makes of Arrow batches: :func:`map_doubles` runs it in its own Python worker,
    so that a wide frame does not pass through the JVM on its way from one worker to the next."""
    _MADE[df] = maker
    return df


def maker_of(df: DataFrame) -> Maker | None:
    return _MADE.get(df)


def map_doubles(df: DataFrame, columns: Sequence[str], function: Batches, ddl: str) -> DataFrame:
    """``mapInArrow`` of ``function``, which gets ``columns`` as DOUBLE, in their order, and nothing else."""
    maker = maker_of(df)
    if maker is None or any(df.schema[c].dataType != T.DoubleType() for c in columns):
        return df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(function, ddl)
    source, make = maker(columns)
    return source.mapInArrow(lambda batches: function(iter(make(batches))), ddl)


def on_doubles(df: DataFrame, columns: Sequence[str], build: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """The partials that ``build`` makes of the batches of each task."""
    return map_doubles(df, columns, per_task(build), PARTIALS_DDL)


def doubles_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` as DOUBLE; of a frame that Arrow functions make, nothing else is made."""
    if maker_of(df) is None:
        return df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return map_doubles(df, columns, lambda batches: batches, ", ".join(f"`{c}` double" for c in columns))


def add_integers(payloads: list[bytes]) -> bytes:
    """The sum of arrays of 64-bit integers."""
    total = np.frombuffer(payloads[0], np.int64).copy()
    for x in payloads[1:]:
        total += np.frombuffer(x, np.int64)
    return total.tobytes()
