"""Shared pieces of the text operators: input columns, distinct pieces of texts, word hashes.

Every operator takes the names of its id and text columns, copies just those under names of its own
and so does not mind other columns. A null text counts as empty unless an operator says otherwise.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.session import materialize

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of an Arrow batch, instead of Spark's 10,000: texts are long.
BATCH_ROWS, _SPARK_BATCH_ROWS = 2000, "10000"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of one instead of Spark's 256 MB: rows of packed numbers are longer than texts.
BATCH_BYTES = 1 << 24
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of text handled at once in a Python worker.
SLICE_BYTES = 4_000_000
#: glibc keeps freed memory for itself; other C libraries have no such call.
_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it by ``sys.path`` alone, and give
    them smaller batches unless the session sets its own size."""
    if spark.conf.get(_BATCH_ROWS, _SPARK_BATCH_ROWS) == _SPARK_BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS, str(BATCH_ROWS))
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, ROOT) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id`` (long) and ``text`` (null: empty) only."""
    prepare(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


#: Spark then deletes the shuffle files of a step once its table is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """``materialize``, and let go of the shuffle files behind it, which nobody reads again."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return materialize(df, label)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def release(df: DataFrame) -> None:
    """Give back the space of a table that ``written`` returned and nobody reads any more."""
    files = df.inputFiles()
    if files:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(os.path.dirname(files[0]))


def bucket(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as -1 (never a held-out row)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)), F.lit(-1))


def batch_of(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, columns[f.name]) for f in schema)],
        schema=schema,
    )


class Pieces:
    """The pieces (words, chunks) of many texts: distinct ones, and where each text uses which."""

    def __init__(self, lists: pa.ListArray):
        coded = lists.flatten().dictionary_encode()
        #: Distinct pieces.
        self.distinct: list[str] = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        #: Index of each piece, over all texts.
        self.codes = coded.indices.to_numpy().astype(np.int64)
        #: Text i has the codes from bounds[i] to bounds[i + 1].
        self.bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()

    def __len__(self) -> int:
        return len(self.bounds) - 1


class PieceCache:
    """Encoded pieces by their text, filled in batches; above ``limit`` pieces only those of the batch stay.

    Only speed depends on the limit: a piece that is not there is encoded again. A worker process keeps
    the pieces of one cache at a time, the one in use.
    """

    in_use: PieceCache | None = None

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], dtype, limit: int = 500_000):
        self.encode, self.dtype, self.limit = encode, np.dtype(dtype), limit
        self.known: dict[str, bytes] = {}

    def packed(self, keys: list[str]) -> list[bytes]:
        if PieceCache.in_use is not self:
            if PieceCache.in_use is not None:
                PieceCache.in_use.known.clear()
            PieceCache.in_use = self
        found = [*map(self.known.get, keys)]
        missing = [k for k, v in zip(keys, found, strict=True) if v is None]
        if not missing:
            return found
        if len(self.known) + len(missing) > self.limit:
            # What is in use now is likely to be met again.
            self.known = {k: v for k, v in zip(keys, found, strict=True) if v is not None} if len(keys) <= self.limit else {}
        new = dict(zip(missing, self.encode(missing), strict=True))
        self.known.update(new)
        return [new[k] if v is None else v for k, v in zip(keys, found, strict=True)]

    def gather(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """All values of all texts in one array, and the bounds of each text in it."""
        taken = pa.array(self.packed(pieces.distinct), pa.large_binary()).take(pa.array(pieces.codes))
        if not len(taken):
            return np.zeros(0, self.dtype), np.zeros(len(pieces.bounds), np.int64)
        _, offsets, values = taken.buffers()
        ends = np.frombuffer(offsets, np.int64, len(taken) + 1, taken.offset * 8) // self.dtype.itemsize
        return np.frombuffer(values, self.dtype, ends[-1] - ends[0], ends[0] * self.dtype.itemsize), ends[pieces.bounds] - ends[0]


def spaced_words(texts: pa.Array) -> Pieces:
    """Words are runs of anything but the six ASCII spaces; a blank text has none."""
    import pyarrow.compute as pc

    trimmed = pc.ascii_trim_whitespace(texts)
    return Pieces(pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), None, trimmed)))


def _word_hashes(words: list[str]) -> list[bytes]:
    import xxhash

    return [xxhash.xxh3_64_digest(w.encode()) for w in words]


WORD_HASHES = PieceCache(_word_hashes, ">u8", 300_000)


def word_codes(pieces: Pieces) -> np.ndarray:
    """A 64-bit hash of each word, over all texts; an empty piece is no word and must not be there."""
    packed = WORD_HASHES.packed(pieces.distinct)
    return np.frombuffer(b"".join(packed), ">u8").astype(np.uint64)[pieces.codes]


def trim() -> None:
    """Give back the memory that freed work arrays leave in a Python worker, and the pieces of a step that is over:
    workers live on and share an executor."""
    if PieceCache.in_use is not None:
        PieceCache.in_use.known.clear()
        PieceCache.in_use = None
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM is not None:
        _MALLOC_TRIM(0)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of texts of about ``limit`` bytes (one text at least), so that work arrays stay small."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield texts.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def whole_rows(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` as the one column ``row``, to pass through Python unchanged."""
    prepare(docs.sparkSession)
    return docs.select(F.struct("*").alias("row"))


def texts_of(batch: pa.RecordBatch, text_col: str = "text") -> pa.Array:
    """The texts of a batch of :func:`whole_rows` (null: empty), or of rows with a column ``text``."""
    if "row" not in batch.schema.names:
        return batch.column("text")
    rows = batch.column("row")
    return rows.field(rows.type.get_field_index(text_col)).cast(pa.string()).fill_null("")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a xorshift-multiply finaliser)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit code for each run of ``width`` words; a shorter text is one run, no word no run."""
    n = len(codes)
    if n == 0:
        return codes
    if n < width:
        total = np.array([n], np.uint64)
        for i in range(n):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + 1])
        return total
    total = np.zeros(n - width + 1, np.uint64)
    factor = 1
    for i in range(width):
        factor = factor * 0x9E3779B97F4A7C15 % 2**64
        total += codes[i : n - width + 1 + i] * np.uint64(factor)
    return mix(total)


#: A key with more than one in so many rows is joined by broadcast.
HOT_SHARE = 1000


def joined_by_key(rows: DataFrame, values: DataFrame, key: str, n_col: str) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row for each key and its number of rows.

    Keys with more than one in ``HOT_SHARE`` rows, of which there are fewer than ``HOT_SHARE``, are
    broadcast; rows of all others are shuffled, of which no key has many. ``rows`` is read three times.
    """
    values = written(values, "values")
    hot = values.filter(F.col(n_col) * HOT_SHARE > rows.count()).drop(n_col)
    found = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    rest = found.filter("__hot is null").select(*rows.columns).join(values.drop(n_col), key)
    return found.filter("__hot").select(*rest.columns).unionByName(rest)
