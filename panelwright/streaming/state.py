"""Keyed state of a stream: the rows of each key that later batches can still need, in bucket folders.

A key belongs to one of ``n_buckets`` buckets. A batch reads and rewrites the buckets of its own keys only,
and of each key the state keeps only a tail, so that the cost of a batch depends on its keys and not on how
many batches came before. A manifest for each batch names the version of every bucket; it is written last
and read by the next batch, so that a batch that is replayed starts from the same state.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.spec import PanelSpec, require_columns

BUCKET = "bucket"
_EARLY, _RANK, _LAST = "_early", "_rank", "_last"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``; errors of the file system are raised."""
    system, place = _file_system(spark, path)
    return system.exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.delete(place, True)


@dataclass(frozen=True)
class Manifest:
    """Versions of the buckets that hold rows, and the (bucket, version) pairs this batch replaced."""

    n_buckets: int
    versions: dict[int, int]
    replaced: list[tuple[int, int]]


@dataclass(frozen=True)
class KeyedState:
    """State under ``path``.

    Of each key it holds the rows of the last ``late_days`` days before the key's latest date and the
    ``lookback`` rows before those: what the features of a row that comes up to ``late_days`` late depend
    on. Rows without a key or a date are not kept, no feature reads them.
    """

    path: str
    panel: PanelSpec
    lookback: int
    late_days: int = 21
    n_buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.panel.key), F.lit(self.n_buckets)).cast("int")

    def buckets_of(self, batch: DataFrame) -> list[int]:
        """The buckets of the batch's keys, ``n_buckets`` at most."""
        keyed = batch.where(F.col(self.panel.key).isNotNull() & F.col(self.panel.date).isNotNull())
        return sorted(r[0] for r in keyed.select(self.bucket()).distinct().collect())

    def manifest(self, spark: SparkSession, batch_id: int) -> Manifest | None:
        """The manifest written with a batch; None if there is none."""
        path = self._manifest_path(batch_id)
        if not path_exists(spark, path):
            return None
        found = json.loads(spark.read.text(path).first()[0])
        if found["n_buckets"] != self.n_buckets:
            raise ValueError(f"The state at {self.path} has {found['n_buckets']} buckets, not {self.n_buckets}")
        versions = {int(b): v for b, v in found["versions"].items()}
        return Manifest(found["n_buckets"], versions, [tuple(x) for x in found["replaced"]])

    def read(self, spark: SparkSession, manifest: Manifest, buckets: Iterable[int], schema: T.StructType) -> DataFrame:
        """Rows of some buckets; a column of ``schema`` that the state does not have is an error."""
        paths = [self._rows_path(manifest.versions[b], b) for b in buckets if b in manifest.versions]
        if not paths:
            return spark.createDataFrame([], schema)
        table = spark.read.parquet(*paths)
        require_columns(table, schema.names)
        return table.select(*schema.names)

    def tail(self, rows: DataFrame) -> DataFrame:
        """The rows of each key that are kept."""
        panel = self.panel
        kept = rows.where(F.col(panel.key).isNotNull() & F.col(panel.date).isNotNull())
        last = F.max(panel.date).over(Window.partitionBy(panel.key))
        if isinstance(rows.schema[panel.date].dataType, T.DateType):
            cutoff = F.date_sub(F.col(_LAST), self.late_days)
        else:
            cutoff = F.col(_LAST) - F.make_dt_interval(days=F.lit(self.late_days))
        early = kept.withColumn(_LAST, last).withColumn(_EARLY, F.col(panel.date) < cutoff)
        newest = Window.partitionBy(panel.key, _EARLY).orderBy(*[F.desc(c) for c in panel.order])
        ranked = early.withColumn(_RANK, F.row_number().over(newest))
        return ranked.where(~F.col(_EARLY) | (F.col(_RANK) <= self.lookback)).select(*rows.columns)

    def write(self, batch_id: int, rows: DataFrame, buckets: list[int], before: Manifest | None) -> None:
        """Replace ``buckets`` by the tails of ``rows``, which hold all their keys, and commit.

        Rows are laid out by ranges of (bucket, key, date), so that a hot key fills several files.
        """
        spark, versions = rows.sparkSession, dict(before.versions) if before else {}
        if buckets:
            order = [BUCKET, self.panel.key, *self.panel.order]
            laid = self.tail(rows).withColumn(BUCKET, self.bucket()).repartitionByRange(*order).sortWithinPartitions(*order)
            laid.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/rows/version={batch_id}")
        replaced = [(b, versions[b]) for b in buckets if b in versions]
        versions |= {b: batch_id for b in buckets}
        content = json.dumps({"n_buckets": self.n_buckets, "versions": versions, "replaced": replaced}, sort_keys=True)
        row = spark.createDataFrame([(content,)], "value string").coalesce(1)
        row.write.mode("overwrite").text(self._manifest_path(batch_id))
        spark.createDataFrame([(str(batch_id),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/latest")

    def latest(self, spark: SparkSession) -> Manifest | None:
        """The manifest of the last batch that was committed."""
        if not path_exists(spark, f"{self.path}/latest"):
            return None
        return self.manifest(spark, int(spark.read.text(f"{self.path}/latest").first()[0]))

    def forget(self, spark: SparkSession, batch_id: int) -> None:
        """Delete what the manifest of ``batch_id`` replaced, and the manifest before it. Call it when the
        next batch starts: no earlier one is replayed then."""
        found = self.manifest(spark, batch_id)
        for bucket, version in found.replaced if found else []:
            _delete(spark, self._rows_path(version, bucket))
        if found and batch_id - 1 >= -1:
            _delete(spark, self._manifest_path(batch_id - 1))

    def _manifest_path(self, batch_id: int) -> str:
        return f"{self.path}/manifest/batch={batch_id}"

    def _rows_path(self, version: int, bucket: int) -> str:
        return f"{self.path}/rows/version={version}/{BUCKET}={bucket}"
