"""Spark's trees read stored features in bounded splits, however large the files and the row groups of a session are."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelwright.operators import features as ft
from panelwright.operators import models as md
from panelwright.spec import FeatureSpec, ModelSpec, PanelSpec


class _Fitted(Exception):
    pass


def _one_file(spark, path):
    """Eight thousand rows of noise in one file of many row groups."""
    made = spark.range(8000, numPartitions=1).select(F.rand(1).alias("x"), F.rand(2).alias("y"))
    made.write.option("parquet.block.size", "4096").parquet(path)
    return spark.read.parquet(path)


def test_trees_read_small_splits(spark, tmp_path, monkeypatch):
    table = _one_file(spark, str(tmp_path / "rows"))
    assert table.rdd.getNumPartitions() == 1
    seen = []

    class Watched:
        def fit(self, rows):
            counts = rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
            seen.extend(n for n in counts if n)
            raise _Fitted

    monkeypatch.setattr(md, "build_model", lambda *a: Watched())
    monkeypatch.setattr(md, "TREE_SPLIT_BYTES", 20_000)
    with pytest.raises(_Fitted):
        md.train_model(ModelSpec("gbt"), table, ["x"], "y")
    assert sum(seen) == 8000 and len(seen) > 3 and max(seen) < 4000
    # The session's own splits are back, also after an error.
    assert spark.read.parquet(str(tmp_path / "rows")).rdd.getNumPartitions() == 1


def test_stored_features_have_small_row_groups(spark, walk, monkeypatch):
    monkeypatch.setattr(ft, "ROW_GROUP_BYTES", 4096)
    stored = []
    write = ft.materialize
    monkeypatch.setattr(ft, "materialize", lambda df, *a, **k: stored.append(write(df.coalesce(1), *a, **k)) or stored[-1])
    panel = PanelSpec(target="target", features=("close", "volume"))
    ft.FeatureEstimator(panel, FeatureSpec()).fit_transform(walk[1])
    (table,) = stored
    (file,) = table.inputFiles()
    assert pq.ParquetFile(file.removeprefix("file://")).metadata.num_row_groups > 1
