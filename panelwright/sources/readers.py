"""Sources: CSV, parquet and columnar JSON payloads as panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.spec import PanelSpec, clean_double, require_columns


def _without_nan(df: DataFrame) -> DataFrame:
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            clean_double(f.name, f.dataType) if isinstance(f.dataType, floats) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    schema: T.StructType | str | None = None,
    dates: Sequence[str] = (),
) -> DataFrame:
    """CSV with a header. Give a schema for large inputs: inferring types reads the files once more.

    ``dates`` names columns parsed into TIMESTAMP_NTZ; a value that is no date is an error. A missing
    path is Spark's own error.
    """
    reader = spark.read.option("header", True)
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", True).csv(path)
    require_columns(df, dates)
    types = {f.name: f.dataType for f in df.schema.fields}

    def parsed(c: str):
        if c not in dates or isinstance(types[c], (T.DateType, T.TimestampNTZType)):
            return F.col(c)
        return F.col(c).cast("timestamp_ntz").alias(c)

    return _without_nan(df.select(*[parsed(c) for c in df.columns]))


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return _without_nan(spark.read.parquet(*paths))


def load_panel(
    spark: SparkSession,
    path: str | Sequence[str],
    panel: PanelSpec,
    *,
    format: str = "csv",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A training or holdout table, checked for its role columns before any job runs on it."""
    if format == "csv":
        df = read_csv(spark, path, schema=schema, dates=[panel.date])
    elif format == "parquet":
        df = read_parquet(spark, path)
    else:
        raise ValueError(f"Unsupported panel format: {format}")
    require_columns(df, panel.roles)
    return df


def explode_payloads(
    df: DataFrame, column: str, fields: Mapping[str, str], dates: Sequence[str] = ("date",)
) -> DataFrame:
    """Rows of JSON records that hold one array per field.

    ``fields`` maps names to element types. Every record must have all arrays, of one length;
    otherwise the job fails with the lengths found. ``dates`` are given as text in the record and come
    out as TIMESTAMP_NTZ.
    """
    wire = {c: "string" if c in dates else kind for c, kind in fields.items()}
    layout = ", ".join(f"`{c}` array<{kind}>" for c, kind in wire.items())
    parsed = df.select(
        *[c for c in df.columns if c != column],
        F.from_json(F.col(column), layout, {"mode": "FAILFAST"}).alias("_record"),
    )
    sizes = [F.coalesce(F.size(F.col(f"_record.{c}")), F.lit(-1)) for c in fields]
    same = F.lit(True)
    for size in sizes:
        same = same & (size == sizes[0]) & (size >= 0)
    message = F.concat(
        F.lit("Payload arrays differ in length: "),
        F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), s.cast("string")) for c, s in zip(fields, sizes)]),
    )
    zipped = F.arrays_zip(*[F.col(f"_record.{c}").alias(c) for c in fields])
    checked = F.when(same, zipped).otherwise(F.raise_error(message).cast(_zip_type(wire)))
    carried = [c for c in df.columns if c != column]
    rows = parsed.select(*carried, F.inline(checked))
    return _without_nan(
        rows.select(
            *carried,
            *[F.col(c).cast("timestamp_ntz").alias(c) if c in dates else F.col(c) for c in fields],
        )
    )


def _zip_type(wire: Mapping[str, str]) -> str:
    inner = ", ".join(f"`{c}`: {kind}" for c, kind in wire.items())
    return f"array<struct<{inner}>>"
