"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}

#: HotSpot compiles no method of more bytes: what Spark generates for a wide projection would stay interpreted.
_METHOD_BYTES, _SPARK_METHOD_BYTES = "8000", "65535"
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def build_session(app: str = "panelwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; anything may be overridden by keyword."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
        # Call sites in error messages cost a stack walk per column expression; wide plans have many.
        "spark.sql.dataFrameQueryContext.enabled": "false",
        _METHOD_LIMIT: _METHOD_BYTES,
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def compiled(spark: SparkSession) -> SparkSession:
    """Let stages whose generated method is too long to be compiled run by short ones, operator by operator, unless
    the session sets a limit of its own."""
    if spark.conf.get(_METHOD_LIMIT, _SPARK_METHOD_BYTES) == _SPARK_METHOD_BYTES:
        spark.conf.set(_METHOD_LIMIT, _METHOD_BYTES)
    return spark


_SPLIT = "spark.sql.files.maxPartitionBytes"
_SPLIT_LOCK = threading.Lock()
#: By session: the setting before the first block that is open, and how many are.
_SPLIT_HELD: dict[int, tuple[str, int]] = {}


@contextmanager
def small_splits(spark: SparkSession, most: int) -> Iterator[None]:
    """Scans that start inside give a task no more than ``most`` bytes of files, or one row group if that is larger.

    Blocks of several threads may overlap: the last one that ends restores the setting.
    """
    session = spark._jsparkSession.hashCode()
    with _SPLIT_LOCK:
        before, open_ = _SPLIT_HELD.get(session, (spark.conf.get(_SPLIT), 0))
        _SPLIT_HELD[session] = before, open_ + 1
        if spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > most:
            spark.conf.set(_SPLIT, str(most))
    try:
        yield
    finally:
        with _SPLIT_LOCK:
            before, open_ = _SPLIT_HELD.pop(session)
            if open_ > 1:
                _SPLIT_HELD[session] = before, open_ - 1
            else:
                spark.conf.set(_SPLIT, before)


_HELD_LOCK = threading.Lock()
#: By session and setting: its value before the first block that is open, and how many are.
_HELD: dict[tuple[int, str], tuple[str | None, int]] = {}


@contextmanager
def at_most(spark: SparkSession, **limits: int) -> Iterator[None]:
    """Numbers of the session (double underscores stand for dots) that are no more than these inside the block.

    Blocks of several threads may overlap: the last one that ends restores the setting.
    """
    names = {k.replace("__", "."): v for k, v in limits.items()}
    session = spark._jsparkSession.hashCode()
    with _HELD_LOCK:
        for name, most in names.items():
            now = spark.conf.get(name, None)
            before, open_ = _HELD.get((session, name), (now, 0))
            _HELD[session, name] = before, open_ + 1
            # A size with a unit is one that somebody chose.
            if now is None or (now.lstrip("-").isdigit() and (int(now) > most or int(now) <= 0)):
                spark.conf.set(name, str(most))
    try:
        yield
    finally:
        with _HELD_LOCK:
            for name in names:
                before, open_ = _HELD.pop((session, name))
                if open_ > 1:
                    _HELD[session, name] = before, open_ - 1
                elif before is None:
                    spark.conf.unset(name)
                else:
                    spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a scratch folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="panelwright-")
    return _LOCAL_FOLDERS[app]


def materialize(df: DataFrame, label: str = "step", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``options`` are those of the parquet writer.

    A parquet table rather than a row checkpoint: it cuts lineage so that a lost executor costs no
    recomputation, and later passes still prune columns and push filters down.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
