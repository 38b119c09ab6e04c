import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelwright.session import build_session  # noqa: E402

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """``rows("a long, b double", [...])`` -> DataFrame."""
    return lambda schema, data: spark.createDataFrame(data, schema)


@pytest.fixture
def walk(spark):
    """A seeded random-walk panel of three keys with gaps in ``volume``; one key is long."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(42)
    parts = []
    for symbol, n in (("A", 400), ("B", 60), ("C", 1)):
        days = pd.date_range("2020-01-01", periods=n, freq="D")
        close = 100 + rng.normal(size=n).cumsum()
        volume = np.where(rng.random(n) < 0.2, np.nan, rng.integers(1, 50, n))
        target = rng.normal(scale=0.01, size=n)
        parts.append(
            pd.DataFrame(
                {"date": days, "symbol": symbol, "close": close, "volume": volume, "target": target}
            )
        )
    frame = pd.concat(parts, ignore_index=True)
    return frame, spark.createDataFrame(frame).withColumn(
        "date", F.col("date").cast("timestamp_ntz")
    )
