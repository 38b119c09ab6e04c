"""Registered queries against DuckDB; set ORACLE_ALL=1 for every query, ORACLE_SF_DIR for the scale."""

import os

import pytest
from compare import connect, differences
from conftest import SF_DIR

import __spark_entry__ as registry

FAST = (
    "panel_project winsorize_bounds lag_features event_history_hot_keys impute_mode standard_scale "
    "trailing_window walk_forward_bounds_instants walk_forward_assign turnover_from_previous "
    "equity_curve_pooled equity_curve_hot_keys drawdown_curve strategy_report tail_risk rsi_many "
    "event_indicators macd macd_gaps dq_gaps profile payload_explode csv_inferred parquet_roundtrip"
).split()


@pytest.fixture(scope="module")
def connection():
    with connect(SF_DIR) as c:
        yield c


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.oracle_sql()) >= 65


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()) if os.environ.get("ORACLE_ALL") else FAST)
def test_query_matches_oracle(spark, connection, name):
    got = registry.queries()[name](spark, SF_DIR).toPandas()
    want = connection.execute(registry.oracle_sql()[name]).df()
    assert len(got) > 0
    assert differences(got, want) == ""


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns[:3] == ["date", "symbol", "excess_return"] and len(df.columns) == 33
    assert df.count() > 0
