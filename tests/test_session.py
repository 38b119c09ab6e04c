"""Settings that queries bring along, whatever session they are given."""

import pytest

from panelwright.catalog.panels import table
from panelwright.session import _METHOD_LIMIT, _SPLIT, compiled, small_splits
from conftest import SF_DIR


@pytest.fixture
def limit(spark):
    before = spark.conf.get(_METHOD_LIMIT)
    yield lambda value: spark.conf.set(_METHOD_LIMIT, value)
    spark.conf.set(_METHOD_LIMIT, before)


def test_reading_a_table_bounds_generated_methods(spark, limit):
    limit("65535")
    table(spark, SF_DIR, "lineitem")
    assert spark.conf.get(_METHOD_LIMIT) == "8000"


def test_a_limit_of_the_session_stays(spark, limit):
    limit("20000")
    assert compiled(spark).conf.get(_METHOD_LIMIT) == "20000"


def test_blocks_of_small_splits_may_overlap(spark):
    before = spark.conf.get(_SPLIT)
    first, second = small_splits(spark, 1000), small_splits(spark, 5000)
    first.__enter__()
    second.__enter__()
    # The smaller one holds for both.
    assert spark.conf.get(_SPLIT) == "1000"
    first.__exit__(None, None, None)
    assert spark.conf.get(_SPLIT) == "1000"
    second.__exit__(None, None, None)
    assert spark.conf.get(_SPLIT) == before
