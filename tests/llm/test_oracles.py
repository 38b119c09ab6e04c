"""Text queries against DuckDB."""

import pytest
from compare import connect, differences

from panelwright.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    with connect(SF_DIR) as connection:
        want = connection.execute(ORACLES[name]).df()
    assert differences(QUERIES[name](spark, SF_DIR).toPandas(), want) == ""
