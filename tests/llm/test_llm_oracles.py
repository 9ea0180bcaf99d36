"""Queries of this subpackage against their SQL."""

import pytest
from oracle import compare

from loomgraph.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name]) > 0
