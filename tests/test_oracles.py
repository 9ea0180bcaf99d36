"""Every graph query that has an oracle against it."""

import pytest
from oracle import compare

from loomgraph.queries import ORACLES, QUERIES


#: No edge outlives the log of the smallest tables.
MAY_BE_EMPTY = {"ops_final_edges"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    rows = compare(spark, name, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")
    assert rows > 0 or name in MAY_BE_EMPTY


def test_final_edges_on_more_rows(spark):
    assert compare(spark, "ops_final_edges", QUERIES["ops_final_edges"], ORACLES["ops_final_edges"], "/root/testdata/sf0.01") > 0
