"""The driver's contract."""

import __spark_entry__ as entry
from loomgraph.queries import QUERIES


def test_contract(spark):
    assert entry.entry(spark).count() == 10
    known = entry.queries()
    assert set(QUERIES) <= set(known) and set(entry.oracle_sql()) <= set(known)
    if entry.corpus:
        assert {k.split("_")[0] for k in known if k.startswith("op") and k[2].isdigit()} == {f"op{n}" for n in range(1, 11)}
    assert ("pipeline" in known) == bool(entry.corpus_pipeline)
