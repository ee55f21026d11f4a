"""Every registered query beside its SQL."""

import pytest

from tessera.catalog import ORACLES, QUERIES
from tools.compare import compare

#: Nothing in the smallest tables fits these.
MAY_BE_EMPTY = {"split_merge_incomplete"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    said = compare(spark, name, QUERIES[name], ORACLES[name], sf_dir)
    assert not said or (said == "no rows" and name in MAY_BE_EMPTY), said


def test_every_query_has_rows_and_stable_columns(spark, sf_dir):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        df = QUERIES[name](spark, sf_dir)
        assert df.columns == QUERIES[name](spark, sf_dir).columns
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
