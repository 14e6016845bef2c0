"""Every query of the slate against its SQL."""

import pytest

import __spark_entry__ as entry
from spanloom import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(name, same):
    same(plans.QUERIES[name], plans.ORACLE_SQL[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_contract_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cycles_stay(spark):
    from spanloom.operators.lineage import unpeeled

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (7, 8)], "parent long, child long")
    assert sorted(map(tuple, unpeeled(edges).collect())) == [(2, 3), (3, 2), (3, 4)]
