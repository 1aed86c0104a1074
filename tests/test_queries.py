"""Every registered query runs over its tables; those with SQL give the same rows."""

import pytest
from compare import same

from kinetrail.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sf, name):
    same(spark, sf, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_without_training_data_operators(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["runs_bridged", "hop_features", "track_greedy", "state_fractions"])
def test_partitions_do_not_matter(spark, sf, name):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(repr, catalog.QUERIES[name](spark, sf).collect()))

    try:
        assert rows("1") == rows("7")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
