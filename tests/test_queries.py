"""Every registered query of the timeline and catalogue operators against its SQL."""

import pytest
from oracle import assert_same, connect

from chronolith.plans import catalog

catalog.load()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    n = assert_same(catalog.QUERIES[name](spark, sf_dir), connect(sf_dir), catalog.ORACLES[name])
    assert n or name in ("classify_videos",)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
