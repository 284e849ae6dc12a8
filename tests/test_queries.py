"""Queries against the SQL that should give the same rows."""

import pytest

import __spark_entry__ as entry
from attesta.plans import suite

from .compare import same

NAMES = sorted(suite.ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    same(suite.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(suite.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(suite.QUERIES) - set(suite.ORACLES)))
def test_query_without_sql(spark, sf_dir, name):
    assert suite.QUERIES[name](spark, sf_dir).columns


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
