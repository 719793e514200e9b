"""Every registered query against its oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck, sf_dir

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(sf_dir())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, sf_dir()), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, name):
    df = QUERIES[name](spark, sf_dir())
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
