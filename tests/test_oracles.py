"""Every registered query runs, and equals its SQL where it has one."""

import compare
import pytest

import __spark_entry__ as entry
from levelfield.plans import load

DIRECTORY = "/root/testdata/sf0.001"
QUERIES, ORACLES = load().QUERIES, load().ORACLES


@pytest.fixture(scope="module")
def con():
    return compare.connect(DIRECTORY)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIRECTORY)
    if name in ORACLES:
        assert compare.difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() >= 0


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
