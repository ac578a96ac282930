"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from recspark.plans.registry import QUERIES, SQL_TWINS as TWINS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, name):
    compare(spark, con, FOLDER, name, QUERIES[name], TWINS[name])


def test_every_query_runs(spark):
    for name in sorted(set(QUERIES) - set(TWINS)):
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "rank", "item_id", "score"]
    assert df.count() > 0
