"""Every registered query against its SQL twin on the smallest data; queries without a twin must yield rows."""

import pytest

import __spark_entry__
from tests.oracle_check import compare, connect

ROOT = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()
ORACLE = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


def test_twins_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, ROOT).toPandas()
    if name in ORACLE:
        verdict = compare(got, duck.execute(ORACLE[name]).df())
        assert verdict.startswith("ok"), verdict
    else:
        assert len(got) > 0 and len(got.columns) == len(set(got.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
