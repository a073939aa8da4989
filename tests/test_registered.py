"""Every registered query against its SQL at the smallest scale, and its plan."""

import re

import pytest

import __spark_entry__ as entry
from tests import oracle
from tests.conftest import plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.collect() is not None
    else:
        assert oracle.difference(df, con, sql) is None
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"PythonUDF|PythonEvaluation|MapInPandas", text)


def test_entry(spark):
    assert entry.entry(spark).count() > 12
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    text = plan(entry.queries()["filter_sort_limit"](spark, SF))
    assert "TakeOrderedAndProject" in text
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThanOrEqual(o_totalprice" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "o_orderpriority" not in schema and "o_custkey" not in schema


def test_top_n_is_limited_before_the_shuffle(spark):
    assert plan(entry.queries()["topn_long"](spark, SF)).count("WindowGroupLimit") == 2
