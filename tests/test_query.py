import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tablewright import ToolError, run
from tablewright.specs import (
    AggregateTable, Filter, FilterTable, GenerateVisual, Metric, PreviewTable, SimpleJoin, SqlQuery, TopN, TopNWide,
)
from tests.conftest import rows


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "sales": spark.createDataFrame(
            [("Jan", "online", 100.0, 10), ("Feb", "store", 200.0, 20), ("Mar", "online", 150.0, 15),
             ("Apr", "store", 300.0, 30), ("May", "online", 250.0, 25)],
            "month string, channel string, revenue double, units bigint",
        ),
        "orders": spark.createDataFrame([(1, 10, 50.0), (2, 20, 80.0), (3, 10, 120.0)], "order_id bigint, customer_id bigint, total double"),
        "customers": spark.createDataFrame([(10, "Alice"), (20, "Bob")], "id bigint, name string"),
        "nulls": spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "c")], "x double, y string"),
    }


def filtered(tables, column, op, value=None, table="sales"):
    return run(tables, FilterTable(table, [Filter(column, op, value)])).count()


def test_preview(tables, spark):
    out = run(tables, PreviewTable("sales", ["revenue", "month"], 2))
    assert out.columns == ["revenue", "month"] and out.count() == 2
    wide = {"t": spark.range(150).toDF("x")}
    assert run(wide, PreviewTable("t")).count() == 100
    assert run(wide, PreviewTable("t", limit=None)).count() == 150


def test_unknown_names_list_what_there_is(tables):
    for spec in (
        PreviewTable("nope"), PreviewTable("sales", ["nope"]), FilterTable("sales", [Filter("nope", "eq", 1)]),
        AggregateTable("sales", ["nope"], []), AggregateTable("sales", ["month"], [Metric("nope", "sum")]),
        SimpleJoin("sales", "nope", "a", "b"), SimpleJoin("orders", "customers", "nope", "id"),
        SimpleJoin("orders", "customers", "customer_id", "id", ["nope"]), TopN("sales", "nope", "month"),
    ):
        with pytest.raises(ToolError, match="nope.*"):
            run(tables, spec)
    with pytest.raises(ToolError, match="Available"):
        run(tables, PreviewTable("nope"))


@pytest.mark.parametrize(
    ("op", "value", "expected"),
    [("eq", 200, 1), ("ne", 200, 4), ("gt", 150, 3), ("gte", 150, 4), ("lt", 150, 1), ("lte", 150, 2),
     ("in", [100, 300.0], 2), ("in", 100, 1), ("not_in", [100], 4), ("gt", 199.5, 3), ("eq", "200", 1)],
)
def test_number_filters(tables, op, value, expected):
    assert filtered(tables, "revenue", op, value) == expected


def test_text_filters(tables):
    assert filtered(tables, "channel", "contains", "on") == 3
    assert filtered(tables, "month", "contains", "^Ma") == 2
    assert filtered(tables, "month", "contains", "ma") == 0
    assert filtered(tables, "units", "contains", "5") == 2
    assert filtered(tables, "channel", "eq", 5) == 0


def test_null_filters(tables):
    for op, value, expected in (
        ("is_null", None, 1), ("is_not_null", None, 2), ("eq", 1, 1), ("ne", 1, 2), ("gt", 0, 2), ("lt", 9, 2),
        ("not_in", [1], 2), ("in", [1, None], 2), ("eq", None, 0), ("ne", None, 3), ("ne", "word", 3), ("eq", "word", 0),
    ):
        assert filtered(tables, "x", op, value, "nulls") == expected, (op, value)
    with pytest.raises(ToolError):
        filtered(tables, "x", "gt", "word", "nulls")
    with pytest.raises(ToolError):
        filtered(tables, "x", "like", "word", "nulls")
    assert filtered(tables, "y", "contains", "None", "nulls") == 0


def test_filter_projects_sorts_limits(tables):
    spec = FilterTable("sales", [Filter("channel", "eq", "online"), Filter("units", "gt", 10)], ["month", "units"], "units", True, 1)
    assert rows(run(tables, spec)) == [("May", 25)]
    with pytest.raises(ToolError, match="sort_by"):
        run(tables, FilterTable("sales", [], ["month"], "units"))


def test_sort_puts_missing_last_both_ways(tables):
    for desc, expected in ((False, [1.0, 3.0, None]), (True, [3.0, 1.0, None])):
        out = run(tables, FilterTable("nulls", [], [], "x", desc)).collect()
        assert [r["x"] for r in out] == expected


def test_dates_compare_with_text(spark):
    t = {"t": spark.createDataFrame([(dt.date(2024, 1, i),) for i in (1, 2, 3)], "d date")}
    assert filtered(t, "d", "gte", "2024-01-02", "t") == 2
    assert filtered(t, "d", "in", ["2024-01-01"], "t") == 1


def test_join(tables, spark):
    out = run(tables, SimpleJoin("orders", "customers", "customer_id", "id"))
    assert out.columns == ["order_id", "customer_id", "total", "id", "name"] and out.count() == 3
    pair = {
        "l": spark.createDataFrame([(1, "x", 5), (None, "n", 6)], "k int, v string, w int"),
        "r": spark.createDataFrame([(1, "y", 7), (None, "m", 8)], "k int, v string, z int"),
    }
    same = run(pair, SimpleJoin("l", "r", "k", "k"))
    assert same.columns == ["k", "v_x", "w", "v_y", "z"]
    assert rows(same) == [(None, "n", 6, "m", 8), (1, "x", 5, "y", 7)]
    other = run(pair, SimpleJoin("l", "r", "k", "z"))
    assert other.columns == ["k_x", "v_x", "w", "k_y", "v_y", "z"]
    with pytest.raises(ToolError, match="differ in type"):
        run(pair, SimpleJoin("l", "r", "k", "v"))


def test_aggregate(tables):
    spec = AggregateTable("sales", ["channel"], [Metric("revenue", "sum"), Metric("units", "avg", "mean_units")], "sum_revenue")
    out = run(tables, spec)
    assert out.columns == ["channel", "sum_revenue", "mean_units"]
    assert [tuple(r) for r in out.collect()] == [("online", 500.0, 50 / 3), ("store", 500.0, 25.0)]
    with pytest.raises(ToolError, match="sort_by"):
        run(tables, AggregateTable("sales", ["channel"], [Metric("revenue", "sum")], "nope"))
    with pytest.raises(ToolError):
        run(tables, AggregateTable("sales", ["channel"], [Metric("revenue", "mode")]))


def test_aggregate_of_missing_values(spark):
    t = {"t": spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), (None, 5.0)], "k string, v double")}
    metrics = [Metric("v", a) for a in ("count", "sum", "avg", "min", "max", "median")]
    out = run(t, AggregateTable("t", ["k"], metrics))
    assert rows(out) == [("a", 0, 0.0, None, None, None, None), ("b", 1, 2.0, 2.0, 2.0, 2.0, 2.0)]
    assert rows(run(t, AggregateTable("t", [], metrics))) == [(2, 7.0, 3.5, 2.0, 5.0, 3.5)]
    empty = {"t": t["t"].limit(0)}
    assert rows(run(empty, AggregateTable("t", [], metrics))) == [(0, 0.0, None, None, None, None)]


@pytest.mark.parametrize(
    ("period", "expected"),
    [("day", 4), ("week", 3), ("month", 3), ("quarter", 2), ("year", 2)],
)
def test_periods(spark, period, expected):
    days = [dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 7), dt.datetime(2024, 2, 5), dt.datetime(2023, 12, 31), None]
    df = spark.createDataFrame([(d, 1) for d in days], "d timestamp_ntz, n int")
    texts = df.selectExpr("date_format(d, 'MM/dd/yyyy') d", "n")
    for t in (df, texts):
        out = run({"t": t}, AggregateTable("t", ["d"], [Metric("n", "sum")], date_trunc_period=period))
        assert out.count() == expected
        assert out.schema["d"].dataType.simpleString() == "timestamp_ntz"


def test_periods_leave_other_text_and_numbers(spark):
    df = spark.createDataFrame([("a", 2024), ("b", 2025), ("2024-01-05", 2024)], "k string, n int")
    out = run({"t": df}, AggregateTable("t", ["k", "n"], [Metric("n", "count")], date_trunc_period="month"))
    assert rows(out, "k", "n") == [("2024-01-05", 2024), ("a", 2024), ("b", 2025)]


def test_top_n(spark):
    counts = {("USA", "Apple"): 4, ("USA", "Banana"): 2, ("USA", "Kiwi"): 1, ("UK", "Banana"): 4, ("UK", "Apple"): 3}
    long = spark.createDataFrame([k for k, n in counts.items() for _ in range(n)], "country string, product string")
    assert rows(run({"t": long}, TopN("t", "country", "product"))) == [("UK", "Banana", 4), ("USA", "Apple", 4)]
    assert run({"t": long}, TopN("t", "country", "product", 2000)).count() == 5
    wide = spark.createDataFrame([("USA", 4, 2, 0), ("UK", 3, 4, -9), ("UK", 0, 1, None)], "country string, apple int, banana int, kiwi int")
    out = run({"t": wide}, TopNWide("t", "country", ["apple", "banana", "kiwi"]))
    assert rows(out) == [("UK", "banana", 5), ("USA", "apple", 4)]


def test_visual_spec(tables):
    assert rows(run(tables, GenerateVisual("sales", "bar", "channel", "revenue"))) == [("online", 500.0), ("store", 500.0)]
    assert rows(run(tables, GenerateVisual("sales", "bar", "channel", "units", "median"))) == [("online", 15.0), ("store", 25.0)]
    with pytest.raises(ToolError):
        run(tables, GenerateVisual("sales", "radar", "channel"))


def test_sql(tables, spark):
    out = run(tables, SqlQuery("WITH t AS (SELECT channel, sum(units) n FROM sales GROUP BY 1) SELECT * FROM t WHERE n > (SELECT min(units) FROM sales)"))
    assert rows(out) == [("online", 50), ("store", 50)]
    assert rows(run(tables, SqlQuery("select `update` from (select 1 as `update`)"))) == [(1,)]
    assert not spark.catalog.tableExists("sales")


@pytest.mark.parametrize(
    "sql",
    ["DROP TABLE sales", "SELECT 1; SELECT 2", "INSERT INTO sales SELECT * FROM sales", "SET a = b", "CACHE TABLE sales",
     "WITH t AS (SELECT 1) INSERT INTO sales SELECT * FROM t", "DESCRIBE sales", "SELECT * FROM parquet.`/tmp/x`",
     "SELECT * FROM elsewhere", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT nope FROM sales", "SELECT FROM WHERE",
     "SELECT * FROM sales WHERE units IN (SELECT x FROM other.place)", "FROM sales SELECT *", "CREATE VIEW v AS SELECT 1",
     "WITH z AS (WITH hidden AS (SELECT 1 AS q) SELECT * FROM hidden) SELECT * FROM hidden",
     "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS q) SELECT * FROM a", "WITH a AS (SELECT * FROM a) SELECT * FROM a",
     "SELECT (WITH h AS (SELECT 1 AS q) SELECT max(q) FROM h) AS m FROM h",
     "SELECT TRANSFORM(units) USING 'cat' AS (u) FROM sales", "EXPLAIN SELECT 1", "SELECT * FROM VALUES (1) AS v(a) JOIN elsewhere e ON true"],
)
def test_sql_refused(tables, sql):
    with pytest.raises(ToolError):
        run(tables, SqlQuery(sql)).collect()


def test_sql_names_are_known_where_they_are_defined(tables, spark):
    spark.range(42, 43).createOrReplaceTempView("hidden")
    with pytest.raises(ToolError, match="hidden"):
        run(tables, SqlQuery("WITH z AS (WITH hidden AS (SELECT 1 AS q) SELECT * FROM hidden) SELECT * FROM hidden"))
    inner = "WITH z AS (WITH hidden AS (SELECT 1 AS q) SELECT * FROM hidden), y AS (SELECT q + 1 AS q FROM z) SELECT y.q FROM y JOIN z ON y.q > z.q"
    assert rows(run(tables, SqlQuery(inner))) == [(2,)]
    counted = "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT max(n) AS n FROM r"
    assert rows(run(tables, SqlQuery(counted))) == [(4,)]
    spark.catalog.dropTempView("hidden")


def test_sql_of_two_threads(spark):
    def total(k):
        return [run({"t": spark.range(k)}, SqlQuery("SELECT count(*) AS n FROM t")).first()["n"] for _ in range(5)]

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(total, (10, 20, 30, 40))) == [[k] * 5 for k in (10, 20, 30, 40)]
    assert not spark.catalog.tableExists("t")


def test_sql_results_join_with_other_tables(tables, spark):
    out = run(tables, SqlQuery("SELECT channel, sum(units) AS n FROM sales GROUP BY 1"))
    assert out.join(spark.createDataFrame([("online", 1)], "channel string, k int"), "channel").count() == 1
    assert out.sparkSession is spark


def test_sql_keeps_views_of_the_session(tables, spark):
    spark.range(3).createOrReplaceTempView("sales")
    run(tables, SqlQuery("SELECT * FROM sales")).collect()
    assert spark.table("sales").columns == ["id"]
    spark.catalog.dropTempView("sales")


@pytest.mark.parametrize("hot", [None, 7])
def test_join_spreads_a_hot_key(spark, hot):
    """Half of the rows share one key, which may be missing: more than one task joins them."""
    n = 200_000
    key = F.when(F.col("id") % 2 == 0, F.lit(hot).cast("long")).otherwise(F.col("id") + 1_000)
    left = spark.range(n, numPartitions=16).select(key.alias("k"), F.col("id").alias("a"))
    right = spark.range(n).select((F.col("id") + 1_000).alias("k"), F.col("id").alias("b")).unionByName(
        spark.range(2).select(F.lit(hot).cast("long").alias("k"), F.col("id").alias("b")))
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {name: spark.conf.get(name, None) for name in changed}
    try:
        for name, value in changed.items():
            spark.conf.set(name, value)
        joined = run({"l": left, "r": right}, SimpleJoin("l", "r", "k", "k"))
        mine = F.col("a") % 2 == 0
        shared = joined.groupBy(F.spark_partition_id().alias("task")).agg(F.count_if(mine).alias("n")).collect()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    sizes = [r["n"] for r in shared if r["n"]]
    assert sum(sizes) == n  # two partners each
    assert len(sizes) > 2 and max(sizes) < n / 2


@pytest.mark.parametrize(("hot", "sides"), [(None, 1), (7, 1), (7, 2), (None, 2)])
def test_a_hot_key_is_split_without_adaptive_execution(spark, hot, sides):
    """A third of a million rows, or of both sides, under one key that may be missing; copies of rows among them."""
    n = 300_000
    key = F.when(F.col("id") % 3 == 0, F.lit(hot).cast("long")).otherwise(F.col("id") + 1000)
    left = spark.range(n, numPartitions=8).select(key.alias("k"), (F.col("id") % 5).alias("a"))
    right = spark.range(n, numPartitions=8).select((F.col("id") + 1000).alias("k"), F.col("id").alias("b"))
    few = spark.range(40_000 if sides == 2 else 3).select(F.lit(hot).cast("long").alias("k"), F.col("id").alias("b"))
    right = right.filter(F.lit(sides == 1) | (F.col("b") % 4 == 0)).unionByName(few)
    if sides == 2:  # both hot: few enough pairs to count
        left = left.filter((F.col("k") > 1000) | (F.rand(1) < 0.002) if hot else F.col("k").isNotNull() | (F.rand(1) < 0.002))
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name, None) for name in changed}
    try:
        for name, value in changed.items():
            spark.conf.set(name, value)
        out = run({"l": left, "r": right}, SimpleJoin("l", "r", "k", "k", limit=None))
        got = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
        want = left.join(right, left["k"].eqNullSafe(right["k"])).count()
        assert sum(r["count"] for r in got) == want
        assert out.columns == ["k", "a", "b"] and out.groupBy("k", "a", "b").count().agg(F.sum("count")).first()[0] == want
        assert max(r["count"] for r in got) < 0.4 * want and len(got) == 8
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
