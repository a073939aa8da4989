"""Filters, joins, aggregates, top-N, SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright import ToolError, run
from tablewright.functions import nulls
from tablewright.operators.aggregates import aggregate_table
from tablewright.sources.tables import preview
from tablewright.specs import (
    AggregateTable, Filter, FilterTable, Metric, PreviewTable, SimpleJoin, SqlQuery, TopN, TopNWide,
)
from workload.base import money, read, register, rounded, texted

_TS = "'%Y-%m-%d %H:%M:%S'"


def _monthly(spark, sf, period):
    orders = money(read(spark, sf, "orders"), "o_totalprice")
    spec = AggregateTable(
        "orders", ["o_orderdate"],
        [Metric("o_totalprice", "sum", "revenue"), Metric("o_orderkey", "count", "orders")],
        date_trunc_period=period, limit=None,
    )
    return texted(run({"orders": orders}, spec)).withColumn("revenue", F.col("revenue").cast("double"))


def _periods():
    for period in ("day", "week", "month", "quarter", "year"):
        register(f"agg_{period}", f"""
            SELECT strftime(date_trunc('{period}', o_orderdate), {_TS}) AS o_orderdate,
                   CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
                   CAST(count(o_orderkey) AS BIGINT) AS orders
            FROM orders GROUP BY 1 ORDER BY 1""")(lambda spark, sf, p=period: _monthly(spark, sf, p))


_periods()


@register("agg_text_month", """
    SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS day_text,
           o_orderstatus, CAST(count(*) AS BIGINT) AS orders
    FROM orders GROUP BY 1, 2""")
def agg_text_month(spark, sf):
    orders = read(spark, sf, "orders").withColumn("day_text", F.date_format("o_orderdate", "MM/dd/yyyy"))
    spec = AggregateTable(
        "orders", ["day_text", "o_orderstatus"], [Metric("o_orderkey", "count", "orders")],
        date_trunc_period="month", limit=None,
    )
    return texted(run({"orders": orders}, spec))


@register("preview_orders", f"""
    SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, {_TS}) AS o_orderdate
    FROM orders ORDER BY o_orderkey LIMIT 100""")
def preview_orders(spark, sf):
    orders = read(spark, sf, "orders").orderBy("o_orderkey")
    return texted(run({"orders": orders}, PreviewTable("orders", ["o_orderkey", "o_orderstatus", "o_orderdate"])))


@register("preview_table", f"""
    SELECT o_orderkey, o_totalprice, strftime(o_orderdate, {_TS}) AS o_orderdate FROM orders ORDER BY o_orderkey LIMIT 50""")
def preview_table(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").orderBy("o_orderkey")
    return texted(preview({"orders": orders}, "orders", 50))


@register("unknown_columns", """
    SELECT 'Unknown column(s) in ''nation'': [''n_size'']. Available: [''n_nationkey'', ''n_name'', ''n_regionkey'']' AS error,
           CAST(count(*) AS BIGINT) AS rows_kept FROM nation""")
def unknown_columns(spark, sf):
    """What a request for a column that is not there says, beside the rows of one that is."""
    nation = {"nation": read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")}
    try:
        run(nation, FilterTable("nation", [Filter("n_size", "gt", 1)]))
        error = None
    except ToolError as refused:
        error = str(refused)
    return run(nation, FilterTable("nation", [Filter("n_regionkey", "gte", 0)])).agg(F.lit(error).alias("error"), F.count(F.lit(1)).alias("rows_kept"))


_LINE = "l_orderkey, l_linenumber, l_quantity, nullif(l_returnflag, 'N') AS flag"
# name: (column, operator, value, the condition in SQL over the columns above)
_FILTERS = {
    "filter_eq": ("flag", "eq", "A", "flag = 'A'"),
    "filter_ne": ("flag", "ne", "A", "flag IS DISTINCT FROM 'A'"),
    "filter_gt": ("l_quantity", "gt", 40, "l_quantity > 40"),
    "filter_lt": ("l_quantity", "lt", 10, "l_quantity < 10"),
    "filter_gte": ("l_quantity", "gte", 40, "l_quantity >= 40"),
    "filter_lte": ("l_quantity", "lte", "10", "l_quantity <= 10"),
    "filter_in": ("flag", "in", ["A", "R"], "flag IN ('A', 'R')"),
    "filter_not_in": ("flag", "not_in", ["R"], "(flag IS NULL OR flag NOT IN ('R'))"),
    "filter_is_null": ("flag", "is_null", None, "flag IS NULL"),
    "filter_is_not_null": ("flag", "is_not_null", None, "flag IS NOT NULL"),
}


def _filters():
    def build(column, op, value):
        def query(spark, sf):
            line = read(spark, sf, "lineitem").select(
                "l_orderkey", "l_linenumber", "l_quantity",
                F.nullif("l_returnflag", F.lit("N")).alias("flag"),
            )
            return run({"lineitem": line}, FilterTable("lineitem", [Filter(column, op, value)], limit=None))
        return query

    for name, (column, op, value, condition) in _FILTERS.items():
        register(name, f"SELECT * FROM (SELECT {_LINE} FROM lineitem) WHERE {condition}")(build(column, op, value))


_filters()


@register("filter_contains", """
    SELECT c_custkey, c_mktsegment FROM customer
    WHERE regexp_matches(c_name, '0[1-4]7$') AND contains(c_mktsegment, 'U')""")
def filter_contains(spark, sf):
    spec = FilterTable(
        "customer",
        [Filter("c_name", "contains", "0[1-4]7$"), Filter("c_mktsegment", "contains", "U")],
        ["c_custkey", "c_mktsegment"], limit=None,
    )
    return run({"customer": read(spark, sf, "customer")}, spec)


@register("filter_sort_limit", f"""
    SELECT o_orderkey, o_totalprice, strftime(o_orderdate, {_TS}) AS o_orderdate FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice >= 1000
    ORDER BY o_orderdate DESC, o_orderkey, o_totalprice LIMIT 500""")
def filter_sort_limit(spark, sf):
    spec = FilterTable(
        "orders", [Filter("o_orderstatus", "eq", "F"), Filter("o_totalprice", "gte", 1000)],
        ["o_orderkey", "o_totalprice", "o_orderdate"], "o_orderdate", True, limit=500,
    )
    return texted(run({"orders": read(spark, sf, "orders")}, spec))


@register("join_orders_customer", """
    SELECT o_orderkey, o_totalprice, c_name, c_mktsegment
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_orders_customer(spark, sf):
    tables = {"orders": read(spark, sf, "orders"), "customer": read(spark, sf, "customer")}
    return run(tables, SimpleJoin(
        "orders", "customer", "o_custkey", "c_custkey",
        ["o_orderkey", "o_totalprice", "c_name", "c_mktsegment"], None,
    ))


@register("join_null_keys", """
    SELECT c_custkey, n_name
    FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) c
    JOIN (SELECT n_name, nullif(n_nationkey, 3) AS k FROM nation) n ON c.k IS NOT DISTINCT FROM n.k""")
def join_null_keys(spark, sf):
    tables = {
        "customer": read(spark, sf, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k")),
        "nation": read(spark, sf, "nation").select("n_name", F.nullif("n_nationkey", F.lit(3)).alias("k")),
    }
    return run(tables, SimpleJoin("customer", "nation", "k", "k", ["c_custkey", "n_name"], None))


@register("join_suffix", """
    SELECT o_custkey AS custkey, o_orderpriority AS label_x, o_orderkey AS id, c_mktsegment AS label_y
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_suffix(spark, sf):
    tables = {
        "left": read(spark, sf, "orders").select(
            F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("id")
        ),
        "right": read(spark, sf, "customer").select(
            F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("label")
        ),
    }
    return run(tables, SimpleJoin("left", "right", "custkey", "custkey", limit=None))


_AGGREGATES = {
    "count": "CAST(count(l_quantity) AS BIGINT)",
    "sum": "coalesce(sum(l_quantity), 0)",
    "avg": "round(avg(l_quantity), 6)",
    "min": "min(l_quantity)",
    "max": "max(l_quantity)",
    "median": "median(l_quantity)",
}


def _aggregates():
    def build(name):
        def query(spark, sf):
            spec = AggregateTable("lineitem", ["l_returnflag"], [Metric("l_quantity", name, "v")], limit=None)
            out = aggregate_table({"lineitem": read(spark, sf, "lineitem")}, spec, gathered=20)
            return out.select("l_returnflag", rounded("v")) if name == "avg" else out
        return query

    for name, sql in _AGGREGATES.items():
        register(f"agg_{name}", f"SELECT l_returnflag, {sql} AS v FROM lineitem GROUP BY 1")(build(name))


_aggregates()


@register("agg_median_prices", """
    SELECT l_suppkey, median(l_extendedprice) AS price, median(l_discount) AS discount,
           CAST(count(l_orderkey) AS BIGINT) AS n
    FROM lineitem GROUP BY 1""")
def agg_median_prices(spark, sf):
    spec = AggregateTable(
        "lineitem", ["l_suppkey"],
        [Metric("l_extendedprice", "median", "price"), Metric("l_discount", "median", "discount"),
         Metric("l_orderkey", "count", "n")], limit=None,
    )
    return aggregate_table({"lineitem": read(spark, sf, "lineitem")}, spec)


@register("agg_median_global", "SELECT median(o_totalprice) AS median_price, max(o_totalprice) AS max_price FROM orders")
def agg_median_global(spark, sf):
    spec = AggregateTable(
        "orders", [], [Metric("o_totalprice", "median", "median_price"), Metric("o_totalprice", "max", "max_price")]
    )
    return aggregate_table({"orders": read(spark, sf, "orders")}, spec)


@register("agg_median_approx")
def agg_median_approx(spark, sf):
    spec = AggregateTable("lineitem", ["l_returnflag"], [Metric("l_extendedprice", "median", "price", approx=True)])
    return run({"lineitem": read(spark, sf, "lineitem")}, spec)


@register("agg_multi_key", """
    SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
           CAST(count(l_orderkey) AS BIGINT) AS lines, max(l_discount) AS max_discount
    FROM lineitem GROUP BY 1, 2""")
def agg_multi_key(spark, sf):
    spec = AggregateTable(
        "lineitem", ["l_returnflag", "l_linestatus"],
        [Metric("l_extendedprice", "sum", "price"), Metric("l_orderkey", "count", "lines"),
         Metric("l_discount", "max", "max_discount")],
        sort_by="price",
    )
    out = run({"lineitem": money(read(spark, sf, "lineitem"), "l_extendedprice")}, spec)
    return out.withColumn("price", F.col("price").cast("double"))


@register("agg_global", """
    SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
           CAST(count(l_orderkey) AS BIGINT) AS count_l_orderkey, min(l_quantity) AS min_l_quantity
    FROM lineitem""")
def agg_global(spark, sf):
    spec = AggregateTable(
        "lineitem", [],
        [Metric("l_extendedprice", "sum", "price"), Metric("l_orderkey", "count"), Metric("l_quantity", "min")],
    )
    out = run({"lineitem": money(read(spark, sf, "lineitem"), "l_extendedprice")}, spec)
    return out.withColumn("price", F.col("price").cast("double"))


@register("agg_all_null_group", """
    SELECT flag, coalesce(sum(q), 0) AS total, CAST(count(q) AS BIGINT) AS n, avg(q) AS mean, median(q) AS middle
    FROM (SELECT nullif(l_returnflag, 'N') AS flag,
                 CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS q FROM lineitem)
    WHERE flag IS NOT NULL GROUP BY 1""")
def agg_all_null_group(spark, sf):
    line = read(spark, sf, "lineitem").select(
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("q"),
    )
    spec = AggregateTable(
        "lineitem", ["flag"],
        [Metric("q", "sum", "total"), Metric("q", "count", "n"), Metric("q", "avg", "mean"), Metric("q", "median", "middle")],
    )
    return aggregate_table({"lineitem": line}, spec, gathered=20)


@register("topn_long", """
    WITH c AS (SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS purchase_frequency FROM events GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY purchase_frequency DESC, event_type) AS rn FROM c)
    SELECT user_id, event_type, purchase_frequency FROM r WHERE rn <= 2""")
def topn_long(spark, sf):
    return run({"events": read(spark, sf, "events")}, TopN("events", "user_id", "event_type", 2))


@register("topn_large", """
    WITH c AS (SELECT l_returnflag, l_partkey, CAST(count(*) AS BIGINT) AS purchase_frequency FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY purchase_frequency DESC, l_partkey) AS rn FROM c)
    SELECT l_returnflag, l_partkey, purchase_frequency FROM r WHERE rn <= 1200""")
def topn_large(spark, sf):
    return run({"lineitem": read(spark, sf, "lineitem")}, TopN("lineitem", "l_returnflag", "l_partkey", 1200))


@register("topn_wide", """
    WITH u AS (
        SELECT l_suppkey, 'qty_a' AS product_name, l_quantity AS q FROM lineitem WHERE l_returnflag = 'A' UNION ALL
        SELECT l_suppkey, 'qty_n', l_quantity FROM lineitem WHERE l_returnflag = 'N' UNION ALL
        SELECT l_suppkey, 'qty_r', l_quantity FROM lineitem WHERE l_returnflag = 'R'),
    s AS (SELECT l_suppkey, product_name, sum(q) AS purchase_frequency FROM u WHERE q > 0 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY purchase_frequency DESC, product_name) AS rn FROM s)
    SELECT l_suppkey, product_name, purchase_frequency FROM r WHERE rn <= 2""")
def topn_wide(spark, sf):
    line = read(spark, sf, "lineitem").select(
        "l_suppkey",
        *[F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0).alias(f"qty_{f.lower()}") for f in "ANR"],
    )
    return run({"lineitem": line}, TopNWide("lineitem", "l_suppkey", ["qty_a", "qty_n", "qty_r"], 2))


_SQL = """
    WITH spend AS (
        SELECT c_mktsegment, c_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY total DESC, c_custkey) AS place FROM spend
    )
    SELECT c_mktsegment, c_custkey, total, CAST(place AS INTEGER) AS place
    FROM ranked WHERE place <= 5 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'X')"""


@register("sql_readonly", _SQL)
def sql_readonly(spark, sf):
    tables = {n: read(spark, sf, n) for n in ("orders", "customer")}
    return run(tables, SqlQuery(_SQL))


@register("nan_to_null", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem""")
def nan_to_null(spark, sf):
    line = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_quantity") < 10, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("l_quantity"),
    )
    return nulls.without_nan(line)
