"""Derived columns and tables, orders over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright import apply_features
from tablewright.operators import aggregates, features, ordering
from tablewright.specs import Feature
from workload.base import money, read, register, rounded

_KEYS = ["l_orderkey", "l_linenumber", "l_quantity"]


@register("feature_ratio", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice / nullif(l_quantity - 10, 0) AS unit
    FROM lineitem""")
def feature_ratio(spark, sf):
    line = read(spark, sf, "lineitem").withColumn("less", F.col("l_quantity") - 10)
    return features.ratio(line, "l_extendedprice", "less", "unit").select(*_KEYS, "unit")


_ARITHMETIC = {"add": "+", "sub": "-", "mul": "*"}


def _arithmetic():
    def build(op):
        return lambda spark, sf: features.arithmetic(
            read(spark, sf, "lineitem"), "l_extendedprice", "l_tax", op, "r"
        ).select(*_KEYS, "r")

    for name, op in _ARITHMETIC.items():
        register(f"feature_{name}", f"SELECT {', '.join(_KEYS)}, l_extendedprice {op} l_tax AS r FROM lineitem")(build(op))
    register("feature_div", f"SELECT {', '.join(_KEYS)}, l_extendedprice / nullif(l_tax, 0) AS r FROM lineitem")(build("/"))


_arithmetic()


@register("feature_date_parts", """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
           CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
           CAST(week(o_orderdate) AS INTEGER) AS o_orderdate_week,
           CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_weekday,
           CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day
    FROM orders""")
def feature_date_parts(spark, sf):
    parts = ["year", "month", "week", "weekday", "day"]
    out = features.date_parts(read(spark, sf, "orders"), "o_orderdate", parts)
    return out.select("o_orderkey", *[f"o_orderdate_{p}" for p in parts])


@register("feature_bucket_edges", """
    SELECT l_orderkey, l_linenumber, l_quantity,
           CASE WHEN l_quantity > 1 AND l_quantity <= 10 THEN 'low'
                WHEN l_quantity > 10 AND l_quantity <= 25 THEN 'medium'
                WHEN l_quantity > 25 AND l_quantity <= 45 THEN 'high' END AS band
    FROM lineitem""")
def feature_bucket_edges(spark, sf):
    out = features.bucketize(read(spark, sf, "lineitem"), "l_quantity", [1, 10, 25, 45], ["low", "medium", "high"], "band")
    return out.select(*_KEYS, "band")


@register("feature_bucket_count", """
    WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
    SELECT p_partkey,
           CASE WHEN p_retailprice <= lo + (hi - lo) * 1 / 5 THEN 'b1'
                WHEN p_retailprice <= lo + (hi - lo) * 2 / 5 THEN 'b2'
                WHEN p_retailprice <= lo + (hi - lo) * 3 / 5 THEN 'b3'
                WHEN p_retailprice <= lo + (hi - lo) * 4 / 5 THEN 'b4' ELSE 'b5' END AS p_retailprice_bucket
    FROM part, b""")
def feature_bucket_count(spark, sf):
    out = features.bucketize(read(spark, sf, "part"), "p_retailprice", 5, ["b1", "b2", "b3", "b4", "b5"])
    return out.select("p_partkey", "p_retailprice_bucket")


@register("feature_aggregate", """
    SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS o_totalprice_sum
    FROM orders GROUP BY 1""")
def feature_aggregate(spark, sf):
    feature = Feature("by_status", "aggregate", "orders", ("o_orderstatus", "o_totalprice"),
                      {"value_column": "o_totalprice", "group_by": "o_orderstatus"})
    run = apply_features({"orders": money(read(spark, sf, "orders"), "o_totalprice")}, [feature])
    out = run.new_tables["o_orderstatus_o_totalprice_agg"]
    return out.withColumn("o_totalprice_sum", F.col("o_totalprice_sum").cast("double"))


_NAMED = {
    "mean": "round(avg(l_quantity), 6)",
    "min": "min(l_quantity)",
    "max": "max(l_quantity)",
    "count": "CAST(count(l_quantity) AS BIGINT)",
    "median": "median(l_quantity)",
    "std": "round(stddev_samp(l_quantity), 6)",
    "var": "round(var_samp(l_quantity), 6)",
    "nunique": "CAST(count(DISTINCT l_quantity) AS BIGINT)",
    "first": "arg_min(l_quantity, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber)",
    "last": "arg_max(l_quantity, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber)",
}


def _named():
    def build(name):
        def query(spark, sf):
            place = F.struct("l_orderkey", "l_partkey", "l_linenumber")
            line = read(spark, sf, "lineitem").withColumn("place", place)
            out = aggregates.aggregate_named(line, "l_quantity", "l_suppkey", name, "v", "place", gathered=10)
            return out.select("l_suppkey", rounded("v")) if name in ("mean", "std", "var") else out
        return query

    for name, sql in _NAMED.items():
        if name in ("first", "last"):
            sql = f"(list(l_quantity ORDER BY l_orderkey, l_partkey, l_linenumber))[{1 if name == 'first' else -1}]"
        register(f"feature_agg_{name}", f"SELECT l_suppkey, {sql} AS v FROM lineitem GROUP BY 1")(build(name))


_named()


@register("feature_arpu", """
    SELECT round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT o_custkey), 6) AS arpu FROM orders""")
def feature_arpu(spark, sf):
    feature = Feature("arpu", "ratio", "orders", ("o_totalprice", "o_custkey"),
                      {"numerator": "o_totalprice", "denominator_distinct": "o_custkey"}, output_column="arpu")
    run = apply_features({"orders": money(read(spark, sf, "orders"), "o_totalprice")}, [feature])
    return run.new_tables["orders_arpu"].select(rounded("arpu"))


@register("feature_arpu_by_status", """
    SELECT o_orderstatus, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT o_custkey), 6) AS arpu
    FROM orders GROUP BY 1""")
def feature_arpu_by_status(spark, sf):
    orders = money(read(spark, sf, "orders"), "o_totalprice")
    out = aggregates.sum_per_distinct(orders, "o_totalprice", "o_custkey", "arpu", ["o_orderstatus"])
    return out.select("o_orderstatus", rounded("arpu"))


_PRICE = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END"


def _gappy_orders(spark, sf):
    """Every seventh order without a price."""
    return money(read(spark, sf, "orders"), "o_totalprice").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    )


@register("running_total", f"""
    SELECT o_orderkey, CASE WHEN p IS NOT NULL THEN
           CAST(sum(p) OVER (ORDER BY o_orderdate, o_orderkey) AS DOUBLE) END AS running
    FROM (SELECT *, {_PRICE} AS p FROM orders)""")
def running_total(spark, sf):
    out = ordering.running_total(
        _gappy_orders(spark, sf), "o_totalprice", "o_orderdate", "running", tie=["o_orderkey"], rows_per_range=5000
    )
    return out.select("o_orderkey", F.col("running").cast("double").alias("running"))


@register("running_total_by", f"""
    SELECT o_orderkey, CASE WHEN p IS NOT NULL AND s IS NOT NULL THEN
           CAST(sum(p) OVER (PARTITION BY s ORDER BY o_orderdate, o_orderkey) AS DOUBLE) END AS running
    FROM (SELECT *, {_PRICE} AS p, nullif(o_orderstatus, 'P') AS s FROM orders)""")
def running_total_by(spark, sf):
    orders = _gappy_orders(spark, sf).withColumn("s", F.nullif("o_orderstatus", F.lit("P")))
    out = ordering.running_total(
        orders, "o_totalprice", "o_orderdate", "running", "s", tie=["o_orderkey"], rows_per_range=5000
    )
    return out.select("o_orderkey", F.col("running").cast("double").alias("running"))


@register("running_count_of_copies", """
    SELECT o_orderstatus, n, CAST(count(*) AS BIGINT) AS rows_with_n FROM (
        SELECT o_orderstatus, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS n
        FROM (SELECT o_orderstatus, o_orderpriority FROM orders))
    GROUP BY 1, 2""")
def running_count_of_copies(spark, sf):
    """Running sums when a few distinct rows make up the whole table."""
    pairs = read(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    out = ordering.prefix_sums(
        pairs, ["o_orderpriority"], {"n": F.lit(1).cast("bigint")}, ["o_orderstatus"], rows_per_range=1000
    )
    return out.groupBy("o_orderstatus", "n").agg(F.count(F.lit(1)).alias("rows_with_n"))


@register("row_numbers", """
    SELECT event_id, CAST(row_number() OVER (ORDER BY value, event_id) AS BIGINT) AS n FROM events""")
def row_numbers(spark, sf):
    out = ordering.row_numbers(read(spark, sf, "events"), ["value"], "n", tie=["event_id"], rows_per_range=4000)
    return out.select("event_id", "n")


@register("row_numbers_by_text", """
    SELECT doc_id, CAST(row_number() OVER (ORDER BY text, doc_id) AS BIGINT) AS n FROM documents""")
def row_numbers_by_text(spark, sf):
    """Texts of any length as order: cuts in two levels, found in Spark."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return ordering.row_numbers(docs, ["text"], "n", tie=["doc_id"], rows_per_range=3).select("doc_id", "n")


@register("period_change", """
    SELECT o_orderkey, round((o_totalprice - p) / nullif(p, 0), 6) AS change FROM (
        SELECT *, lag(o_totalprice, 3) OVER (ORDER BY o_orderdate, o_orderkey) AS p FROM orders)""")
def period_change(spark, sf):
    out = features.period_change(
        read(spark, sf, "orders"), "o_totalprice", "o_orderdate", 3, "change", ["o_orderkey"], rows_per_range=5000
    )
    return out.select("o_orderkey", rounded("change"))


@register("period_change_filled", """
    WITH g AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS v FROM orders),
    f AS (SELECT *, last_value(v IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey) AS w FROM g),
    l AS (SELECT *, lag(w) OVER (ORDER BY o_orderdate, o_orderkey) AS p FROM f)
    SELECT o_orderkey, round((w - p) / nullif(p, 0), 6) AS change FROM l""")
def period_change_filled(spark, sf):
    gappy = read(spark, sf, "orders").withColumn("v", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    out = features.period_change(gappy, "v", "o_orderdate", 1, "change", ["o_orderkey"], True, rows_per_range=5000)
    return out.select("o_orderkey", rounded("change"))


@register("feature_batch", """
    SELECT o_orderkey, o_totalprice / nullif(o_custkey, 0) AS per_customer,
           CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, o_totalprice / nullif(o_custkey, 0) + o_totalprice AS both
    FROM orders""")
def feature_batch(spark, sf):
    batch = [
        Feature("per_customer", "ratio", "orders", ("o_totalprice", "o_custkey"),
                {"numerator": "o_totalprice", "denominator": "o_custkey"}, "per_customer"),
        Feature("refused", "custom_formula", "orders"),
        Feature("year", "date_extract", "orders", ("o_orderdate",), {"source_column": "o_orderdate", "parts": ["year"]}),
        Feature("lost", "ratio", "nowhere", (), {"numerator": "a", "denominator": "b"}),
        Feature("both", "arithmetic", "orders", ("per_customer",),
                {"left": "per_customer", "right": "o_totalprice", "operator": "+"}, "both"),
    ]
    run = apply_features({"orders": read(spark, sf, "orders")}, batch)
    return run.tables["orders"].select("o_orderkey", "per_customer", "o_orderdate_year", "both")
