"""Cleaning operations and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright import apply_cleaning
from tablewright.operators import cleaning
from tablewright.specs import CleaningStep
from workload.base import read, register, texted


@register("clean_drop", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def clean_drop(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    return cleaning.drop_rows(orders, "o_orderstatus")


@register("clean_fill", """
    SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'Unknown') AS o_orderstatus, coalesce(nullif(o_custkey, 5), 0) AS o_custkey
    FROM orders""")
def clean_fill(spark, sf):
    orders = read(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.nullif("o_custkey", F.lit(5)).alias("o_custkey")
    )
    return cleaning.fill_missing(cleaning.fill_missing(orders, "o_orderstatus"), "o_custkey", 0)


@register("clean_dedup", "SELECT DISTINCT text, lang, source, n_chars FROM documents")
def clean_dedup(spark, sf):
    return cleaning.deduplicate(read(spark, sf, "documents").drop("doc_id"))


@register("clean_strip", r"""
    SELECT c_custkey, c_mktsegment, c_name FROM customer""")
def clean_strip(spark, sf):
    padded = read(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment",
        F.concat(F.lit(" \t"), "c_name", F.when(F.col("c_custkey") % 2 == 0, " \n").otherwise("")).alias("c_name"),
    )
    return cleaning.strip_whitespace(padded, "c_name")


@register("clean_cast", """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE value END AS value FROM events""")
def clean_cast(spark, sf):
    text = (
        F.when(F.col("event_id") % 5 == 0, "not a number")
        .when(F.col("event_id") % 5 == 1, "12d")
        .otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    )
    return cleaning.cast_number(read(spark, sf, "events").select("event_id", text.alias("value")), "value")


_SPELLINGS = ["yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy", "yyyyMMdd", "d MMM yyyy", "MM-dd-yyyy"]


@register("clean_dates", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS day FROM orders""")
def clean_dates(spark, sf):
    text = F.lit("soon")
    for i, spelling in enumerate(_SPELLINGS):
        text = F.when(F.col("o_orderkey") % 7 == i, F.date_format("o_orderdate", spelling)).otherwise(text)
    return texted(cleaning.parse_dates(read(spark, sf, "orders").select("o_orderkey", text.alias("day")), "day"))


@register("clean_map", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus
    FROM orders""")
def clean_map(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return cleaning.normalize_format(orders, "o_orderstatus", {"F": "finished", "O": "open"})


@register("clean_map_large", """
    SELECT c_custkey, CASE WHEN CAST(right(c_name, 3) AS INTEGER) < 400 THEN 'group ' || right(c_name, 3) ELSE right(c_name, 3) END AS code
    FROM customer""")
def clean_map_large(spark, sf):
    customer = read(spark, sf, "customer").select("c_custkey", F.right("c_name", F.lit(3)).alias("code"))
    return cleaning.normalize_format(customer, "code", {f"{i:03d}": f"group {i:03d}" for i in range(400)})


@register("clean_replace", "SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 0 ELSE o_custkey END AS o_custkey FROM orders")
def clean_replace(spark, sf):
    return cleaning.replace_value(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 7, 0)


@register("clean_drop_rename", "SELECT r_regionkey AS region_id FROM region")
def clean_drop_rename(spark, sf):
    return cleaning.rename_column(cleaning.drop_column(read(spark, sf, "region"), "r_name"), "r_regionkey", "region_id")


@register("clean_clip", """
    WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM part)
    SELECT p_partkey, round(greatest(a - 0.1 * (b - a), least(b + 0.1 * (b - a), p_retailprice)), 6) AS p_retailprice FROM part, q""")
def clean_clip(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", "p_retailprice")
    out = cleaning.clip_outlier(part, "p_retailprice", factor=0.1)
    return out.withColumn("p_retailprice", F.round("p_retailprice", 6))


def _dirty_orders(spark, sf):
    """Orders as they might come in: padded, incomplete, urgent ones twice."""
    orders = read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.concat(F.lit(" "), "o_orderstatus").alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    return orders.unionByName(orders.filter(F.col("urgent"))).drop("urgent")


_STEPS = [
    CleaningStep("orders", "strip_whitespace", "o_orderstatus", step_id="s1"),
    CleaningStep("orders", "deduplicate", step_id="s2"),
    CleaningStep("orders", "drop_rows", "o_custkey", step_id="s3"),
    CleaningStep("orders", "fill_missing", "o_orderpriority", {"fill_value": "Unknown"}, step_id="s4"),
    CleaningStep("orders", "normalize_format", "o_orderstatus", {"mapping": {"F": "finished"}}, "rejected", "s5"),
    CleaningStep("orders", "ignore_issue", "o_orderstatus", step_id="s6"),
    CleaningStep("returns", "deduplicate", step_id="s7"),
]


@register("clean_batch", """
    SELECT o_orderkey, o_custkey, o_orderstatus,
           CASE WHEN o_orderkey % 13 = 0 THEN 'Unknown' ELSE o_orderpriority END AS o_orderpriority
    FROM orders WHERE o_orderkey % 11 <> 0""")
def clean_batch(spark, sf):
    return apply_cleaning({"orders": _dirty_orders(spark, sf)}, _STEPS).tables["orders"]


_COUNTS_SQL = """
    n AS (SELECT count(*) AS once, count(*) FILTER (o_orderpriority = '1-URGENT') AS twice,
                 count(*) FILTER (o_orderkey % 11 = 0) AS gone,
                 count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0) AS filled FROM orders)"""


@register("clean_metrics", f"""
    WITH {_COUNTS_SQL}
    SELECT CAST(i AS INTEGER) AS sequence, 's' || i AS step_id, status, CAST(b AS BIGINT) AS rows_before,
           CAST(a AS BIGINT) AS rows_after, CAST(b - a AS BIGINT) AS rows_removed, CAST(c AS BIGINT) AS rows_changed
    FROM (
        SELECT 1 AS i, 'success' AS status, once + twice AS b, once + twice AS a, once + twice AS c FROM n UNION ALL
        SELECT 2, 'success', once + twice, once, 0 FROM n UNION ALL
        SELECT 3, 'success', once, once - gone, 0 FROM n UNION ALL
        SELECT 4, 'success', once - gone, once - gone, filled FROM n UNION ALL
        SELECT 5, 'skipped', once - gone, once - gone, 0 FROM n UNION ALL
        SELECT 6, 'skipped', once - gone, once - gone, 0 FROM n UNION ALL
        SELECT 7, 'failed', 0, 0, 0 FROM n)""")
def clean_metrics(spark, sf):
    run = apply_cleaning({"orders": _dirty_orders(spark, sf)}, _STEPS, stage_deduplicated=True)
    return run.metrics().select(
        "sequence", "step_id", "status", "rows_before", "rows_after", "rows_removed", "rows_changed"
    )


@register("clean_summary", f"""
    WITH {_COUNTS_SQL}
    SELECT CAST(7 AS BIGINT) AS total_steps, CAST(4 AS BIGINT) AS executed_steps, CAST(2 AS BIGINT) AS skipped_steps,
           CAST(1 AS BIGINT) AS failed_steps,
           CAST(2 * (once + twice) + once + 3 * (once - gone) AS BIGINT) AS rows_before,
           CAST(once - gone AS BIGINT) AS rows_after, CAST(twice + gone AS BIGINT) AS rows_removed,
           'o_orderstatus,o_custkey,o_orderpriority' AS columns_changed
    FROM n""")
def clean_summary(spark, sf):
    run = apply_cleaning({"orders": _dirty_orders(spark, sf)}, _STEPS, stage_deduplicated=True)
    return run.summary().withColumn("columns_changed", F.concat_ws(",", "columns_changed"))
