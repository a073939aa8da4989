"""Profiles, issues, proposals and chart data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright import Dataset, chart_data, profile_table, profile_tables, run, suggest_charts, suggest_cleaning, suggest_features
from tablewright.operators import charts
from tablewright.operators.aggregates import duplicate_count
from tablewright.operators.profiling import likely_columns
from tablewright.plans import chart_plan, cleaning_plan, feature_plan
from tablewright.specs import Chart, GenerateVisual
from workload.base import money, read, register, scratch, texted

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_COLUMNS = (
    "column_name", "data_type", "total_count", "null_count", "null_percent", "unique_count",
    "unique_percent", "top_values", "num_min", "num_max", "num_mean", "num_median", "num_std",
    "num_q1", "num_q3", "min_date", "max_date", "unique_dates",
    "is_likely_id", "is_likely_metric", "is_likely_categorical", "is_likely_date",
)


def _comparable(profile: DataFrame) -> DataFrame:
    shown = {
        "top_values": F.concat_ws("|", "top_values"),
        "min_date": F.col("min_date").cast("string"),
        "max_date": F.col("max_date").cast("string"),
        **{n: F.round(n, 3) for n in ("num_mean", "num_std")},
        **{n: F.round(n, 5) for n in ("num_median", "num_q1", "num_q3")},
    }
    return profile.select(*[shown.get(n, F.col(n)).alias(n) for n in _COLUMNS])


def _has(column: str, words: str) -> str:
    return "(" + " OR ".join(f"contains(lower('{column}'), '{w}')" for w in words.split()) + ")"


_METRIC = "revenue sales amount price cost spend orders quantity users count profit margin"
_CATEGORY = "country region channel campaign product status segment category type tier"
_DATE = "date time created_at updated_at timestamp created updated at"


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    """One SELECT per column; `columns` maps names to integer, float, text, time or day_text."""
    return " UNION ALL ".join(_column_sql(table, name, kind) for name, kind in columns.items())


def _column_sql(table: str, c: str, kind: str) -> str:
    label = {
        "integer": "'integer'", "float": "'float'", "time": "'datetime'", "day_text": "'date'",
        "text": f"""CASE WHEN count({c}) = 0 THEN 'unknown'
                    WHEN count(DISTINCT {c}) <= 15 OR count(DISTINCT {c}) <= 0.05 * count(*) THEN 'categorical' ELSE 'string' END""",
    }[kind]
    number, time = kind in ("integer", "float"), kind in ("time", "day_text")
    shown = f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if kind == "time" else f"CAST({c} AS VARCHAR)"
    num = lambda e, k=3: f"CAST(round({e}, {k}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    raw = lambda e: f"CAST({e} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    day = lambda e: f"trim({e})" if kind == "day_text" else f"strftime({e}, '%Y-%m-%d')" if time else "CAST(NULL AS VARCHAR)"
    metric = f"{number} AND {_has(c, _METRIC)}"
    return f"""
    SELECT '{c}' AS column_name, {label} AS data_type, CAST(count(*) AS BIGINT) AS total_count,
           CAST(count(*) - count({c}) AS BIGINT) AS null_count,
           round((count(*) - count({c})) / count(*) * 100, 2) AS null_percent,
           CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count,
           round(count(DISTINCT {c}) / count(*) * 100, 2) AS unique_percent,
           (SELECT string_agg(v, '|' ORDER BY n DESC, v) FROM (
                SELECT {shown} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL
                GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) AS top_values,
           {raw(f"min({c})")} AS num_min, {raw(f"max({c})")} AS num_max, {num(f"avg({c})")} AS num_mean,
           {num(f"median({c})", 5)} AS num_median, {num(f"stddev_samp({c})")} AS num_std,
           {num(f"quantile_cont({c}, 0.25)", 5)} AS num_q1, {num(f"quantile_cont({c}, 0.75)", 5)} AS num_q3,
           {day(f"min({c})")} AS min_date, {day(f"max({c})")} AS max_date,
           {f"CAST(count(DISTINCT {c}) AS BIGINT)" if time else "CAST(NULL AS BIGINT)"} AS unique_dates,
           contains('{c}', 'id') OR (round(count(DISTINCT {c}) / count(*) * 100, 2) >= 90 AND NOT ({metric})) AS is_likely_id,
           {metric} AS is_likely_metric,
           ({label}) = 'categorical' OR {_has(c, _CATEGORY)} AS is_likely_categorical,
           {time} OR {_has(c, _DATE)} AS is_likely_date
    FROM {table}"""


_PROFILED = {
    "orders": {
        "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "text", "o_totalprice": "float",
        "o_orderdate": "time", "o_orderpriority": "text",
    },
    "customer": {
        "c_custkey": "integer", "c_name": "text", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "text",
    },
    "documents": {"doc_id": "integer", "text": "text", "lang": "text", "source": "text", "n_chars": "integer"},
    "events": {"event_id": "integer", "ts": "time", "user_id": "integer", "event_type": "text", "value": "float", "props": "text"},
    "lineitem": {
        "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
        "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
        "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time",
    },
}


def _profiles():
    def build(table, columns):
        def query(spark, sf):
            df = read(spark, sf, table)
            if table == "events":
                df = df.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
            return _comparable(profile_table(df.select(*columns), table, duplicates=False).columns)
        return query

    for table, columns in _PROFILED.items():
        source = "(SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events)" if table == "events" else table
        register(f"profile_{table}", _profile_sql(source, columns))(build(table, columns))


_profiles()


_LONG_SQL = """(SELECT repeat(' ', 70) || strftime(o_orderdate, '%Y-%m-%d') AS day_text, repeat('same start ', 9) || o_clerk AS remark
                FROM (SELECT *, 'clerk ' || CAST(o_custkey % 40 AS VARCHAR) AS o_clerk FROM orders)) AS long_texts"""


@register("profile_long_texts", _profile_sql(_LONG_SQL, {"day_text": "day_text", "remark": "text"}))
def profile_long_texts(spark, sf):
    """Dates behind 70 blanks, and long texts that only differ behind the place where keys end."""
    long = read(spark, sf, "orders").select(
        F.concat(F.lit(" " * 70), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day_text"),
        F.concat(F.lit("same start " * 9 + "clerk "), (F.col("o_custkey") % 40).cast("string")).alias("remark"))
    return _comparable(profile_table(long, "long_texts", duplicates=False).columns)


@register("profile_approx")
def profile_approx(spark, sf):
    return _comparable(profile_table(read(spark, sf, "lineitem"), "lineitem", duplicates=False, approx=True).columns)


@register("profile_of_added_rows", """
    SELECT c AS column_name, CAST(count(*) AS BIGINT) AS total_count, CAST(0 AS BIGINT) AS null_count,
           CAST(min(x) AS DOUBLE) AS num_min, CAST(max(x) AS DOUBLE) AS num_max, round(avg(x), 3) AS num_mean,
           round(stddev_samp(x), 3) AS num_std, true AS distinct_within, true AS median_within
    FROM (SELECT 'o_orderkey' AS c, CAST(o_orderkey AS DOUBLE) AS x FROM orders UNION ALL
          SELECT 'o_custkey', o_custkey FROM orders UNION ALL SELECT 'o_totalprice', o_totalprice FROM orders) GROUP BY c""")
def profile_of_added_rows(spark, sf):
    """A version in two parts, profiled from merged sketches; estimates within 3 % of the distinct values and 2 % of the ranks."""
    numbers = ("o_orderkey", "o_custkey", "o_totalprice")
    orders = read(spark, sf, "orders")
    data = Dataset(spark, scratch(spark, "dataset"))
    data.write({"orders": orders.filter("o_orderkey % 4 <> 0")})
    data.sketch()
    data.extend({"orders": orders.filter("o_orderkey % 4 = 0")})
    found = data.sketched_profile().filter(F.col("column_name").isin(*numbers))
    exact = profile_table(orders, "orders", duplicates=False).columns.select("column_name", F.col("unique_count").alias("exact"))
    median = {r["column_name"]: r["num_median"] for r in found.collect()}
    ranks = orders.agg(*[F.avg((F.col(n) <= median[n]).cast("int")).alias(n) for n in numbers]).first().asDict()
    rank = F.create_map(*[F.lit(v) for n in numbers for v in (n, ranks[n])])[F.col("column_name")]
    return found.join(exact, "column_name").select(
        "column_name", "total_count", "null_count", "num_min", "num_max", F.round("num_mean", 3).alias("num_mean"), F.round("num_std", 3).alias("num_std"),
        (F.abs(F.col("unique_count") - F.col("exact")) <= 0.03 * F.col("exact")).alias("distinct_within"),
        (F.abs(rank - 0.5) <= 0.02).alias("median_within"))


@register("profile_samples", f"""
    SELECT c AS column_name, string_agg(v, '|' ORDER BY n DESC, v) AS sample_values FROM (
        SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS k FROM (
            {" UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM customer WHERE {c} IS NOT NULL GROUP BY 2" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))}))
    WHERE k <= 3 GROUP BY 1""")
def profile_samples(spark, sf):
    customer = read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return profile_table(customer, "customer", duplicates=False).columns.select("column_name", F.concat_ws("|", "sample_values").alias("sample_values"))


@register("likely_columns_orders", """
    SELECT 'orders' AS table_name, CAST(count(*) AS BIGINT) AS row_count, CAST(6 AS BIGINT) AS column_count,
           'o_orderkey' || CASE WHEN round(count(DISTINCT o_custkey) / count(*) * 100, 2) >= 90 THEN ',o_custkey' ELSE '' END AS likely_id_columns,
           'o_totalprice' AS likely_metric_columns, 'o_orderstatus,o_orderpriority' AS likely_categorical_columns,
           'o_orderstatus,o_orderdate' AS likely_date_columns FROM orders""")
def likely_columns_orders(spark, sf):
    out = likely_columns(profile_table(read(spark, sf, "orders"), "orders", duplicates=False).columns)
    return out.select("table_name", "row_count", "column_count", *[
        F.concat_ws(",", f"likely_{k}_columns").alias(f"likely_{k}_columns") for k in ("id", "metric", "categorical", "date")])


@register("suggest_for_other_gaps", """
    SELECT 'remark' AS column_name, 'ignore_issue' AS operation, false AS requires_approval, CAST(count(*) AS BIGINT) AS rows_before
    FROM orders HAVING count(*) FILTER (o_orderkey % 3 = 0) > 0""")
def suggest_for_other_gaps(spark, sf):
    """Gaps in a column that is no measure, key, date or category are left alone."""
    orders = read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("free words "), "o_orderkey")).alias("remark"))
    p = profile_table(orders, "orders")
    return suggest_cleaning(p.columns, p.issues).select("column_name", "operation", "requires_approval", "rows_before")


def _dirty(spark, sf):
    """Orders as they might come in: numbers and dates as text, gaps, padding, urgent ones twice."""
    key = F.col("o_orderkey")
    orders = read(spark, sf, "orders").select(
        key.alias("order_id"),
        F.when(key % 4 != 0, F.col("o_totalprice").cast("string")).alias("amount"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("day_text"),
        F.when(key % 5 != 0, F.col("o_orderpriority")).alias("segment"),
        F.concat(F.when(key % 3 == 0, F.lit(" ")).otherwise(F.lit("")), "o_orderstatus").alias("note"),
        F.when(key % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(key.cast("string")).alias("memo"),
        F.concat(F.lit("c"), "o_custkey").alias("channel"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    return orders.unionByName(orders.filter(F.col("urgent"))).drop("urgent")


_DIRTY_SQL = """
    o AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'),
    d AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS amount,
                 CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS segment,
                 o_orderkey % 3 = 0 AS padded, o_custkey FROM o),
    t AS (SELECT count(*) AS n, count(*) - count(amount) AS no_amount, count(*) - count(segment) AS no_segment,
                 count(*) FILTER (padded) AS padded, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS twice FROM d)"""


@register("issues_orders", f"""
    WITH {_DIRTY_SQL},
    i AS (
        SELECT 0 AS issue_order, CAST(NULL AS VARCHAR) AS column_name, 'duplicate_rows' AS issue_type, twice AS k,
               CASE WHEN round(twice / n * 100, 2) > 10 THEN 'high' ELSE 'medium' END AS impact_level FROM t UNION ALL
        SELECT 20, 'amount', 'missing_values', no_amount, 'high' FROM t UNION ALL
        SELECT 21, 'amount', 'numeric_stored_as_text', n - no_amount, 'medium' FROM t UNION ALL
        SELECT 32, 'day_text', 'date_stored_as_text', n, 'medium' FROM t UNION ALL
        SELECT 40, 'segment', 'missing_values', no_segment, 'medium' FROM t UNION ALL
        SELECT 55, 'note', 'whitespace', padded, 'low' FROM t UNION ALL
        SELECT 64, 'memo', 'mixed_types', n, 'medium' FROM t UNION ALL
        SELECT 73, 'channel', 'high_cardinality_category', n, 'low' FROM t)
    SELECT issue_order, column_name, issue_type, CAST(k AS BIGINT) AS affected_rows_count,
           CAST(round(k / n * 100, 2) AS DOUBLE) AS affected_rows_percent, impact_level
    FROM i, t""")
def issues_orders(spark, sf):
    return profile_table(_dirty(spark, sf), "orders").issues.select(
        "issue_order", "column_name", "issue_type", "affected_rows_count", "affected_rows_percent", "impact_level"
    )


@register("suggest_cleaning_orders", f"""
    WITH {_DIRTY_SQL},
    s AS (
        SELECT 1 AS sequence, CAST(NULL AS VARCHAR) AS column_name, 'deduplicate' AS operation, true AS requires_approval, n - twice AS a FROM t UNION ALL
        SELECT 2, 'amount', 'drop_rows', true, n - no_amount FROM t UNION ALL
        SELECT 3, 'amount', 'cast_type', true, n FROM t UNION ALL
        SELECT 4, 'day_text', 'parse_dates', true, n FROM t UNION ALL
        SELECT 5, 'segment', 'fill_missing', true, n FROM t UNION ALL
        SELECT 6, 'note', 'strip_whitespace', false, n FROM t UNION ALL
        SELECT 7, 'memo', 'ignore_issue', true, n FROM t UNION ALL
        SELECT 8, 'channel', 'ignore_issue', false, n FROM t)
    SELECT CAST(sequence AS INTEGER) AS sequence, column_name, operation, requires_approval,
           CAST(n AS BIGINT) AS rows_before, CAST(a AS BIGINT) AS estimated_rows_after FROM s, t""")
def suggest_cleaning_orders(spark, sf):
    p = profile_table(_dirty(spark, sf), "orders")
    return suggest_cleaning(p.columns, p.issues).select(
        "sequence", "column_name", "operation", "requires_approval", "rows_before", "estimated_rows_after"
    )


@register("cleaning_plan_summary", f"""
    WITH {_DIRTY_SQL}
    SELECT 'orders' AS table_name, CAST(8 AS BIGINT) AS total_steps, CAST(6 AS BIGINT) AS steps_requiring_approval,
           CAST(0 AS BIGINT) AS auto_approved_steps, CAST(2 AS BIGINT) AS auto_ignored_steps,
           CAST(twice + no_amount AS BIGINT) AS estimated_row_count_change,
           'amount,day_text,segment,note,memo,channel' AS estimated_columns_changed FROM t""")
def cleaning_plan_summary(spark, sf):
    p = profile_table(_dirty(spark, sf), "orders")
    out = cleaning_plan.summarize_cleaning(suggest_cleaning(p.columns, p.issues))
    return out.withColumn("estimated_columns_changed", F.concat_ws(",", "estimated_columns_changed"))


@register("decisions_orders", """
    SELECT CAST(8 AS BIGINT) AS total_steps, CAST(2 AS BIGINT) AS approved_steps, CAST(1 AS BIGINT) AS rejected_steps,
           CAST(1 AS BIGINT) AS modified_steps, CAST(1 AS BIGINT) AS auto_approved_steps,
           CAST(1 AS BIGINT) AS blocked_steps, CAST(2 AS BIGINT) AS skipped_steps, false AS can_execute
    FROM (SELECT count(*) FROM orders)""")
def decisions_orders(spark, sf):
    p = profile_table(_dirty(spark, sf), "orders")
    steps = suggest_cleaning(p.columns, p.issues)
    wanted = (
        F.when(F.col("sequence").isin(1, 3), "approve").when(F.col("sequence") == 4, "reject")
        .when(F.col("sequence") == 5, "modify")
    )
    decisions = steps.select(
        "step_id", wanted.alias("decision"),
        F.when(F.col("sequence") == 5, "drop_rows").alias("modified_operation"),
        F.when(F.col("sequence") == 5, F.create_map(F.lit("column"), F.lit("segment"))).alias("modified_parameters"),
    ).filter(F.col("decision").isNotNull())
    # Two undecided steps ask for approval: one to drop rows, one that only notes.
    return cleaning_plan.summarize_decisions(cleaning_plan.resolve_decisions(steps, decisions))


@register("duplicate_count", """
    SELECT CAST((SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS BIGINT) AS rows_repeated,
           CAST((SELECT count(*) - count(DISTINCT text) FROM documents) AS BIGINT) AS texts_repeated""")
def duplicates(spark, sf):
    documents = read(spark, sf, "documents").drop("doc_id")
    rows = duplicate_count(documents).select(F.col("duplicate_rows").alias("rows_repeated"))
    texts = duplicate_count(documents.select("text")).select(F.col("duplicate_rows").alias("texts_repeated"))
    both = rows.unionByName(texts, allowMissingColumns=True)
    return both.agg(F.max("rows_repeated").alias("rows_repeated"), F.max("texts_repeated").alias("texts_repeated"))


def _all_tables(spark, sf):
    return {t: read(spark, sf, t) for t in TABLES}


@register("table_sizes", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {t}" for t in TABLES))
def table_sizes(spark, sf):
    p = profile_tables({t: df for t, df in _all_tables(spark, sf).items()}, duplicates=False)
    return likely_columns(p.columns).select("table_name", "row_count")


@register("suggest_cleaning")
def suggest_cleaning_all(spark, sf):
    p = profile_tables(_all_tables(spark, sf))
    return suggest_cleaning(p.columns, p.issues).select(
        "step_id", "table_name", "sequence", "issue_type", "column_name", "operation", "requires_approval"
    )


@register("suggest_features")
def suggest_features_all(spark, sf):
    p = profile_tables(_all_tables(spark, sf), duplicates=False)
    return suggest_features(p.columns, most=8).select("feature_id", "table_name", "sequence", "feature_name", "operation", "output_column")


@register("suggest_charts")
def suggest_charts_all(spark, sf):
    p = profile_tables(_all_tables(spark, sf), duplicates=False)
    return suggest_charts(p.columns, most=8, count_bars=20).select(
        "chart_id", "table_name", "sequence", "chart_type", "x_column", "y_column", "aggregation"
    )


@register("suggest_features_orders", """
    SELECT * FROM (VALUES
        (1, 'date_parts_o_orderstatus', 'date_extract'), (2, 'date_parts_o_orderdate', 'date_extract'),
        (3, 'aov', 'ratio'), (4, 'running_revenue', 'window'), (5, 'revenue_by_o_orderstatus', 'aggregate')
    ) AS v(sequence, feature_name, operation) WHERE (SELECT count(*) FROM orders) > 0""")
def suggest_features_orders(spark, sf):
    p = profile_table(read(spark, sf, "orders"), "orders", duplicates=False)
    return suggest_features(p.columns, most=8).select("sequence", "feature_name", "operation")


@register("suggest_charts_orders", """
    SELECT * FROM (VALUES
        (1, 'line', 'o_orderstatus', 'o_totalprice'), (2, 'line', 'o_orderdate', 'o_totalprice'),
        (3, 'bar', 'o_orderstatus', 'o_totalprice'), (4, 'bar', 'o_orderpriority', 'o_totalprice'),
        (5, 'bar', 'o_orderstatus', NULL), (6, 'bar', 'o_orderpriority', NULL),
        (7, 'pie', 'o_orderstatus', NULL), (8, 'pie', 'o_orderpriority', NULL)
    ) AS v(sequence, chart_type, x_column, y_column) WHERE (SELECT count(*) FROM orders) > 0""")
def suggest_charts_orders(spark, sf):
    p = profile_table(read(spark, sf, "orders"), "orders", duplicates=False)
    return suggest_charts(p.columns, most=8, count_bars=20).select("sequence", "chart_type", "x_column", "y_column")


@register("feature_decisions", """
    SELECT CAST(5 AS BIGINT) AS total, CAST(1 AS BIGINT) AS approved, CAST(1 AS BIGINT) AS rejected,
           CAST(3 AS BIGINT) AS blocked, false AS can_execute FROM (SELECT count(*) FROM orders)""")
def feature_decisions(spark, sf):
    p = profile_table(read(spark, sf, "orders"), "orders", duplicates=False)
    suggested = suggest_features(p.columns, most=8)
    decisions = suggested.filter("sequence <= 2").select(
        "feature_id", F.when(F.col("sequence") == 1, "approve").otherwise("modify").alias("decision")
    )
    return feature_plan.summarize(feature_plan.decide(suggested, decisions))


@register("suggested_charts_drawn", """
    SELECT o_orderstatus AS x, CAST(count(*) AS DOUBLE) AS y, 'bar' AS chart FROM orders GROUP BY 1 UNION ALL
    SELECT o_orderpriority, CAST(count(*) AS DOUBLE), 'pie' FROM orders GROUP BY 1""")
def suggested_charts_drawn(spark, sf):
    """Approve two suggestions and draw them."""
    orders = read(spark, sf, "orders")
    suggested = suggest_charts(profile_table(orders, "orders", duplicates=False).columns, most=8, count_bars=20)
    decisions = suggested.select("chart_id", F.when(F.col("sequence").isin(5, 8), "approve").otherwise("reject").alias("decision"))
    approved = chart_plan.to_charts(chart_plan.decide(suggested, decisions, "chart_id"))
    drawn = charts.chart_batch({"orders": orders}, approved)
    return reduce(DataFrame.union, [
        r.data.select(F.col(r.data.columns[0]).alias("x"), F.col(r.data.columns[1]).cast("double").alias("y"), F.lit(str(r.chart.kind)).alias("chart"))
        for r in drawn
    ])


def _orders(spark, sf):
    return {"orders": money(read(spark, sf, "orders"), "o_totalprice")}


@register("chart_line", """
    SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS o_totalprice
    FROM orders GROUP BY o_orderdate ORDER BY 1""")
def chart_line(spark, sf):
    out = chart_data(_orders(spark, sf), Chart("orders", "line", "o_orderdate", "o_totalprice", "sum"))
    return texted(out).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@register("chart_line_raw", """
    SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_totalprice FROM orders
    ORDER BY orders.o_orderdate, o_totalprice""")
def chart_line_raw(spark, sf):
    return texted(chart_data({"orders": read(spark, sf, "orders")}, Chart("orders", "line", "o_orderdate", "o_totalprice")))


@register("chart_bar", """
    SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS o_totalprice FROM orders GROUP BY 1""")
def chart_bar(spark, sf):
    out = chart_data(_orders(spark, sf), Chart("orders", "bar", "o_orderpriority", "o_totalprice", "sum"))
    return out.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@register("chart_bar_count", """
    SELECT o_custkey, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def chart_bar_count(spark, sf):
    return chart_data(_orders(spark, sf), Chart("orders", "bar", "o_custkey", aggregation="count", limit=20))


@register("chart_pie", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS count FROM customer GROUP BY 1")
def chart_pie(spark, sf):
    return chart_data({"customer": read(spark, sf, "customer")}, Chart("customer", "pie", "c_mktsegment"))


@register("chart_scatter", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey, o_totalprice""")
def chart_scatter(spark, sf):
    return chart_data(
        {"orders": read(spark, sf, "orders")}, Chart("orders", "scatter", "o_orderkey", "o_totalprice", sort="asc")
    )


@register("chart_scatter_sample", """
    SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7|' || o_orderkey || '|' || o_custkey) LIMIT 200""")
def chart_scatter_sample(spark, sf):
    chart = Chart("orders", "scatter", "o_orderkey", "o_custkey", sample_seed=7, limit=200)
    return chart_data({"orders": read(spark, sf, "orders")}, chart)


@register("chart_visual", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")
def chart_visual(spark, sf):
    out = run({"orders": read(spark, sf, "orders")}, GenerateVisual("orders", "bar", "o_orderstatus", "o_totalprice", "avg"))
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


@register("chart_records", """
    SELECT '{"o_orderdate":"' || strftime(d, '%Y-%m-%dT00:00:00.000') || '","count":' || n || '}' AS record FROM (
        SELECT o_orderdate AS d, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, d)""")
def chart_records(spark, sf):
    return charts.records(chart_data(_orders(spark, sf), Chart("orders", "bar", "o_orderdate")))


@register("chart_histogram", """
    WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
    SELECT CAST(greatest(1, ceil((l_quantity - lo) * 10 / (hi - lo))) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS count
    FROM lineitem, b GROUP BY 1""")
def chart_histogram(spark, sf):
    out = chart_data({"lineitem": read(spark, sf, "lineitem")}, Chart("lineitem", "histogram", "l_quantity"))
    upper = F.regexp_extract("l_quantity", r", ([^\]]+)\]", 1).cast("double")
    return out.select(F.ceil(F.round((upper - 1) * 10 / 49, 6)).cast("int").alias("bin"), "count")


@register("chart_box", """
    SELECT l_linestatus, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
           round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3,
           max(l_extendedprice) AS max
    FROM lineitem GROUP BY 1""")
def chart_box(spark, sf):
    out = chart_data({"lineitem": read(spark, sf, "lineitem")}, Chart("lineitem", "box", "l_linestatus", "l_extendedprice"))
    return out.withColumns({n: F.round(n, 6) for n in ("q1", "median", "q3")})


@register("chart_heatmap", "SELECT event_type, CAST(dayofweek(ts) + 1 AS INTEGER) AS day, CAST(count(*) AS BIGINT) AS count FROM events GROUP BY 1, 2")
def chart_heatmap(spark, sf):
    events = read(spark, sf, "events").withColumn("day", F.dayofweek("ts"))
    return chart_data({"events": events}, Chart("events", "heatmap", "event_type", "day"))


@register("chart_area", "SELECT l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
def chart_area(spark, sf):
    return chart_data({"lineitem": read(spark, sf, "lineitem")}, Chart("lineitem", "area", "l_linenumber", "l_quantity", "sum"))


@register("chart_table", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey")
def chart_table(spark, sf):
    return chart_data({"supplier": read(spark, sf, "supplier")}, Chart("supplier", "table", "s_suppkey", "s_name", sort="asc"))
