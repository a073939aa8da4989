"""Import, versions, saved results and arriving files, each read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright import Dataset, ResultStore, import_directory, profile_tables, run
from tablewright.sources.results import dataset_summary, table_output
from tablewright.sources.tables import import_tables, normalise_table, table_info
from tablewright.sources.texts import text_statistics
from tablewright.specs import AggregateTable, Chart, CleaningStep, Feature, Metric
from tablewright.operators.charts import chart_data
from tablewright.streaming.arrivals import import_arrivals
from workload.base import read, register, scratch, texted

_ORDERS = """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
    FROM orders"""


@register("import_csv", _ORDERS)
def import_csv(spark, sf):
    folder = scratch(spark, "import")
    orders = read(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "M-d-yyyy"))
    orders.write.option("header", True).csv(f"{folder}/Orders 2024.csv")
    orders.limit(0).write.option("header", True).csv(f"{folder}/empty.csv")
    return texted(import_directory(spark, folder)["orders_2024"])


@register("import_parquet_json", "SELECT n_nationkey, n_name, 'n' AS kind FROM nation UNION ALL SELECT r_regionkey, r_name, 'r' FROM region")
def import_parquet_json(spark, sf):
    folder = scratch(spark, "import")
    read(spark, sf, "nation").write.parquet(f"{folder}/Nation.parquet")
    read(spark, sf, "region").write.json(f"{folder}/Region.json")
    nation = import_directory(spark, folder, "parquet")["nation"].select("n_nationkey", "n_name", F.lit("n").alias("kind"))
    region = import_directory(spark, folder, "json")["region"].select(F.col("r_regionkey").cast("int"), "r_name", F.lit("r"))
    return nation.union(region)


@register("normalise", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS day,
           CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders""")
def normalise(spark, sf):
    key = F.col("o_orderkey")
    orders = read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 3 == 0, "later").otherwise(F.date_format("o_orderdate", "d MMM yyyy")).alias("day"),
        F.when(key % 2 == 0, " \t").otherwise(F.col("o_orderstatus")).alias("status"),
    )
    return texted(normalise_table(orders))


@register("text_stats", r"""
    SELECT doc_id, CAST(length(text) AS INTEGER) AS char_count,
           CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS line_count, left(text, 500) AS preview
    FROM documents""")
def text_stats(spark, sf):
    return text_statistics(read(spark, sf, "documents").select("doc_id", "text"))


@register("table_info", "SELECT 'orders' AS table_name, CAST(count(*) AS BIGINT) AS row_count, CAST(6 AS INTEGER) AS column_count FROM orders")
def info(spark, sf):
    return table_info({"orders": read(spark, sf, "orders")}).select("table_name", "row_count", "column_count")


@register("version_roundtrip", _ORDERS)
def version_roundtrip(spark, sf):
    data = Dataset(spark, scratch(spark, "dataset"))
    first = data.write({"orders": read(spark, sf, "orders")})
    second = data.copy(first.number)
    return texted(data.tables(second.number)["orders"])


@register("version_clean_enrich", """
    SELECT CAST(v AS INTEGER) AS version_number, CAST(nullif(v - 1, 0) AS INTEGER) AS parent_version, t AS version_type, CAST(n AS BIGINT) AS row_count FROM (
        SELECT 1 AS v, 'original' AS t, count(*) AS n FROM orders UNION ALL
        SELECT 2, 'cleaned', count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL
        SELECT 3, 'enriched', count(*) + count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus <> 'P')""")
def version_clean_enrich(spark, sf):
    data = Dataset(spark, scratch(spark, "dataset"))
    data.write({"orders": read(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))})
    data.clean([CleaningStep("orders", "drop_rows", "o_orderstatus"), CleaningStep("orders", "deduplicate")])
    data.enrich([Feature("by", "aggregate", "orders", (), {"value_column": "o_totalprice", "group_by": "o_orderstatus"})])
    return data.versions().select("version_number", "parent_version", "version_type", "row_count")


@register("cleaning_log", """
    SELECT CAST(1 AS INTEGER) AS sequence, 'drop_rows' AS operation, CAST(count(*) AS BIGINT) AS rows_before,
           CAST(count(*) FILTER (o_orderstatus <> 'P') AS BIGINT) AS rows_after FROM orders UNION ALL
    SELECT CAST(2 AS INTEGER), 'strip_whitespace', CAST(count(*) AS BIGINT), CAST(count(*) AS BIGINT) FROM orders WHERE o_orderstatus <> 'P'""")
def cleaning_log(spark, sf):
    data = Dataset(spark, scratch(spark, "dataset"))
    data.write({"orders": read(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))})
    data.clean([CleaningStep("orders", "drop_rows", "o_orderstatus"), CleaningStep("orders", "strip_whitespace", "o_orderpriority")])
    return data.cleaning_log().select("sequence", "operation", "rows_before", "rows_after")


@register("view_roundtrip", "SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1")
def view_roundtrip(spark, sf):
    store = ResultStore(spark, scratch(spark, "results"))
    spec = AggregateTable("orders", ["o_custkey"], [Metric("o_totalprice", "max", "best")], limit=None)
    view = store.save_view(run({"orders": read(spark, sf, "orders")}, spec), "best order", 1, spec)
    return store.read_view(view)


@register("visual_roundtrip", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1")
def visual_roundtrip(spark, sf):
    store = ResultStore(spark, scratch(spark, "results"))
    chart = Chart("orders", "bar", "o_orderpriority", title="Orders")
    visual = store.save_visual(chart, chart_data({"orders": read(spark, sf, "orders")}, chart), 1)
    return store.visual_data(visual)


@register("large_result", "SELECT o_orderkey, o_custkey FROM orders")
def large_result(spark, sf):
    output = table_output(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), scratch(spark, "results"))
    return spark.read.schema("o_orderkey bigint, o_custkey bigint").csv(output.path, header=True)


@register("result_formats", """
    SELECT fmt, o_orderkey, note, strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS moment FROM (SELECT unnest(['csv', 'json', 'parquet']) AS fmt), (
        SELECT o_orderkey, o_orderdate + INTERVAL 1 MICROSECOND * (o_orderkey % 1000003) AS moment,
               CASE o_orderkey % 6 WHEN 0 THEN '  padded ' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'say "hi", you'
                                   WHEN 4 THEN 'two' || chr(10) || 'lines \\ "' ELSE o_orderstatus END AS note FROM orders)""")
def result_formats(spark, sf):
    """A saved view holds what was saved, whatever its format."""
    store, key = ResultStore(spark, scratch(spark, "results")), F.col("o_orderkey") % 6
    notes = {0: F.lit("  padded "), 1: F.lit(""), 2: F.lit(None), 3: F.lit('say "hi", you'), 4: F.lit('two\nlines \\ "'), 5: F.col("o_orderstatus")}
    note = F.coalesce(*[F.when(key == k, v) for k, v in notes.items()])
    orders = read(spark, sf, "orders").select(
        "o_orderkey", note.alias("note"),
        F.expr("timestamp_micros(unix_micros(CAST(o_orderdate AS TIMESTAMP)) + o_orderkey % 1000003)").alias("moment"))
    out = None
    for fmt in ("csv", "json", "parquet"):
        back = store.read_view(store.save_view(orders, fmt, 1, fmt=fmt)).withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out.withColumn("moment", F.date_format("moment", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@register("import_colliding_names", """
    SELECT t AS table_name, CAST(count(*) AS BIGINT) AS row_count
    FROM nation, (VALUES ('a', 0), ('a_2', 1), ('a_1', 2), ('t_1', 3), ('table', 4)) AS names(t, k) WHERE n_nationkey % 5 = k GROUP BY t""")
def import_colliding_names(spark, sf):
    """Names that become equal lose no table."""
    nation = read(spark, sf, "nation")
    tables = import_tables({n: nation.filter(F.col("n_nationkey") % 5 == k) for k, n in enumerate(("a", "A!", "a_1", "1", "?"))})
    return table_info(tables).select("table_name", "row_count")


@register("dataset_summary", """
    SELECT 'customer' AS table_name, CAST(count(*) AS BIGINT) AS row_count, CAST(5 AS BIGINT) AS column_count, CAST(1 AS INTEGER) AS views, CAST(1 AS INTEGER) AS visuals FROM customer UNION ALL
    SELECT 'orders', CAST(count(*) AS BIGINT), CAST(6 AS BIGINT), CAST(1 AS INTEGER), CAST(1 AS INTEGER) FROM orders""")
def summary(spark, sf):
    tables = {t: read(spark, sf, t) for t in ("orders", "customer")}
    store = ResultStore(spark, scratch(spark, "results"))
    chart = Chart("customer", "pie", "c_mktsegment")
    points = chart_data(tables, chart)
    store.save_visual(chart, points, 1)
    store.save_view(points, "segments", 1)
    p = profile_tables(tables, duplicates=False)
    out = dataset_summary(p.columns, p.issues, store.views(1), store.visuals(1), 1)
    return out.select(
        "table_name", "row_count", "column_count",
        F.size("saved_views").alias("views"), F.size("saved_visuals").alias("visuals"),
    )


@register("import_stream", """
    SELECT event_id, user_id, event_type, value FROM events""")
def import_stream(spark, sf):
    """Files arrive twice; each run imports what is new as the next version."""
    folder, root, checkpoint = (scratch(spark, n) for n in ("arriving", "dataset", "progress"))
    events = read(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    schema = "event_id bigint, user_id bigint, event_type string, value double"
    clicks = F.col("event_type").isin("click", "view")
    for arriving in (clicks, ~clicks):
        events.filter(arriving).write.mode("append").option("header", True).csv(folder)
        import_arrivals(spark, folder, schema, root, "Events", checkpoint).awaitTermination()
    data = Dataset(spark, root)
    return data.tables(1)["events"].union(data.tables(2)["events"])


@register("import_stream_quoted", """
    SELECT t AS place, event_id, 'say "' || event_type || '", ' || user_id AS note FROM events, (VALUES ('first'), ('second'), ('again')) AS names(t)""")
def import_stream_quoted(spark, sf):
    """Two tables, then a new checkpoint, take all files of one folder; quotes are read as the batch import reads them."""
    folder, root = scratch(spark, "arriving"), scratch(spark, "dataset")
    note = F.concat(F.lit('say "'), "event_type", F.lit('", '), F.col("user_id").cast("string"))
    read(spark, sf, "events").select("event_id", note.alias("note")).write.option("header", True).option("escape", '"').csv(folder)
    data, out = Dataset(spark, root), None
    for place, table in (("first", "one"), ("second", "two"), ("again", "one")):
        import_arrivals(spark, folder, "event_id bigint, note string", root, table, scratch(spark, "progress")).awaitTermination()
        new = data.tables()[table].withColumn("place", F.lit(place))
        out = new if out is None else out.unionByName(new)
    return out
