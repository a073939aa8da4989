"""Charts proposed from the profiles of many tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import ids, words
from tablewright.plans.feature_plan import decide, summarize  # noqa: F401  the same decisions apply
from tablewright.specs import Chart

PIE_MAX_VALUES = 5


def _columns(profile: DataFrame, role: str, prefix: str) -> DataFrame:
    """Columns of a role that do not look like ids, with a prefix per use in a pair."""
    return profile.filter(F.col(role) & ~F.col("is_likely_id")).select(
        "table_name",
        F.col("column_index").alias(f"{prefix}_at"),
        F.col("column_name").alias(prefix),
        F.col("unique_count").alias(f"{prefix}_unique"),
    )


def _row(rule: int, kind: str, x: Column, y: Column | None, first: Column, second: Column | None,
         title: Column, description: Column, explanation: Column, aggregation: str | None = None,
         sort: str | None = None, limit: int | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    y_name = y if y is not None else none
    seed = F.concat_ws(".", F.lit("chart"), F.col("table_name"), F.lit(kind), F.lit(aggregation or "none"), x, y_name)
    return [
        ids.uuid5(seed).alias("chart_id"),
        F.col("table_name"),
        F.array(F.lit(rule), first.cast("int"), (second if second is not None else F.lit(0)).cast("int")).alias("place"),
        F.lit(kind).alias("chart_type"),
        x.alias("x_column"),
        y_name.alias("y_column"),
        F.lit(aggregation).cast("string").alias("aggregation"),
        F.lit(sort).cast("string").alias("sort"),
        F.lit(limit).cast("int").alias("limit"),
        title.alias("title"),
        description.alias("description"),
        explanation.alias("explanation"),
        F.lit(True).alias("requires_approval"),
    ]


def suggest_charts(profile: DataFrame, most: int | None = None, count_bars: int | None = None) -> DataFrame:
    """Charts per table, `most` of them at most: lines, bars, counts, pies, scatter plots, in that order."""
    days = _columns(profile, "is_likely_date", "day")
    cats = _columns(profile, "is_likely_categorical", "cat")
    a = _columns(profile, "is_likely_metric", "a")
    b = _columns(profile, "is_likely_metric", "b")
    day, cat, m, n = F.col("day"), F.col("cat"), F.col("a"), F.col("b")
    title, fmt = words.title_of, F.format_string

    lines = days.join(a, "table_name").select(*_row(
        1, "line", day, m, F.col("day_at"), F.col("a_at"),
        F.concat(title(m), F.lit(" over time")), fmt("%s summed per %s", m, day),
        fmt("Rise and fall of %s", m), "sum", "asc",
    ))
    bars = cats.join(a, "table_name").select(*_row(
        2, "bar", cat, m, F.col("cat_at"), F.col("a_at"),
        F.concat(title(m), F.lit(" by "), title(cat)), fmt("%s summed per %s", m, cat),
        fmt("Where %s comes from, by %s", m, cat), "sum", "desc",
    ))
    counts = cats.select(*_row(
        3, "bar", cat, None, F.col("cat_at"), None,
        F.concat(F.lit("Count by "), title(cat)), fmt("Rows per %s", cat),
        fmt("Which %s occurs most", cat), "count", "desc", count_bars,
    ))
    pies = cats.filter(F.col("cat_unique") <= PIE_MAX_VALUES).select(*_row(
        4, "pie", cat, None, F.col("cat_at"), None,
        F.concat(F.lit("Share by "), title(cat)), fmt("Rows per %s as parts of all rows", cat),
        fmt("How rows divide over %s", cat), "count",
    ))
    # Pairs of metric columns of one table; a profile has few of them.
    scatters = a.join(b, "table_name").filter(F.col("a_at") < F.col("b_at")).select(*_row(
        5, "scatter", m, n, F.col("a_at"), F.col("b_at"),
        F.concat(title(m), F.lit(" vs "), title(n)), fmt("%s against %s", m, n),
        fmt("Whether %s moves with %s", m, n),
    ))
    everything = reduce(DataFrame.unionByName, [lines, bars, counts, pies, scatters])
    in_order = Window.partitionBy("table_name").orderBy("place")
    return (
        everything.withColumn("sequence", F.row_number().over(in_order))
        .filter(F.lit(True) if most is None else F.col("sequence") <= most)
        .drop("place")
    )


def to_charts(decided: DataFrame) -> list[Chart]:
    """Approved rows as charts to draw: at most eight per table."""
    rows = decided.filter(F.col("outcome") == "approved").orderBy("table_name", "sequence").collect()
    return [
        Chart(
            table=r["table_name"], kind=r["chart_type"], x_column=r["x_column"], y_column=r["y_column"],
            aggregation=r["aggregation"], sort=r["sort"], limit=r["limit"], title=r["title"], chart_id=r["chart_id"],
        )
        for r in rows
    ]
