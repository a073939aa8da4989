"""Features proposed from the profiles of many tables, and decisions about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.errors import ToolError
from tablewright.functions import ids, words
from tablewright.operators.features import DATE_PARTS
from tablewright.specs import Feature

_LIST_PARAMETERS = {"parts"}


def _roles(profile: DataFrame) -> DataFrame:
    """Per table the first column of every role and all date columns, in column order."""
    name = F.col("column_name")
    moment = F.col("is_likely_date") | F.col("data_type").isin("date", "datetime")
    first = {
        "rev": words.name_has(name, words.REVENUE_WORDS),
        "ord": words.name_has(name, words.ORDER_WORDS),
        "usr": words.name_has(name, words.USER_WORDS),
        "chn": words.name_has(name, words.CHANNEL_WORDS),
        "day": moment,
        "cat": F.col("is_likely_categorical"),
    }
    return profile.groupBy("table_name").agg(
        *[F.min_by(name, F.when(hit, F.col("column_index"))).alias(r) for r, hit in first.items()],
    )


def _row(kind: str, name: Column, seed: Column, formula: Column, required: list[Column],
         parameters: dict[str, Column], priority: Column, display: Column,
         output_column: Column | None = None, output_table: Column | None = None) -> list[Column]:
    table = F.col("table_name")
    none = F.lit(None).cast("string")
    return [
        ids.uuid5(F.concat(table, F.lit("."), seed)).alias("feature_id"),
        table,
        priority.cast("bigint").alias("priority"),
        name.alias("feature_name"),
        display.alias("display_name"),
        F.lit(kind).alias("operation"),
        formula.alias("formula"),
        (output_column if output_column is not None else none).alias("output_column"),
        (output_table if output_table is not None else none).alias("output_table"),
        F.array(*required).alias("required_columns"),
        F.create_map(*[p for k, v in parameters.items() for p in (F.lit(k), v)]).alias("parameters"),
        F.lit(True).alias("requires_approval"),
    ]


def suggest_features(profile: DataFrame, most: int | None = None) -> DataFrame:
    """Features per table, `most` of them at most, date parts first."""
    text = F.concat
    day_name = F.col("column_name")
    moments = profile.filter(F.col("is_likely_date") | F.col("data_type").isin("date", "datetime"))
    parts = moments.select(*_row(
        "date_extract", text(F.lit("date_parts_"), day_name), text(F.lit("date_extract."), day_name),
        F.concat_ws(", ", *[F.format_string(f"{p}(%s)", day_name) for p in DATE_PARTS]),
        [day_name], {"source_column": day_name, "parts": F.lit(",".join(DATE_PARTS))},
        F.col("column_index"), text(F.lit("Calendar parts of "), day_name),
        output_column=text(day_name, F.lit("_year")),
    ))

    r = _roles(profile)
    rev, order, user, channel, day, cat = (F.col(c) for c in ("rev", "ord", "usr", "chn", "day", "cat"))

    def have(*columns: Column) -> DataFrame:
        return r.filter(reduce(lambda a, b: a & b, [c.isNotNull() for c in columns]))

    def after_dates(n: int) -> Column:
        return F.lit(1_000_000 + n)

    aov = have(rev, order).select(*_row(
        "ratio", F.lit("aov"), F.lit("ratio.aov"), text(rev, F.lit(" / "), order), [rev, order],
        {"numerator": rev, "denominator": order}, after_dates(0),
        F.lit("Revenue per order"), output_column=F.lit("aov"),
    ))
    arpu = have(rev, user).select(*_row(
        "ratio", F.lit("arpu"), F.lit("ratio.arpu"), F.format_string("sum of %s / distinct %s", rev, user),
        [rev, user], {"numerator": rev, "denominator_distinct": user}, after_dates(1),
        F.lit("Revenue per user"), output_column=F.lit("arpu"),
    ))
    running = have(day, rev).select(*_row(
        "window", F.lit("running_revenue"), F.lit("window.running_revenue"),
        F.format_string("running sum of %s by %s", rev, day), [day, rev],
        {"value_column": rev, "sort_column": day}, after_dates(2),
        F.lit("Revenue so far"), output_column=F.lit("running_revenue"),
    ))
    by_channel = text(F.lit("running_revenue_by_"), channel)
    running_by = have(day, rev, channel).select(*_row(
        "window", by_channel, text(F.lit("window."), by_channel),
        F.format_string("running sum of %s by %s within %s", rev, day, channel), [day, rev, channel],
        {"value_column": rev, "sort_column": day, "partition_column": channel}, after_dates(3),
        text(F.lit("Revenue so far per "), channel), output_column=by_channel,
    ))
    by_category = text(F.lit("revenue_by_"), cat)
    revenue_by = have(cat, rev).select(*_row(
        "aggregate", by_category, text(F.lit("aggregate."), by_category),
        F.format_string("sum of %s per %s", rev, cat), [cat, rev],
        {"value_column": rev, "group_by": cat, "aggregation": F.lit("sum")}, after_dates(4),
        text(F.lit("Revenue per "), cat), output_table=by_category,
    ))
    everything = reduce(DataFrame.unionByName, [parts, aov, arpu, running, running_by, revenue_by])
    in_order = Window.partitionBy("table_name").orderBy("priority")
    return (
        everything.withColumn("sequence", F.row_number().over(in_order))
        .filter(F.lit(True) if most is None else F.col("sequence") <= most)
        .drop("priority")
    )


def decide(suggestions: DataFrame, decisions: DataFrame, id_column: str = "feature_id") -> DataFrame:
    """Suggestions with `outcome`: approved, rejected (anything but approve) or blocked (undecided)."""
    twice = decisions.groupBy(id_column).count().filter("count > 1").first()
    if twice:
        raise ToolError(f"Duplicate decision for {twice[id_column]}")
    d = decisions.select(id_column, "decision")
    outcome = (
        F.when(F.col("decision") == "approve", "approved")
        .when(F.col("decision").isNotNull(), "rejected")
        .when(F.col("requires_approval"), "blocked")
        .otherwise("skipped")
    )
    return suggestions.join(d, id_column, "left").withColumn("outcome", outcome).drop("decision")


def summarize(decided: DataFrame) -> DataFrame:
    """Counts per outcome; nothing may run while a suggestion is undecided."""
    row = decided.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("approved", "rejected", "blocked")],
    )
    return row.withColumn("can_execute", F.col("blocked") == 0)


def to_features(decided: DataFrame) -> list[Feature]:
    """Approved rows as features to apply: at most eight per table."""
    rows = decided.filter(F.col("outcome") == "approved").orderBy("table_name", "sequence").collect()
    return [
        Feature(
            name=r["feature_name"], kind=r["operation"], table=r["table_name"],
            required_columns=tuple(r["required_columns"]),
            parameters={k: v.split(",") if k in _LIST_PARAMETERS else v for k, v in r["parameters"].items()},
            output_column=r["output_column"], output_table=r["output_table"], feature_id=r["feature_id"],
        )
        for r in rows
    ]
