"""Group-by aggregates, exact quantiles, distinct and duplicate counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import ToolError
from tablewright.functions import ids, nulls, parse, words
from tablewright.operators import quantiles
from tablewright.operators.predicates import check_columns, table_of
from tablewright.specs import Agg, AggregateTable, Metric, Period

_TRUNC = {
    Period.day: "day",
    Period.week: "week",
    Period.month: "month",
    Period.quarter: "quarter",
    Period.year: "year",
}
_ALL = "__all"


def _simple(metric: Metric) -> Column:
    c = nulls.col(metric.column)
    return {
        Agg.count: lambda: F.count(c),
        Agg.sum: lambda: nulls.sum_or_zero(c),
        Agg.avg: lambda: F.avg(c),
        Agg.min: lambda: F.min(c),
        Agg.max: lambda: F.max(c),
        Agg.median: lambda: F.percentile_approx(c.cast("double"), 0.5, 10_000),
    }[Agg(metric.aggregation)]().alias(metric.output)


def truncate_period(c: Column, dtype: T.DataType, period: Period) -> Column:
    """Start of the period (weeks start on Monday) as a wall-clock timestamp."""
    day = (parse.to_time_any(c) if isinstance(dtype, T.StringType) else c).cast("date")
    if period is not Period.day:
        day = F.trunc(day, _TRUNC[period])
    return day.cast("timestamp_ntz")


def _date_text_columns(df: DataFrame, names: Sequence[str]) -> set[str]:
    """Text columns of which at least 70 % of the values read as dates (one scan)."""
    if not names:
        return set()
    shares = df.agg(
        *[
            F.try_divide(F.count(parse.to_time_any(nulls.col(n))), F.count(nulls.col(n))).alias(f"s{i}")
            for i, n in enumerate(names)
        ]
    ).first()
    return {n for n, s in zip(names, shares) if s is not None and s >= words.TEXT_SHARE}


def with_periods(df: DataFrame, keys: Sequence[str], period: Period) -> DataFrame:
    """Cut date and timestamp keys, and text keys that hold dates, to the period start."""
    types = {f.name: f.dataType for f in df.schema}
    texts = [k for k in keys if isinstance(types[k], T.StringType)]
    dated = _date_text_columns(df, texts)
    for k in keys:
        if isinstance(types[k], nulls.TEMPORAL) or k in dated:
            df = df.withColumn(k, truncate_period(nulls.col(k), types[k], period))
    return df


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probabilities: Sequence[float],
    gathered: int = quantiles.GATHERED,
) -> DataFrame:
    """Interpolated quantiles per group: keys, column index `metric`, one `q{i}` per probability.

    Counts narrow down where the wanted ranks lie (see `quantiles`), so the values of a group
    are neither sorted nor moved, whatever its size. Groups without a value do not appear.
    """
    return quantiles.quantiles(df, keys, [nulls.col(c) for c in columns], probabilities, gathered)


def _with_medians(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], gathered: int
) -> DataFrame:
    """Plain aggregates joined with exact medians on the group keys."""
    exact = [m for m in metrics if Agg(m.aggregation) is Agg.median and not m.approx]
    plain = [_simple(m) for m in metrics if m not in exact]
    rows = F.count(F.lit(1)).alias("__rows")
    columns = list(dict.fromkeys(m.column for m in exact))
    medians = exact_quantiles(df, keys, columns, [0.5], gathered)
    wide = medians.groupBy(*[nulls.col(k) for k in keys]).agg(
        *[
            F.max(F.when(F.col("metric") == columns.index(m.column), F.col("q0"))).alias(m.output)
            for m in exact
        ]
    )
    if list(keys) == [_ALL]:
        # Two one-row tables, put side by side; a table without rows still gives a row.
        both = df.agg(rows, *plain).unionByName(wide, allowMissingColumns=True)
        return both.agg(*[F.max(nulls.col(m.output)).alias(m.output) for m in metrics])
    base = df.groupBy(*[nulls.col(k) for k in keys]).agg(rows, *plain).drop("__rows")
    return base.join(wide, list(keys), "left")


def aggregate(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[Metric],
    gathered: int = quantiles.GATHERED,
) -> DataFrame:
    """One row per group of non-null keys; one row in all without keys."""
    for k in keys:
        df = df.filter(nulls.col(k).isNotNull())
    if any(Agg(m.aggregation) is Agg.median and not m.approx for m in metrics):
        if keys:
            out = _with_medians(df, keys, metrics, gathered)
        else:
            one_group = df.withColumn(_ALL, F.lit(0))
            out = _with_medians(one_group, [_ALL], metrics, gathered)
    else:
        out = df.groupBy(*[nulls.col(k) for k in keys]).agg(*[_simple(m) for m in metrics])
    return out.select(*[nulls.col(k) for k in keys], *[nulls.col(m.output) for m in metrics])


def sorted_and_limited(
    df: DataFrame, sort: Sequence[tuple[str, bool]], limit: int | None
) -> DataFrame:
    """Order by (column, descending) pairs, missing values last, then keep `limit` rows."""
    if sort:
        df = df.orderBy(
            *[nulls.col(c).desc_nulls_last() if desc else nulls.col(c).asc_nulls_last() for c, desc in sort]
        )
    return df if limit is None else df.limit(limit)


def aggregate_table(
    tables, spec: AggregateTable, gathered: int = quantiles.GATHERED
) -> DataFrame:
    df = table_of(tables, spec.table)
    keys = list(spec.group_by)
    check_columns(df, keys, spec.table)
    check_columns(df, [m.column for m in spec.metrics], spec.table)
    for m in spec.metrics:
        if m.aggregation not in set(Agg):
            raise ToolError(f"Unsupported aggregation: {m.aggregation}")
    if spec.date_trunc_period in set(Period):
        df = with_periods(df, keys, Period(spec.date_trunc_period))
    outputs = keys + [m.output for m in spec.metrics]
    if spec.sort_by and spec.sort_by not in outputs:
        raise ToolError(f"sort_by column '{spec.sort_by}' not in the result: {outputs}")
    result = aggregate(df, keys, spec.metrics, gathered)
    sort = [(spec.sort_by, spec.sort_desc)] if spec.sort_by else []
    sort += [(k, False) for k in keys if k != spec.sort_by]
    return sorted_and_limited(result, sort, spec.limit)


# Aggregations of a derived table, by their usual names.
_NAMED = {
    "sum": nulls.sum_or_zero,
    "mean": F.avg,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.count_distinct,
    "approx_nunique": F.approx_count_distinct,
}


def aggregate_named(
    df: DataFrame,
    value: str,
    key: str,
    aggregation: str,
    output: str,
    order_by: str | None = None,
    gathered: int = quantiles.GATHERED,
) -> DataFrame:
    """One aggregate of one column per key. `first` and `last` need an order column."""
    df = df.filter(nulls.col(key).isNotNull())
    c = nulls.col(value)
    if aggregation == "median":
        metric = Metric(value, Agg.median, output)
        return aggregate(df, [key], [metric], gathered)
    if aggregation in ("first", "last"):
        if order_by is None:
            raise ToolError(f"Aggregation '{aggregation}' needs an order_by column")
        at = F.when(c.isNotNull(), nulls.col(order_by))
        pick = F.min_by if aggregation == "first" else F.max_by
        return df.groupBy(nulls.col(key)).agg(pick(c, at).alias(output))
    if aggregation not in _NAMED:
        raise ToolError(f"Unsupported aggregation: {aggregation}")
    return df.groupBy(nulls.col(key)).agg(_NAMED[aggregation](c).alias(output))


def sum_per_distinct(
    df: DataFrame, value: str, distinct: str, output: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Sum of a value divided by the number of distinct members (revenue per user)."""
    for k in keys:
        df = df.filter(nulls.col(k).isNotNull())
    members = F.count_distinct(nulls.col(distinct))
    total = nulls.sum_or_zero(nulls.col(value))
    return df.groupBy(*[nulls.col(k) for k in keys]).agg(nulls.safe_divide(total, members).alias(output))


def row_identity(df: DataFrame) -> list[Column]:
    """Grouping columns under which two rows are equal exactly when the rows are.

    Long texts take part as digests, so that counting copies does not move documents.
    """
    return [
        (ids.text_key(nulls.col(f.name)) if isinstance(f.dataType, T.StringType) else nulls.col(f.name)).alias(f"k{i}")
        for i, f in enumerate(df.schema)
    ]


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows, and all rows, as one row."""
    df = nulls.without_nan(df)
    groups = df.groupBy(*row_identity(df)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
    )
