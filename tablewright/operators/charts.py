"""Data behind a chart: x and y columns, sorted; all points unless the chart has a limit."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import ToolError
from tablewright.functions import nulls
from tablewright.operators import buckets
from tablewright.operators.aggregates import aggregate, exact_quantiles, sorted_and_limited
from tablewright.operators.predicates import check_columns, table_of
from tablewright.specs import Agg, Chart, ChartKind, GenerateVisual, Metric, Status

_VALUE_AGGREGATES = {
    "sum": nulls.sum_or_zero,
    "mean": F.avg,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
}


@dataclass(frozen=True)
class _Rule:
    """How a chart turns rows into points."""

    needs_y: bool = False
    #: Aggregations that need y; with any other, or without y, rows are counted. None: all do.
    of_y: frozenset[str] | None = None
    #: Keep rows as they are where no aggregation is named.
    raw: bool = False
    by_size: bool = False


_RULES = {
    ChartKind.line: _Rule(needs_y=True, raw=True),
    ChartKind.area: _Rule(needs_y=True, raw=True),
    ChartKind.bar: _Rule(of_y=frozenset({"sum", "mean", "avg", "min", "max", "median"}), raw=True, by_size=True),
    ChartKind.pie: _Rule(of_y=frozenset({"sum"})),
}


def _grouped(known: DataFrame, x: str, y: str, aggregation: str) -> DataFrame:
    if aggregation == "median":
        return aggregate(known, [x], [Metric(y, Agg.median, y)])
    functions = _VALUE_AGGREGATES | {"count": F.count}
    if aggregation not in functions:
        raise ToolError(f"Unsupported aggregation: {aggregation}")
    return known.groupBy(nulls.col(x)).agg(functions[aggregation](nulls.col(y)).alias(y))


def grouped_points(df: DataFrame, c: Chart) -> DataFrame:
    """Points of a line, area, bar or pie chart: y or row count per x, in the order of its rule."""
    rule, x, y = _RULES[ChartKind(c.kind)], c.x_column, c.y_column
    if rule.needs_y and not y:
        raise ToolError(f"A chart of kind {ChartKind(c.kind)} needs y_column")
    known = df.filter(nulls.col(x).isNotNull())
    if rule.of_y is not None and (not y or c.aggregation == "count" or (c.aggregation not in rule.of_y and not rule.raw)):
        data, value = known.groupBy(nulls.col(x)).agg(F.count(F.lit(1)).alias("count")), "count"
    elif c.aggregation is None:
        data, value = df.select(nulls.col(x), nulls.col(y)), y
    else:
        data, value = _grouped(known, x, y, c.aggregation), y
    if rule.by_size:
        order = [(value, c.sort != "asc"), (x, False)]
    else:
        order = [(x, rule.raw and c.sort == "desc")] + ([(value, False)] if rule.raw else [])
    return sorted_and_limited(data, order, c.limit)


def scatter(df: DataFrame, c: Chart) -> DataFrame:
    """Points with both values: sorted by x if asked, a choice drawn with a seed, else the first.

    The choice are the points with the least keyed hashes, so it depends on the seed and the points alone,
    not on how often or in how many parts the table is read. Equal points have equal hashes and stand together.
    """
    if not c.y_column:
        raise ToolError("A scatter chart needs y_column")
    points = nulls.without_nan(df.select(nulls.col(c.x_column), nulls.col(c.y_column))).dropna()
    limit = c.limit
    if c.sample_seed is not None:
        parts = [F.lit(str(c.sample_seed)), *[nulls.col(n).cast("string") for n in (c.x_column, c.y_column)]]
        drawn = points.withColumn("__at", F.md5(F.concat_ws("|", *parts).cast("binary")))
        return sorted_and_limited(drawn, [("__at", False)], limit).drop("__at")
    sort = [(c.x_column, c.sort == "desc"), (c.y_column, False)] if c.sort else []
    return sorted_and_limited(points, sort, limit)


def table(df: DataFrame, c: Chart) -> DataFrame:
    columns = [c.x_column] + ([c.y_column] if c.y_column else [])
    sort = [(c.x_column, c.sort == "desc"), *[(x, False) for x in columns[1:]]] if c.sort else []
    return sorted_and_limited(df.select(*[nulls.col(x) for x in columns]), sort, c.limit)


def histogram(df: DataFrame, c: Chart, bins: int = 10) -> DataFrame:
    """Number of values in each of ten equal intervals, empty ones left out."""
    edges = buckets.value_range(df, c.x_column)
    if edges is None:
        return df.select(F.lit("").alias(c.x_column), F.lit(0).cast("bigint").alias("count")).limit(0)
    cuts = buckets.equal_edges(*edges, bins)
    place = buckets.by_edges(nulls.col(c.x_column).cast("double"), cuts, [f"{i}" for i in range(bins)])
    counted = df.groupBy(place.cast("int").alias("__bin")).agg(F.count(F.lit(1)).alias("count"))
    labels = F.array(*[F.lit(t) for t in buckets.interval_labels(cuts)])
    return (
        counted.filter(F.col("__bin").isNotNull())
        .orderBy("__bin")
        .select(F.get(labels, F.col("__bin")).alias(c.x_column), "count")
    )


def box(df: DataFrame, c: Chart) -> DataFrame:
    """Minimum, quartiles and maximum of y per x."""
    if not c.y_column:
        raise ToolError("A box chart needs y_column")
    known = df.filter(nulls.col(c.x_column).isNotNull())
    five = exact_quantiles(known, [c.x_column], [c.y_column], [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ("min", "q1", "median", "q3", "max")
    data = five.select(nulls.col(c.x_column), *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])
    return sorted_and_limited(data, [(c.x_column, False)], c.limit)


def heatmap(df: DataFrame, c: Chart) -> DataFrame:
    """Row count per pair of x and y."""
    if not c.y_column:
        raise ToolError("A heat map needs y_column")
    pair = [c.x_column, c.y_column]
    known = df.filter(nulls.col(pair[0]).isNotNull() & nulls.col(pair[1]).isNotNull())
    data = known.groupBy(*[nulls.col(p) for p in pair]).agg(F.count(F.lit(1)).alias("count"))
    return sorted_and_limited(data, [(p, False) for p in pair], c.limit)


_BUILDERS = {
    **dict.fromkeys(_RULES, grouped_points),
    ChartKind.scatter: scatter,
    ChartKind.histogram: histogram,
    ChartKind.box: box,
    ChartKind.heatmap: heatmap,
    ChartKind.table: table,
}


def chart_data(tables: Mapping[str, DataFrame], c: Chart) -> DataFrame:
    """Lazy data of one chart."""
    df = table_of(tables, c.table)
    check_columns(df, [c.x_column] + ([c.y_column] if c.y_column else []), c.table)
    if c.kind not in set(ChartKind):
        raise ToolError(f"Unsupported chart type '{c.kind}'. Allowed: {sorted(ChartKind)}")
    return _BUILDERS[ChartKind(c.kind)](df, c)


def visual(tables: Mapping[str, DataFrame], spec: GenerateVisual) -> DataFrame:
    """Chart data of a query spec; bars and lines with a y add up unless told otherwise."""
    aggregation = spec.aggregation
    if aggregation is None and spec.y_column and spec.chart_type in (ChartKind.bar, ChartKind.line):
        aggregation = "sum"
    return chart_data(tables, Chart(spec.table, spec.chart_type, spec.x_column, spec.y_column, aggregation))


@dataclass(frozen=True)
class ChartResult:
    chart: Chart
    status: Status
    data: DataFrame | None = None
    series_label: str | None = None
    error: str | None = None


def chart_batch(tables: Mapping[str, DataFrame], charts: Iterable[Chart]) -> list[ChartResult]:
    """Many charts over many tables; a bad one fails alone."""
    results = []
    for c in charts:
        try:
            data = chart_data(tables, c)
            results.append(ChartResult(c, Status.success, data, series_label(data.columns[-1])))
        except (ToolError, PySparkException) as error:
            results.append(ChartResult(c, Status.failed, error=str(error)))
    return results


def series_label(column: str) -> str:
    return column.replace("_", " ").title()


def records(data: DataFrame) -> DataFrame:
    """One JSON object per point, dates and timestamps in ISO form, as `record`."""
    return data.select(F.to_json(F.struct(*[_iso(data, n) for n in data.columns]), {"ignoreNullFields": "false"}).alias("record"))


def _iso(data: DataFrame, name: str) -> Column:
    c = nulls.col(name)
    if isinstance(data.schema[name].dataType, nulls.TEMPORAL):
        c = F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return c.alias(name)
