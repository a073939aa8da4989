"""Typed query specs applied to a set of named tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce, singledispatch
from operator import and_

from pyspark.sql import DataFrame

from tablewright.errors import ToolError
from tablewright.functions import nulls
from tablewright.operators import charts
from tablewright.operators.aggregates import aggregate_table, sorted_and_limited
from tablewright.operators.joins import join_tables
from tablewright.operators.predicates import check_columns, predicate, table_of
from tablewright.operators.topn import top_n, top_n_wide
from tablewright.plans.readonly_sql import run_sql
from tablewright.specs import (
    AggregateTable,
    FilterTable,
    GenerateVisual,
    PreviewTable,
    SimpleJoin,
    SqlQuery,
    TopN,
    TopNWide,
)

Tables = Mapping[str, DataFrame]


@singledispatch
def _apply(spec, tables: Tables) -> DataFrame:
    raise ToolError(f"Unsupported query spec: {type(spec).__name__}")


def run(tables: Tables, spec) -> DataFrame:
    """Lazy result of any query spec. Names are checked now, data is read at the action."""
    return _apply(spec, tables)


@_apply.register
def _(spec: PreviewTable, tables: Tables) -> DataFrame:
    df = table_of(tables, spec.table)
    if spec.columns:
        check_columns(df, spec.columns, spec.table)
        df = df.select(*[nulls.col(c) for c in spec.columns])
    return df if spec.limit is None else df.limit(spec.limit)


@_apply.register
def _(spec: FilterTable, tables: Tables) -> DataFrame:
    df = table_of(tables, spec.table)
    check_columns(df, [f.column for f in spec.filters], spec.table)
    check_columns(df, spec.columns, spec.table)
    output = list(spec.columns) or df.columns
    if spec.sort_by and spec.sort_by not in output:
        raise ToolError(f"sort_by column '{spec.sort_by}' not in the result: {output}")
    if spec.filters:
        df = df.filter(reduce(and_, [predicate(df, f) for f in spec.filters]))
    df = df.select(*[nulls.col(c) for c in output])
    sort = []
    if spec.sort_by:
        ties = [f.name for f in df.schema if nulls.is_scalar(f.dataType) and f.name != spec.sort_by]
        sort = [(spec.sort_by, spec.sort_desc), *[(c, False) for c in ties]]
    return sorted_and_limited(df, sort, spec.limit)


@_apply.register
def _(spec: AggregateTable, tables: Tables) -> DataFrame:
    return aggregate_table(tables, spec)


@_apply.register
def _(spec: SimpleJoin, tables: Tables) -> DataFrame:
    return join_tables(tables, spec)


@_apply.register
def _(spec: TopN, tables: Tables) -> DataFrame:
    return top_n(tables, spec)


@_apply.register
def _(spec: TopNWide, tables: Tables) -> DataFrame:
    return top_n_wide(tables, spec)


@_apply.register
def _(spec: SqlQuery, tables: Tables) -> DataFrame:
    return run_sql(tables, spec.sql)


@_apply.register
def _(spec: GenerateVisual, tables: Tables) -> DataFrame:
    return charts.visual(tables, spec)
