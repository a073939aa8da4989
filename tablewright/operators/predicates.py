"""Filter operators and the check of column names."""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import ToolError
from tablewright.functions import nulls
from tablewright.specs import Filter, Op

_META = re.compile(r"[\\^$.|?*+()\[\]{}]")


def table_of(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    if name not in tables:
        raise ToolError(f"Table '{name}' not found. Available: {sorted(tables)}")
    return tables[name]


def check_columns(df: DataFrame, names: Iterable[str], table: str) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ToolError(f"Unknown column(s) in '{table}': {unknown}. Available: {df.columns}")


def _fits(value: Any, dtype: T.DataType) -> bool:
    """Whether the constant means something in a column of this type."""
    if isinstance(dtype, nulls.NUMERIC):
        if isinstance(value, str):
            try:
                float(value)
            except ValueError:
                return False
        return isinstance(value, (bool, int, float, str, decimal.Decimal))
    if isinstance(dtype, nulls.TEMPORAL):
        if isinstance(value, str):
            try:
                dt.datetime.fromisoformat(value.strip())
            except ValueError:
                return False
        return isinstance(value, (str, dt.date))
    if isinstance(dtype, T.BooleanType):
        return isinstance(value, bool) or value in (0, 1) or str(value).lower() in ("true", "false")
    return True


def constant(value: Any, dtype: T.DataType) -> Column:
    """The constant as a literal that compares with the column without casting the column."""
    if isinstance(dtype, nulls.NUMERIC):
        return F.lit(float(value)) if isinstance(value, str) else F.lit(value)
    if isinstance(dtype, T.BooleanType):
        return F.lit(value if isinstance(value, bool) else str(value).lower() in ("1", "1.0", "true"))
    return F.lit(value).cast(dtype)


def _ordered(c: Column, op: Op, value: Column) -> Column:
    if op is Op.gt:
        return c > value
    if op is Op.lt:
        return c < value
    if op is Op.gte:
        return c >= value
    return c <= value


def predicate(df: DataFrame, f: Filter) -> Column:
    """Boolean column of one filter, never NULL-dependent on the caller's side."""
    try:
        op = Op(f.operator)
    except ValueError:
        raise ToolError(f"Unsupported filter operator: {f.operator}") from None
    dtype = df.schema[f.column].dataType
    c = nulls.col(f.column)
    if op is Op.is_null:
        return c.isNull()
    if op is Op.is_not_null:
        return c.isNotNull()
    if op is Op.contains:
        pattern = str(f.value)
        text = c.cast("string")
        return text.rlike(pattern) if _META.search(pattern) else text.contains(pattern)
    if op in (Op.in_, Op.not_in):
        values = list(f.value) if isinstance(f.value, (list, tuple, set, frozenset)) else [f.value]
        known = [constant(v, dtype) for v in values if v is not None and _fits(v, dtype)]
        hit = nulls.one_of(c, known, with_null=None in values)
        return hit if op is Op.in_ else ~hit
    if f.value is None or not _fits(f.value, dtype):
        if op is Op.eq:
            return F.lit(False)
        if op is Op.ne:
            return F.lit(True)
        raise ToolError(f"Cannot compare column '{f.column}' ({dtype.simpleString()}) with {f.value!r}")
    value = constant(f.value, dtype)
    if op is Op.eq:
        return c == value
    if op is Op.ne:
        return nulls.ne(c, value)
    return _ordered(c, op, value)
