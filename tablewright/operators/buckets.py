"""Cutting a number into intervals that are open on the left and closed on the right."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import ToolError
from tablewright.functions import nulls


def by_edges(c: Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Label of the interval (a, b] the value falls into; NULL outside and at the lowest edge."""
    if any(a >= b for a, b in zip(edges, edges[1:])):
        raise ToolError("Bin edges must increase")
    if len(edges) < 2:
        raise ToolError("At least two bin edges are needed")
    if labels is None:
        labels = [f"({a}, {b}]" for a, b in zip(edges, edges[1:])]
    if len(labels) != len(edges) - 1:
        raise ToolError("One label per interval is needed")
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = (c > F.lit(low)) & (c <= F.lit(high))
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def equal_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of equal intervals; the lowest is moved down so that the minimum is inside."""
    if low == high:
        margin = 0.001 * abs(low) if low else 0.001
        low, high = low - margin, high + margin
        return [low + (high - low) * i / bins for i in range(bins)] + [high]
    edges = [low + (high - low) * i / bins for i in range(bins)] + [high]
    edges[0] -= (high - low) * 0.001
    return edges


def _shown(x: float, digits: int) -> float:
    """Rounded for a label: three decimals, or three digits for fractions below one."""
    if not math.isfinite(x) or x == 0:
        return x
    whole = int(abs(x))
    places = digits if whole else -math.floor(math.log10(abs(x))) - 1 + digits
    return round(x, places)


def interval_labels(edges: Sequence[float]) -> list[str]:
    digits = 3
    shown = [_shown(e, digits) for e in edges]
    while len(set(shown)) < len(shown) and digits < 20:
        digits += 1
        shown = [_shown(e, digits) for e in edges]
    return [f"({a}, {b}]" for a, b in zip(shown, shown[1:])]


def value_range(df: DataFrame, column: str) -> tuple[float, float] | None:
    """Smallest and largest number of a column (one pre-aggregated pass), None without values."""
    c = nulls.nan_to_null(nulls.col(column), df.schema[column].dataType)
    low, high = df.agg(F.min(c).cast("double"), F.max(c).cast("double")).first()
    return None if low is None else (low, high)


def by_count(df: DataFrame, column: str, bins: int, labels: Sequence[str] | None = None) -> Column:
    """Label of one of `bins` intervals of equal width between minimum and maximum."""
    if bins < 1:
        raise ToolError("The number of bins must be positive")
    bounds = value_range(df, column)
    if bounds is None:
        return F.lit(None).cast("string")
    edges = equal_edges(*bounds, bins)
    return by_edges(nulls.col(column).cast("double"), edges, labels or interval_labels(edges))
