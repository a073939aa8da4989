"""Declarative requests: what to read, filter, join, aggregate, derive, clean or chart."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from enum import StrEnum
from typing import Any

PREVIEW_ROWS = 100
RESULT_ROWS = 500


class VersionType(StrEnum):
    original = "original"
    cleaned = "cleaned"
    enriched = "enriched"
    filtered = "filtered"
    joined = "joined"
    aggregated = "aggregated"


class ViewSource(StrEnum):
    query = "query"
    aggregation = "aggregation"
    pivot = "pivot"
    join = "join"
    filter = "filter"
    feature_result = "feature_result"
    visualization_result = "visualization_result"
    chat_output = "chat_output"
    manual = "manual"


class Op(StrEnum):
    """Filter operators."""

    eq = "eq"
    ne = "ne"
    gt = "gt"
    lt = "lt"
    gte = "gte"
    lte = "lte"
    in_ = "in"
    not_in = "not_in"
    is_null = "is_null"
    is_not_null = "is_not_null"
    contains = "contains"


class Agg(StrEnum):
    count = "count"
    sum = "sum"
    avg = "avg"
    min = "min"
    max = "max"
    median = "median"


class Period(StrEnum):
    day = "day"
    week = "week"
    month = "month"
    quarter = "quarter"
    year = "year"


class CleaningKind(StrEnum):
    drop_rows = "drop_rows"
    fill_missing = "fill_missing"
    replace_value = "replace_value"
    cast_type = "cast_type"
    strip_whitespace = "strip_whitespace"
    normalize_format = "normalize_format"
    drop_column = "drop_column"
    rename_column = "rename_column"
    deduplicate = "deduplicate"
    clip_outlier = "clip_outlier"
    ignore_issue = "ignore_issue"
    parse_dates = "parse_dates"


class FeatureKind(StrEnum):
    ratio = "ratio"
    arithmetic = "arithmetic"
    aggregate = "aggregate"
    window = "window"
    period_change = "period_change"
    date_extract = "date_extract"
    bucketize = "bucketize"
    custom_formula = "custom_formula"


class ChartKind(StrEnum):
    line = "line"
    bar = "bar"
    scatter = "scatter"
    histogram = "histogram"
    pie = "pie"
    heatmap = "heatmap"
    box = "box"
    area = "area"
    table = "table"


class Status(StrEnum):
    success = "success"
    skipped = "skipped"
    failed = "failed"


class Outcome(StrEnum):
    approved = "approved"
    rejected = "rejected"
    modified = "modified"
    auto_approved = "auto_approved"
    blocked = "blocked"
    skipped = "skipped"


RUNNABLE = (Outcome.approved, Outcome.auto_approved, Outcome.modified)


@dataclass(frozen=True)
class Filter:
    column: str
    operator: Op | str
    value: Any = None


@dataclass(frozen=True)
class Metric:
    column: str
    aggregation: Agg | str
    alias: str | None = None
    # median only: percentile_approx in one pass instead of the exact two-pass answer
    approx: bool = False

    @property
    def output(self) -> str:
        return self.alias or f"{Agg(self.aggregation)}_{self.column}"


@dataclass(frozen=True)
class PreviewTable:
    """First rows of chosen columns. `limit=None` keeps every row; below that is the default."""

    table: str
    columns: Sequence[str] = ()
    limit: int | None = PREVIEW_ROWS


@dataclass(frozen=True)
class FilterTable:
    table: str
    filters: Sequence[Filter] = ()
    columns: Sequence[str] = ()
    sort_by: str | None = None
    sort_desc: bool = False
    limit: int | None = None


@dataclass(frozen=True)
class AggregateTable:
    table: str
    group_by: Sequence[str]
    metrics: Sequence[Metric]
    sort_by: str | None = None
    sort_desc: bool = True
    limit: int | None = None
    date_trunc_period: Period | str | None = None


@dataclass(frozen=True)
class SimpleJoin:
    left: str
    right: str
    key_left: str
    key_right: str
    output_columns: Sequence[str] = ()
    limit: int | None = None


@dataclass(frozen=True)
class TopN:
    """Most frequent items of each group: items in one column, one row per occurrence."""

    table: str
    partition: str
    item: str
    n: int = 1


@dataclass(frozen=True)
class TopNWide:
    """Largest items of each group: one column of amounts per item."""

    table: str
    partition: str
    items: Sequence[str]
    n: int = 1


@dataclass(frozen=True)
class SqlQuery:
    sql: str


@dataclass(frozen=True)
class GenerateVisual:
    table: str
    chart_type: ChartKind | str
    x_column: str
    y_column: str | None = None
    aggregation: str | None = None


@dataclass(frozen=True)
class CleaningStep:
    """One operation on one table; `outcome` says whether it may run."""

    table: str
    kind: CleaningKind | str
    column: str | None = None
    parameters: Mapping[str, Any] = field(default_factory=dict)
    outcome: Outcome | str = Outcome.approved
    step_id: str = ""


@dataclass(frozen=True)
class Feature:
    name: str
    kind: FeatureKind | str
    table: str
    required_columns: Sequence[str] = ()
    parameters: Mapping[str, Any] = field(default_factory=dict)
    output_column: str | None = None
    output_table: str | None = None
    feature_id: str = ""


@dataclass(frozen=True)
class Chart:
    table: str
    kind: ChartKind | str
    x_column: str
    y_column: str | None = None
    aggregation: str | None = None
    sort: str | None = None
    limit: int | None = None
    title: str = ""
    chart_id: str = ""
    # scatter only: seed for a random choice of points instead of the first ones
    sample_seed: int | None = None
