"""Cleaning operations, batches of them, and the row counts of every step."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import ToolError
from tablewright.functions import nulls, parse
from tablewright.operators.aggregates import exact_quantiles
from tablewright.operators.predicates import _fits, constant
from tablewright.specs import RUNNABLE, CleaningKind, CleaningStep, Status
from tablewright.staging import stage

# A mapping with more entries is joined instead of being spelled out in the expression; the rows are the same.
INLINE_MAPPING = 200


def drop_rows(df: DataFrame, column: str) -> DataFrame:
    """Keep the rows in which the column has a value."""
    return df.filter(_present(df, column))


def _present(df: DataFrame, column: str) -> Column:
    """A value that is neither NULL nor NaN, as for `fill_missing`."""
    return nulls.nan_to_null(nulls.col(column), df.schema[column].dataType).isNotNull()


def fill_missing(df: DataFrame, column: str, fill_value="Unknown") -> DataFrame:
    """Missing values become a constant of the column's own type."""
    dtype = df.schema[column].dataType
    if not _fits(fill_value, dtype):
        raise ToolError(f"Cannot fill column '{column}' ({dtype.simpleString()}) with {fill_value!r}")
    value = constant(fill_value, dtype).cast(dtype)
    return df.withColumn(column, F.coalesce(nulls.nan_to_null(nulls.col(column), dtype), value))


def deduplicate(df: DataFrame) -> DataFrame:
    """One row of each group of equal rows; copies are combined before the shuffle."""
    return df.dropDuplicates()


def strip_whitespace(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, parse.trimmed(nulls.col(column).cast("string")))


def cast_number(df: DataFrame, column: str) -> DataFrame:
    """Text to double, unreadable values to NULL; numbers stay what they are."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, nulls.NUMERIC):
        return df
    if isinstance(dtype, T.BooleanType):
        return df.withColumn(column, nulls.col(column).cast("double"))
    return df.withColumn(column, parse.to_number(nulls.col(column).cast("string")))


def parse_dates(df: DataFrame, column: str) -> DataFrame:
    """Text to timestamp value by value, unreadable values to NULL."""
    if isinstance(df.schema[column].dataType, nulls.TEMPORAL):
        return df
    return df.withColumn(column, parse.to_time_any(nulls.col(column).cast("string")))


def normalize_format(df: DataFrame, column: str, mapping: Mapping) -> DataFrame:
    """Exact replacement of values; values that are not in the mapping stay."""
    dtype = df.schema[column].dataType
    entries = [(constant(k, dtype).cast(dtype), F.lit(v).cast(dtype)) for k, v in mapping.items() if k is not None and _fits(k, dtype)]
    if not entries:
        return df
    c = nulls.col(column)
    if len(entries) <= INLINE_MAPPING:
        out = F
        for old, new in entries:
            out = out.when(c == old, new)
        return df.withColumn(column, out.otherwise(c))
    # The same literals as rows. Of keys that are equal in the column's type the first counts,
    # as in the chain above, so the number of entries decides about the plan only.
    rows = F.explode(F.array(*[F.struct(old.alias("old"), F.lit(i).alias("at"), new.alias("new")) for i, (old, new) in enumerate(entries)]))
    old, hit = (f"__{part}_{uuid.uuid4().hex}" for part in ("old", "hit"))
    first = df.sparkSession.range(1).select(rows.alias("e")).select("e.*").groupBy(F.col("old").alias(old)).agg(F.min(F.struct("at", "new")).alias(hit))
    joined = df.join(first, c == F.col(old), "left")
    return joined.withColumn(column, F.when(F.col(hit).isNotNull(), F.col(f"{hit}.new")).otherwise(c)).drop(old, hit)


def replace_value(df: DataFrame, column: str, old, new) -> DataFrame:
    return normalize_format(df, column, {old: new})


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(nulls.col(column))


def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    if new_name in df.columns:
        raise ToolError(f"Column '{new_name}' exists already")
    return df.withColumnRenamed(column, new_name)


def outlier_bounds(df: DataFrame, column: str, factor: float = 1.5) -> tuple[float, float] | None:
    """Quartiles widened by `factor` times their distance; None without values."""
    found = exact_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], [column], [0.25, 0.75]).first()
    if found is None:
        return None
    q1, q3 = found["q0"], found["q1"]
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def clip_outlier(df: DataFrame, column: str, lower=None, upper=None, factor: float = 1.5) -> DataFrame:
    """Numbers outside the bounds move to the nearest bound; bounds default to the quartile rule."""
    dtype = df.schema[column].dataType
    if not isinstance(dtype, nulls.NUMERIC):
        raise ToolError(f"Column '{column}' is not a number")
    if lower is None and upper is None:
        bounds = outlier_bounds(df, column, factor)
        if bounds is None:
            return df
        lower, upper = bounds
    c = nulls.col(column)
    out = c
    if upper is not None:
        out = F.when(out > F.lit(upper), F.lit(upper)).otherwise(out)
    if lower is not None:
        out = F.when(c < F.lit(lower), F.lit(lower)).otherwise(out)
    return df.withColumn(column, out)


_NEEDS_COLUMN = set(CleaningKind) - {CleaningKind.deduplicate, CleaningKind.ignore_issue}
# Operations after which the column is still there and its values may differ.
_CHANGES_VALUES = {
    CleaningKind.fill_missing,
    CleaningKind.replace_value,
    CleaningKind.cast_type,
    CleaningKind.strip_whitespace,
    CleaningKind.normalize_format,
    CleaningKind.clip_outlier,
    CleaningKind.parse_dates,
}


def apply_step(df: DataFrame, step: CleaningStep) -> DataFrame:
    """One operation on one table. A column that is not there leaves the table as it is."""
    kind, column, p = CleaningKind(step.kind), step.column, dict(step.parameters)
    if kind in _NEEDS_COLUMN and (not column or column not in df.columns):
        return df
    if kind is CleaningKind.ignore_issue:
        return df
    if kind is CleaningKind.deduplicate:
        return deduplicate(df)
    if kind is CleaningKind.drop_rows:
        return drop_rows(df, column)
    if kind is CleaningKind.fill_missing:
        return fill_missing(df, column, p.get("fill_value", "Unknown"))
    if kind is CleaningKind.strip_whitespace:
        return strip_whitespace(df, column)
    if kind is CleaningKind.cast_type:
        return cast_number(df, column)
    if kind is CleaningKind.parse_dates:
        return parse_dates(df, column)
    if kind is CleaningKind.normalize_format:
        return normalize_format(df, column, p.get("mapping", {}))
    if kind is CleaningKind.replace_value:
        return replace_value(df, column, p["old"], p["new"])
    if kind is CleaningKind.drop_column:
        return drop_column(df, column)
    if kind is CleaningKind.rename_column:
        return rename_column(df, column, p["new_name"])
    return clip_outlier(df, column, p.get("lower"), p.get("upper"), p.get("factor", 1.5))


@dataclass
class _Stretch:
    """Steps of one table between two deduplications, all computed from one scan."""

    frame: DataFrame
    counts: list[tuple[int, str, Column]] = field(default_factory=list)


@dataclass(frozen=True)
class StepNote:
    sequence: int
    step: CleaningStep
    status: Status
    error: str | None = None


@dataclass(frozen=True)
class CleaningRun:
    tables: dict[str, DataFrame]
    notes: list[StepNote]
    stretches: list[_Stretch]
    spark: SparkSession

    @property
    def failed(self) -> list[StepNote]:
        return [n for n in self.notes if n.status is Status.failed]

    def metrics(self) -> DataFrame:
        """One row per step: rows before and after, removed and changed, status and error."""
        noted = self.spark.createDataFrame(
            [
                (n.sequence, n.step.step_id, n.step.table, str(n.step.kind), str(n.status),
                 [n.step.column] if n.step.column and n.status is not Status.failed
                 and n.step.outcome in RUNNABLE else [], n.error)
                for n in self.notes
            ],
            "sequence int, step_id string, table_name string, operation string, status string, "
            "columns_changed array<string>, error string",
        )
        parts = [_counted(s) for s in self.stretches if s.counts]
        if not parts:
            parts = [noted.select("sequence", *[F.lit(0).cast("bigint").alias(n) for n in _COUNTS]).limit(0)]
        counted = reduce(DataFrame.unionByName, parts).groupBy("sequence").agg(
            *[F.max(n).alias(n) for n in _COUNTS]
        )
        before = F.coalesce("before", F.lit(0))
        removed = F.coalesce("removed", F.col("before") - F.col("after"), F.lit(0))
        return noted.join(counted, "sequence", "left").select(
            "sequence", "step_id", "table_name", "operation", "status",
            before.alias("rows_before"),
            (before - removed).alias("rows_after"),
            removed.alias("rows_removed"),
            F.coalesce("changed", F.lit(0)).alias("rows_changed"),
            "columns_changed", "error",
        )

    def summary(self) -> DataFrame:
        """One row for the whole run."""
        m = self.metrics()
        status = F.col("status")
        seen = m.select("sequence", F.explode("columns_changed").alias("c")).groupBy("c").agg(
            F.min("sequence").alias("first")
        ).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "c"))), lambda s: s.c).alias("columns_changed"))
        totals = m.agg(
            F.count(F.lit(1)).alias("total_steps"),
            F.count_if(status == Status.success).alias("executed_steps"),
            F.count_if(status == Status.skipped).alias("skipped_steps"),
            F.count_if(status == Status.failed).alias("failed_steps"),
            F.coalesce(F.sum("rows_before"), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum("rows_removed"), F.lit(0)).alias("rows_removed"),
        )
        sizes = reduce(
            DataFrame.union, [t.agg(F.count(F.lit(1)).alias("n")) for t in self.tables.values()]
        ).agg(F.sum("n").alias("rows_after"))
        # Three one-row tables put side by side.
        parts = totals.unionByName(sizes, allowMissingColumns=True).unionByName(seen, allowMissingColumns=True)
        names = ("total_steps", "executed_steps", "skipped_steps", "failed_steps",
                 "rows_before", "rows_after", "rows_removed", "columns_changed")
        return parts.agg(*[F.max(n).alias(n) for n in names])


_COUNTS = ("before", "after", "removed", "changed")


def _counted(s: _Stretch) -> DataFrame:
    """The counts of a stretch as rows (sequence, before, after, removed, changed)."""
    row = s.frame.agg(*[c.alias(f"m{i}") for i, (_, _, c) in enumerate(s.counts)])
    lanes = []
    for i, (sequence, what, _) in enumerate(s.counts):
        lanes.append(F.lit(sequence))
        lanes += [F.col(f"m{i}") if what == n else F.lit(None).cast("bigint") for n in _COUNTS]
    return row.select(F.stack(F.lit(len(s.counts)), *lanes).alias("sequence", *_COUNTS))


class _Table:
    """A table on its way through the steps, with a second, counting copy beside it.

    The counting copy never filters: it marks rows that are gone in `alive`, so the
    counts of all steps up to the next deduplication come from one aggregate. Counting
    in a query of its own gives right numbers also when tasks are repeated.
    """

    def __init__(self, df: DataFrame):
        self.data = df
        self.start(df)

    def start(self, df: DataFrame) -> None:
        self.counting = df.withColumn("__alive", F.lit(True))
        self.stretch = _Stretch(self.counting)
        self.extra: list[str] = []

    def note(self, sequence: int, what: str, flag: Column) -> None:
        name = f"__f{len(self.extra)}"
        self.counting = self.counting.withColumn(name, flag)
        self.extra.append(name)
        self.stretch.counts.append((sequence, what, F.count_if(F.col(name))))
        self.stretch.frame = self.counting


def apply_cleaning(
    tables: Mapping[str, DataFrame],
    steps: Iterable[CleaningStep],
    stage_deduplicated: bool = False,
) -> CleaningRun:
    """Apply the steps in order to lazy tables.

    A step whose outcome does not allow it is skipped; an unknown table or operation, or
    a step that cannot be planned, fails alone. With `stage_deduplicated` the result of
    a deduplication is written once to the shared folder, so that writing the table and
    counting its rows do not shuffle it twice.
    """
    at = {name: _Table(df) for name, df in tables.items()}
    notes, stretches = [], [t.stretch for t in at.values()]
    for sequence, step in enumerate(steps, 1):
        table = at.get(step.table)
        if table is not None:
            table.note(sequence, "before", F.col("__alive"))
        if step.outcome not in RUNNABLE:
            notes.append(StepNote(sequence, step, Status.skipped))
            continue
        if table is None or step.kind not in set(CleaningKind):
            what = f"Unsupported operation: {step.kind}" if table else f"Table '{step.table}' not found"
            notes.append(StepNote(sequence, step, Status.failed, what))
            continue
        try:
            _advance(table, sequence, step, stage_deduplicated, stretches)
        except (ToolError, PySparkException) as error:
            notes.append(StepNote(sequence, step, Status.failed, str(error)))
        except KeyError as error:
            notes.append(StepNote(sequence, step, Status.failed, f"Missing parameter {error}"))
        else:
            done = Status.skipped if step.kind == CleaningKind.ignore_issue else Status.success
            notes.append(StepNote(sequence, step, done))
    spark = next(iter(tables.values())).sparkSession
    return CleaningRun({n: t.data for n, t in at.items()}, notes, stretches, spark)


def _advance(t: _Table, sequence: int, step: CleaningStep, staged: bool, stretches: list) -> None:
    kind, column = CleaningKind(step.kind), step.column
    step = _with_bounds(t.data, step)
    data = apply_step(t.data, step)
    if kind is CleaningKind.deduplicate:
        t.data = stage(data, "deduplicated") if staged else data
        t.start(t.data)
        stretches.append(t.stretch)
        t.note(sequence, "after", F.col("__alive"))
        return
    present = bool(column) and column in t.data.columns
    if present and kind is CleaningKind.drop_rows:
        gone = ~_present(t.data, column)
        t.note(sequence, "removed", F.col("__alive") & gone)
        t.counting = t.counting.withColumn("__alive", F.col("__alive") & ~gone)
    elif present and kind in _CHANGES_VALUES:
        before = t.counting.withColumn("__old", nulls.col(column))
        t.counting = apply_step(before, step)
        changed = ~F.col("__old").cast("string").eqNullSafe(nulls.col(column).cast("string"))
        if data.schema[column].dataType == t.data.schema[column].dataType:
            changed = ~F.col("__old").eqNullSafe(nulls.col(column))
        t.note(sequence, "changed", F.col("__alive") & changed)
        t.counting = t.counting.drop("__old")
    elif present:
        t.counting = apply_step(t.counting, step)
    t.data = data


def _with_bounds(data: DataFrame, step: CleaningStep) -> CleaningStep:
    """A clip step with its bounds computed once, for the table and for its counting copy."""
    clips = step.kind == CleaningKind.clip_outlier and step.column in data.columns
    if not clips or {"lower", "upper"} & set(step.parameters) or not isinstance(data.schema[step.column].dataType, nulls.NUMERIC):
        return step
    bounds = outlier_bounds(data, step.column, step.parameters.get("factor", 1.5))
    if bounds is None:
        return step
    return replace(step, parameters={**step.parameters, "lower": bounds[0], "upper": bounds[1]})
