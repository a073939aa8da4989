"""Import of CSV, Parquet and JSON files as named tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import ToolError
from tablewright.functions import nulls, parse
from tablewright.operators.predicates import table_of
from tablewright.sources.registry import child_names
from tablewright.specs import PREVIEW_ROWS

MIN_DATE_SHARE = 0.5
# Words that stand for a missing value in a CSV.
MISSING_WORDS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
FORMATS = ("csv", "parquet", "json")


def table_name(name: str) -> str:
    """Safe identifier: the runs of letters a-z and digits, joined by underscores.

    A leading digit gets `t_` before it, and a name without any such run is `table`.
    """
    joined = "_".join(re.findall("[a-z0-9]+", name.lower()))
    return f"t_{joined}" if joined[:1].isdigit() else joined or "table"


def unique_table_names(names: Iterable[str]) -> list[str]:
    """Safe names in order, all different: the first free of name, name_1, name_2 and so on.

    Names that are safe as they stand keep themselves before numbers are given out.
    """
    wanted = [table_name(n) for n in names]
    free = set(wanted)  # names that some table has by right
    taken: set[str] = set()
    out = []
    for safe in wanted:
        numbered = (f"{safe}_{i}" for i in count(1))
        chosen = safe if safe not in taken else next(n for n in numbered if n not in taken | free)
        taken.add(chosen)
        out.append(chosen)
    return out


# What a CSV file means, for batch, stream and results: quotes inside quotes are doubled.
CSV_OPTIONS = {"header": True, "escape": '"'}


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """One file or folder of files.

    Without a schema the types of a CSV are found by a pass over all its values; give one
    to save that pass. Large CSV files are split; `multi_line=True` reads each file in one
    task and is needed where quoted values hold line breaks.
    """
    df = _raw(spark, path, fmt, schema, multi_line)
    return _recognised(df, numbers=True) if fmt == "csv" and schema is None else df


def _raw(spark, path: str, fmt: str, schema=None, multi_line: bool = False) -> DataFrame:
    if fmt not in FORMATS:
        raise ToolError(f"Unsupported format '{fmt}'. Allowed: {FORMATS}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        return reader.options(**CSV_OPTIONS).csv(path, multiLine=multi_line)
    return reader.json(path) if fmt == "json" else reader.parquet(path)


def normalise_table(df: DataFrame, kept: Mapping[str, str] | None = None) -> DataFrame:
    """NaN and blank text become NULL; text columns that mostly read as dates become timestamps.

    One pass counts, for every text column, how many values each date format reads. The
    best format is used for the column when it reads at least half of the values. `kept`
    says how columns are to be read instead, as `date_readings` found it for an earlier part.
    """
    return _recognised(df, dates=True) if kept is None else _read_as(df, kept)


def date_readings(df: DataFrame) -> dict[str, str]:
    """How each text column is read: a date format, or `filled` for text that stays text."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    hits = _hits(df, {n: _readings(_filled(n), False, True) for n in texts}) if texts else {}
    return {n: _best_reading(h) for n, h in hits.items()}


def _read_as(df: DataFrame, kept: Mapping[str, str]) -> DataFrame:
    df = nulls.without_nan(df)
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(*[
        (_readings(_filled(n), False, True)[kept.get(n, "filled")] if n in texts else nulls.col(n)).alias(n) for n in df.columns])


def _filled(name: str) -> Column:
    return F.when(parse.trimmed(nulls.col(name)) != "", nulls.col(name))


def _readings(c: Column, numbers: bool, dates: bool) -> dict[str, Column]:
    found = {"filled": c}
    if numbers:
        found |= {"bigint": c.try_cast("bigint"), "double": parse.to_number(c), "boolean": _boolean(c)}
    if dates:
        found |= {f: parse.to_time(c, f) for f in parse.DATE_FORMATS}
    return found


def _hits(df: DataFrame, read: Mapping[str, Mapping[str, Column]]) -> dict[str, dict[str, int]]:
    """How many values of each column each reading accepts, from one aggregate."""
    counts = df.agg(*[F.count(c).alias(f"{i}.{kind}") for i, n in enumerate(read) for kind, c in read[n].items()]).first()
    return {n: {kind: counts[f"{i}.{kind}"] for kind in read[n]} for i, n in enumerate(read)}


def _recognised(df: DataFrame, numbers: bool = False, dates: bool = False) -> DataFrame:
    """Text columns with the types their values have, decided by one aggregate over all of them.

    A column becomes bigint, double or boolean only if every value does.
    """
    df = nulls.without_nan(df)
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    if numbers:
        df = df.withColumns({n: F.when(~nulls.col(n).isin(*MISSING_WORDS), nulls.col(n)) for n in texts})
    read = {n: _readings(_filled(n), numbers, dates) for n in texts}
    out = {n: read[n][_best_reading(hits)] for n, hits in _hits(df, read).items()}
    return df.select(*[(out[n] if n in out else nulls.col(n)).alias(n) for n in df.columns])


def _best_reading(hits: Mapping[str, int]) -> str:
    present = hits["filled"]
    if present == 0:
        return "filled"
    for kind in ("bigint", "double", "boolean"):
        if hits.get(kind) == present:
            return kind
    by_format = {f: hits[f] for f in parse.DATE_FORMATS if f in hits}
    best = max(by_format, key=by_format.get, default=None)
    return best if best and by_format[best] / present >= MIN_DATE_SHARE else "filled"


def _boolean(c: Column) -> Column:
    return F.when(c.isin("True", "TRUE", "true"), True).when(c.isin("False", "FALSE", "false"), False)


def import_tables(sources: Mapping[str, DataFrame], normalise: bool = True) -> dict[str, DataFrame]:
    """Named tables under safe unique names, empty ones left out."""
    kept = _not_empty(sources)
    return {n: normalise_table(df) if normalise else df for n, df in kept.items()}


def _not_empty(sources: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    kept = {n: df for n, df in sources.items() if not df.isEmpty()}
    if not kept:
        raise ToolError("There is no table with rows")
    return dict(zip(unique_table_names(kept), kept.values(), strict=True))


def import_directory(
    spark: SparkSession, path: str, fmt: str = "csv", normalise: bool = True, multi_line: bool = False
) -> dict[str, DataFrame]:
    """Every file or sub-folder of a folder as one table; numbers and dates of a CSV in one pass."""
    found = {}
    for name, is_folder in child_names(spark, path):
        stem, dot, suffix = name.rpartition(".")
        other = suffix in FORMATS and suffix != fmt
        if name.startswith(("_", ".")) or (dot and other) or not (is_folder or suffix == fmt):
            continue
        found[stem if dot and suffix == fmt else name] = _raw(spark, f"{path}/{name}", fmt, None, multi_line)
    if not found:
        raise ToolError(f"No {fmt} tables in {path}")
    is_csv = fmt == "csv"
    return {
        n: _recognised(df, numbers=is_csv, dates=normalise) if is_csv or normalise else df
        for n, df in _not_empty(found).items()
    }


def preview(tables: Mapping[str, DataFrame], name: str, limit: int = PREVIEW_ROWS) -> DataFrame:
    return table_of(tables, name).limit(limit)


def table_info(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: name, row count, column count, column names."""
    if not tables:
        raise ToolError("No tables")
    rows = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.union, rows)
