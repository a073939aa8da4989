"""Column statistics and quality issues of tables.

One job of aggregates over the table, a few columns each and without a shuffle of values, gives all that adds up: counts of
present, numeric, dated and padded cells, extremes, means and spreads. Exact quantiles narrow down
their ranks by counts (`quantiles`). Only distinct counts and top values need the values themselves:
cells become (column, value) pairs in typed lanes, equal pairs are counted map-side first, and both
come from one shuffle of these counts. Long texts take part as their start and 128 bits of hash.
Nothing is gathered per column into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import ids, nulls, parse, words
from tablewright.operators.aggregates import duplicate_count
from tablewright.operators.quantiles import GATHERED, quantiles
from tablewright.staging import held, side_by_side, small

TOP_VALUES = 5
SAMPLE_VALUES = 3
_DAY = 86_400_000_000


@dataclass(frozen=True)
class Profile:
    """`columns` has one row per table and column, `issues` one row per finding."""

    columns: DataFrame
    issues: DataFrame


# How a Spark type is labelled and which lane carries its values.
_KINDS: list[tuple[tuple[type, ...], str, str]] = [
    ((T.BooleanType,), "boolean", "boolean"),
    (nulls.INTEGRAL, "integer", "integer"),
    (nulls.FRACTIONAL, "float", "float"),
    ((T.DecimalType,), "decimal", "float"),
    ((T.DateType,), "day", "datetime"),
    ((T.TimestampType,), "instant", "datetime"),
    ((T.TimestampNTZType,), "wallclock", "datetime"),
    ((T.StringType,), "text", "text"),
]


def kind_of(dtype: T.DataType) -> tuple[str, str]:
    for types, kind, label in _KINDS:
        if isinstance(dtype, types):
            return kind, label
    return "nested", "unknown"


def _lanes(field: T.StructField) -> tuple[Column, Column, Column]:
    """(bigint, double, text) of one cell; a value fills the lanes its type needs, a missing one none."""
    c = nulls.col(field.name)
    no_i, no_d, no_t = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))
    kind, _ = kind_of(field.dataType)
    if kind in ("boolean", "integer"):
        return c.cast("bigint"), no_d, no_t
    if kind == "float":
        return no_i, nulls.nan_to_null(c, field.dataType).cast("double"), no_t
    if kind == "decimal":
        return no_i, no_d, c.cast("string")
    if kind == "day":
        return F.unix_date(c).cast("bigint"), no_d, no_t
    if kind == "instant":
        return F.unix_micros(c), no_d, no_t
    if kind == "wallclock":
        return parse.micros(c), no_d, no_t
    long = F.length(c) > ids.LONG_TEXT
    return F.when(long, F.xxhash64(c)), no_d, F.when(long, _long_key(c)).otherwise(c)


def _long_key(c: Column) -> Column:
    """Stands for a long text, beside a hash of it: its start, for the order, and another hash."""
    return F.concat(F.substring(c, 1, ids.LONG_TEXT), F.lpad(F.hex(F.xxhash64(c, F.lit(1))), 16, "0"))


def _cells(df: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """(c, i, d, t): one row per present cell of some columns, column number and value in its lane."""
    lanes = [p for no in numbers for p in (F.lit(no), *_lanes(df.schema[no]))]
    cells = df.select(F.stack(F.lit(len(numbers)), *lanes).alias("c", "i", "d", "t"))
    return cells.filter(F.col("i").isNotNull() | F.col("d").isNotNull() | F.col("t").isNotNull())


def value_counts(df: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """(c, i, d, t, n): a cell value and the number of rows that have it."""
    return _cells(df, numbers).groupBy("c", "i", "d", "t").agg(F.count(F.lit(1)).alias("n"))


class _Columns:
    """Which column numbers are of which kind."""

    def __init__(self, schema: T.StructType):
        self.numbers: dict[str, list[int]] = {}
        for no, f in enumerate(schema):
            self.numbers.setdefault(kind_of(f.dataType)[0], []).append(no)

    def text(self, number: int) -> bool:
        return number in self.numbers.get("text", [])

    def are(self, *kinds: str) -> Column:
        wanted = [no for k in kinds for no in self.numbers.get(k, [])]
        return F.col("c").isin(wanted) if wanted else F.lit(False)


#: What one aggregate over the table tells about a column: names and types.
SCALARS = {
    "total": "bigint", "present": "bigint", "numeric_rows": "bigint", "date_rows": "bigint", "date_only_rows": "bigint",
    "padded_rows": "bigint", "num_min": "double", "num_max": "double", "num_mean": "double", "num_std": "double",
    "first_at": "bigint", "last_at": "bigint",
}
_SKETCHES = {
    "unique": "bigint", "date_unique": "bigint", "num_q1": "double", "num_median": "double", "num_q3": "double", "top_values": "array<string>",
}


def _read(field: T.StructField) -> dict[str, Column]:
    """A cell as what it may be: present value, number `x`, point in time `at`, padded text."""
    c = nulls.col(field.name)
    kind, _ = kind_of(field.dataType)
    if kind == "text":
        return {"v": c, "x": parse.to_number(c), "at": parse.micros(parse.to_time_any(c)), "padded": parse.is_padded(c)}
    if kind in ("integer", "float", "decimal"):
        number = nulls.nan_to_null(c, field.dataType).cast("double")
        return {"v": number, "x": number}
    if kind in ("day", "instant", "wallclock"):
        return {"v": c, "at": _lanes(field)[0] * F.lit(_DAY if kind == "day" else 1)}
    return {"v": c}


#: So many fields, of aggregates side by side, at most: generated code of more is too long to be compiled, and
#: Spark interprets aggregates of more than 100 of them.
_FIELDS = 40


def _sums(r: dict[str, Column], cell: Callable[[str], Column]) -> dict[str, Column]:
    """The aggregates of one column, without those that its type leaves empty."""
    none = {n: F.lit(0 if n.endswith("rows") else None).cast(t) for n, t in SCALARS.items()}
    own = {"total": F.count(F.lit(1)), "present": F.count(cell("v"))}
    if "x" in r:
        x = cell("x")
        own |= {"numeric_rows": F.count(x), "num_min": F.min(x), "num_max": F.max(x), "num_mean": F.avg(x), "num_std": F.stddev_samp(x)}
    if "at" in r:
        at = cell("at")
        only = at.isNotNull() & cell("x").isNull() if "x" in r else at.isNotNull()
        own |= {"date_rows": F.count(at), "date_only_rows": F.count_if(only), "first_at": F.min(at), "last_at": F.max(at)}
    if "padded" in r:
        own |= {"padded_rows": F.count_if(cell("padded"))}
    return none | own


def _summed(df: DataFrame, more: Callable[..., dict[str, Column]] | None = None) -> DataFrame:
    """`s`, what adds up over the cells of a few columns: a row for each few columns, an entry for each column."""
    readings = [_read(f) for f in df.schema]
    width = [2 + 7 * ("x" in r) + 4 * ("at" in r) + ("padded" in r) for r in readings]
    chunks: list[list[int]] = [[]]
    for no in range(len(readings)):
        if sum(width[n] for n in chunks[-1]) + width[no] > _FIELDS and chunks[-1]:
            chunks.append([])
        chunks[-1].append(no)
    rows = []
    for chunk in chunks:
        read = df.select(*[c.alias(f"{name}{no}") for no in chunk for name, c in readings[no].items()])
        parts = []
        for no in chunk:
            r, types = readings[no], {"v": "int", "x": "double", "at": "bigint"}
            own = _sums(r, lambda name, no=no: F.col(f"{name}{no}"))
            if more is not None:
                kind, _ = kind_of(df.schema[no].dataType)
                v, x, at = (F.col(f"{name}{no}") if name in r else F.lit(None).cast(t) for name, t in types.items())
                shown = v if kind == "text" else F.lit(None).cast("string") if kind == "nested" else _as_text(df.schema[no].dataType, v)
                own |= more(kind, v, x, at, shown)
            parts.append(F.struct(F.lit(no).alias("c"), *[p.alias(n) for n, p in own.items()]))
        rows.append(read.agg(F.array(*parts).alias("s")))
    return reduce(DataFrame.unionByName, rows)


def scalars(df: DataFrame, more: Callable[..., dict[str, Column]] | None = None) -> list[dict]:
    """For each column what adds up over its cells, from one job; each cell is read once.

    `more` adds aggregates of a column's kind, value, number, point in time and text.
    """
    return sorted((s.asDict() for row in _summed(df, more).collect() for s in row["s"]), key=lambda s: s["c"])


def _estimates(kind: str, v: Column, x: Column, at: Column, shown: Column) -> dict[str, Column]:
    """Distinct counts, quartiles and top values without a shuffle of values."""
    quartiles = F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000)
    top = F.transform(F.call_function("approx_top_k", shown, F.lit(TOP_VALUES)), lambda e: e.item)
    return dict(zip(_SKETCHES, (
        F.approx_count_distinct(shown), F.approx_count_distinct(at), *[F.get(quartiles, F.lit(i)) for i in range(3)], top)))


def _as_text(dtype: T.DataType, c: Column) -> Column:
    return c.cast("timestamp_ntz").cast("string") if isinstance(dtype, T.TimestampNTZType) else c.cast("string")


def _shown(columns: _Columns) -> Column:
    """A distinct value as text."""
    i = F.col("i")
    return (
        F.when(columns.are("boolean"), (i == 1).cast("string"))
        .when(columns.are("integer"), i.cast("string"))
        .when(columns.are("float"), F.col("d").cast("string"))
        .when(columns.are("day"), F.date_from_unix_date(i.cast("int")).cast("string"))
        .when(columns.are("instant"), F.timestamp_micros(i).cast("string"))
        .when(columns.are("wallclock"), parse.from_micros(i).cast("string"))
        .when(columns.are("decimal", "text"), F.col("t"))
    )


def _first(shown: DataFrame, *order: str) -> DataFrame:
    """The most frequent values of each column, equal frequencies in the given order."""
    best = Window.partitionBy("c").orderBy(F.col("n").desc(), *[F.col(o).asc() for o in order])
    ranked = shown.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP_VALUES)
    return ranked.select("c", "rank", "n", "start", "shown")


def _uniques_and_tops(df: DataFrame, numbers: Sequence[int], columns: _Columns) -> DataFrame:
    """At most five values a column, and as rank 0 its number of distinct ones.

    Both read the same shuffle of counts; without a look at n Spark would count and shuffle the values once
    more for the number of them.
    """
    counts = value_counts(df, numbers)
    unique = counts.filter("n > 0").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    nothing = F.lit(None).cast("string")
    return unique.select("c", F.lit(0).alias("rank"), "n", nothing.alias("start"), nothing.alias("shown")).unionByName(
        _first(_with_start(counts, columns), "start", "shown"))


def _values(df: DataFrame, columns: _Columns) -> dict[int, dict]:
    """For each column its number of distinct values and the most frequent ones, equal frequencies in text order."""
    numbers = [no for no, f in enumerate(df.schema) if kind_of(f.dataType)[0] != "nested"]
    if not numbers:
        return {}
    rows = _uniques_and_tops(df, numbers, columns).collect()
    tops: dict[int, list] = {}
    for r in sorted(r for r in rows if r["rank"] > 0):
        tops.setdefault(r["c"], []).append(r)
    wanted = [c for c, top in tops.items() if columns.text(c) and any(len(r["shown"]) > ids.LONG_TEXT for r in top)]
    if wanted:
        # A key tells the start of a text. Whole texts decide among all values that may still be among the first.
        last = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(tops[c][-1]["n"]).alias("n"), F.lit(tops[c][-1]["start"]).alias("start")) for c in wanted])
        own = _with_start(value_counts(df, wanted), columns)
        last = F.filter(last, lambda e: e.c == F.col("c"))[0]
        open_ = (F.col("n") > last.n) | ((F.col("n") == last.n) & (F.col("start") <= last.start))
        undecided, _ = held(own.filter(open_), "top")
        for c in wanted:
            tops[c] = []
        for r in sorted(_first(_with_long_texts(df, undecided, wanted), "shown").collect()):
            tops[r["c"]].append(r)
    return {r["c"]: {"unique": r["n"], "top_values": [t["shown"] for t in tops.get(r["c"], [])]} for r in rows if r["rank"] == 0}


def _with_start(counts: DataFrame, columns: _Columns) -> DataFrame:
    shown = counts.withColumn("shown", _shown(columns))
    return shown.select("c", "i", "n", "shown", F.substring("shown", 1, ids.LONG_TEXT).alias("start"))


def _with_long_texts(df: DataFrame, values: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """Replace the keys of long texts by the texts they stand for."""
    lanes = [p for no in wanted for p in (F.lit(no), nulls.col(df.columns[no]))]
    cells = df.select(F.stack(F.lit(len(wanted)), *lanes).alias("c", "text")).filter(F.length("text") > ids.LONG_TEXT)
    cells = cells.select("c", F.xxhash64("text").alias("i"), _long_key(F.col("text")).alias("shown"), "text")
    # One key is one text, so any copy of it will do.
    originals = cells.join(values.select("c", "i", "shown"), ["c", "i", "shown"], "left_semi").dropDuplicates(["c", "i", "shown"])
    return values.join(originals, ["c", "i", "shown"], "left").withColumn("shown", F.coalesce("text", "shown")).drop("text")


def _moments(df: DataFrame, facts: Sequence[dict]) -> dict[int, dict]:
    """Distinct points in time of columns whose texts, or some of them, read as dates."""
    texts = [s["c"] for s in facts if s["date_rows"] and kind_of(df.schema[s["c"]].dataType)[0] == "text"]
    if not texts:
        return {}
    lanes = [p for no in texts for p in (F.lit(no), _read(df.schema[no])["at"])]
    at = df.select(F.stack(F.lit(len(texts)), *lanes).alias("c", "at")).filter(F.col("at").isNotNull())
    rows = at.distinct().groupBy("c").agg(F.count(F.lit(1)).alias("date_unique")).collect()
    return {r["c"]: {"date_unique": r["date_unique"]} for r in rows}


def _quartiles(df: DataFrame, numbers: Sequence[int], gathered: int) -> dict[int, dict]:
    """Exact quartiles of some columns."""
    if not numbers:
        return {}
    rows = quantiles(df, [], [_read(df.schema[no])["x"] for no in numbers], [0.25, 0.5, 0.75], gathered).collect()
    return {numbers[r["metric"]]: {"num_q1": r["q0"], "num_median": r["q1"], "num_q3": r["q2"]} for r in rows}


def profile_columns(
    df: DataFrame,
    table_name: str,
    strict_date_words: bool = False,
    gathered: int = GATHERED,
    approx: bool = False,
) -> DataFrame:
    """One row per column: counts, inferred type, summaries, top values and likely roles.

    Runs the jobs now; what comes back are as many rows as the table has columns. With
    `approx` one aggregate without any shuffle of values estimates distinct counts, quantiles
    and top values; everything else stays exact.
    """
    if not df.columns:
        facts = []
    else:
        facts = scalars(df, _estimates) if approx else _exact(df, gathered)
    types = {"c": "int", "column_name": "string", "kind": "string", "label": "string", **SCALARS, **_SKETCHES}
    rows = [
        tuple((f | dict(zip(("column_name", "kind", "label"), (df.columns[f["c"]], *kind_of(df.schema[f["c"]].dataType))))).get(n) for n in types)
        for f in facts
    ]
    known = df.sparkSession.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in types.items()), verifySchema=False)
    return small(labelled(known, table_name, strict_date_words))


def _exact(df: DataFrame, gathered: int) -> list[dict]:
    """All statistics of each column; what does not depend on each other runs at the same time."""
    kinds = [kind_of(f.dataType)[0] for f in df.schema]
    typed = [no for no, k in enumerate(kinds) if k in ("integer", "float", "decimal")]

    def sums() -> tuple[list[dict], dict, dict]:
        found = scalars(df)
        texts = [s["c"] for s in found if kinds[s["c"]] == "text" and s["present"] and s["numeric_rows"] / s["present"] >= words.TEXT_SHARE]
        return found, *side_by_side(lambda: _quartiles(df, texts, gathered), lambda: _moments(df, found))

    (facts, *more), quartiles, values = side_by_side(
        sums, lambda: _quartiles(df, typed, gathered), lambda: _values(df, _Columns(df.schema)))
    for f in facts:
        for part in (*more, quartiles, values):
            f.update(part.get(f["c"], {}))
        if f["date_rows"]:
            f.setdefault("date_unique", f.get("unique"))
    return facts


def _percent(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)).cast("double") * 100, 2)


def labelled(joined: DataFrame, table_name: str, strict: bool) -> DataFrame:
    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    is_text = F.col("kind") == "text"
    present, total = known("present"), known("total")
    share = lambda c: F.try_divide(known(c).cast("double"), present.cast("double"))
    text_label = (
        F.when(present == 0, "unknown")
        .when(share("numeric_rows") >= words.TEXT_SHARE, "float")
        .when(share("date_rows") >= words.TEXT_SHARE, "date")
        .when(
            (known("unique") <= words.CATEGORICAL_MAX_UNIQUE)
            | (known("unique") / F.greatest(total, F.lit(1)).cast("double") <= words.CATEGORICAL_MAX_SHARE),
            "categorical",
        )
        .otherwise("string")
    )
    base = joined.select(
        F.lit(table_name).alias("table_name"),
        F.col("c").alias("column_index"),
        "column_name",
        F.when(is_text, text_label).otherwise(F.col("label")).alias("data_type"),
        is_text.alias("is_text"),
        total.alias("total_count"),
        (total - present).alias("null_count"),
        _percent(total - present, total).alias("null_percent"),
        F.when(F.col("kind") != "nested", known("unique")).alias("unique_count"),
        F.when(F.col("kind") != "nested", _percent(known("unique"), total)).alias("unique_percent"),
        F.coalesce("top_values", F.array().cast("array<string>")).alias("top_values"),
        share("numeric_rows").alias("numeric_share"),
        share("date_rows").alias("date_share"),
        share("date_only_rows").alias("date_only_share"),
        known("padded_rows").alias("padded_count"),
        *[f for f in ("num_min", "num_max", "num_mean", "num_median", "num_std", "num_q1", "num_q3")],
        "first_at", "last_at", "date_unique",
    )
    name, label = F.col("column_name"), F.col("data_type")
    number = label.isin("integer", "float")
    moment = label.isin("date", "datetime")
    date_words = words.STRICT_DATE_WORDS if strict else words.DATE_WORDS
    metric = number & words.name_has(name, words.METRIC_WORDS)
    roles = base.select(
        "*",
        metric.alias("is_likely_metric"),
        (moment | words.name_has(name, date_words)).alias("is_likely_date"),
        ((label == "categorical") | words.name_has(name, words.CATEGORY_WORDS)).alias("is_likely_categorical"),
        (
            F.lower(name).contains("id")
            | (F.coalesce(F.col("unique_percent") >= words.ID_UNIQUE_PERCENT, F.lit(False)) & ~metric)
        ).alias("is_likely_id"),
    )
    dated = F.col("is_likely_date") & F.col("first_at").isNotNull()
    summaries = {n: F.when(number, F.col(n)) for n in base.columns if n.startswith("num_")}
    summaries["min_date"] = F.when(dated, _day_of(F.col("first_at")))
    summaries["max_date"] = F.when(dated, _day_of(F.col("last_at")))
    summaries["unique_dates"] = F.when(dated, F.col("date_unique"))
    return roles.select(
        *[summaries[n].alias(n) if n in summaries else F.col(n) for n in base.columns
          if n not in ("first_at", "last_at", "date_unique")],
        *[summaries[n].alias(n) for n in ("min_date", "max_date", "unique_dates")],
        "is_likely_id", "is_likely_metric", "is_likely_categorical", "is_likely_date",
        F.slice("top_values", 1, SAMPLE_VALUES).alias("sample_values"),
    )


def _day_of(at: Column) -> Column:
    return F.date_from_unix_date(F.floor(at / F.lit(_DAY)).cast("int"))


ISSUE_COLUMNS = (
    "table_name", "issue_order", "column_name", "issue_type", "description",
    "affected_rows_count", "affected_rows_percent", "impact_level", "sample_values",
)


def column_issues(profile: DataFrame) -> DataFrame:
    """Findings about single columns, from the profile alone."""
    name, total, nulls_ = F.col("column_name"), F.col("total_count"), F.col("null_count")
    present = total - nulls_
    present_percent = _percent(present, total)
    number_text = F.col("is_text") & (F.col("data_type") == "float")
    date_text = F.col("is_text") & (F.col("data_type") == "date")
    unknown_role = F.when(F.col("is_likely_categorical"), "medium").otherwise("low")
    key = F.col("is_likely_metric") | F.col("is_likely_date") | F.col("is_likely_id")
    said = lambda *parts: F.concat(F.lit("Column '"), name, F.lit("' "), *parts)
    none = F.array().cast("array<string>")
    sample = F.col("sample_values")

    def found(order, when, kind, text, count, percent, impact, samples):
        return F.when(
            when,
            F.struct(
                F.lit(order).alias("o"), F.lit(kind).alias("issue_type"), text.alias("description"),
                count.cast("bigint").alias("affected_rows_count"),
                percent.cast("double").alias("affected_rows_percent"),
                impact.alias("impact_level"), samples.alias("sample_values"),
            ),
        )

    whole = F.lit(100.0)
    candidates = F.array(
        found(0, nulls_ > 0, "missing_values",
              said(F.lit("is empty in "), nulls_.cast("string"), F.lit(" rows, "),
                   F.col("null_percent").cast("string"), F.lit(" percent")),
              nulls_, F.col("null_percent"), F.when(key, "high").otherwise(unknown_role), sample),
        found(1, number_text, "numeric_stored_as_text",
              said(F.lit("holds numbers as text")),
              present, present_percent, F.lit("medium"), sample),
        found(2, date_text, "date_stored_as_text",
              said(F.lit("holds dates as text")),
              present, present_percent, F.lit("medium"), sample),
        found(3, F.col("is_likely_categorical") & (F.col("unique_count") > words.HIGH_CARDINALITY),
              "high_cardinality_category",
              said(F.lit("is a category with "), F.col("unique_count").cast("string"), F.lit(" different values")),
              total, whole, F.lit("low"), none),
        found(4, F.col("is_text") & ~number_text & ~date_text
              & (F.col("numeric_share") > words.MIXED_SHARE) & (F.col("date_only_share") > words.MIXED_SHARE),
              "mixed_types", said(F.lit("mixes numbers and dates")),
              total, whole, F.lit("medium"), sample),
        found(5, F.col("padded_count") > 0, "whitespace",
              said(F.lit("has "), F.col("padded_count").cast("string"), F.lit(" values with surrounding white space")),
              F.col("padded_count"), _percent(F.col("padded_count"), total), F.lit("low"), sample),
    )
    issues = profile.select(
        "table_name", "column_index", "column_name", F.explode(F.array_compact(candidates)).alias("f")
    )
    order = (F.col("column_index") + 1) * 10 + F.col("f.o")
    return issues.select(
        "table_name", order.alias("issue_order"), "column_name",
        *[F.col(f"f.{n}").alias(n) for n in ISSUE_COLUMNS[3:]],
    )


def duplicate_issue(df: DataFrame, table_name: str) -> DataFrame:
    """At most one row: how many rows repeat an earlier one (a shuffle of its own)."""
    percent = _percent(F.col("duplicate_rows"), F.col("total_rows"))
    return duplicate_count(df).filter(F.col("duplicate_rows") > 0).select(
        F.lit(table_name).alias("table_name"),
        F.lit(0).alias("issue_order"),
        F.lit(None).cast("string").alias("column_name"),
        F.lit("duplicate_rows").alias("issue_type"),
        F.concat(F.col("duplicate_rows").cast("string"), F.lit(" rows repeat another one, "), percent.cast("string"), F.lit(" percent")).alias("description"),
        F.col("duplicate_rows").cast("bigint").alias("affected_rows_count"),
        percent.alias("affected_rows_percent"),
        F.when(percent > words.HIGH_DUPLICATE_PERCENT, "high").otherwise("medium").alias("impact_level"),
        F.array().cast("array<string>").alias("sample_values"),
    )


def profile_table(
    df: DataFrame,
    table_name: str,
    duplicates: bool = True,
    strict_date_words: bool = False,
    gathered: int = GATHERED,
    approx: bool = False,
) -> Profile:
    """Profile and issues of one table; `duplicates=False` saves the shuffle of whole rows."""
    columns, copies = side_by_side(
        lambda: profile_columns(df, table_name, strict_date_words, gathered, approx),
        lambda: small(duplicate_issue(df, table_name)) if duplicates else None,
    )
    issues = column_issues(columns)
    return Profile(columns, copies.unionByName(issues) if duplicates else issues)


def profile_tables(tables: Mapping[str, DataFrame], **options) -> Profile:
    """Profile of every table of a version, as two tables."""
    profiles = side_by_side(
        *[lambda name=name, df=df: profile_table(df, name, **options) for name, df in tables.items()]
    )
    return Profile(
        reduce(DataFrame.unionByName, [p.columns for p in profiles]),
        reduce(DataFrame.unionByName, [p.issues for p in profiles]),
    )


def likely_columns(profile: DataFrame) -> DataFrame:
    """Per table: row and column count and the names of likely id, metric, category and date columns."""

    def names(flag: str) -> Column:
        pairs = F.collect_list(F.when(F.col(flag), F.struct("column_index", "column_name")))
        return F.transform(F.array_sort(pairs), lambda s: s.column_name)

    return profile.groupBy("table_name").agg(
        F.max("total_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        names("is_likely_id").alias("likely_id_columns"),
        names("is_likely_metric").alias("likely_metric_columns"),
        names("is_likely_categorical").alias("likely_categorical_columns"),
        names("is_likely_date").alias("likely_date_columns"),
    )
