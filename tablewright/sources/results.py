"""Results of queries and charts: large result files, saved views, saved chart data."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.errors import ToolError
from tablewright.operators.charts import ChartResult, series_label
from tablewright.sources import registry
from tablewright.sources.tables import CSV_OPTIONS
from tablewright.specs import PREVIEW_ROWS, RESULT_ROWS, Chart, ViewSource

FORMATS = ("csv", "parquet", "json")
_VIEWS = (
    "view_id string, version_number int, name string, description string, source_type string, "
    "spec string, path string, format string, schema string, row_count bigint, column_count int, created_at timestamp"
)
_VISUALS = (
    "visual_id string, version_number int, title string, description string, chart_type string, "
    "x_key string, y_key string, label string, spec string, path string, created_at timestamp"
)


def _spec_text(spec: Any) -> str:
    if spec is None:
        return "{}"
    return json.dumps(asdict(spec) if is_dataclass(spec) else spec, default=str)


# Text formats keep blanks, tell the empty text from a missing one, and microseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_CSV = CSV_OPTIONS | _TIMES | {
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "quoteAll": True, "nullValue": "\\N", "emptyValue": "", "lineSep": "\n",
}


def _writer(df: DataFrame, fmt: str, path: str) -> None:
    if fmt not in FORMATS:
        raise ToolError(f"Unsupported format '{fmt}'. Allowed: {FORMATS}")
    w = df.write.mode("errorifexists")
    {"csv": lambda: w.options(**_CSV).csv(path),
     "parquet": lambda: w.parquet(path),
     "json": lambda: w.options(**_TIMES, ignoreNullFields=False).json(path)}[fmt]()


def _reader(spark: SparkSession, fmt: str, path: str, schema: str | None) -> DataFrame:
    """Files written above if the schema is known, else files of another writer."""
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        options = {k: v for k, v in _CSV.items() if k != "lineSep"} if schema else CSV_OPTIONS
        return reader.options(**options).csv(path, multiLine=True, inferSchema=schema is None)
    return reader.options(**(_TIMES if schema else {})).json(path) if fmt == "json" else reader.parquet(path)


@dataclass(frozen=True)
class TableOutput:
    """First rows of a result, its size, and where all of it lies when it was large."""

    columns: list[str]
    preview: DataFrame
    row_count: int
    path: str | None = None
    format: str | None = None


def table_output(df: DataFrame, folder: str | None = None, inline_rows: int = RESULT_ROWS, fmt: str = "csv") -> TableOutput:
    """Preview and count of a result; more than `inline_rows` rows are also written, and then read back."""
    head = df.take(inline_rows + 1)
    if len(head) <= inline_rows or folder is None:
        shown = df.sparkSession.createDataFrame(head[:PREVIEW_ROWS], df.schema)
        return TableOutput(df.columns, shown, len(head) if len(head) <= inline_rows else df.count())
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.{fmt}"
    _writer(df, fmt, path)
    written = _reader(df.sparkSession, fmt, path, df.schema.toDDL())
    return TableOutput(df.columns, written.limit(PREVIEW_ROWS), written.count(), path, fmt)


class ResultStore:
    """Saved views and chart data below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # views

    def save_view(
        self, df: DataFrame, name: str, version: int, spec: Any = None, description: str | None = None,
        source: ViewSource | str = ViewSource.query, fmt: str = "parquet",
    ) -> str:
        """Write a result and its metadata; the id of the view. CSV and JSON are for export: one task reads a file."""
        view_id = uuid.uuid4().hex
        path = f"{self.root}/views/{view_id}"
        _writer(df, fmt, path)
        rows = _reader(self.spark, fmt, path, df.schema.toDDL()).count()
        return self._record_view(view_id, version, name, description, source, spec, path, fmt, df.schema.toDDL(), rows, len(df.columns))

    def save_view_of(
        self, path: str, fmt: str, name: str, version: int, spec: Any = None, description: str | None = None,
        row_count: int | None = None, column_count: int | None = None,
    ) -> str:
        """A view of files that were written before."""
        if fmt not in FORMATS:
            raise ToolError(f"Unsupported format '{fmt}'. Allowed: {FORMATS}")
        return self._record_view(
            uuid.uuid4().hex, version, name, description, ViewSource.manual, spec, path, fmt, None, row_count, column_count
        )

    def _record_view(self, view_id, version, name, description, source, spec, path, fmt, schema, rows, columns) -> str:
        registry.append(
            self.spark, f"{self.root}/_views", _VIEWS,
            [(view_id, version, name, description, str(ViewSource(source)), _spec_text(spec), path, fmt,
              schema, rows, columns, dt.datetime.now(dt.timezone.utc))],
        )
        return view_id

    def views(self, version: int | None = None) -> DataFrame:
        """Saved views, newest first; those of one version if given."""
        return _listed(self.spark, f"{self.root}/_views", _VIEWS, "view_id", version)

    def read_view(self, view_id: str) -> DataFrame:
        row = self.views().filter(F.col("view_id") == view_id).first()
        if row is None:
            raise ToolError(f"View '{view_id}' not found")
        return _reader(self.spark, row["format"], row["path"], row["schema"])

    def preview_view(self, view_id: str, limit: int = PREVIEW_ROWS) -> DataFrame:
        return self.read_view(view_id).limit(limit)

    def delete_view(self, view_id: str) -> None:
        """Take a view off the list. Its files stay, other views may point at them."""
        row = self.views().filter(F.col("view_id") == view_id).first()
        if row is None:
            raise ToolError(f"View '{view_id}' not found")
        _append_removal(self.spark, f"{self.root}/_views", _VIEWS, "view_id", view_id, row["version_number"])

    # chart data

    def save_visual(
        self, chart: Chart, data: DataFrame, version: int, title: str = "", description: str | None = None,
        fmt: str = "parquet",
    ) -> str:
        """Write the points of a chart and its metadata; the id of the visual."""
        visual_id = uuid.uuid4().hex
        path = f"{self.root}/visuals/{visual_id}"
        _writer(data, fmt, path)
        x, y = data.columns[0], data.columns[-1]
        registry.append(
            self.spark, f"{self.root}/_visuals", _VISUALS,
            [(visual_id, version, title or chart.title, description, str(chart.kind), x, y, series_label(y),
              json.dumps({"chart": asdict(chart), "format": fmt, "schema": data.schema.toDDL()}, default=str),
              path, dt.datetime.now(dt.timezone.utc))],
        )
        return visual_id

    def save_visual_result(self, results: Sequence[ChartResult], version: int, index: int = 0, title: str = "") -> str:
        """Save one chart of a batch."""
        if not 0 <= index < len(results) or results[index].data is None:
            raise ToolError(f"There is no chart {index} in the batch")
        return self.save_visual(results[index].chart, results[index].data, version, title)

    def visuals(self, version: int | None = None) -> DataFrame:
        return _listed(self.spark, f"{self.root}/_visuals", _VISUALS, "visual_id", version)

    def visual_data(self, visual_id: str) -> DataFrame:
        row = self.visuals().filter(F.col("visual_id") == visual_id).first()
        if row is None:
            raise ToolError(f"Visual '{visual_id}' not found")
        spec = json.loads(row["spec"])
        return _reader(self.spark, spec["format"], row["path"], spec["schema"])

    def delete_visual(self, visual_id: str) -> None:
        row = self.visuals().filter(F.col("visual_id") == visual_id).first()
        if row is None:
            raise ToolError(f"Visual '{visual_id}' not found")
        _append_removal(self.spark, f"{self.root}/_visuals", _VISUALS, "visual_id", visual_id, row["version_number"])


def _listed(spark: SparkSession, path: str, schema: str, key: str, version: int | None) -> DataFrame:
    """Rows whose id was not removed later. A removal is a row without a path."""
    rows = registry.read(spark, path, schema)
    removed = rows.filter(F.col("path").isNull()).select(key)
    kept = rows.filter(F.col("path").isNotNull()).join(removed, key, "left_anti")
    if version is not None:
        kept = kept.filter(F.col("version_number") == version)
    return kept.orderBy(F.col("created_at").desc())


def _append_removal(spark: SparkSession, path: str, schema: str, key: str, value: str, version: int) -> None:
    names = [part.split()[0] for part in schema.split(", ")]
    known = {key: value, "version_number": version, "created_at": dt.datetime.now(dt.timezone.utc)}
    registry.append(spark, path, schema, [tuple(known.get(n) for n in names)])


def dataset_summary(
    profile: DataFrame, issues: DataFrame, views: DataFrame, visuals: DataFrame, version: int, listed: int | None = 10, top_values: int | None = 5,
) -> DataFrame:
    """One row per table of a version: size, columns with roles, issues, latest views and visuals.

    `listed` views and visuals and `top_values` values per column are shown, all with None.
    """
    column = F.struct(
        "column_index", "column_name", "data_type", "null_percent", "unique_count", "is_likely_id",
        "is_likely_metric", "is_likely_categorical", "is_likely_date",
        (F.col("top_values") if top_values is None else F.slice("top_values", 1, top_values)).alias("top_values"),
    )
    tables = profile.groupBy("table_name").agg(
        F.max("total_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.array_sort(F.collect_list(column)).alias("columns"),
    )
    found = issues.groupBy("table_name").agg(F.count(F.lit(1)).alias("quality_issue_count"))
    tables = tables.join(found, "table_name", "left").withColumn(
        "quality_issue_count", F.coalesce("quality_issue_count", F.lit(0))
    )
    latest_views = _latest(views, version, listed, "saved_views", "view_id", "name", "source_type", "row_count", "column_count")
    latest_visuals = _latest(visuals, version, listed, "saved_visuals", "visual_id", "title", "chart_type")
    # The lists belong to the version: one row each, spread over its tables by a window.
    rows = (
        tables.withColumn("version_number", F.lit(version))
        .unionByName(latest_views, allowMissingColumns=True)
        .unionByName(latest_visuals, allowMissingColumns=True)
    )
    whole = Window.partitionBy("version_number")
    shown = {n: F.first(n, ignorenulls=True).over(whole) for n in ("saved_views", "saved_visuals")}
    return rows.withColumns(shown).filter(F.col("table_name").isNotNull())


def _latest(rows: DataFrame, version: int, most: int | None, output: str, *names: str) -> DataFrame:
    newest = Window.partitionBy("version_number").orderBy(F.col("created_at").desc())
    top = rows.filter(F.col("version_number") == version).withColumn("at", F.row_number().over(newest)).filter(F.lit(True) if most is None else F.col("at") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", *names))), lambda s: F.struct(*[s[n].alias(n) for n in names]))
    return top.groupBy("version_number").agg(listed.alias(output))
