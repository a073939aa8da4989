"""Immutable versions of a dataset: a folder of Parquet tables and one row of metadata.

    <root>/v1_original_<token>/<table>/   data, written once, under a name no other attempt has
    <root>/_versions/rows-<number>/       the log: one row per finished version
    <root>/_sketches/                     column sketches of versions that were sketched

Data is written first, then its row is put under the next free number; a writer that finds the
number taken tries the one after. So numbers have no gaps, and a failed attempt takes none.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import ToolError
from tablewright.functions import nulls
from tablewright.operators import sketches
from tablewright.operators.cleaning import CleaningRun, apply_cleaning
from tablewright.operators.features import FeatureRun, apply_features
from tablewright.sources import registry
from tablewright.sources.tables import table_info
from tablewright.specs import CleaningStep, Feature, VersionType
from tablewright.staging import side_by_side

_SCHEMA = (
    "version_number int, parent_version int, version_type string, path string, "
    "tables array<struct<table_name:string, row_count:bigint, column_count:int>>, "
    "row_count bigint, column_count int, source string, created_at timestamp"
)


_CLEANING_LOG, _FEATURE_LOG = "_cleaning_log", "_feature_log"
_CLEANING_SCHEMA = (
    "version_number int, sequence int, step_id string, table_name string, operation string, status string, "
    "rows_before bigint, rows_after bigint, rows_removed bigint, rows_changed bigint, "
    "columns_changed array<string>, error string"
)
_FEATURE_SCHEMA = (
    "version_number int, sequence int, feature_id string, feature_name string, operation string, status string, "
    "output_columns array<string>, output_table string, error string"
)


@dataclass(frozen=True)
class Version:
    number: int
    kind: str
    path: str
    tables: tuple[str, ...]
    parent: int | None = None


class Dataset:
    """A folder that holds the versions of one dataset."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def versions(self) -> DataFrame:
        """One row per finished version."""
        return registry.read(self.spark, f"{self.root}/_versions", _SCHEMA)

    def get(self, number: int | None = None) -> Version:
        """A version by number, the newest without one."""
        rows = self.versions()
        rows = rows.orderBy(F.col("version_number").desc()) if number is None else rows.filter(F.col("version_number") == number)
        row = rows.select("version_number", "version_type", "path", "tables.table_name", "parent_version").first()
        if row is None:
            raise ToolError(f"Version {number} not found" if number else "The dataset has no version")
        return Version(row[0], row[1], row[2], tuple(row[3]), row[4])

    def tables(self, number: int | None = None) -> dict[str, DataFrame]:
        """Lazy scans of all tables of a version."""
        v = self.get(number)
        return {t: self.spark.read.parquet(f"{v.path}/{t}") for t in v.tables}

    def next_number(self) -> int:
        """The number after the last version."""
        log = f"{self.root}/_versions"
        names = registry.child_names(self.spark, log) if registry.path_exists(self.spark, log) else []
        numbers = [n.removeprefix("rows-") for n, _ in names if n.startswith("rows-")]
        if all(n.isdigit() for n in numbers):
            return max(map(int, numbers), default=0) + 1
        return (self.versions().agg(F.max("version_number")).first()[0] or 0) + 1

    def write(
        self,
        tables: Mapping[str, DataFrame],
        kind: VersionType | str = VersionType.original,
        parent: int | None = None,
        source: str | None = None,
        number: int | None = None,
        replace_unfinished: bool = False,
    ) -> Version:
        """Write all tables as a new version.

        A folder `v<number>_<kind>` that another tool left there is an error, unless
        `replace_unfinished` says that it may be passed over. Row counts are read from the
        footers of the written files, so repeated tasks cannot distort them. NaN is written as NULL.
        """
        if not tables:
            raise ToolError("A version needs at least one table")
        kind = str(VersionType(kind))
        expected = number or self.next_number()
        if number is not None and not self.versions().filter(F.col("version_number") == number).isEmpty():
            raise ToolError(f"Version {number} exists already")
        path = f"{self.root}/v{expected}_{kind}"
        if registry.path_exists(self.spark, path) and not replace_unfinished:
            raise ToolError(f"Folder exists already: {path}")
        path = f"{path}_{uuid.uuid4().hex[:12]}"
        side_by_side(*[
            lambda name=name, df=df: nulls.without_nan(df).write.mode("errorifexists").parquet(f"{path}/{name}")
            for name, df in tables.items()
        ])
        written = {n: self.spark.read.parquet(f"{path}/{n}") for n in tables}
        info = [(r["table_name"], r["row_count"], r["column_count"]) for r in table_info(written).collect()]
        taken = self._put(number, parent, kind, path, info, source)
        return Version(taken, kind, path, tuple(tables), parent)

    def _put(self, number: int | None, parent: int | None, kind: str, path: str, info: list[tuple], source: str | None) -> int:
        """Log a version under the given number, else under the next one that is free."""
        while True:
            wanted = number or self.next_number()
            row = (wanted, parent, kind, path, info, sum(i[1] for i in info), max(i[2] for i in info), source, dt.datetime.now(dt.timezone.utc))
            if registry.put(self.spark.createDataFrame([row], _SCHEMA), f"{self.root}/_versions", f"rows-{wanted:08d}"):
                return wanted
            if number is not None:
                raise ToolError(f"Version {number} exists already")

    def copy(self, number: int, kind: VersionType | str = VersionType.enriched) -> Version:
        """A new version with the tables of an older one."""
        return self.write(self.tables(number), kind, parent=number)

    def extend(self, added: Mapping[str, DataFrame], number: int | None = None, kind: VersionType | str = VersionType.original) -> Version:
        """A new version with rows added to tables of an older one, and tables it did not have.

        Its sketches are those of the older version merged with those of the added rows; tables are
        sketched as a whole only where the older version has no sketch yet.
        """
        parent = self.get(number)
        old = self.tables(parent.number)
        known = self.sketches(parent.number)
        tables = {n: old[n].unionByName(added[n], allowMissingColumns=True) if n in added else old[n] for n in old}
        version = self.write({**tables, **{n: df for n, df in added.items() if n not in old}}, kind, parent.number)
        parts = {}
        for name in version.tables:
            merged = [known.get(name) or sketches.sketch_columns(old[name])] if name in old else []
            merged += [sketches.sketch_columns(added[name])] if name in added else []
            parts[name] = sketches.merge_sketches(*merged) if len(merged) > 1 else merged[0]
        self._keep_sketches(version.number, parts)
        return version

    def sketch(self, number: int | None = None) -> None:
        """Keep sketches of all columns of a version; one pass over each table."""
        version = self.get(number)
        tables = self.tables(version.number)
        parts = side_by_side(*[lambda df=df: sketches.sketch_columns(df) for df in tables.values()])
        self._keep_sketches(version.number, dict(zip(tables, parts)))

    def _keep_sketches(self, number: int, parts: Mapping[str, DataFrame]) -> None:
        rows = [df.select(F.lit(number).alias("version_number"), F.lit(name).alias("table_name"), "*") for name, df in parts.items()]
        registry.append_frame(reduce(DataFrame.unionByName, rows), f"{self.root}/_sketches")

    def sketches(self, number: int | None = None) -> dict[str, DataFrame]:
        """The kept sketches of a version by table; none where it was not sketched."""
        version = self.get(number)
        schema = f"version_number int, table_name string, {sketches.SCHEMA}"
        rows = registry.read(self.spark, f"{self.root}/_sketches", schema).filter(F.col("version_number") == version.number)
        have = {r[0] for r in rows.select("table_name").distinct().collect()}
        # A version that was sketched twice has equal rows twice.
        return {
            n: rows.filter(F.col("table_name") == n).drop("version_number", "table_name").dropDuplicates(["column_name", "kind", "label"])
            for n in version.tables if n in have
        }

    def sketched_profile(self, number: int | None = None) -> DataFrame:
        """The profile of a version from its sketches alone; no table is read."""
        parts = self.sketches(number)
        if not parts:
            raise ToolError("The version has no sketches")
        return reduce(DataFrame.unionByName, [sketches.sketched_profile(df, name) for name, df in parts.items()])

    def clean(
        self, steps: Iterable[CleaningStep], number: int | None = None, log: bool = True
    ) -> tuple[Version, CleaningRun]:
        """Apply cleaning steps and write the result; a failed step leaves no version behind.

        `log` also keeps the row counts of every step, for another scan of the touched columns.
        """
        parent = self.get(number)
        run = apply_cleaning(self.tables(parent.number), steps, stage_deduplicated=True)
        if run.failed:
            raise ToolError("; ".join(f"step {n.sequence}: {n.error}" for n in run.failed))
        version = self.write(run.tables, VersionType.cleaned, parent.number)
        if log:
            self._log(_CLEANING_LOG, run.metrics(), version)
        return version, run

    def enrich(self, features: Iterable[Feature], number: int | None = None) -> tuple[Version, FeatureRun]:
        """Apply features and write the result; failed features are left out."""
        parent = self.get(number)
        run = apply_features(self.tables(parent.number), features)
        version = self.write({**run.tables, **run.new_tables}, VersionType.enriched, parent.number)
        self._log(_FEATURE_LOG, run.log(self.spark), version)
        return version, run

    def _log(self, name: str, rows: DataFrame, version: Version) -> None:
        numbered = rows.select(F.lit(version.number).alias("version_number"), "*")
        registry.append_frame(numbered, f"{self.root}/{name}")

    def cleaning_log(self) -> DataFrame:
        """One row per cleaning step of every cleaned version."""
        return registry.read(self.spark, f"{self.root}/{_CLEANING_LOG}", _CLEANING_SCHEMA)

    def feature_log(self) -> DataFrame:
        """One row per feature of every enriched version."""
        return registry.read(self.spark, f"{self.root}/{_FEATURE_LOG}", _FEATURE_SCHEMA)
