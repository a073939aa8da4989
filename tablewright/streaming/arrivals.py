"""Files that arrive in a folder become versions of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.sources import registry
from tablewright.sources.tables import CSV_OPTIONS, date_readings, normalise_table, table_name
from tablewright.sources.versions import Dataset
from tablewright.specs import VersionType


_READINGS = "column_name string, reading string"


def _readings(spark: SparkSession, path: str, batch: DataFrame) -> dict[str, str]:
    """How the table's text columns are read: what the first batch of all writers decided."""
    texts = [f.name for f in batch.schema if isinstance(f.dataType, T.StringType)]
    kept = dict(registry.read(spark, path, _READINGS).collect())
    if any(n not in kept for n in texts):
        found = [(n, r) for n, r in date_readings(batch).items() if n not in kept]
        registry.put(spark.createDataFrame(found, _READINGS), path, "rows-first")
        kept = dict(registry.read(spark, path, _READINGS).collect())
    return kept


def import_arrivals(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    dataset_root: str,
    table: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Import the CSV files that are there now, one version per batch, and stop.

    The streaming checkpoint remembers which files were taken, so a later call continues.
    A batch that is repeated after a failure finds the row of its version and does
    nothing. Files are taken in the order of their age.

    How text columns are read is decided by the first batch and kept with the table, so all its
    versions have one schema: a column of dates stays one, and what does not read as a date there
    is missing; a column of text, or one without a value in the first batch, stays text.
    """
    dataset = Dataset(spark, dataset_root)
    name = table_name(table)

    def import_batch(batch: DataFrame, batch_id: int) -> None:
        # A checkpoint counts its own batches, so it is part of what a version came from.
        source = f"{folder} > {name} @ {checkpoint}#{batch_id}"
        versions = dataset.versions()
        if not versions.filter(F.col("source") == source).isEmpty() or batch.isEmpty():
            return
        newest = versions.agg(F.max("version_number")).first()[0]
        kept = _readings(spark, f"{dataset.root}/_readings/{name}", batch)
        dataset.write({name: normalise_table(batch, kept)}, VersionType.original, newest, source, replace_unfinished=True)

    arriving = (
        spark.readStream.schema(schema)
        .options(**CSV_OPTIONS)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )
    return (
        arriving.writeStream.foreachBatch(import_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
