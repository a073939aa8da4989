"""Intermediate tables in the shared folder of the cluster.

A table that several jobs read again is written once as Parquet. It survives lost
executors, lets later reads prune columns, and cuts the lineage behind it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

#: Rows of an intermediate table up to which the driver keeps it.
KEPT = 20_000

_kept: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staging").rstrip("/")


def _new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/tablewright/{label}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write the table once and return a scan of what was written.

    The result may be read at any later time, so its files stay until `tidy` is called or the
    driver ends.
    """
    path = _new_path(df.sparkSession, label)
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    _files(df.sparkSession, target).deleteOnExit(target)
    _kept.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return _written(df, path)


def tidy(spark: SparkSession) -> int:
    """Remove what `stage` wrote in this session, once no result built on it is needed any more."""
    paths = _kept.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _remove(spark, path)
    return len(paths)


def _files(spark: SparkSession, target):
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    _files(spark, target).delete(target, True)


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """The same for use inside a `with` block, whose end removes the files."""
    spark, path = df.sparkSession, _new_path(df.sparkSession, label)
    try:
        yield _written(df, path)
    finally:
        _remove(spark, path)


def small(df: DataFrame) -> DataFrame:
    """The rows of a table whose size the schema bounds (a few per column), held by the driver.

    Only for metadata such as profile rows, which several later plans read again.
    """
    return df.sparkSession.createDataFrame(df.collect(), df.schema, verifySchema=False)


def held(df: DataFrame, label: str, most: int = KEPT) -> tuple[DataFrame, pa.Table | None]:
    """A computed table to read again: kept by the driver up to `most` rows, and marked for
    broadcast, else written to the shared folder. The rows themselves come with the former.
    """
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return stage(df, label), None
    return broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows


def side_by_side(*jobs):
    """Run independent Spark actions at the same time; their results in order."""
    with ThreadPoolExecutor(max_workers=min(len(jobs), 4) or 1) as pool:
        # Job groups, tags and scheduler pools of the caller apply to the jobs as well.
        own = inheritable_thread_target(SparkSession.active())
        return [f.result() for f in [pool.submit(own(j)) for j in jobs]]
