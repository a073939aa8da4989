"""Small append-only tables of metadata beside the data they describe.

Data is written first and its row last; readers believe only rows, so a job that died
half-way leaves nothing visible behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tablewright.errors import ToolError


def append(spark: SparkSession, path: str, schema: str, rows: Sequence[tuple]) -> None:
    append_frame(spark.createDataFrame(list(rows), schema), path)


def append_frame(df: DataFrame, path: str) -> None:
    """Rows in a folder of their own, moved into place when whole: writers do not share files."""
    if not put(df, path, f"rows-{uuid.uuid4().hex}"):
        raise ToolError(f"Cannot write to {path}")


def put(df: DataFrame, path: str, name: str) -> bool:
    """Rows under a name that nothing has yet; False where another writer was first.

    The rows are written aside and their folder is moved to the name. A folder can't take the
    place of one that holds files, so of many writers one alone finds its file there afterwards.
    That needs a store that moves a folder in one step, as HDFS and local disks do.
    """
    spark, target = df.sparkSession, f"{path}/{name}"
    if path_exists(spark, target):
        return False
    draft = f"_draft-{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(f"{path}/{draft}")  # a few rows of metadata
    own = next(n for n, _ in child_names(spark, f"{path}/{draft}") if n.startswith("part-"))
    source, goal = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}/{draft}", target))
    files = _files(spark, source)
    if not path_exists(spark, target):
        files.rename(source, goal)
    if path_exists(spark, f"{target}/{own}"):
        return True
    # Readers pass over the name of a draft, wherever the move has left it.
    for left in (f"{path}/{draft}", f"{target}/{draft}"):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(left), True)
    return False


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows written so far; no rows when nothing was. Other faults are errors."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    written = [f"{path}/{name}" for name, is_folder in child_names(spark, path) if is_folder and name.startswith("rows-")]
    return spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)


def _files(spark: SparkSession, jvm_path):
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm_path)


def child_names(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is folder) of what lies directly in a folder, in name order."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(jvm_path))
