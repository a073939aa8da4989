"""What the operators share: the folder all executors reach, tables written there, the package on executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests), a folder below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """The table as Parquet in the shared folder, read back: computed once, safe when executors go."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table made by `written` once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' path, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="package-")
        shutil.copytree(top, f"{folder}/tree/{top.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{top.name}", "zip", f"{folder}/tree"))
        _shipped.add(context.applicationId)


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns only, under fixed names; all others stay unread."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def unsigned_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))
