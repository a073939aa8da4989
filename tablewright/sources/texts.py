"""Text documents with their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import nulls

PREVIEW_CHARS = 500


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """`path` and whole `text` of the .txt and .md files of a folder; files without a byte give no row."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{txt,md}", recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _lines(text: Column) -> Column:
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(newlines + 1)


def text_statistics(df: DataFrame, text_column: str = "text") -> DataFrame:
    """The table with `char_count`, `line_count` and the first 500 characters in place of the text."""
    text = nulls.col(text_column)
    return df.select(
        *[nulls.col(c) for c in df.columns if c != text_column],
        F.length(text).alias("char_count"),
        _lines(text).alias("line_count"),
        F.substring(text, 1, PREVIEW_CHARS).alias("preview"),
    )
