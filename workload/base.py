"""Registration of queries and small helpers for comparable output."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import nulls
from tablewright.staging import shared_root

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Put a function under a name, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(df: DataFrame, *columns: str) -> DataFrame:
    """Amounts as decimals, so that sums do not depend on the order of addition."""
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in columns})


def rounded(name: str, places: int = 6) -> Column:
    return F.round(F.col(name).cast("double"), places).alias(name)


def texted(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text to the second."""
    return df.select(
        *[
            F.date_format(nulls.col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name)
            if isinstance(f.dataType, nulls.TEMPORAL) else nulls.col(f.name)
            for f in df.schema
        ]
    )


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder of the session."""
    return f"{shared_root(spark)}/tablewright/{label}-{uuid.uuid4().hex}"
