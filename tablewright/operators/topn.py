"""Most frequent items per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import ToolError
from tablewright.functions import nulls
from tablewright.operators.predicates import check_columns, table_of
from tablewright.specs import TopN, TopNWide

# Up to this n Spark itself keeps only n rows per group and task before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
_SPARK_GROUP_LIMIT = 1000
_SALTS = 64


def top_rows(df: DataFrame, partition: str, amount: str, item: str, n: int) -> DataFrame:
    """The n rows of each group with the largest amount; the item decides ties."""
    order = [nulls.col(amount).desc_nulls_last(), nulls.col(item).asc_nulls_last()]
    if n > _SPARK_GROUP_LIMIT:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(nulls.col(item)), F.lit(_SALTS)))
        part = Window.partitionBy(nulls.col(partition), "__salt").orderBy(*order)
        df = salted.withColumn("__rn", F.row_number().over(part)).filter(F.col("__rn") <= n).drop("__salt", "__rn")
    whole = Window.partitionBy(nulls.col(partition)).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(whole)).filter(F.col("__rn") <= n).drop("__rn")


def _ordered(df: DataFrame, partition: str, item: str) -> DataFrame:
    return df.orderBy(
        F.col("purchase_frequency").desc_nulls_last(),
        nulls.col(partition).asc_nulls_last(),
        nulls.col(item).asc_nulls_last(),
    )


def top_n(tables, spec: TopN) -> DataFrame:
    """Count rows per (group, item) and keep the n most frequent items of each group."""
    df = table_of(tables, spec.table)
    check_columns(df, [spec.partition, spec.item], spec.table)
    counts = df.groupBy(nulls.col(spec.partition), nulls.col(spec.item)).agg(
        F.count(F.lit(1)).alias("purchase_frequency")
    )
    return _ordered(
        top_rows(counts, spec.partition, "purchase_frequency", spec.item, spec.n), spec.partition, spec.item
    )


def top_n_wide(tables, spec: TopNWide) -> DataFrame:
    """The same when every item has its own column of amounts; only positive ones count."""
    df = table_of(tables, spec.table)
    check_columns(df, [spec.partition, *spec.items], spec.table)
    sums = positive_sums(df, spec.partition, spec.items)
    return _ordered(
        top_rows(sums, spec.partition, "purchase_frequency", "product_name", spec.n),
        spec.partition,
        "product_name",
    )


def positive_sums(df: DataFrame, partition: str, items: Sequence[str]) -> DataFrame:
    """(group, product_name, sum of positive amounts), missing where no amount is positive.

    One wide aggregate runs before the columns are turned into rows, so a source row is
    not multiplied by the number of items.
    """
    if not items:
        raise ToolError("No item columns given")
    for i in items:
        if not isinstance(df.schema[i].dataType, nulls.NUMERIC):
            raise ToolError(f"Item column '{i}' is not a number")
    sums = df.groupBy(nulls.col(partition)).agg(
        *[F.sum(F.when(nulls.col(i) > 0, nulls.col(i))).alias(f"__s{j}") for j, i in enumerate(items)]
    )
    common = _widest([sums.schema[f"__s{j}"].dataType for j in range(len(items))])
    lanes = [p for j, i in enumerate(items) for p in (F.lit(i), F.col(f"__s{j}").cast(common))]
    return sums.select(
        nulls.col(partition),
        F.stack(F.lit(len(items)), *lanes).alias("product_name", "purchase_frequency"),
    ).filter(F.col("purchase_frequency").isNotNull())


def _widest(types: Sequence[T.DataType]) -> T.DataType:
    if any(isinstance(t, nulls.FRACTIONAL) for t in types):
        return T.DoubleType()
    decimals = [t for t in types if isinstance(t, T.DecimalType)]
    if decimals:
        return T.DecimalType(38, max(t.scale for t in decimals))
    return T.LongType()
