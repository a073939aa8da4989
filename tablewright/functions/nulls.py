"""The null model in one place.

Missing values are SQL NULL. NaN is turned into NULL when data comes in and in the
profiler, so that the predicates below stay plain comparisons the scan can push down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FRACTIONAL + (T.DecimalType,)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
TEXT = (T.StringType,)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def is_scalar(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC + TEMPORAL + TEXT + (T.BooleanType,))


def nan_to_null(c: Column, dtype: T.DataType) -> Column:
    return F.when(~F.isnan(c), c) if isinstance(dtype, FRACTIONAL) else c


def without_nan(df: DataFrame) -> DataFrame:
    """The same table with NaN replaced by NULL; columns of other types pass through."""
    if not any(isinstance(f.dataType, FRACTIONAL) for f in df.schema):
        return df
    return df.select(
        *[nan_to_null(df[_quoted(f.name)], f.dataType).alias(f.name) for f in df.schema]
    )


def eq(c: Column, value: Column) -> Column:
    return F.coalesce(c == value, F.lit(False))


def ne(c: Column, value: Column) -> Column:
    """NULL counts as different from every constant."""
    return ~c.eqNullSafe(value)


def one_of(c: Column, values: list[Column], with_null: bool) -> Column:
    hit = F.coalesce(c.isin(values), F.lit(False)) if values else F.lit(False)
    return hit | c.isNull() if with_null else hit


def sum_or_zero(c: Column) -> Column:
    """A group without any value sums to zero."""
    total = F.sum(c)
    return F.coalesce(total, F.lit(0))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient of two doubles; NULL for a NULL or zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its literal name, dots and spaces included."""
    return F.col(_quoted(name))
