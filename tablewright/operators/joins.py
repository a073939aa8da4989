"""Inner equi-join on one pair of keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import ToolError
from tablewright.functions import nulls
from tablewright.operators.predicates import table_of
from tablewright.specs import SimpleJoin


#: A key is hot if it has so many times the rows of an average shuffle partition.
HOT = 2.0
#: Pieces for each average partition that a hot key would fill: hashing deals more of them more evenly.
PIECES = 4
#: Bytes of a side from which its keys are sampled, at about one row in a hundred bytes.
SAMPLED_BYTES = 100_000_000
#: Rows that a key must have in the sample; fewer tell nothing about its share.
LEAST_SAMPLED = 50


def _family(df: DataFrame, name: str) -> str:
    dtype = df.schema[name].dataType
    if isinstance(dtype, nulls.NUMERIC):
        return "number"
    if isinstance(dtype, nulls.TEMPORAL):
        return "time"
    return dtype.typeName()


def _renamed(df: DataFrame, shared: set[str], suffix: str) -> DataFrame:
    return df.select(
        *[nulls.col(n).alias(n + suffix if n in shared else n) for n in df.columns]
    )


def join_tables(tables, spec: SimpleJoin) -> DataFrame:
    """Rows of both sides with equal keys; missing keys match each other.

    The null-safe condition is still an equi-join, so Spark picks a broadcast or a
    sort-merge join by size. Where neither side is small enough for a broadcast, a sample of
    the keys finds hot ones. Those that adaptive execution would not split, because it is off
    or they are below its thresholds, are dealt to several tasks here, each with all partner rows.
    """
    left, right = table_of(tables, spec.left), table_of(tables, spec.right)
    for df, key, name in ((left, spec.key_left, spec.left), (right, spec.key_right, spec.right)):
        if key not in df.columns:
            raise ToolError(f"Join key '{key}' not found in table '{name}'. Available: {df.columns}")
    kinds = _family(left, spec.key_left), _family(right, spec.key_right)
    if kinds[0] != kinds[1]:
        raise ToolError(f"Join keys differ in type: {kinds[0]} and {kinds[1]}")

    same_name = spec.key_left == spec.key_right
    shared = set(left.columns) & set(right.columns) - ({spec.key_left} if same_name else set())
    right_key = "__right_key" if same_name else spec.key_right + ("_y" if spec.key_right in shared else "")
    left_key = spec.key_left + ("_x" if spec.key_left in shared else "")
    left, right = _renamed(left, shared, "_x"), _renamed(right, shared, "_y")
    if same_name:
        right = right.withColumnRenamed(spec.key_right, right_key)

    joined = _joined(left, right, left_key, right_key)
    if same_name:
        joined = joined.drop(right_key)
    if spec.output_columns:
        unknown = [c for c in spec.output_columns if c not in joined.columns]
        if unknown:
            raise ToolError(f"Output columns not in the join result: {unknown}. Available: {joined.columns}")
        joined = joined.select(*[nulls.col(c) for c in spec.output_columns])
    return joined if spec.limit is None else joined.limit(spec.limit)


def _joined(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    same = left[nulls._quoted(left_key)].eqNullSafe(right[nulls._quoted(right_key)])
    conf = left.sparkSession._jsparkSession.sessionState().conf()
    sizes = [int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in (left, right)]
    if min(sizes) <= max(0, conf.autoBroadcastJoinThreshold()):
        return left.join(right, same, "inner")
    partitions = conf.numShufflePartitions()
    hot = [_hot_keys(df, key, size, partitions) for df, key, size in zip((left, right), (left_key, right_key), sizes)]
    if not any(hot):
        return left.join(right, same, "inner")
    # A row of one side is dealt to one of its key's pieces and repeated for each piece of the other side.
    pieces = [(k, hot[0].get(k, 1), hot[1].get(k, 1)) for k in {**hot[0], **hot[1]}]
    left = _dealt(left, left_key, pieces, "__left_piece", "__right_piece", right.schema[right_key])
    right = _dealt(right, right_key, [(k, b, a) for k, a, b in pieces], "__right_piece", "__left_piece", right.schema[right_key])
    same = left[nulls._quoted(left_key)].eqNullSafe(right[nulls._quoted(right_key)])
    for piece in ("__left_piece", "__right_piece"):
        same = same & (left[piece] == right[piece])
    out = left.join(right, same, "inner")
    return out.drop(left["__left_piece"], left["__right_piece"], right["__left_piece"], right["__right_piece"])


def _hot_keys(df: DataFrame, key: str, size: int, partitions: int) -> dict:
    """Hot keys of a side, at most one per partition, and into how many pieces each is dealt."""
    c = nulls.col(key)
    sample = df.select(c.alias("k")).sample(min(1.0, SAMPLED_BYTES / max(size, 1)), seed=5)
    many = max(1, math.ceil(partitions / HOT))
    total, present, top = sample.agg(F.count(F.lit(1)), F.count("k"), F.expr(f"approx_top_k(k, {min(many, 1000)}, 10000)")).first()
    counts = [(None, total - present), *[(e["item"], e["count"]) for e in top or ()]]
    least = max(LEAST_SAMPLED, HOT * total / partitions)
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    most = math.inf
    if conf.adaptiveExecutionEnabled() and conf.getConfString("spark.sql.adaptive.skewJoin.enabled", "true") == "true":
        factor = float(conf.getConfString("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "5.0"))
        threshold = _bytes(df, conf.getConfString("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "256MB"))
        most = max(factor / partitions, threshold / max(size, 1)) * total
    return {k: math.ceil(PIECES * n * partitions / total) for k, n in counts if least <= n <= most}


def _bytes(df: DataFrame, text: str) -> int:
    """A size like 64k or 256MB as Spark reads it."""
    return df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


def _dealt(df: DataFrame, key: str, pieces: list[tuple], own: str, other: str, field) -> DataFrame:
    """Rows with the number of their piece, once for each piece of the other side."""
    schema = T.StructType([T.StructField("__hot", field.dataType), T.StructField("__own", T.IntegerType()), T.StructField("__other", T.IntegerType())])
    table = F.broadcast(df.sparkSession.createDataFrame(pieces, schema, verifySchema=False))
    rest = [nulls.col(f.name) for f in df.schema if nulls.is_scalar(f.dataType)]
    # Copies of a row differ in where they lie, which a repeated task does not change.
    place = F.pmod(F.xxhash64(*rest, F.spark_partition_id()), F.coalesce("__own", F.lit(1))).cast("int")
    marked = df.join(table, nulls.col(key).eqNullSafe(F.col("__hot")), "left")
    return marked.select(
        *[nulls.col(n) for n in df.columns], place.alias(own),
        F.explode(F.sequence(F.lit(0), F.coalesce("__other", F.lit(1)) - 1)).alias(other))
