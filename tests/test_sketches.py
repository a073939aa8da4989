"""Merged sketches against the exact profile of all rows."""

import math

import pytest
from pyspark.sql import functions as F

from tablewright import Dataset, ToolError, profile_table
from tablewright.operators.sketches import merge_sketches, sketch_columns, sketched_profile
from tests.conftest import rows

EXACT = (
    "column_name", "data_type", "total_count", "null_count", "null_percent", "num_min", "num_max", "min_date", "max_date", "padded_count",
    "is_likely_id", "is_likely_metric", "is_likely_date",
)


@pytest.fixture(scope="module")
def table(spark):
    k = F.col("id")
    return spark.range(20_000).select(
        (k * 7919 % 20_011).alias("order_id"), F.when(k % 9 != 0, F.exp((k * 31 % 1000) / 100.0)).alias("price"),
        F.when(k % 4 == 0, " b").otherwise(F.concat(F.lit("c"), (k % 300).cast("string"))).alias("name"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int")).alias("day"), F.lit(None).cast("string").alias("nothing"),
        F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (k % 90).cast("int")), "yyyy-MM-dd").alias("day_text"), F.array(k).alias("list"),
    )


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_merged_sketches(table, parts):
    pieces = [sketch_columns(table.filter(F.col("order_id") % parts == i)) for i in range(parts)]
    got = sketched_profile(merge_sketches(*pieces), "t")
    want = profile_table(table, "t", duplicates=False).columns
    assert rows(got, *EXACT) == rows(want, *EXACT)
    estimated = {r["column_name"]: r for r in got.collect()}
    for r in want.collect():
        e = estimated[r["column_name"]]
        for n in ("unique_count", "unique_dates"):
            assert (e[n] is None) == (r[n] is None) and (r[n] is None or abs(e[n] - r[n]) <= 0.03 * r[n]), (r["column_name"], n)
        for n in ("num_mean", "num_std"):
            assert e[n] == r[n] or math.isclose(e[n], r[n], rel_tol=1e-9)
        if r["num_median"] is not None:
            c = F.col(r["column_name"])
            for n, p in (("num_q1", 0.25), ("num_median", 0.5), ("num_q3", 0.75)):
                low, high = table.filter(c.isNotNull()).agg(F.avg((c < e[n]).cast("int")), F.avg((c <= e[n]).cast("int"))).first()
                assert low - 0.02 <= p <= high + 0.02


def test_nothing_to_sketch(spark):
    empty = sketch_columns(spark.createDataFrame([], "a int, b string"))
    one = sketch_columns(spark.createDataFrame([(4, "x")], "a int, b string"))
    got = sketched_profile(merge_sketches(empty, one, empty), "t")
    assert rows(got, "column_name", "total_count", "unique_count", "num_mean", "num_std") == [("a", 1, 1, 4.0, None), ("b", 1, 1, None, None)]
    assert rows(sketched_profile(merge_sketches(empty, empty), "t"), "column_name", "total_count", "unique_count") == [("a", 0, 0), ("b", 0, 0)]


def test_versions_keep_sketches(spark, tmp_path, table):
    data = Dataset(spark, str(tmp_path / "d"))
    data.write({"t": table.filter("order_id % 3 > 0"), "u": spark.range(5)})
    with pytest.raises(ToolError, match="sketches"):
        data.sketched_profile()
    data.sketch()
    version = data.extend({"t": table.filter("order_id % 3 = 0"), "v": spark.range(7).withColumnRenamed("id", "k")})
    assert (version.number, version.parent) == (2, 1) and data.tables()["t"].count() == 20_000
    data.tables(1)["t"].sparkSession  # the older version stays readable
    got = {(r["table_name"], r["column_name"]): r["total_count"] for r in data.sketched_profile().collect()}
    assert got["t", "price"] == 20_000 and got["u", "id"] == 5 and got["v", "k"] == 7
    assert rows(data.sketched_profile(1).filter("table_name = 't'"), "total_count") == [(table.filter("order_id % 3 > 0").count(),)] * 7
