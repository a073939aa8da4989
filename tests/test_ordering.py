"""Running sums over ranges against plain windows, with skew, copies and gaps."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.operators import features, ordering
from tablewright.operators.aggregates import exact_quantiles
from tests.conftest import plan, rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One group has a third of all rows, one day has half of them, every ninth value is missing."""
    rng = random.Random(3)
    data = [
        (i, "hot" if i % 3 == 0 else f"g{rng.randrange(40)}" if i % 50 else None,
         5 if i % 2 else rng.randrange(100) if i % 31 else None, rng.randrange(1000) if i % 9 else None)
        for i in range(4000)
    ]
    return spark.createDataFrame(data, "id bigint, g string, day int, v bigint").repartition(5).cache()


def _plain(df, partition):
    w = Window.partitionBy(*partition).orderBy(F.col("day").asc_nulls_last(), "id").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("e", F.when(F.col("v").isNotNull(), F.sum("v").over(w)))


@pytest.mark.parametrize("rows_per_range", [50, 700, 10_000])
def test_running_total_matches_window(skewed, rows_per_range):
    out = ordering.running_total(skewed, "v", "day", "e", tie=["id"], rows_per_range=rows_per_range)
    assert rows(out, "id", "e") == rows(_plain(skewed, []), "id", "e")


@pytest.mark.parametrize("rows_per_range", [50, 700, 10_000])
def test_running_total_per_group_matches_window(skewed, rows_per_range):
    out = ordering.running_total(skewed, "v", "day", "e", "g", ["id"], rows_per_range)
    expected = _plain(skewed, ["g"]).withColumn("e", F.when(F.col("g").isNotNull(), F.col("e")))
    assert rows(out, "id", "e") == rows(expected, "id", "e")


def test_hot_group_is_spread_over_ranges(skewed):
    r, heavy = ordering.ranged(skewed, ["day"], ["g"], ["id"], 200)
    assert not heavy and r.count >= 15
    sizes = [n for _, n in rows(r.frame.groupBy("__range").count())]
    assert sum(sizes) == 4000 and max(sizes) < 700


def test_no_single_partition_window_over_the_rows(skewed):
    text = plan(ordering.running_total(skewed, "v", "day", "e", tie=["id"], rows_per_range=200))
    assert "shufflepartitionidpassthrough" in text.lower()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_copies_of_one_row(spark):
    df = spark.createDataFrame([("a", 1, 2)] * 3000 + [("b", 1, 1)] * 50 + [("a", 0, 5)] * 7, "g string, s int, v int")
    out = ordering.running_total(df, "v", "s", "t", "g", rows_per_range=300)
    got = rows(out, "g", "t")
    expected = [("a", 5 * i) for i in range(1, 8)] + [("a", 35 + 2 * i) for i in range(1, 3001)] + [("b", i) for i in range(1, 51)]
    assert got == sorted(expected)


def test_one_value_of_the_order_column_for_most_rows(spark):
    """The cut columns alone cannot split these rows; a hash of the rest can."""
    df = spark.range(5000).select("id", F.when(F.col("id") < 4500, 1).otherwise(F.col("id")).alias("s"), F.lit(1).alias("v"))
    assert ordering.ranged(df, ["s"], rows_per_range=400)[1]
    r, heavy = ordering.ranged(df, ["s"], rows_per_range=400, cut_by_hash=True)
    assert not heavy and r.frame.groupBy("__range").count().agg(F.max("count")).first()[0] < 1200
    for tie in (None, []):
        out = ordering.running_total(df, "v", "s", "t", tie=tie, rows_per_range=400)
        assert [t for (t,) in rows(out, "t")] == list(range(1, 5001))
        assert out.filter("s > 1").agg(F.min("t")).first()[0] == 4501


def test_many_ranges(spark):
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("k"))
    out = ordering.row_numbers(df, ["k"], "n", rows_per_range=40)
    assert out.filter("n <> k + 1").count() == 0 and out.count() == 60_000


def test_row_numbers_and_lag(skewed):
    out = ordering.row_numbers(skewed, ["day"], "n", ["id"], 300)
    assert [n for (n,) in rows(out, "n")] == list(range(1, 4001))
    w = Window.orderBy(F.col("day").asc_nulls_last(), "id")
    for k in (1, 450, -2):
        got = ordering.lagged(skewed, "v", "day", k, "p", ["id"], rows_per_range=300)
        assert rows(got, "id", "p") == rows(skewed.withColumn("p", F.lag("v", k).over(w)), "id", "p")


def test_period_change(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 0.0), (3, 50.0), (4, None), (5, 100.0)], "d int, v double")
    assert rows(features.period_change(df, "v", "d"), "d", "v_pct_change") == [(1, None), (2, -1.0), (3, None), (4, None), (5, None)]
    filled = features.period_change(df, "v", "d", fill=True, rows_per_range=2)
    assert rows(filled, "d", "v_pct_change") == [(1, None), (2, -1.0), (3, None), (4, 0.0), (5, 1.0)]
    with pytest.raises(ValueError):
        features.period_change(df, "v", None)


def test_exact_quantiles(skewed):
    known = skewed.filter("g is not null")
    got = exact_quantiles(known, ["g"], ["v"], [0.0, 0.25, 0.5, 1.0], gathered=15)
    want = known.groupBy("g").agg(*[F.percentile("v", p).alias(f"q{i}") for i, p in enumerate((0.0, 0.25, 0.5, 1.0))])
    assert rows(got, "g", "q0", "q1", "q2", "q3") == rows(want)


def test_strings_decimals_and_timestamps_as_order(spark):
    df = spark.range(500).select(
        "id", F.concat(F.lit('q"uo\\te '), (F.col("id") * 7919 % 500).cast("string")).alias("s"),
        (F.col("id") * 31 % 500).cast("decimal(12,3)").alias("d"),
        F.timestamp_micros(F.col("id") * 7_000_003 % 500_000_000).alias("t"),
        F.timestamp_micros(F.col("id") * 7_000_003 % 500_000_000).cast("timestamp_ntz").alias("n"),
    )
    for c in ("s", "d", "t", "n"):
        out = ordering.row_numbers(df, [c], "r", ["id"], 60)
        want = df.withColumn("r", F.row_number().over(Window.orderBy(c, "id")))
        assert rows(out, "id", "r") == rows(want, "id", "r")
        grouped = ordering.prefix_sums(df, ["id"], {"r": F.lit(1)}, [c], totals=True, rows_per_range=60)
        assert grouped.agg(F.max("r_total")).first()[0] <= 2


def test_empty(spark):
    df = spark.createDataFrame([], "a int, b int")
    assert ordering.running_total(df, "b", "a", "c", rows_per_range=1).count() == 0


def test_ten_thousand_ranges(spark):
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("k"), (F.col("id") % 3).alias("g"))
    r, heavy = ordering.ranged(df, ["k"], rows_per_range=6)
    assert not heavy and 9_000 < r.count < 11_000
    out = ordering.row_numbers(df, ["k"], "n", rows_per_range=6)
    assert out.filter("n <> k + 1").count() == 0 and out.count() == 60_000
    grouped = ordering.running_total(df.withColumn("one", F.lit(1)), "one", "k", "n", "g", rows_per_range=6)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert grouped.join(want, ["k", "g", "n"]).count() == 60_000


@pytest.mark.parametrize("most", [1 << 30, 1000])
def test_wide_text_keys_stay_in_spark(spark, monkeypatch, most):
    """10 kB of order key a row; cuts are broadcast or joined, never part of the plan."""
    monkeypatch.setattr(ordering, "BROADCAST_BYTES", most)
    monkeypatch.setattr(ordering, "BROADCAST_ROWS", most)
    monkeypatch.setattr(ordering, "ROWS_PER_SALT", 20)
    df = spark.range(3000).select("id", F.concat(F.lpad((F.col("id") * 7919 % 3000).cast("string"), 5, "0"), F.repeat(F.lit("wide key "), 1100)).alias("s"))
    df = df.withColumn("s", F.concat(F.lit("the same start of every key "), "s"))
    out = ordering.row_numbers(df, ["s"], "n", ["id"], rows_per_range=5)
    assert "the same start" not in plan(out).replace("concat(the same start of every key ", "")
    assert out.filter(F.col("n") != F.col("id") * 7919 % 3000 + 1).count() == 0 and out.count() == 3000


@pytest.mark.parametrize("fan", [2, 5])
def test_offsets_up_a_tree(skewed, monkeypatch, fan):
    monkeypatch.setattr(ordering, "FAN", fan)
    out = ordering.running_total(skewed, "v", "day", "e", "g", ["id"], 60)
    expected = _plain(skewed, ["g"]).withColumn("e", F.when(F.col("g").isNotNull(), F.col("e")))
    assert rows(out, "id", "e") == rows(expected, "id", "e")
    out = ordering.running_total(skewed, "v", "day", "e", tie=["id"], rows_per_range=60)
    assert rows(out, "id", "e") == rows(_plain(skewed, []), "id", "e")


@pytest.mark.parametrize("fan", [3, 256])
def test_a_gap_over_many_blocks_is_filled(spark, monkeypatch, fan):
    monkeypatch.setattr(ordering, "FAN", fan)
    df = spark.range(2000).select("id", F.when(F.col("id").isin(0, 5, 1203), F.col("id").cast("double")).alias("v"))
    out = ordering.lagged(df, "v", "id", 1, "p", [], True, rows_per_range=20)
    assert rows(out.filter("id > 0"), "id", "p") == [(i, 0.0 if i <= 5 else 5.0 if i <= 1203 else 1203.0) for i in range(1, 2000)]


def test_no_window_or_sort_in_a_single_task(skewed):
    for out in (
        ordering.running_total(skewed, "v", "day", "e", tie=["id"], rows_per_range=50),
        ordering.lagged(skewed, "v", "day", 1, "p", ["id"], True, rows_per_range=50),
    ):
        assert "SinglePartition" not in plan(out)


def test_many_short_ranges_share_tasks(spark):
    """a range of a few rows does not cost a task of its own."""
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v"), F.concat(F.lit("t"), F.col("id") * 31 % 997).alias("s"))
    r, heavy = ordering.ranged(df, ["s"], tie=["v"], rows_per_range=3)
    assert not heavy and r.count > 500
    assert r.shuffled().rdd.getNumPartitions() <= 8
    out = ordering.row_numbers(df, ["s"], "n", tie=["v"], rows_per_range=3)
    expected = df.withColumn("n", F.row_number().over(Window.orderBy("s", "v")))
    assert rows(out, "v", "n") == rows(expected, "v", "n")


def test_copies_are_written_out_by_many_tasks(spark, monkeypatch):
    """the few rows that stand for all copies do not meet in one task."""
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 500)
    df = spark.createDataFrame([("a", 1)] * 3000 + [("b", 1)] * 2000, "g string, s int")
    out = ordering.prefix_sums(df, ["s"], {"n": F.lit(1).cast("bigint")}, ["g"], rows_per_range=100)
    sizes = [n for _, n in rows(out.groupBy(F.spark_partition_id().alias("p")).count())]
    assert sum(sizes) == 5000 and max(sizes) <= 1000
    assert rows(out, "g", "n") == sorted([("a", i + 1) for i in range(3000)] + [("b", i + 1) for i in range(2000)])


def test_a_frequent_key_of_the_sample_is_one_row(spark):
    """cuts from counted keys are those from all keys of the sample in order."""
    keys = [0] * 40 + [1] * 3 + list(range(2, 30)) + [30] * 25
    sample = spark.createDataFrame([(p, k) for p in (0, 1) for k in keys[p:]], "part int, __key int")
    for step in (1, 2, 7, 50, 500):
        for r in ordering._every(sample, "part", step).collect():
            every = [k for i, k in enumerate(keys[r["part"]:]) if i and i % step == 0]
            assert r["__cuts"] == sorted(set(every)) and r["__all"] == len(every)


def test_cuts_of_long_texts_are_never_in_one_task(spark, monkeypatch):
    """neither a task that numbers the ranges nor a row holds the cuts of many ranges."""
    monkeypatch.setattr(ordering, "BROADCAST_BYTES", 1000)
    staged, write = [], ordering.stage
    monkeypatch.setattr(ordering, "stage", lambda df, label: staged.append(write(df, label)) or staged[-1])
    wide = F.concat(F.repeat(F.lit("the same start "), 400), F.lpad((F.col("id") * 7919 % 3000).cast("string"), 5, "0"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordering.row_numbers(spark.range(3000).select("id", wide.alias("s")), ["s"], "n", ["id"], rows_per_range=3)
        held = [df.select(F.length(F.to_json(F.struct("*"))).alias("size"), F.input_file_name().alias("f")) for df in staged]
        sizes = [[n for _, n in rows(df.groupBy("f").agg(F.sum("size")))] for df in held]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    cuts = 950 * 6000
    assert sum(map(sum, sizes)) > cuts and max(map(max, sizes)) < cuts / 3
    assert out.filter(F.col("n") != F.col("id") * 7919 % 3000 + 1).count() == 0 and out.count() == 3000


@pytest.mark.parametrize("most", [1 << 30, 100])
@pytest.mark.parametrize("salt", [2_000_000, 40])
def test_shortened_cuts_keep_the_order(spark, monkeypatch, most, salt):
    """texts that share starts of many lengths, copies, empty and missing ones, in groups with such names."""
    monkeypatch.setattr(ordering, "BROADCAST_BYTES", most)
    monkeypatch.setattr(ordering, "ROWS_PER_SALT", salt)
    rng = random.Random(5)
    starts = ["", "a", "é" * 16, "b" * 15, "b" * 16, "b" * 17, "b" * 64, "b" * 600, "b" * 5000]
    data = [
        (i, rng.choice(["g", "g", "g" * 20, "g" * 20 + "h", "", None]),
         None if i % 40 == 0 else rng.choice(starts) + (rng.choice("abcé") * rng.randrange(70) if i % 3 else ""), i % 7 + 0.5, [i])
        for i in range(1500)
    ]
    df = spark.createDataFrame(data, "id bigint, g string, s string, v double, a array<bigint>").repartition(4)
    order = [F.col("s").asc_nulls_last(), "id"]
    out = ordering.row_numbers(df, ["s"], "n", ["id"], rows_per_range=3)
    assert rows(out, "id", "n", "a") == rows(df.withColumn("n", F.row_number().over(Window.orderBy(*order))), "id", "n", "a")
    grouped = ordering.running_total(df, "v", "s", "t", "g", ["id"], rows_per_range=3).filter("g is not null")
    running = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    assert rows(grouped, "id", "t") == rows(df.filter("g is not null").withColumn("t", F.sum("v").over(running)), "id", "t")


def test_sorted_parts_are_dealt_out_once(spark, monkeypatch):
    """long rows go to the task of their part and stay there; sums and rows read the same shuffle."""
    monkeypatch.setattr(ordering, "BROADCAST_BYTES", 100)
    df = spark.range(3000).select("id", F.concat((F.col("id") * 7919 % 3000).cast("string"), F.lit("x")).alias("s"))
    out = ordering.row_numbers(df, ["s"], "n", ["id"], rows_per_range=3).select("id", "n")
    assert "shufflepartitionidpassthrough" not in plan(out).lower() and "SinglePartition" not in plan(out)
    assert rows(out) == rows(df.select("id", F.row_number().over(Window.orderBy("s", "id"))))
    hot = df.withColumn("s", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("s")))
    out = ordering.row_numbers(hot, ["s"], "n", ["id"], rows_per_range=3).select("id", "n")
    assert rows(out) == rows(hot.select("id", F.row_number().over(Window.orderBy("s", "id"))))
