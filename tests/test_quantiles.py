"""Radix selection against sorted values, and the shape of its plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tablewright import staging
from tablewright.operators import quantiles
from tests.conftest import plan, rows

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def expected(values, p):
    values = sorted(v + 0.0 for v in values if v is not None and not math.isnan(v))
    place = (len(values) - 1) * p
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low if low == high else low + (high - low) * (place - math.floor(place))


def _samples():
    rng = random.Random(8)
    same = [5.25] * 3000 + [1.0, 9.0]
    wide = [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(900)]
    near = [1.0 + k * 2.0**-52 for k in range(600)] * 2
    tiny = [k * 5e-324 for k in range(-40, 400)]
    ends = [math.inf, -math.inf, 0.0, -0.0, 1.0, -1.0, None, math.nan] * 5
    powers = [float(2**k) for k in range(-60, 60)] + [2.0**k - 2.0 ** (k - 53) for k in range(-60, 60)]
    normal = [round(rng.gauss(0, 100), 2) for _ in range(4000)]
    return {"same": same, "wide": wide, "near": near, "tiny": tiny, "ends": ends, "powers": powers, "normal": normal, "one": [3.5], "two": [1.0, 2.0], "none": [None]}


@pytest.mark.parametrize("gathered", [0, 5, 4096])
def test_every_kind_of_values(spark, gathered):
    samples = _samples()
    df = spark.createDataFrame([(g, v) for g, vs in samples.items() for v in vs], "g string, v double").repartition(6)
    got = {r["g"]: r for r in quantiles.quantiles(df, ["g"], [F.col("v")], PROBABILITIES, gathered).collect()}
    assert set(got) == set(samples) - {"none"}
    for g, r in got.items():
        for i, p in enumerate(PROBABILITIES):
            want = expected(samples[g], p)
            assert r[f"q{i}"] == want or math.isnan(want) and math.isnan(r[f"q{i}"]), (g, p)


def test_more_opened_slots_than_the_driver_keeps(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "held", lambda df, label: staging.held(df, label, 10))
    df = spark.range(6000).select((F.col("id") % 30).alias("g"), (F.col("id") * 7919 % 6007).cast("double").alias("v"))
    got = rows(quantiles.quantiles(df, ["g"], [F.col("v"), -F.col("v")], [0.5], gathered=3))
    want = df.groupBy("g").agg(F.percentile("v", 0.5).alias("a"), F.percentile(-F.col("v"), 0.5).alias("b")).collect()
    assert got == sorted([(r.g, 0, r.a) for r in want] + [(r.g, 1, r.b) for r in want])


def test_no_keys_missing_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 5), ("a", None)], "g string, v int")
    assert rows(quantiles.quantiles(df, [], [F.col("v")], [0.5])) == [(0, 2.5)]
    assert rows(quantiles.quantiles(df, ["g"], [F.col("v")], [0.5])) == [("a", 0, 4.0)]
    assert quantiles.quantiles(df.limit(0), ["g"], [F.col("v")], [0.5]).count() == 0


def test_values_are_neither_sorted_nor_staged(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("nothing is written where few groups are open")

    monkeypatch.setattr(staging, "stage", refuse)
    df = spark.range(100_000).select((F.col("id") % 3).alias("g"), F.rand(3).alias("v"))
    text = plan(quantiles.quantiles(df, ["g"], [F.col("v")], [0.5]))
    assert "RangePartitioning" not in text and "rangepartitioning" not in text and "SortMergeJoin" not in text
