import datetime as dt

import pytest

from tablewright import apply_features
from tablewright.operators import aggregates, features
from tablewright.operators.buckets import equal_edges, interval_labels
from tablewright.specs import Feature
from tests.conftest import rows


def test_ratio_and_arithmetic(spark):
    df = spark.createDataFrame([(100.0, 2.0), (200.0, 4.0), (100.0, 0.0), (None, 1.0)], "revenue double, n double")
    assert [r["revenue_per_n"] for r in features.ratio(df, "revenue", "n").collect()] == [50.0, 50.0, None, None]
    for op, expected in (("+", 102.0), ("-", 98.0), ("*", 200.0), ("/", 50.0)):
        assert features.arithmetic(df, "revenue", "n", op).first()["result"] == expected
    assert features.arithmetic(df, "revenue", "n", "/").collect()[2]["result"] is None
    with pytest.raises(ValueError, match="is none of"):
        features.arithmetic(df, "revenue", "n", "^")


def test_date_parts(spark):
    df = spark.createDataFrame([("2024-03-15",), ("x",), ("01/01/2023",)], "d string")
    out = features.date_parts(df, "d", ["year", "month", "week", "weekday", "day"])
    assert [tuple(r)[1:] for r in out.collect()] == [(2024, 3, 11, 4, 15), (None,) * 5, (2023, 1, 52, 6, 1)]
    assert features.date_parts(df, "d").columns == ["d", "d_year", "d_month", "d_week", "d_weekday"]
    stamp = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "d timestamp")
    assert tuple(features.date_parts(stamp, "d").first())[1:] == (2024, 1, 1, 0)


def test_buckets(spark):
    df = spark.createDataFrame([(10.0,), (75.0,), (200.0,), (0.0,), (50.0,), (301.0,), (None,)], "v double")
    out = features.bucketize(df, "v", [0, 50, 150, 300], ["low", "medium", "high"])
    assert [r["v_bucket"] for r in out.collect()] == ["low", "medium", "high", None, "low", None, None]
    assert features.bucketize(df, "v", [0, 50, 150]).first()["v_bucket"] == "(0, 50]"
    by_count = features.bucketize(df, "v", 3).collect()
    assert [r["v_bucket"] for r in by_count][:4] == ["(-0.301, 100.333]", "(-0.301, 100.333]", "(100.333, 200.667]", "(-0.301, 100.333]"]
    with pytest.raises(ValueError):
        features.bucketize(df, "v", [5, 1])


def test_edges_of_a_constant():
    assert equal_edges(5.0, 5.0, 2) == [4.995, 5.0, 5.005]
    assert interval_labels([0.0001, 0.00012, 1.0]) == ["(0.0001, 0.00012]", "(0.00012, 1.0]"]


def test_aggregates_by_name(spark):
    df = spark.createDataFrame([("email", 100.0, 2), ("social", 200.0, 1), ("email", 50.0, 1), ("social", None, 3), (None, 9.0, 1)], "channel string, v double, at int")
    expected = {
        "sum": (150.0, 200.0), "mean": (75.0, 200.0), "min": (50.0, 200.0), "max": (100.0, 200.0), "count": (2, 1),
        "median": (75.0, 200.0), "nunique": (2, 1), "first": (50.0, 200.0), "last": (100.0, 200.0),
        "var": (1250.0, None),
    }
    for name, values in expected.items():
        out = aggregates.aggregate_named(df, "v", "channel", name, "o", "at")
        assert rows(out, "channel", "o") == list(zip(("email", "social"), values)), name
    with pytest.raises(ValueError):
        aggregates.aggregate_named(df, "v", "channel", "first", "o")
    with pytest.raises(ValueError):
        aggregates.aggregate_named(df, "v", "channel", "mode", "o")


def test_batch(spark):
    df = spark.createDataFrame([("2024-01-02", "a", 100.0, 1), ("2024-01-01", "a", 50.0, 2), ("2024-01-03", "b", 10.0, 2)], "d string, ch string, revenue double, user int")
    run = apply_features({"t": df}, [
        Feature("r", "ratio", "t", ("revenue",), {"numerator": "revenue", "denominator": "user"}, "r"),
        Feature("again", "arithmetic", "t", ("r",), {"left": "r", "right": "revenue", "operator": "-"}, "again"),
        Feature("w", "window", "t", (), {"value_column": "revenue", "sort_column": "d"}),
        Feature("wp", "window", "t", (), {"value_column": "revenue", "sort_column": "d", "partition_column": "ch"}, "by_ch"),
        Feature("parts", "date_extract", "t", ("d",), {"source_column": "d", "parts": ["year"]}),
        Feature("agg", "aggregate", "t", (), {"value_column": "revenue", "group_by": "ch"}),
        Feature("arpu", "ratio", "t", (), {"numerator": "revenue", "denominator_distinct": "user"}, "arpu"),
        Feature("no", "custom_formula", "t"),
        Feature("gone", "ratio", "t", ("nope",), {}),
        Feature("lost", "ratio", "u", (), {}),
        Feature("half", "ratio", "t", (), {"numerator": "revenue"}),
        Feature("bad", "arithmetic", "t", (), {"left": "revenue", "right": "user", "operator": "%"}),
        Feature("odd", "teleport", "t"),
        Feature("change", "period_change", "t", (), {"value_column": "revenue", "sort_column": "d"}),
        Feature("bucket", "bucketize", "t", (), {"column": "revenue", "bins": [0, 60, 200]}),
    ])
    statuses = [str(s.status) for s in run.steps]
    assert statuses == ["success"] * 7 + ["failed"] * 6 + ["success"] * 2
    assert rows(run.tables["t"], "d", "r", "again", "running_revenue", "by_ch", "d_year", "revenue_pct_change", "revenue_bucket") == [
        ("2024-01-01", 25.0, -25.0, 50.0, 50.0, 2024, None, "(0, 60]"),
        ("2024-01-02", 100.0, 0.0, 150.0, 150.0, 2024, 1.0, "(60, 200]"),
        ("2024-01-03", 5.0, -5.0, 160.0, 10.0, 2024, -0.9, "(0, 60]"),
    ]
    assert rows(run.new_tables["ch_revenue_agg"]) == [("a", 150.0), ("b", 10.0)]
    assert rows(run.new_tables["t_arpu"]) == [(80.0,)]
    assert run.log(spark).filter("status = 'failed' and error is not null").count() == 6
    assert df.columns == ["d", "ch", "revenue", "user"]
