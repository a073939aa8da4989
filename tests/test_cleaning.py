import datetime as dt

import pytest

from tablewright import apply_cleaning
from tablewright.operators import cleaning as c
from tablewright.specs import CleaningStep
from tests.conftest import rows


def test_drop_fill_dedup(spark):
    df = spark.createDataFrame([(100.0, "A"), (None, "B"), (300.0, "C")], "revenue double, product string")
    assert c.drop_rows(df, "revenue").count() == 2
    country = spark.createDataFrame([("US",), (None,), ("UK",), (None,)], "country string")
    assert rows(c.fill_missing(country, "country")) == [("UK",), ("US",), ("Unknown",), ("Unknown",)]
    with pytest.raises(ValueError, match="Cannot fill"):
        c.fill_missing(df, "revenue")
    assert rows(c.fill_missing(df, "revenue", 0), "revenue") == [(0.0,), (100.0,), (300.0,)]
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, None), (None, None)], "a bigint, b string")
    assert c.deduplicate(twice).count() == 3


def test_strip(spark):
    df = spark.createDataFrame([("  Widget  ",), ("Gadget",), (" \tDoohickey\n",), (None,)], "p string")
    assert rows(c.strip_whitespace(df, "p")) == [(None,), ("Doohickey",), ("Gadget",), ("Widget",)]
    assert c.strip_whitespace(spark.range(1), "id").schema["id"].dataType.simpleString() == "string"


def test_cast(spark):
    df = spark.createDataFrame([(x,) for x in ("100", " 12 ", "1e3", "inf", "nan", "not_a_number", "1,000", "1d", "2f", "0x10", "", None)], "r string")
    assert [r[0] for r in c.cast_number(df, "r").collect()] == [100.0, 12.0, 1000.0, float("inf")] + [None] * 8
    assert c.cast_number(spark.range(1), "id").schema["id"].dataType.simpleString() == "bigint"


def test_parse_dates(spark):
    texts = ["2024-01-01", "2024-01-02 10:30:00", "2024-01-02T10:30:00Z", "not-a-date", "01/31/2024", "1-2-2024",
             "2024/03/04", "Jan 5, 2024", "5 Jan 2024", "20240105", "2024", "today", " 2024-01-01 ", "2024-13-01", None]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    d = dt.datetime
    assert [r[0] for r in c.parse_dates(df, "d").collect()] == [
        d(2024, 1, 1), d(2024, 1, 2, 10, 30), d(2024, 1, 2, 10, 30), None, d(2024, 1, 31), d(2024, 1, 2),
        d(2024, 3, 4), d(2024, 1, 5), d(2024, 1, 5), d(2024, 1, 5), None, None, d(2024, 1, 1), None, None,
    ]


def test_mapping(spark):
    df = spark.createDataFrame([("complete",), ("COMPLETE",), ("completed",), ("Pending",), (None,)], "status string")
    mapping = {"complete": "Completed", "COMPLETE": "Completed", "completed": "Completed"}
    expected = [(None,), ("Completed",), ("Completed",), ("Completed",), ("Pending",)]
    assert rows(c.normalize_format(df, "status", mapping)) == expected
    large = {**mapping, **{f"x{i}": "y" for i in range(300)}}
    assert rows(c.normalize_format(df, "status", large)) == expected


def test_declared_operations(spark):
    df = spark.createDataFrame([(1, float(i)) for i in (1, 2, 3, 4, 100)] + [(1, None)], "a int, v double")
    assert rows(c.clip_outlier(df, "v"), "v")[-1] == (7.0,)
    assert rows(c.clip_outlier(df, "v", 2, 3), "v") == [(None,), (2.0,), (2.0,), (3.0,), (3.0,), (3.0,)]
    assert rows(c.replace_value(df, "v", 100, 5), "v")[-1] == (5.0,)
    assert c.rename_column(c.drop_column(df, "a"), "v", "w").columns == ["w"]


def test_batch(spark):
    df = spark.createDataFrame([(100.0, " a"), (None, "b"), (None, "b"), (400.0, "c")], "revenue double, p string")
    steps = [
        CleaningStep("t", "strip_whitespace", "p", step_id="1"),
        CleaningStep("t", "deduplicate", step_id="2"),
        CleaningStep("t", "drop_rows", "revenue", step_id="3"),
        CleaningStep("t", "drop_rows", "p", outcome="rejected", step_id="4"),
        CleaningStep("t", "ignore_issue", "p", step_id="5"),
        CleaningStep("t", "fill_missing", "revenue", {"fill_value": "word"}, step_id="6"),
        CleaningStep("u", "deduplicate", step_id="7"),
        CleaningStep("t", "shuffle_cards", step_id="8"),
        CleaningStep("t", "fill_missing", "not_there", step_id="9"),
        CleaningStep("t", "clip_outlier", "revenue", {"upper": 300}, step_id="10"),
    ]
    for staged in (False, True):
        run = apply_cleaning({"t": df}, steps, staged)
        assert rows(run.tables["t"]) == [(100.0, "a"), (300.0, "c")]
        got = run.metrics().orderBy("sequence").select("status", "rows_before", "rows_after", "rows_removed", "rows_changed").collect()
        assert [tuple(r) for r in got] == [
            ("success", 4, 4, 0, 1), ("success", 4, 3, 1, 0), ("success", 3, 2, 1, 0), ("skipped", 2, 2, 0, 0),
            ("skipped", 2, 2, 0, 0), ("failed", 2, 2, 0, 0), ("failed", 0, 0, 0, 0), ("failed", 2, 2, 0, 0),
            ("success", 2, 2, 0, 0), ("success", 2, 2, 0, 1),
        ]
        s = run.summary().first()
        assert (s["total_steps"], s["executed_steps"], s["skipped_steps"], s["failed_steps"]) == (10, 5, 2, 3)
        assert s["rows_after"] == 2 and s["rows_removed"] == 2 and s["columns_changed"] == ["p", "revenue", "not_there"]
    assert df.count() == 4


def test_step_log(spark):
    df = spark.createDataFrame([(100.0,), (None,), (None,), (400.0,)], "revenue double")
    m = apply_cleaning({"t": df}, [CleaningStep("t", "drop_rows", "revenue")]).metrics().first()
    assert (m["rows_before"], m["rows_after"], m["rows_removed"], m["columns_changed"]) == (4, 2, 2, ["revenue"])


def test_mapping_size_changes_nothing(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (None, 3), (float("nan"), 4)], "v double, n int")
    few = {"1": 10, "1.0": 20, 2: 1.5, 7: None}
    many = few | {str(k): k for k in range(1000, 1500)}
    got = [rows(apply_cleaning({"t": df}, [CleaningStep("t", "normalize_format", "v", parameters={"mapping": m})]).tables["t"].filter("n < 4")) for m in (few, many)]
    assert got[0] == got[1] and len(got[0]) == 3


def test_missing_number_is_dropped_like_it_is_filled(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    run = apply_cleaning({"t": df}, [CleaningStep("t", "drop_rows", "v")])
    assert rows(run.tables["t"]) == [(1.0,)] and run.metrics().first()["rows_after"] == 1


def test_long_padded_dates_are_read(spark):
    df = spark.createDataFrame([(" " * 70 + "2024-01-02",)], "d string")
    assert str(c.parse_dates(df, "d").first()[0]).startswith("2024-01-02")
