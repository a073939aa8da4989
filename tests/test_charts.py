import datetime as dt
import json

import pytest

from tablewright import ToolError, chart_batch, chart_data
from tablewright.operators.charts import records
from tablewright.specs import Chart
from tests.conftest import rows


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "m": spark.createDataFrame([(dt.datetime(2024, i, 28), i * 100) for i in (3, 1, 2, 6, 5, 4)], "date timestamp, revenue bigint"),
        "r": spark.createDataFrame([("North", 200), ("South", 150), ("East", 180), ("North", 220), ("South", 130), (None, 9)], "region string, revenue bigint"),
        "s": spark.createDataFrame([("active",)] * 3 + [("inactive",)] * 2 + [("pending",)], "status string"),
        "p": spark.createDataFrame([(i, 2 * i) for i in range(5)] + [(None, 1), (1, None)], "revenue bigint, cost bigint"),
    }


def points(tables, *args, **options):
    return [tuple(r) for r in chart_data(tables, Chart(*args, **options)).collect()]


def test_line(tables):
    assert [y for _, y in points(tables, "m", "line", "date", "revenue", "sum")] == [100, 200, 300, 400, 500, 600]
    assert [y for _, y in points(tables, "m", "line", "date", "revenue", sort="desc")][0] == 600
    with pytest.raises(ToolError, match="y_column"):
        chart_data(tables, Chart("m", "line", "date"))


def test_bar(tables):
    assert points(tables, "r", "bar", "region", "revenue", "sum") == [("North", 420), ("South", 280), ("East", 180)]
    assert points(tables, "r", "bar", "region", "revenue", "avg")[0] == ("North", 210.0)
    assert points(tables, "r", "bar", "region", limit=2) == [("North", 2), ("South", 2)]
    assert points(tables, "r", "bar", "region", "revenue", "median") == [("North", 210.0), ("East", 180.0), ("South", 140.0)]
    with pytest.raises(ToolError):
        chart_data(tables, Chart("r", "bar", "region", "revenue", "mode"))


def test_pie(tables):
    assert points(tables, "s", "pie", "status") == [("active", 3), ("inactive", 2), ("pending", 1)]
    assert points(tables, "r", "pie", "region", "revenue", "sum") == [("East", 180), ("North", 420), ("South", 280)]


def test_scatter(tables, spark):
    assert len(points(tables, "p", "scatter", "revenue", "cost")) == 5
    many = {"t": spark.range(2000).selectExpr("id x", "id y")}
    assert len(points(many, "t", "scatter", "x", "y")) == 2000
    a, b = (points(many, "t", "scatter", "x", "y", sample_seed=s, limit=500) for s in (1, 1))
    assert a == b and len(a) == 500 and max(x for x, _ in a) > 1500


def test_declared_kinds(tables, spark):
    t = {"t": spark.createDataFrame([(g, float(v)) for g in "ab" for v in range(11)], "g string, v double")}
    assert points(t, "t", "box", "g", "v") == [(g, 0.0, 2.5, 5.0, 7.5, 10.0) for g in "ab"]
    bars = points(t, "t", "histogram", "v")
    assert sum(n for _, n in bars) == 22 and bars[0] == ("(-0.01, 1.0]", 4) and len(bars) == 10
    assert points(t, "t", "histogram", "v") == bars
    assert len(points(t, "t", "heatmap", "g", "v")) == 22
    assert points(t, "t", "area", "g", "v", "sum") == [("a", 55.0), ("b", 55.0)]
    assert points(t, "t", "table", "v", sort="asc", limit=2) == [(0.0,), (0.0,)]


def test_batch_and_records(tables):
    results = chart_batch(tables, [
        Chart("m", "line", "date", "revenue", "sum"), Chart("zzz", "bar", "x"), Chart("m", "bar", "nope"), Chart("m", "radar", "date")])
    assert [str(r.status) for r in results] == ["success", "failed", "failed", "failed"]
    assert results[0].series_label == "Revenue" and "nope" in results[2].error
    first = json.loads(records(results[0].data).first()["record"])
    assert first == {"date": "2024-01-28T00:00:00.000", "revenue": 100}
