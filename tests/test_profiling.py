import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tablewright import profile_table, profile_tables, suggest_charts, suggest_cleaning, suggest_features
from tablewright.functions import ids
from tablewright.operators import profiling
from tablewright.operators.aggregates import duplicate_count
from tablewright.operators.profiling import likely_columns, profile_columns
from tablewright.plans import chart_plan, cleaning_plan, feature_plan
from tests.conftest import plan, rows


def issues(p, *columns):
    return [tuple(r) for r in p.issues.orderBy("issue_order").select(*(columns or ("column_name", "issue_type", "impact_level"))).collect()]


def column(p, name):
    return p.columns.filter(F.col("column_name") == name).first()


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [("2024-01-01", "Widget A", 10, 500.0), ("2024-01-02", "Widget B", 5, 250.0), ("2024-01-03", "Widget A", 8, 400.0),
         ("2024-01-04", "Widget C", 12, 720.0), ("2024-01-05", "Widget B", 3, 150.0)],
        "date string, product string, units int, revenue double",
    )


def test_simple_sales(sales):
    p = profile_table(sales, "sales")
    assert p.columns.count() == 4
    assert {r["column_name"]: r["data_type"] for r in p.columns.collect()} == {
        "date": "date", "product": "categorical", "units": "integer", "revenue": "float"}
    assert column(p, "revenue")["is_likely_metric"] and column(p, "date")["is_likely_date"]
    assert column(p, "product")["is_likely_categorical"]
    assert issues(p) == [("date", "date_stored_as_text", "medium")]
    r = column(p, "revenue")
    assert (r["num_min"], r["num_max"], r["num_mean"], r["num_median"], r["num_q1"], r["num_q3"]) == (150.0, 720.0, 404.0, 400.0, 250.0, 500.0)
    assert r["num_std"] == pytest.approx(49330 ** 0.5)
    d = column(p, "date")
    assert (d["min_date"], d["max_date"], d["unique_dates"]) == (dt.date(2024, 1, 1), dt.date(2024, 1, 5), 5)
    assert column(p, "product")["top_values"] == ["Widget A", "Widget B", "Widget C"]
    assert column(p, "units")["total_count"] == 5 and column(p, "units")["unique_percent"] == 100.0


def test_missing_values(spark):
    p = profile_table(spark.createDataFrame([(100.0,), (None,), (float("nan"),), (300.0,), (500.0,)], "revenue double"), "t")
    r = column(p, "revenue")
    assert (r["null_count"], r["null_percent"], r["unique_count"]) == (2, 40.0, 3)
    assert issues(p) == [(None, "duplicate_rows", "high"), ("revenue", "missing_values", "high")]
    p = profile_table(spark.createDataFrame([("US",), (None,)] + [("UK",)] * 3, "country string"), "t", duplicates=False)
    assert issues(p) == [("country", "missing_values", "medium")]
    text = [(f"words number {i}",) for i in range(20)] * 2 + [(None,)]
    p = profile_table(spark.createDataFrame(text, "description string"), "t", duplicates=False)
    assert issues(p) == [("description", "missing_values", "low")]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a bigint, b string")
    assert issues(profile_table(df, "t"), "issue_type", "affected_rows_count", "affected_rows_percent", "impact_level") == [
        ("duplicate_rows", 1, 33.33, "high")]
    long = "w" * 500
    df = spark.createDataFrame([(long, None), (long, None), (long + "!", None), (None, long), ("", None), (None, "")], "a string, b string")
    assert duplicate_count(df).first()[0] == 1


def test_text_kinds(spark):
    def one(values, name="c"):
        p = profile_table(spark.createDataFrame([(v,) for v in values], f"{name} string"), "t", duplicates=False)
        return p.columns.first(), issues(p)

    r, found = one(["100", "200", "300", "400", "x"], "amount")
    assert r["data_type"] == "float" and r["is_likely_metric"] and r["num_max"] == 400.0
    assert found == [("amount", "numeric_stored_as_text", "medium")]
    assert one([None, None])[0]["data_type"] == "unknown"
    assert one(["10", "20", "2024-01-01", "2024-01-02", "a", "b", "c"])[1] == [("c", "mixed_types", "medium")]
    assert one([" a", "b", "c "])[1] == [("c", "whitespace", "low")]
    r, found = one([f"k{i}" for i in range(60)], "channel")
    assert r["data_type"] == "string" and found == [("channel", "high_cardinality_category", "low")]
    assert one([f"v{i % 16}" for i in range(400)])[0]["data_type"] == "categorical"
    assert one([f"v{i % 16}" for i in range(300)])[0]["data_type"] == "string"


def test_long_texts_are_counted_whole(spark):
    stem = "word " * 100
    df = spark.createDataFrame([(stem + "a",)] * 3 + [(stem + "b",)] * 2 + [("short",)] + [("1" * 100,)], "body string")
    r = profile_table(df, "t").columns.first()
    assert r["unique_count"] == 4 and r["top_values"][:2] == [stem + "a", stem + "b"]
    assert r["padded_count"] == 0 and r["numeric_share"] == pytest.approx(1 / 7)


def test_other_types(spark):
    df = spark.sql("""SELECT true AS flag, CAST(1.50 AS DECIMAL(9,2)) AS price, DATE'2024-02-01' AS day,
        TIMESTAMP'2024-02-01 10:00:00.5' AS seen, TIMESTAMP_NTZ'2024-02-01 10:00:00.000001' AS wall, array(1) AS list,
        CAST(9007199254740993 AS BIGINT) AS big, X'00' AS raw
        UNION ALL SELECT false, 2.50, DATE'2024-02-03', NULL, NULL, NULL, 9007199254740992, NULL""")
    p = profile_table(df, "t")
    got = {r["column_name"]: (r["data_type"], r["null_count"], r["unique_count"], r["top_values"]) for r in p.columns.collect()}
    assert got == {
        "flag": ("boolean", 0, 2, ["false", "true"]), "price": ("float", 0, 2, ["1.50", "2.50"]),
        "day": ("datetime", 0, 2, ["2024-02-01", "2024-02-03"]), "seen": ("datetime", 1, 1, ["2024-02-01 10:00:00.5"]),
        "wall": ("datetime", 1, 1, ["2024-02-01 10:00:00.000001"]), "list": ("unknown", 1, None, []),
        "big": ("integer", 0, 2, ["9007199254740992", "9007199254740993"]), "raw": ("unknown", 1, None, []),
    }
    assert column(p, "price")["num_mean"] == 2.0


def test_approximate_profile_of_small_data_is_exact(sales):
    exact, approx = (profile_table(sales, "t", approx=a).columns.drop("top_values", "sample_values").orderBy("column_index").collect() for a in (False, True))
    for e, a in zip(exact, approx):
        for n in e.asDict():
            same = pytest.approx(e[n]) if isinstance(e[n], float) and n not in ("num_q1", "num_q3") else e[n]
            assert a[n] == same, n


def test_empty_table(spark):
    p = profile_table(spark.createDataFrame([], "a int, b string"), "t")
    assert [(r["total_count"], r["null_percent"], r["unique_count"]) for r in p.columns.collect()] == [(0, 0.0, 0)] * 2
    assert p.issues.count() == 0


def test_strict_date_words(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "status string")
    assert issues(profile_table(df, "t", False)) == [("status", "missing_values", "high")]
    assert issues(profile_table(df, "t", False, strict_date_words=True)) == [("status", "missing_values", "medium")]


def test_uuid5(spark):
    names = ["t.ratio.aov", "clean_001_missing_values_t_é", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n")))
    assert {tuple(r) for r in df.collect()} == {(n, str(uuid.uuid5(uuid.NAMESPACE_DNS, n))) for n in names}


@pytest.fixture(scope="module")
def dirty(spark):
    data = [(i, None if i % 4 == 0 else str(i * 10.5), None if i % 5 == 0 else "ab"[i % 2], f"2024-01-{i % 28 + 1:02d}",
             " x" if i % 3 else "x", None if i == 1 else "free text %d" % i) for i in range(100)]
    df = spark.createDataFrame(data + data[:5], "user_id bigint, revenue string, segment string, day string, note string, remark string")
    return profile_table(df, "orders")


def test_cleaning_steps(dirty):
    steps = suggest_cleaning(dirty.columns, dirty.issues)
    got = [tuple(r) for r in steps.orderBy("sequence").select(
        "column_name", "operation", "requires_approval", "default_decision", "estimated_rows_removed").collect()]
    assert got == [
        (None, "deduplicate", True, "require_review", 5), ("revenue", "drop_rows", True, "require_review", 27),
        ("revenue", "cast_type", True, "require_review", 0), ("segment", "fill_missing", True, "require_review", 0),
        ("day", "parse_dates", True, "require_review", 0), ("note", "strip_whitespace", False, "approve", 0),
        ("remark", "ignore_issue", False, "approve", 0),
    ] or got[6][1] in ("drop_rows", "ignore_issue")
    first = steps.filter("sequence = 2").first()
    assert first["step_id"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "clean_002_missing_values_orders_revenue"))
    assert first["parameters"] == {"column": "revenue", "strategy": "drop_rows_with_missing_key_fields"}
    assert first["metrics_potentially_affected"] == ["revenue"] and first["rows_before"] == 105
    s = cleaning_plan.summarize_cleaning(steps).first()
    assert s["total_steps"] == 7 and s["estimated_row_count_change"] >= 32
    assert s["estimated_columns_changed"][:2] == ["revenue", "segment"]


def test_decisions(dirty, spark):
    steps = suggest_cleaning(dirty.columns, dirty.issues)
    by_seq = {r["sequence"]: r["step_id"] for r in steps.collect()}
    schema = "step_id string, decision string, modified_operation string, modified_parameters map<string,string>"

    def decide(*items):
        return spark.createDataFrame([(i + (None, None))[:4] for i in items], schema)

    resolved = cleaning_plan.resolve_decisions(steps, decide(
        (by_seq[1], "approve"), (by_seq[2], "reject"),
        (by_seq[4], "modify", "normalize_format", {"column": "segment", "mapping": '{"a": "z"}'}), (by_seq[5], "approve")))
    outcomes = {r["sequence"]: r["outcome"] for r in resolved.collect()}
    assert [outcomes[i] for i in range(1, 7)] == ["approved", "rejected", "blocked", "modified", "approved", "auto_approved"]
    assert not cleaning_plan.summarize_decisions(resolved).first()["can_execute"]
    ready = cleaning_plan.to_steps(resolved)
    assert (ready[3].kind, ready[3].parameters, ready[3].outcome) == ("normalize_format", {"mapping": {"a": "z"}}, "modified")
    for bad in (
        decide((by_seq[1], "approve"), (by_seq[1], "reject")), decide(("no-such-step", "approve")),
        decide((by_seq[1], "modify")), decide((by_seq[1], "modify", "drop_column", None)), decide((by_seq[1], "maybe")),
    ):
        with pytest.raises(ValueError):
            cleaning_plan.resolve_decisions(steps, bad)


def test_features(spark):
    df = spark.createDataFrame(
        [("2024-01-01", 10.0, 1, 5, "web"), ("2024-01-02", 20.0, 2, 6, "app")],
        "order_date string, revenue double, user_id int, orders int, channel string")
    suggested = suggest_features(profile_table(df, "t").columns, most=8)
    got = [tuple(r) for r in suggested.orderBy("sequence").select("feature_name", "operation").collect()]
    assert got == [
        ("date_parts_order_date", "date_extract"), ("aov", "ratio"), ("arpu", "ratio"), ("running_revenue", "window"),
        ("running_revenue_by_channel", "window"), ("revenue_by_channel", "aggregate")]
    aov = suggested.filter("feature_name = 'aov'").first()
    assert aov["parameters"] == {"numerator": "revenue", "denominator": "order_date"}
    assert aov["feature_id"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "t.ratio.aov"))
    decided = feature_plan.decide(suggested, suggested.select("feature_id", F.lit("approve").alias("decision")))
    assert feature_plan.summarize(decided).first()["can_execute"]
    from tablewright import apply_features

    run = apply_features({"t": df}, feature_plan.to_features(decided))
    assert {s.feature.name: str(s.status) for s in run.steps} == {
        "date_parts_order_date": "success", "aov": "success", "arpu": "success", "running_revenue": "success",
        "running_revenue_by_channel": "success", "revenue_by_channel": "success"}
    many = spark.createDataFrame([tuple(range(12))], ", ".join(f"date_{i} int" for i in range(12)))
    assert suggest_features(profile_table(many, "m").columns, most=8).count() == 8


def test_charts(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, d), r, float(c), "ns"[d % 2]) for d, r, c in ((1, 5, 1), (2, 6, 1), (3, 5, 2), (4, 6, 2))],
        "day date, revenue int, cost double, segment string")
    df = df.union(df)
    suggested = suggest_charts(profile_table(df, "t").columns, most=8, count_bars=20)
    got = [tuple(r) for r in suggested.orderBy("sequence").select("chart_type", "x_column", "y_column", "aggregation", "sort", "limit").collect()]
    assert got == [
        ("line", "day", "revenue", "sum", "asc", None), ("line", "day", "cost", "sum", "asc", None),
        ("bar", "segment", "revenue", "sum", "desc", None), ("bar", "segment", "cost", "sum", "desc", None),
        ("bar", "segment", None, "count", "desc", 20), ("pie", "segment", None, "count", None, None),
        ("scatter", "revenue", "cost", None, None, None)]
    decided = chart_plan.decide(suggested, suggested.limit(2).select("chart_id", F.lit("approve").alias("decision")), "chart_id")
    assert chart_plan.summarize(decided).first()["blocked"] == 5 and len(chart_plan.to_charts(decided)) == 2


def test_many_tables(sales, spark):
    p = profile_tables({"a": sales, "b": spark.range(3)})
    got = {r["table_name"]: r for r in likely_columns(p.columns).collect()}
    assert got["a"]["row_count"] == 5 and got["b"]["column_count"] == 1
    assert got["a"]["likely_metric_columns"] == ["revenue"] and got["b"]["likely_id_columns"] == ["id"]
    assert got["a"]["likely_date_columns"] == ["date"]


def test_long_texts_follow_the_rules_of_short_ones(spark):
    pad = " " * 80
    texts = [f"{pad}2024-01-0{i}" for i in range(1, 6)]
    df = spark.createDataFrame([(t, "same " * 20 + x) for t, x in zip(texts, "edcba", strict=True)], "d string, s string")
    for approx in (False, True):
        got = {r.column_name: r for r in profile_columns(df, "t", approx=approx).collect()}
        assert (got["d"].data_type, got["d"].date_share, str(got["d"].min_date), got["d"].padded_count) == ("date", 1.0, "2024-01-01", 5)
        assert sorted(got["s"].top_values) == ["same " * 20 + x for x in "abcde"]
    many = spark.createDataFrame([(f"{'x' * 70}{i % 50:02d}{'y' * (i % 3)}",) for i in range(150)], "s string")
    assert profile_columns(many, "t").first().top_values == sorted({r.s for r in many.collect()})[:5]
    mixed = spark.createDataFrame([(v,) for v in ("z", "a" * 70, "m" * 65, "b", "y" * 64, "y" * 64 + "a", "c")], "s string")
    assert profile_columns(mixed, "t").first().top_values == ["a" * 70, "b", "c", "m" * 65, "y" * 64]


@pytest.fixture
def plain_plans(spark):
    """Plans as they are before any stage has run, with the marks of generated code."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_values_are_counted_once(spark, plain_plans):
    """F3-F6: distinct numbers and top values read one shuffle of counts."""
    df = spark.createDataFrame([(i % 7, f"v{i % 3}", i / 4) for i in range(50)], "a int, b string, d double")
    both = profiling._uniques_and_tops(df, [0, 1, 2], profiling._Columns(df.schema))
    assert "ReusedExchange" in plan(both)
    assert {r["c"]: r["n"] for r in both.collect() if r["rank"] == 0} == {0: 7, 1: 3, 2: 50}


def test_sums_of_wide_tables_are_generated_code(spark, plain_plans):
    """F3-F6: with more than 100 aggregates side by side Spark interprets them."""
    df = spark.range(20).select(*[(F.col("id") + i).alias(f"n{i}") for i in range(20)], F.lit(" 7").alias("t"))
    summed = profiling._summed(df)
    partial = [line for line in plan(summed).splitlines() if "HashAggregate(keys=[], functions=[partial" in line]
    assert len(partial) > 1 and all("*(" in line for line in partial)
    facts = profiling.scalars(df)
    assert [f["c"] for f in facts] == list(range(21))
    assert (facts[3]["num_min"], facts[3]["num_max"], facts[3]["numeric_rows"], facts[3]["date_rows"]) == (3.0, 22.0, 20, 0)
    assert (facts[20]["num_min"], facts[20]["padded_rows"], facts[20]["first_at"]) == (7.0, 20, None)
