import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tablewright import Dataset, ResultStore, ToolError, chart_batch, import_directory, read_table
from tablewright.sources import registry
from tablewright.sources.results import table_output
from tablewright.sources.tables import import_tables, normalise_table, preview, table_info, table_name, unique_table_names
from tablewright.sources.texts import read_texts, text_statistics
from tablewright.specs import Chart, CleaningStep, Feature
from tablewright.staging import stage, staged, tidy
from tablewright.streaming.arrivals import import_arrivals
from tests.conftest import rows


@pytest.mark.parametrize(
    ("raw", "safe"),
    [(" Sales Data ", "sales_data"), ("2024-Q1", "t_2024_q1"), ("__a--b__", "a_b"), ("!!!", "table"), ("Ünï", "n"), ("ok_1", "ok_1")],
)
def test_table_name(raw, safe):
    assert table_name(raw) == safe


def test_unique_names():
    assert unique_table_names(["A", "a", "a!", "b"]) == ["a", "a_1", "a_2", "b"]


def test_csv_directory(spark, tmp_path):
    (tmp_path / "January.csv").write_text("date,product,revenue\n01-31-2024,A,5\n02-01-2024, ,7\nbad,C,\n")
    (tmp_path / "Empty.csv").write_text("a,b\n")
    (tmp_path / "note.txt").write_text("x")
    tables = import_directory(spark, str(tmp_path))
    assert list(tables) == ["january"]
    assert rows(tables["january"]) == [
        (None, "C", None), (dt.datetime(2024, 1, 31), "A", 5), (dt.datetime(2024, 2, 1), None, 7)]
    with pytest.raises(ToolError):
        import_directory(spark, str(tmp_path), "parquet")
    with pytest.raises(ToolError):
        import_tables({"e": spark.range(0)})
    typed = read_table(spark, str(tmp_path / "January.csv"), "csv", "date string, product string, revenue bigint")
    assert typed.schema["revenue"].dataType.simpleString() == "bigint"


def test_csv_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        'i,d,b,s,n,quoted,day\n1,1,True,x,NA,"two\nlines",2024-01-01\n007,NA,false,NA,,"a ""q""",x\n ,2.5,NULL,5,nan,z,2024-01-03\n')
    typed = read_table(spark, str(tmp_path / "t.csv"), multi_line=True)
    assert [f.dataType.simpleString() for f in typed.schema] == ["bigint", "double", "boolean", "string", "string", "string", "string"]
    assert [tuple(r) for r in typed.collect()] == [
        (1, 1.0, True, "x", None, "two\nlines", "2024-01-01"), (7, None, False, None, None, 'a "q"', "x"),
        (None, 2.5, None, "5", None, "z", "2024-01-03")]
    whole = import_directory(spark, str(tmp_path), multi_line=True)["t"]
    assert [f.dataType.simpleString() for f in whole.schema][-1] == "timestamp_ntz" and whole.schema["i"].dataType.simpleString() == "bigint"


def test_normalise_keeps_mostly_other_text(spark):
    df = spark.createDataFrame([("2024-01-01", float("nan")), ("x", 1.0), ("y", None)], "a string, b double")
    out = normalise_table(df)
    assert out.schema["a"].dataType.simpleString() == "string" and out.filter("b is null").count() == 2


def test_preview_and_info(spark):
    t = {"t": spark.range(150)}
    assert preview(t, "t").count() == 100 and preview(t, "t", 3).count() == 3
    assert tuple(table_info(t).first()) == ("t", 150, 1, ["id"])
    with pytest.raises(ToolError):
        preview(t, "u")


def test_versions(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"))
    with pytest.raises(ToolError):
        data.get()
    df = spark.createDataFrame([(" a ", 1.0), ("b", None), ("b", 3.0)], "product string, revenue double")
    assert data.write({"t": df}).number == 1
    version, run = data.clean([CleaningStep("t", "strip_whitespace", "product"), CleaningStep("t", "drop_rows", "revenue")])
    assert (version.number, version.kind, version.parent) == (2, "cleaned", 1)
    assert rows(data.tables(2)["t"]) == [("a", 1.0), ("b", 3.0)]
    assert data.tables(1)["t"].count() == 3
    with pytest.raises(ToolError, match="nope"):
        data.clean([CleaningStep("nope", "deduplicate")])
    assert data.get().number == 2
    enriched, steps = data.enrich([Feature("agg", "aggregate", "t", (), {"value_column": "revenue", "group_by": "product"}), Feature("bad", "custom_formula", "t")])
    assert enriched.tables == ("t", "product_revenue_agg") and len(steps.steps) == 2
    assert [tuple(r) for r in data.cleaning_log().orderBy("sequence").select("version_number", "operation", "rows_after", "rows_changed").collect()] == [
        (2, "strip_whitespace", 3, 1), (2, "drop_rows", 2, 0)]
    assert rows(data.feature_log(), "version_number", "feature_name", "status") == [(3, "agg", "success"), (3, "bad", "failed")]
    with pytest.raises(ToolError, match="exists"):
        data.write({"t": df}, number=2)
    assert data.copy(1).number == 4
    got = data.versions().orderBy("version_number").select("version_type", "parent_version", "row_count", "column_count").collect()
    assert [tuple(r) for r in got] == [("original", None, 3, 2), ("cleaned", 1, 2, 2), ("enriched", 2, 4, 2), ("enriched", 1, 3, 2)]


def test_written_versions_hold_no_nan(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"))
    data.write({"t": spark.createDataFrame([(float("nan"),), (1.0,)], "v double")})
    assert rows(data.tables()["t"]) == [(None,), (1.0,)]


def test_staged_tables(spark):
    df = stage(spark.range(5), "test")
    (path,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    assert df.count() == 5 and registry.path_exists(spark, path)
    with staged(spark.range(3), "test") as inner:
        assert inner.count() == 3
        (other,) = {f.rsplit("/", 1)[0] for f in inner.inputFiles()}
    assert not registry.path_exists(spark, other)
    assert tidy(spark) >= 1 and not registry.path_exists(spark, path)


def test_unfinished_version_is_not_seen(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"))
    spark.range(3).write.parquet(str(tmp_path / "d/v1_original/t"))
    assert data.next_number() == 1
    with pytest.raises(ToolError, match="Folder"):
        data.write({"t": spark.range(5)})
    data.write({"t": spark.range(5)}, replace_unfinished=True)
    assert data.tables()["t"].count() == 5


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_views(spark, tmp_path, fmt):
    store = ResultStore(spark, str(tmp_path))
    df = spark.createDataFrame([(1, 'a "q",\n b', None), (2, None, 2.5)], "a int, b string, c double")
    view = store.save_view(df, "first", 1, {"k": 1}, fmt=fmt)
    other = store.save_view(df, "second", 2, fmt=fmt)
    assert rows(store.read_view(view)) == rows(df)
    assert [r["name"] for r in store.views().collect()] == ["second", "first"]
    assert [r["row_count"] for r in store.views(1).collect()] == [2]
    store.delete_view(other)
    assert [r["view_id"] for r in store.views().collect()] == [view]
    with pytest.raises(ToolError):
        store.read_view(other)
    again = store.save_view_of(store.views().first()["path"], fmt, "pointer", 1)
    assert store.preview_view(again, 1).count() == 1


def test_visuals(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    data = spark.createDataFrame([("a", 3), ("b", 1)], "status string, count bigint")
    visual = store.save_visual(Chart("t", "pie", "status", title="Share"), data, 1)
    assert rows(store.visual_data(visual)) == rows(data)
    row = store.visuals(1).first()
    assert (row["title"], row["chart_type"], row["x_key"], row["y_key"], row["label"]) == ("Share", "pie", "status", "count", "Count")
    batch = chart_batch({"t": data}, [Chart("t", "bar", "status", "count", "sum"), Chart("t", "bar", "nope")])
    assert rows(store.visual_data(store.save_visual_result(batch, 2))) == rows(data)
    with pytest.raises(ToolError):
        store.save_visual_result(batch, 2, 1)
    store.delete_visual(visual)
    assert store.visuals(1).count() == 0 and store.visuals().count() == 1


def test_table_output(spark, tmp_path):
    small = table_output(spark.range(510).limit(500), str(tmp_path))
    assert small.path is None and small.row_count == 500 and small.preview.count() == 100
    large = table_output(spark.range(510).selectExpr("id x", "id y"), str(tmp_path))
    assert large.row_count == 510 and large.format == "csv" and large.preview.count() == 100
    assert spark.read.csv(large.path, header=True).count() == 510
    assert table_output(spark.range(510)).path is None


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n" + "x" * 600)
    (tmp_path / "b.md").write_text("é")
    (tmp_path / "c.csv").write_text("no")
    out = text_statistics(read_texts(spark, str(tmp_path)))
    empty = spark.createDataFrame([("",)], "text string")
    assert tuple(text_statistics(empty).first()) == (0, 0, "")
    assert sorted((r["char_count"], r["line_count"], len(r["preview"])) for r in out.collect()) == [(1, 1, 1), (608, 3, 500)]


def test_arrivals(spark, tmp_path):
    folder, root, progress = (str(tmp_path / n) for n in ("in", "data", "progress"))
    schema = "date string, product string, units int"

    def arrive(name, lines):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("date,product,units\n" + "\n".join(lines) + "\n")

    def load():
        import_arrivals(spark, folder, schema, root, "My Sales", progress).awaitTermination()

    arrive("1.csv", ["2024-01-01,A,1", "2024-01-02,B,2"])
    load()
    load()
    arrive("2.csv", ["2024-01-03,C,3"])
    load()
    data = Dataset(spark, root)
    assert rows(data.versions(), "version_number", "parent_version", "row_count") == [(1, None, 2), (2, 1, 1)]
    assert rows(data.tables(2)["my_sales"]) == [(dt.datetime(2024, 1, 3), "C", 3)]


def test_batches_of_one_table_agree(spark, tmp_path):
    folder, root, progress = (str(tmp_path / n) for n in ("in", "data", "progress"))
    (tmp_path / "in").mkdir()
    for name, lines in (("1.csv", ["2024-01-01,x,1", "2024-01-02,2024-01-02,2"]), ("2.csv", ["later,2024-01-01,3", "unknown,2024-01-02,4", "2024-02-01,,5"])):
        (tmp_path / "in" / name).write_text("day,note,units\n" + "\n".join(lines) + "\n")
        import_arrivals(spark, folder, "day string, note string, units int", root, "t", progress).awaitTermination()
    data = Dataset(spark, root)
    first, second = data.tables(1)["t"], data.tables(2)["t"]
    assert first.schema == second.schema
    assert [f.dataType.simpleString() for f in second.schema] == ["timestamp_ntz", "timestamp_ntz", "int"]
    assert rows(second) == [(None, dt.datetime(2024, 1, 1), 3), (None, dt.datetime(2024, 1, 2), 4), (dt.datetime(2024, 2, 1), None, 5)]


def test_names_never_collide():
    assert unique_table_names(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]


def test_two_writers_take_different_numbers(spark, tmp_path):
    from tablewright.staging import side_by_side

    data = Dataset(spark, f"{tmp_path}/data")
    data.write({"t": spark.range(3)})
    made = side_by_side(*[lambda: data.write({"t": spark.range(5)}, "cleaned", 1), lambda: data.write({"t": spark.range(7)}, "enriched", 1)])
    assert sorted(v.number for v in made) == [2, 3] and data.versions().count() == 3


def test_eight_writers_take_consecutive_numbers(spark, tmp_path):
    data = Dataset(spark, f"{tmp_path}/data")
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: data.write({"t": spark.range(i + 1)}, "cleaned" if i % 2 else "original"), range(8)))
    assert sorted(v.number for v in made) == list(range(1, 9))
    assert rows(data.versions(), "version_number") == [(i,) for i in range(1, 9)]
    assert all(data.tables(v.number)["t"].count() == i + 1 for i, v in enumerate(made))


def test_a_failed_attempt_takes_no_number(spark, tmp_path):
    data = Dataset(spark, f"{tmp_path}/data")
    data.write({"t": spark.range(1)})
    with pytest.raises(Exception, match="refuse"):
        data.write({"t": spark.range(3).select(F.raise_error(F.lit("refuse")).cast("int").alias("x"))})
    assert data.write({"t": spark.range(2)}).number == 2
    with pytest.raises(ToolError, match="exists"):
        data._put(2, None, "original", "nowhere", [("t", 1, 1)], None)
    assert data.versions().count() == 2


def test_metadata_of_another_kind_is_an_error(spark, tmp_path):
    spark.range(2).select(F.col("id").cast("string").alias("version_number")).write.parquet(f"{tmp_path}/data/_versions/rows-1")
    with pytest.raises(Exception, match="version_number|PARQUET"):
        Dataset(spark, f"{tmp_path}/data").versions().collect()
