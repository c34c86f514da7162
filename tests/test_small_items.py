"""Small operators on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell import workflows
from tidewell.functions import hydro
from tidewell.operators import columns, quality, series
from tidewell.sources import files, hydrology, readers


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*[F.col(f"`{n}`") for n in names]).collect()), key=str)


def test_filters(spark):
    df = spark.createDataFrame([("Run_A", 1), ("run_b", 2), (None, 3)], "internalName string, v int")
    assert rows(quality.containing(df, "internalName", "_A"), "v") == [(1,)] and quality.containing(df, "internalName", "zzz").count() == 3
    assert quality.containing(df.limit(0), "internalName", "a").count() == 0
    tables = {"Q": df.withColumnRenamed("internalName", "Chan ID"), "PO": df.withColumnRenamed("internalName", "Location").filter("v = 2"), "X": df}
    kept = quality.filtered_tables(tables, ["Run_A"])
    assert sorted(kept) == ["Q", "X"] and kept["Q"].count() == 1


def test_numbers_and_keys(spark):
    df = spark.createDataFrame([("1.5", "3", "x"), ("?", "2.5", "y"), (None, "", "z"), ("NaN", "4.0", "w")], "a string, `n b` string, k string")
    assert rows(columns.clean_numbers(df, ["a", "none"], ["n b"]), "k", "a", "n b") == [("w", 0.0, 4), ("x", 1.5, 3), ("y", 0.0, None), ("z", 0.0, None)]
    assert [r[0] for r in df.orderBy("k").select(columns.number_or(F.col("a"), -1.0)).collect()][1:] == [1.5, -1.0, -1.0]
    assert columns.grouping_keys(df, ["k", "aep"], ["a"]) == ["k", "a"]
    with pytest.raises(KeyError, match="Chan ID"):
        columns.grouping_keys(df, [], ["Chan ID"])


def test_plot_times(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "never", 2)], "k string, Time string, o int")
    assert rows(series.plot_times(df, ["k"], ["o"]), "o", "plot_time") == [(1, dt.datetime(2024, 1, 1))]
    assert rows(series.plot_times(df.drop("Time"), ["k"], ["o"]), "o", "plot_time") == [(1, 0), (2, 1)]


def test_crossing_names_and_projects(spark):
    df = spark.createDataFrame([("Run 1", None, "C/1"), (" ", "trim", None), (None, None, "C2")], "i string, t string, c string")
    name = lambda **o: sorted(r[0] for r in df.select(hydro.crossing_name(F.col("i"), F.col("t"), F.col("c"), **o)).collect())
    assert name() == ["Run_1_C_1", "Scenario_C2", "trim_CHAN"] and set(name(template="{channel}")) == {"C_1", "CHAN", "C2"}
    assert name(template="--") == ["Run_1", "Scenario", "trim"]
    with pytest.raises(ValueError, match="internal, channel"):
        name(template="{record}")
    one = spark.createDataFrame([(2.0, 1.0, 0.5, 1.0, 1.4)], "q double, ui double, di double, h double, ds double")
    own = hydro.CrossingOptions(flow=lambda q: F.struct((q * 2).alias("design")), roadway=lambda h, crest: F.struct(crest.alias("crest")), barrel_count=lambda area, h: F.lit(7))
    made = one.select(hydro.crossing(F.col("q"), F.col("ui"), F.col("di"), F.col("h"), F.col("ds"), F.lit("C"), F.lit(9.0), F.lit(1.0), options=own).alias("crossing"), F.lit("a").alias("name"), F.lit("R").alias("run"))
    c = made.first()["crossing"]
    assert (c["flow"]["design"], c["roadway"]["crest"], c["barrel"]["barrels"]) == (4.0, 2.5, 7)
    project = workflows.crossing_project(made.unionByName(made.withColumn("crossing", F.when(F.lit(False), F.col("crossing")))), "T", "me", by=["run"]).first()
    assert (project["run"], project["title"], project["n_crossings"], project["crossings"][0]["name"]) == ("R", "T", 1, "a")


def test_arrays_of_pages(spark):
    pages = spark.createDataFrame([("a", 'var x = [{"k": 1},]; var y = [{"k": 2}, {"k": 3}];'), ("b", 'var x = [];'), ("c", "var x = [oops; var y = [];"), ("d", None)], "catchment string, html string")
    found, failed = readers.js_arrays(pages, ["x", "y"], "catchment")
    assert sorted((r["catchment"], r["variable"], r["place"], r["entry"]["k"]) for r in found.collect()) == [("a", "x", 0, "1"), ("a", "y", 0, "2"), ("a", "y", 1, "3")]
    assert rows(failed, "catchment", "reason") == [("b", "has no y"), ("c", "can't read x"), ("d", "has no x, has no y")]


def test_design_kinds(spark):
    names = ["Town_ifds_2020.csv", "A b_rare.csv", "x_very_frequent.csv", "other.csv"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(hydrology.design_kind(F.col("n"))).collect()]
    assert [tuple(r) if r else None for r in got] == [("Town", "ifds"), ("A b", "rare"), ("x", "very_frequent"), None]


def test_duplicate_report(spark):
    actions = spark.createDataFrame([("delete", "/b/x", "/a/x", ".t", 4, "d", []), ("placeholder", "/b/x.txt", "/a/x", ".t", 4, "d", ["/b/x"])], "action string, path string, keep string, suffix string, length long, digest string, files array<string>")
    assert files.duplicate_report(actions).first()["lines"] == ["keep /a/x (4 bytes, d), 1 deleted", "delete /b/x", "placeholder /b/x.txt for /b/x"]
