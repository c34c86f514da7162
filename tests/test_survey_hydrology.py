"""Older hydrologic reports, rainfall tables, survey culverts, terrain text and command lists on small texts."""

import pytest
from pyspark.sql import functions as F

from tidewell.sources import hydrology, readers, survey


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*[F.col(f"`{n}`") if isinstance(n, str) else n for n in names]).collect()), key=str)


@pytest.fixture
def lines(spark):
    return lambda text, path="/r/a": spark.createDataFrame([(path, i, t) for i, t in enumerate(text.split("\n"))], "path string, line int, text string")


BATCH = """Parameters:  kc = 12.5 m = 0.8
Loss parameters   Initial   Cont.
  10.0  2.5
Peak  Description
1  Outlet of all
02 Town
x

 Run        Duration             AEP  TPat Peak1 Peak2
 1 24 hour 1% 10 12.5 Y
Run,    Representative hydrograph
"""


def test_older_batch_report(lines):
    text = lines(BATCH)
    assert hydrology.summary_names(text).first()["names"] == {"Hyd0001": "Outlet of all", "Hyd0002": "Town"}
    assert tuple(hydrology.batch_parameters(text).first()) == ("/r/a", 10.0, 2.5, 1.0, 12.5, 0.8)
    other = hydrology.batch_parameters(lines("Loss parameters Initial Runoff\n 5 0.4\nPeak  Description\nLoss parameters Cont\n 9 9")).first()
    assert (other["il"], other["cl"], other["roc"], other["kc"]) == (5.0, 0.0, 0.4, 0.0)


def test_peak_table(lines):
    text = lines("Parameters:  kc =  12.5   m = 0.80\nInitial loss (mm)  15.0 Cont 2.5\n Run        Duration             AEP  TPat  Peak\n1  24hour  1%  3  12.5\n1  2\n2  6hour  1%  4  7.5")
    assert rows(hydrology.peak_table(text).filter("field in ('Run', 'Peak')"), "row", "field", "value") == [(3, "Peak", "12.5"), (3, "Run", "1"), (5, "Peak", "7.5"), (5, "Run", "2")]
    assert tuple(hydrology.report_parameters(text).first()) == ("/r/a", 12.5, 0.8, 15.0, 2.5)


def cells_of(lines, column):
    return lines("x").select(column).first()[0]


def test_rainfall_of_a_file(lines):
    text = "Time increment (hours)=  0.50\nother = 3\nTime  Mean  \n\nIncs        A\n   1   2.0  1.0\n\n   2   3.0  4.0\nend"
    other = lines("Time increment (hours)= 2\nTime Incs   A\n 1     x   5.0 9\n", "/r/b")
    got = hydrology.rainfall(lines(text).union(lines("no step", "/r/c")), 6, 8, 2)
    assert rows(got, "increment", "time", "name", "value") == [
        (1.0, 0.5, "Mean", 2.0), (1.0, 0.5, "Sub-area A", 0.0), (2.0, 1.0, "Mean", 3.0), (2.0, 1.0, "Sub-area A", 5.0), (3.0, 1.5, "Mean", 0.0), (3.0, 1.5, "Sub-area A", 0.0)]
    assert rows(hydrology.rainfall(other, 3, 3, 1).filter("increment = 1"), "time", "name", "value") == [(2.0, "Column 4", 9.0), (2.0, "Incs", 0.0), (2.0, "Sub-area A", 5.0)]
    failed = hydrology.rainfall_failures(lines(text).union(lines("no step\n1 2\n", "/r/c")).union(lines("Time increment (hours)=1\n", "/r/d")), 3, 8)
    assert rows(failed, "path", "reason") == [("/r/c", "no time increment"), ("/r/d", "no rows of a table")]


def test_rainfall_table(lines):
    names = lambda heads, sample: cells_of(lines, hydrology.column_names(F.array(*[F.lit(h) for h in heads]), F.lit(sample)))
    assert names(["Time  Sub-         ", "Incs  catch        ", "      ment    A   B"], "   1   2.0  1.0 3.0") == ["Time Increment", "Sub-catchment area area", "Sub-area A", "Sub-area B"]  # fragments are replaced one after the other
    assert names(["Time  Mean   ", "Incs       A "], "  1   2.0  1.0") == ["Time Increment", "Mean", "Sub-area A"]
    assert names(["ABCDEFGHIJKL"], "1 2   3") == ["AB", "CDEF", "GHIJKL"] and names(["x"], "  1      2") == ["Column 1", "Column 2"] and names(["a  bb   "], "1     2 ") == ["Sub-area a", "Column 2"]
    cells = hydrology.rainfall_cells(lines("head\n1 5.0 1.0\n\n2 x 2.0\n3 0 0.5"), 2, 5)
    got = hydrology.rainfall_table(cells, ["Time Increment", "Mean", "Sub-area A"], 0.5)
    assert rows(got.filter("name = 'Sub-area A'"), "increment", "time", "value") == [(1.0, 0.5, 0.0), (2.0, 1.0, 3.0), (3.0, 1.5, 0.5), (4.0, 2.0, 0.0)]
    assert rows(got.filter("name = 'Mean'"), "increment", "value") == [(1.0, 5.0), (2.0, 0.0), (3.0, 0.0), (4.0, 0.0)]
    ragged = hydrology.padded_table(lines("1 2 3\n2 4"), 1, 2, 1.0)
    assert rows(ragged, "increment", "name", "value") == [(1.0, "Catchment", 2.0), (1.0, "Sub-Area A", 3.0), (2.0, "Catchment", 4.0), (2.0, "Sub-Area A", None), (3.0, "Catchment", 0.0), (3.0, "Sub-Area A", 0.0)]


def test_design_rainfall(lines, spark):
    text = "c\nc\nc\nc\nx,Town A\nx,Requested,-22.5 (S),long,118.2\nx,Nearest,22.4875,long,118.2125 (E)\nn\nDuration,Duration in min,1EY,1%\n1 min,1,1.5,3.5\n2 min,2,2.5,\n"
    lookup = spark.createDataFrame([("1%", 100.0)], "raw string, ari double")
    got = hydrology.design_rainfall(lines(text), lookup)
    assert rows(got, "duration", "minutes", "aep", "value", "req_lat", "grid_lat", "grid_long", "location_label", "ari") == [
        ("1 min", 1, "1%", 3.5, -22.5, -22.4875, 118.2125, "Town A", 100.0), ("1 min", 1, "1EY", 1.5, -22.5, -22.4875, 118.2125, "Town A", None),
        ("2 min", 2, "1%", None, -22.5, -22.4875, 118.2125, "Town A", 100.0), ("2 min", 2, "1EY", 2.5, -22.5, -22.4875, 118.2125, "Town A", None),
    ]


def test_hydrographs_by_name(lines, spark):
    text = "t\nt\nTime (hrs),Calculated hydrograph:  Town,Other\n0,1.0,5\n1,2.0,5"
    both = lines(text, "/r/Creek_01_ aep1_du12hourtp2.csv").union(lines(text, "/r/Creek_01_ aep1_du12hourtp3.csv")).union(lines(text, "/r/other.csv"))
    got = hydrology.selected_hydrographs(both, [("aep1", "tp2"), ("aep5", "tp3")], "Town")
    assert rows(got, "creek", "aep", "duration", "tp", "time", "value") == [("Creek", "aep1", "du12hour", "tp2", 0.0, 1.0), ("Creek", "aep1", "du12hour", "tp2", 1.0, 2.0)]
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None), (None, None)], "u double, d double")
    assert [r[0] for r in df.select(hydrology.mean_level(F.col("u"), F.col("d"))).collect()] == [1.5, 1.0, None]


def test_culverts_of_two_reports(lines, spark, tmp_path):
    head = "\t".join(x.title() for x in survey.CULVERT)
    row = lambda *c: "\t".join(map(str, c))
    body = [row("Culvert A", 10, 20, 5, "", "RCP", 0.9, "", 2, "", "N"), row("Culvert A", 30, 40, "", 4, "", "", "", "", 0.5, ""), row("B", 1, 1, 1, 1, "", 1, 1, 1, 1, ""), row("C", 1, 1, 1, 1, "", 1, 1, 1, 1, ""), row("D", *[1] * 10)]
    text = "\n".join(["first", head, "units", *body])
    pairs = survey.culvert_pairs(lines(text))
    assert rows(pairs, "Name", "US_X", "DS_X", "Invert US", "Invert DS", "Number of Pipes", "Separation", "Pipe Type", "Direction") == [("Culvert A", 10.0, 30.0, 5.0, 4.0, 2, 0.5, "RCP", "N")]
    angles = readers.culvert_angles(lines('  1.0 45°0\'0" 3.0 "Culvert A"\n 2.0 90°30\'0" 1 "Z"'))
    both = survey.combined_culverts(angles, pairs)
    assert rows(both, "Name", "US_X", "Angle_Degrees", "Number of Pipes") == [("Culvert A", 10.0, 45.0, 2), ("Z", 0.0, 90.5, None)]
    assert rows(survey.missing_culverts(both), "Name", "missing") == [("Z", "txt")]
    (tmp_path / "a.rpt").write_bytes("é one\nb".encode("utf-16"))
    (tmp_path / "b.rpt").write_bytes("é one".encode("utf-8-sig"))
    assert rows(survey.read_marked_lines(spark, str(tmp_path), "*.rpt"), "line", "text") == [(0, "é one"), (0, "é one"), (1, "b")]


def test_point_files(lines):
    text = lines("1 2 3.0\n2 1  -9999\nbad\n\n1 1 -9999.0\n2 2 x")
    assert [r[0] for r in survey.without_sentinel(text, -9999.0).orderBy("line").select("text").collect()] == ["1 2 3.0", "bad", "", "2 2 x"]
    assert [r[0] for r in survey.without_sentinel(text, -9999.0, True).orderBy("line").select("text").collect()] == ["1 2 3.0", ""]
    assert survey.without_sentinel(text, "-9999").count() == 5
    grid = survey.ordered_grid(survey.points(lines("1 1 5\n2 2 6")), -1.0)
    assert [r["text"] for r in grid.collect()] == ["1.0 2.0 -1.0", "2.0 2.0 6.0", "1.0 1.0 5.0", "2.0 1.0 -1.0"]
    tagged = survey.tagged_points(lines("layer road\nline 1\n1 2 3\n4 5 6\nlayer fence\nline 2\n7 8"), r"^line", r"^layer (\S+)")
    assert rows(tagged, "object", "layer", "place", "x", "z") == [(1, "road", 1, 1.0, 3.0), (1, "road", 2, 4.0, 6.0), (2, "fence", 1, 7.0, None)]
    same = survey.points(lines("1.0001 1 1\n1.0002 1 1\n2 2 2")).withColumn("n", F.col("x"))
    assert rows(survey.distinct_rounded(same, "n"), "x") == [(1.0001,), (2.0,)]


def test_profile_areas(spark):
    df = spark.createDataFrame([("p", x, y, 2.0, 2.0, 1.0) for x, y in ((0.0, 0.0), (1.0, 0.0), (3.0, 4.0), (4.0, 4.0))] + [("q", 0.0, 0.0, None, None, 1.0)], "k string, x double, y double, cx double, cy double, s double")
    got = {r["k"]: (r["below"], r["above"]) for r in survey.profile_areas(df, ["k"], "x", "y", "cx", "cy", "s").collect()}
    assert got == {"p": (1.0, 1.0), "q": (0.0, 0.0)}


def test_run_lists(lines, spark):
    text = 'REM nothing\nsolver -e1 Q100 -s1 Exg -pu0 # note -e2 x\n  solver -S1 exg -E1 q100\n-e1 Q20 -e1 Q50 -s2 "a #b" ; c\n:: -e1 z\nno flags\n-e1 Q10\n@REM solver -e1 ghost\n @:: -e1 ghost\n-s Exg -e0 x\n! solver -e3 kept\nrun-e4 glued -e1 -s1\nsolver -pu 1 -e5 y\n'
    got = survey.run_list(lines(text))
    want = [(1, {"e1": "Q100", "s1": "Exg"}), (3, {"e1": "Q50", "s2": '"a'}), (6, {"e1": "Q10"}), (10, {"e3": "kept"}), (11, {"e1": "-s1", "e4": "glued"}), (12, {"e5": "y"})]
    assert sorted((r["line"], r["combo"]) for r in got.collect()) == want
    assert dict(rows(survey.run_variables(got.filter("line in (1, 6)")), "flag", "values")) == {"e1": "Q10 Q100", "s1": "Exg"}
    assert rows(survey.runnable(got, ["s1"], ["e1"]), "arguments") == [("-e1 Q100 -s1 Exg",)]
    marks = {"a # b": "a", 'a "x # y" c': 'a "x # y" c', "a REM b": "a", "a#b": "a#b", 'a "open # b': 'a "open # b'}
    assert {k: spark.range(1).select(survey.without_comment(F.lit(k))).first()[0] for k in marks} == marks


def test_small_texts(spark):
    get = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert get(survey.layer_name(lit("a b/c" + "x" * 60))) == ("a_b_c" + "x" * 60)[:50]
    assert get(survey.crossing_label(lit("R"), lit(" "), lit(3))) == "R / row=3" and get(survey.crossing_label(lit(""), lit(None).cast("string"), lit(None).cast("int"))) == "unknown culvert"
    assert get(survey.notes(run=lit("R"), chan=lit(""), slope=lit(1.5))) == "run=R; slope=1.5"
    assert get(survey.on_drive(lit("//Server/Share/a/b"), {"//server/share": "Q:"})) == "Q:/a/b" and get(survey.on_drive(lit("/x"), {"//s": "Q:"})) == "/x"
    assert get(survey.relative_to(lit("/a/b/c"), "/a/b")) == "c" and get(survey.relative_to(lit("/z"), "/a", lit("NA"))) == "NA"
    assert tuple(get(survey.rgb(lit(0x102030)))) == (16, 32, 48)
    assert get(survey.of_channel(lit("2d_C1.a_U"), "C1.a")) and not get(survey.of_channel(lit("C1xa_U"), "C1.a"))
