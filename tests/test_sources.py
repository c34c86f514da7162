"""Readers on small files of each layout, sinks, cache and the stream."""

import sqlite3
import struct

from pyspark.sql import functions as F

from tidewell.sources import files, readers, sinks
from tidewell.streaming import incremental


def lines(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return readers.read_lines(spark, str(tmp_path / name))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_files_and_scenarios(spark, tmp_path):
    for name, text in (("R01_TP01_1.0p_120m_POMM.csv", "x"), ("empty_PO.csv", ""), ("note.txt", "xyz")):
        (tmp_path / name).write_text(text)
    found = files.collect_files(spark, [str(tmp_path), str(tmp_path)])
    assert rows(found, "name", "data_type", "tp_numeric", "aep_numeric") == [("R01_TP01_1.0p_120m_POMM.csv", "POMM", 1, 1.0)]
    assert rows(files.find_files(spark, [str(tmp_path)], ["*.TXT"]), "name") == [("note.txt",)]
    assert files.summary(files.find_files(spark, [str(tmp_path)])).first()["n_files"] == 2


def test_wide_series_and_levels(spark, tmp_path):
    q = lines(spark, tmp_path, "a_1d_Q.csv", "x,Time (h),Q ds1 [run],Q ds2 [run]\n0,0.0,1.0,2.0\n1,0.5,3.0,\n")
    assert rows(readers.time_series(q, "Q"), "time", "entity", "value") == [(0.0, "ds1", "1.0"), (0.0, "ds2", "2.0"), (0.5, "ds1", "3.0")]
    h = lines(spark, tmp_path, "a_1d_H.csv", "x,Time,H C1.1,H C1.2,H C1.3\n0,0.0,10,9,8\n")
    assert rows(readers.levels(h), "time", "entity", "us_h", "ds_h") == [(0.0, "C1", 10.0, 9.0)]


def test_point_output(spark, tmp_path):
    po = lines(spark, tmp_path, "a_PO.csv", "Dummy,Time,H,V\nDummy,Time,Loc1,Loc1\nDummy,0.0,10.0,-1.0\nDummy,1.0,10.1,x\n")
    assert rows(readers.point_output(po), "time", "location", "type", "value", "abs_value") == [(0.0, "Loc1", "H", 10.0, 10.0), (0.0, "Loc1", "V", -1.0, 1.0), (1.0, "Loc1", "H", 10.1, 10.1)]
    assert readers.point_output(lines(spark, tmp_path, "b_PO.csv", "only,one\n")).count() == 0


def test_peak_summary(spark, tmp_path):
    text = "r,Location,Loc1,Loc2\nr,Time,10,20\nr,Maximum (Extracted from Time Series),5,6\nr,Time of Maximum,1,2\nr,Minimum (Extracted From Time Series),-7,2\nr,Time of Minimum,3,4\n"
    got = rows(readers.peak_summary(lines(spark, tmp_path, "a_POMM.csv", text)), "type", "location", "max", "abs_max", "signed_abs_max")
    assert got == [("Loc1", "10", 5.0, 7.0, -7.0), ("Loc2", "20", 6.0, 6.0, 6.0)]


def test_maximums_and_status(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a_1d_Cmx.csv").write_text("Chan ID, Qmax, Other\nC1, 10.0, z\nC2, , z\n")
    (tmp_path / "d" / "b_1d_Cmx.csv").write_text("Chan ID, Other\nC1, z\n")
    (tmp_path / "d" / "c_1d_Cmx.csv").write_text("Chan ID, Qmax\n")
    got, status = readers.maximums(readers.read_lines(spark, str(tmp_path / "d")), {"Chan ID": "chan_id", "Qmax": "q"}, ["chan_id"])
    assert rows(got, "chan_id", "q") == [("C1", 10.0), ("C2", None)]
    assert sorted(r["status"] for r in status.collect()) == ["EMPTY", "FAILURE", "SUCCESS"]


def test_culvert_section(spark, tmp_path):
    row = "FC04.1_C  C  3  43.350  42.750  44.550  43.950  23.9  2.51  0.012  1.200  -----  0.9  Adjusted  0.5  1.0  0.0  1.5"
    text = f"top\nCULVERT AND PIPE DATA\n\nlegend\nChannel  Type  ...\n{row}\n{row}\n\n{row}\n"
    got = readers.culvert_section(lines(spark, tmp_path, "a.eof", text))
    assert rows(got, "`Chan ID`", "Num_barrels", "Height", "Inlet_Width") == [("FC04.1_C", 3.0, None, None)] * 2
    assert readers.culvert_section(lines(spark, tmp_path, "b.eof", "nothing\n")).count() == 0


def test_culvert_names_with_a_blank_and_overflow(spark, tmp_path):
    row = "  ".join(["MLETP 156.66", "C", *["1"] * 15, "1.5", "x"])
    got = readers.culvert_section(lines(spark, tmp_path, "c.eof", f"CULVERT AND PIPE DATA\nChannel\n{row}\nA  C  1\n"))
    assert rows(got, "`Chan ID`", "Length", "`Ent/Exit Losses`") == [("MLETP 156.66", 1.0, None)]


def test_cells_may_be_quoted(spark, tmp_path):
    got = readers.cells(lines(spark, tmp_path, "q.csv", 'a,"Q a,b",c\n1,"say ""x""",\n'))
    assert rows(got, "row", "col", "value") == [(0, 0, "a"), (0, 1, "Q a,b"), (0, 2, "c"), (1, 0, "1"), (1, 1, 'say "x"'), (1, 2, "")]


def test_js_arrays_may_be_nested(spark):
    html = 'x; var a = [{"k": "v];", "l": [1, [2]],}, {"k": "w, ]"},]; var b = [1]; more ];'
    pages = spark.createDataFrame([(html,), ("nothing",)], "html string")
    assert [r["entry"] for r in readers.js_array(pages, "a").select("entry").collect()] == [{"k": "v];", "l": "[1,[2]]"}, {"k": "w, ]"}]


def test_batch_and_hydrograph(spark, tmp_path):
    text = "x\n Peak  Description\n 01 Calc\n 1 24 hour 1% 10 12.5 Y 100\n 2 30 minutes 2% 3 1.5 N 7\nRun,    Representative hydrograph\n 9 24 hour 1% 1 1 Y 1\n"
    got = rows(readers.batch_runs(lines(spark, tmp_path, "batch.out", text)), "run", "duration_hours", "aep", "tp", "values")
    assert got == [(1, 24.0, "1", 10, [12.5, 1.0, 100.0]), (2, 0.5, "2", 3, [1.5, 0.0, 7.0])]
    h = lines(spark, tmp_path, "h.csv", "t\nt\nInc,Time (hrs),Calculated hydrograph:  Loc1\n1,0,0\n2,1,10\n")
    assert rows(readers.hydrograph(h), "time", "location", "value") == [(0.0, "Loc1", 0.0), (1.0, "Loc1", 10.0)]


def test_survey_files(spark, tmp_path):
    rpt = lines(spark, tmp_path, "a.rpt", "   1.0 2.0 45°0'0\" 3.0 \"Culvert A\"\nother\n")
    assert rows(readers.culvert_angles(rpt), "name", "degrees") == [("Culvert A", 45.0)]
    points = readers.strings(lines(spark, tmp_path, "a.str", "1, 0.0, 0.0, 1.0\n1, 0.0, 1.0, 1.0\n1, 1.0, 0.0, 1.0\n0, 0.0, 0.0, 0.0\n2, 5.0, 6.0, 7.0\n"))
    assert rows(points, "place", "group_id", "x")[-1] == (5, 1, 6.0)
    faces = readers.triangles(lines(spark, tmp_path, "a.dtm", "head\n9 9 9\nTRISOLATION\n1 2 3\n1 2 99\n"))
    both = readers.surfaces(points.withColumn("path", F.lit("p")), faces.withColumn("path", F.lit("p")))
    assert both.count() == 1


def test_js_array(spark):
    df = spark.createDataFrame([("var results = [{'a': '1', \"b\": \"x\"},];".replace("'", '"'),), (None,)], "html string")
    assert [r["entry"] for r in readers.js_array(df, "results").collect()] == [{"a": "1", "b": "x"}]


def test_channel_areas(spark, tmp_path):
    field = lambda name, n: name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([n]) + b"\0" * 15
    raw = b"\x03" + b"\0" * 3 + struct.pack("<IHH", 1, 32 + 64 + 1, 1 + 10 + 6) + b"\0" * 20 + field("Channel", 10) + field("pFull_Max", 6) + b"\r" + b" Chan1     1.23  "
    (tmp_path / "a_1d_ccA_L.dbf").write_bytes(raw)
    db = sqlite3.connect(tmp_path / "a_Results1D.gpkg")
    db.executescript('CREATE TABLE gpkg_contents(table_name TEXT); INSERT INTO gpkg_contents VALUES ("x_1d_ccA_L"); CREATE TABLE x_1d_ccA_L(fid INTEGER, geom BLOB, "Chan ID" TEXT, pFull_Max REAL); INSERT INTO x_1d_ccA_L VALUES (1, NULL, "CULV1", 2.5);')
    db.commit()
    db.close()
    (tmp_path / "bad_Results.gpkg").write_bytes(b"not a database")
    got = rows(readers.channel_areas(spark, str(tmp_path)), "field", "value")
    assert got == [("Chan ID", "CULV1"), ("Chan ID", "Chan1"), ("pFull_Max", "1.23"), ("pFull_Max", "2.5")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("Q", "r1", 1.5), ("V", "r1", 2.0)], "data_type string, run string, v double")
    paths = sinks.export({"a b!": df}, str(tmp_path / "out"), "both")
    assert spark.read.parquet(paths["a b!"][0]).count() == 2 and sinks.sheet_name("!!") == "Sheet"
    sinks.write_cache(df, str(tmp_path / "cache"))
    assert sinks.read_cache(spark, str(tmp_path / "cache"), data_type=["V"]).count() == 1
    assert rows(sinks.column_widths(df), "column", "width") == [("data_type", 11), ("run", 5), ("v", 5)]
    said = sinks.data_dictionary(spark, {"s": df}, {"v": "value"}, {("s", "run"): "the run"})
    assert rows(said, "column", "description") == [("data_type", "TODO: describe"), ("run", "the run"), ("v", "value")]


def test_stream_renews_peaks(spark, tmp_path):
    schema, where = "k string, v double, name string", [str(tmp_path / x) for x in ("in", "out", "state")]
    for data in ([("a", 1.0, "x"), ("b", 5.0, "y")], [("a", 3.0, "z")]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(where[0])
        incremental.stream_peaks(spark, where[0], schema, where[1], where[2], ["k"], "v", ["name"]).awaitTermination(60)
    assert rows(incremental.peaks(spark, where[1], schema), "k", "v", "name") == [("a", 3.0, "z"), ("b", 5.0, "y")]
