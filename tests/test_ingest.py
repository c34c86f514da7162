"""The file-aware cache, its failures, the layouts and whole versions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewell.sources import ingest, layouts, readers, results, versions

RUN = "M_TP01_1.0p_120m"


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*[F.col(f"`{n}`") for n in names]).collect()), key=str)


def read_in_full(spark, folder, kind):
    return rows(results.read_results(spark, folder, [kind])[kind], "Chan ID", "Time", "Q", "internalName")


def test_refresh_follows_the_files(spark, tmp_path):
    folder, cache = tmp_path / "in", str(tmp_path / "cache")
    folder.mkdir()
    put = lambda name, text: (folder / name).write_text(text)
    put(f"{RUN}_1d_Q.csv", "x,Time (h),Q a [r],Q b [r]\nx,0,1,2\nx,1,3,4\n")
    put(f"{RUN}_1d_Cmx.csv", "Chan ID,Time Qmax,Qmax,Time Vmax,Vmax\na,1,10,1,1\n")
    put("notes.txt", "no result")
    same = lambda: rows(ingest.table(spark, cache, "Q"), "Chan ID", "Time", "Q", "internalName") == read_in_full(spark, str(folder), "Q")
    assert ingest.refresh(spark, str(folder), cache) == {"added": 2, "changed": 0, "touched": 0, "removed": 0, "same": 0} and same()
    assert ingest.refresh(spark, str(folder), cache)["same"] == 2 and len(versions.history(spark, cache)) == 1
    put("M_TP02_1.0p_120m_1d_Q.csv", "x,Time (h),Q a [r]\nx,0,7\n")  # another file
    put(f"{RUN}_1d_Q.csv", "x,Time (h),Q a [r],Q b [r]\nx,0,5,6\n")  # a changed one
    os.utime(folder / f"{RUN}_1d_Cmx.csv", (2_000_000_000, 2_000_000_000))  # one that is only newer
    assert ingest.refresh(spark, [str(folder)], cache) == {"added": 1, "changed": 1, "touched": 1, "removed": 0, "same": 0} and same()
    assert rows(ingest.table(spark, cache, "Q", ["b"]), "Chan ID", "Q") == [("b", 6.0)]
    (folder / "M_TP02_1.0p_120m_1d_Q.csv").unlink()
    assert ingest.refresh(spark, str(folder), cache)["removed"] == 1 and same()
    assert ingest.table(spark, cache, "Cmx").count() == 2 and ingest.table(spark, cache, "V") is None
    assert ingest.failures(spark, cache).count() == 0


def test_failures_are_told_and_stop_nothing(spark, tmp_path):
    folder, cache = tmp_path / "in", str(tmp_path / "cache")
    folder.mkdir()
    good = "Chan ID,Time Qmax,Qmax,Time Vmax,Vmax\na,1,10,1,1\n"
    texts = {
        "good_1d_Cmx.csv": good, "lacks_1d_Cmx.csv": "Chan ID,Qmax\na,1\n", "bad_1d_Cmx.csv": good + "b,1,ten,1,1\n", "head_1d_Cmx.csv": "Chan ID,Time Qmax,Qmax,Time Vmax,Vmax\n",
        "blank_1d_Cmx.csv": " \n", "nan_1d_Cmx.csv": good + "b,1,NaN,,1\n", "good_1d_Q.csv": "x,Time (h),Q a\nx,0,1\n", "bad_1d_Q.csv": "x,Time (h),Q a\nx,0,1\nx,1,oops\n", "none_1d_Q.csv": "x,Time (h)\n", "a_PO.csv": "d,Time,Flow\nd,Time,A\nd,noon,1\n", "a.eof": "nothing",
    }
    for name, text in texts.items():
        (folder / name).write_text(text)
    ingest.refresh(spark, str(folder), cache)
    told = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in ingest.failures(spark, cache).collect()}
    assert told == {
        "lacks_1d_Cmx.csv": "lacks Time Qmax, Time Vmax, Vmax", "bad_1d_Cmx.csv": "line 3, Qmax: ten is no double", "head_1d_Cmx.csv": "has no rows", "blank_1d_Cmx.csv": "gives no rows",
        "bad_1d_Q.csv": "line 3, a value: oops is no double", "none_1d_Q.csv": "has no columns of values", "a_PO.csv": "line 3, time: noon is no double", "a.eof": "has no line with 'CULVERT AND PIPE DATA'",
    }
    assert {r[0] for r in rows(ingest.table(spark, cache, "Cmx"), "internalName")} == {"good", "nan"}
    assert rows(ingest.table(spark, cache, "Q"), "internalName", "Q") == [("good", 1.0)]
    (folder / "bad_1d_Q.csv").write_text(texts["good_1d_Q.csv"])
    ingest.refresh(spark, str(folder), cache)
    assert "bad_1d_Q.csv" not in {r["path"].rsplit("/", 1)[1] for r in ingest.failures(spark, cache).collect()} and ingest.table(spark, cache, "Q").count() == 2


def test_layouts_are_checked_when_loaded(spark):
    assert layouts.by_suffix()["_1d_ccA_L.dbf"] == "ccA" and list(layouts.by_suffix())[0] == max(layouts.by_suffix(), key=len)
    assert layouts.of_group("series") == ["Q", "V", "CF", "H"]
    schema = layouts.LAYOUTS["Cmx"].schema
    assert schema.simpleString() == "struct<Chan ID:string,tq:double,q:double,tv:double,v:double>" and layouts.LAYOUTS["Chan"].optional[0] == "DS Invert"
    good = {"type": "A", "suffixes": [".a"], "group": "g", "layout": "table", "columns": {"X": {"name": "x", "type": "double", "required": True}}}
    assert layouts.load(json.dumps([good]))["A"].names == {"X": "x"}
    wrong = [good | {"layout": "sheet"}, good, good | {"type": "B", "suffixes": [".A"], "columns": {"X": {"name": "x", "type": "float", "required": True}, "Y": {"name": "x", "type": "double", "required": True}}}, {"type": "C"}]
    with pytest.raises(ValueError) as error:
        layouts.load(json.dumps(wrong))
    for part in ("unknown layout 'sheet'", "A: given twice", "suffix '.a' is empty or taken", "unknown type 'float'", "two columns are called 'x'", "C: has"):
        assert part in str(error.value)
    with pytest.raises(ValueError, match="no JSON"):
        layouts.load("{")
    lines = spark.createDataFrame([("a", 0, ""), ("a", 1, "X, Y"), ("b", 0, "X")], "path string, line int, text string")
    assert rows(layouts.headers_match(lines, ["X", "Y"]), "path", "matches") == [("a", True), ("b", False)]


def test_versions_are_whole_and_batches_count_once(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "k string, v long"
    make = lambda *r: spark.createDataFrame(list(r), schema)
    assert versions.read(spark, root, schema).count() == 0
    assert versions.append(make(("a", 1)), root, "one") and versions.append(make(("b", 2)), root, "two")
    assert not versions.append(make(("b", 2)), root, "two")
    assert rows(versions.read(spark, root, schema), "k", "v") == [("a", 1), ("b", 2)] and rows(versions.read(spark, root, schema, 0), "k", "v") == [("a", 1)]
    make(("c", 3)).write.parquet(f"{root}/data/half")  # written, never committed
    assert versions.read(spark, root, schema).count() == 2
    assert versions.append(make(("d", 4)), root, "three", replaces=True) and rows(versions.read(spark, root, schema), "k", "v") == [("d", 4)]
    assert versions.vacuum(spark, root) == 2 and rows(versions.read(spark, root, schema), "k", "v") == [("d", 4)]
    assert not versions._create(spark, f"{root}/commits/000000000000.json", "{}")


def test_batches_of_a_stream_count_once(spark, tmp_path):
    from tidewell.streaming import incremental

    schema, source, target = "k string, v double, n string", str(tmp_path / "in"), str(tmp_path / "peaks")
    put = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: incremental.stream_peaks(spark, source, schema, target, str(tmp_path / "check"), ["k"], "v", ["n"]).awaitTermination()
    put(("a", 1.0, "x"), ("b", 5.0, "y"))
    run()
    put(("a", 3.0, "z"))
    run()
    got = incremental.peaks(spark, target, schema)
    assert rows(got, "k", "v") == [("a", 3.0), ("b", 5.0)] and len(versions.history(spark, target)) == 2
    assert readers.number is not None
