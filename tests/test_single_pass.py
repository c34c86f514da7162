"""Results follow the files, nothing stays cached, and a set of files is read once."""

import re

import pytest

from tidewell import workflows
from tidewell.operators import ensemble, series
from tidewell.sources import readers, results


def executed(df):
    """The plan that ran: what a later use of the same shuffle reads again is not in it."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def scans(df):
    return len(re.findall(r"FileScan|Scan ExistingRDD|Scan text", executed(df)))


def exchanges(df):
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (hash|range)partitioning", executed(df)))


def persisted(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def put(spark, folder, first, n):
    spark.range(first, first + n).selectExpr("'g' AS k", "cast(id as double) AS v", "'TP01' AS tp", "concat('n', id) AS name", "'d' AS duration").coalesce(1).write.mode("append").parquet(folder)


def test_new_files_give_new_numbers(spark, tmp_path):
    folder = str(tmp_path / "t")
    median = lambda: ensemble.ensemble_statistics(spark.read.parquet(folder), ["k"], "v", "tp", "name").first()
    culverts = lambda s: ensemble.statistic_of_columns(spark.read.parquet(folder), ["k"], ["v"], s, "v", "name").first()
    put(spark, folder, 1, 10)
    first = median()
    assert (first["count_tp"], first["median"], first["mean_including_zeroes"]) == (10, 6.0, 5.5)
    assert (culverts("mean")["v_mean"], culverts("median")["v_median"]) == (5.5, 6.0)
    put(spark, folder, 1001, 40)
    second = median()
    assert (second["count_tp"], second["median"], second["mean_including_zeroes"]) == (50, 1016.0, 817.5)
    assert (culverts("mean")["v_mean"], culverts("median")["v_median"], culverts("mean")["count_bin"]) == (817.5, 1016.0, 50)
    assert persisted(spark) == 0


def test_closures_follow_the_files(spark, tmp_path):
    def summary():
        po = results.read_results(spark, str(tmp_path), ["PO"])["PO"]
        return [(r["threshold"], r["central_value"]) for r in workflows.closure_durations(po, [4.0])["Duration_Summary"].collect()]

    (tmp_path / "M_TP01_1.0p_120m_PO.csv").write_text("d,Time,Flow\nd,Time,A\nd,0.0,0.0\nd,0.5,5.0\n")
    assert summary() == [(4.0, 0.5)]
    for k in (2, 3):
        (tmp_path / f"M_TP0{k}_1.0p_120m_PO.csv").write_text("d,Time,Flow\nd,Time,A\nd,0.0,9.0\nd,0.5,5.0\nd,1.0,8.0\n")
    assert summary() == [(4.0, 1.5)]
    assert persisted(spark) == 0


def test_one_scan_of_a_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    put(spark, folder, 1, 30)
    df = spark.read.parquet(folder)
    assert scans(ensemble.ensemble_statistics(df, ["k"], "v", "tp", "name")) == 1
    assert scans(series.exceedance_durations(df, ["k"], "v", "v", [3.0, 9.0])) == 1


TABLES = {
    "Q": (lambda x: readers.time_series(x, "Q"), "d,Time (h),Q a [r],Q b [r]\nd,0,1,2\n"),
    "PO": (readers.point_output, "d,Time,Flow\nd,Time,A\nd,0.0,9.0\n"),
    "POMM": (readers.peak_summary, "x,Location,A\nx,Time,Flow\nx,Max,5\nx,T,1\nx,Min,-1\nx,T,3\n"),
    "Cmx": (lambda x: readers.maximums(x, {"Chan ID": "id", "Qmax": "q"}, ["id"])[0], "Chan ID,Qmax\nc,1.0\n"),
    "RORB": (readers.hydrograph, "t\nt\nInc,Time (hrs),Calculated hydrograph:  Loc1\n1,0,0\n"),
}


@pytest.mark.parametrize("kind", TABLES)
def test_readers_take_one_pass(spark, tmp_path, kind):
    read, text = TABLES[kind]
    (tmp_path / "a.csv").write_text(text)
    df = read(readers.read_lines(spark, str(tmp_path)))
    assert df.count() > 0 and scans(df) == 1 and exchanges(df) <= 1


def test_groups_of_equal_values(spark):
    rows = [("g", 0.0 if i % 3 else None if i % 2 else 7.0, f"TP{i % 4:02d}", f"n{i:04d}") for i in range(400)]
    df = spark.createDataFrame(rows + [("h", 5.0, "TP01", f"n{i:03d}") for i in range(301)], "k string, v double, tp string, name string")
    got = {r["k"]: (r["median"], r["median_tp"], r["median_name"]) for r in ensemble.ensemble_statistics(df, ["k"], "v", "tp", "name").collect()}
    order = sorted((r[1:] for r in rows), key=lambda m: (m[0] is not None, m[0] or 0.0, m[1], m[2]))
    assert got == {"g": order[200], "h": (5.0, "TP01", "n150")}
