"""From small files of each layout to the sheets of each report."""

import pytest
from pyspark.sql import functions as F

from tidewell import workflows
from tidewell.operators import columns
from tidewell.sources import logs, readers, results


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*[F.col(f"`{n}`") for n in names]).collect()), key=str)


RUN = "M_TP01_1.0p_120m"
CULVERT = "  ".join(["FC04.12", "C", "3", "43.5", "42.5", "45.5", "44.5", "23.9", "2.51", "0.012", "1.2", "-----", "0.9", "Adjusted", "0.5", "1.0", "0.0", "1.5"])


@pytest.fixture
def folder(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)

    put(f"{RUN}_1d_Cmx.csv", "Chan ID,Time Qmax,Qmax,Time Vmax,Vmax\nFC04.123,1.0,10.0,1.1,1.0\nC2,2.0,20.0,2.1,2.0\n")
    put(f"{RUN}_1d_Nmx.csv", "Node ID,Time Hmax,Hmax\nFC04.123.1,1.0,47.5\nFC04.123.2,1.0,46.0\nC2.3,1.0,9.0\n")
    put(f"{RUN}_1d_Chan.csv", "Channel,LBUS Obvert,US Invert,Length\nFC04.123,45.0,43.0,20.0\n")
    put(f"{RUN}_RLL_Qmx.csv", "ID,Qmax,Time Qmax,dQmax,Time dQmax,H\nL1,10,1,0,1,5\n")
    put(f"{RUN}.eof", f"x\nCULVERT AND PIPE DATA\n\nChannel  Type\n{CULVERT}\n\nend\n")
    put("Other.eof", f"x\nCULVERT AND PIPE DATA\n\nChannel  Type\n{CULVERT}\n\nend\n")
    put(f"{RUN}_1d_Q.csv", f"x,Time (h),Q FC04.123 [{RUN}],Q C2 [{RUN}]\na,0.0,1.0,2.0\na,1.0,3.0,\n")
    put(f"{RUN}_1d_H.csv", f"x,Time (h),H FC04.123.1 [{RUN}],H FC04.123.2 [{RUN}]\na,0.0,44.5,43.0\n")
    put(f"{RUN}_PO.csv", "d,Time,Flow,Flow\nd,Time,A,B\n" + "".join(f"d,{t * 0.5},{q},{1 + t}\n" for t, q in enumerate([0.0, 5.0, 12.0, 8.0, 1.0])))
    put("M_TP02_1.0p_120m_PO.csv", "d,Time,Flow\nd,Time,A\nd,0.0,0.0\nd,0.5,12.0\nd,1.0,12.0\n")
    for k, peak in ((1, 5.0), (2, 9.0), (3, 7.0)):
        put(f"M_TP0{k}_1.0p_60m_POMM.csv", f"x,Location,A\nx,Time,Flow\nx,Maximum (Extracted from Time Series),{peak}\nx,Time of Maximum,1\nx,Minimum (Extracted From Time Series),-1\nx,Time of Minimum,3\n")
    return str(tmp_path)


def test_culvert_reports(spark, folder):
    tables = results.read_results(spark, folder, ["Cmx", "Nmx", "Chan", "EOF"])
    sheets = workflows.culvert_maximums(tables)
    got = sheets["Maximums"]
    assert got.columns[:2] == ["trim_runcode", "aep_text"]
    assert rows(got, "internalName", "Chan ID", "Q", "V", "US_h", "US Invert", "Height", "HW_D") == [
        (RUN, "C2", 20.0, 2.0, None, None, None, None), (RUN, "FC04.123", 10.0, 1.0, 47.5, 43.5, 2.0, 2.0), ("Other", "FC04.12", None, None, None, 43.5, None, None),
    ]
    assert sheets["raw_data"].count() == 4 + 1 + 1 + 2
    assert rows(workflows.culvert_statistics(got, keys=["trim_runcode", "aep_text", "Chan ID"])["aep-mean-max"], "Chan ID", "Q_mean", "adopted_name") == [("C2", 20.0, RUN), ("FC04.123", 10.0, RUN)]


def test_culvert_series(spark, folder):
    tables = results.read_results(spark, folder, ["Q", "H", "Chan", "EOF"], [" FC04.123", ""])
    got = workflows.culvert_series(tables)["1d_timeseries_data"]
    assert rows(got, "Chan ID", "Time", "Q", "US_h", "US Invert", "HW_D") == [("FC04.123", 0.0, 1.0, 44.5, 43.0, 0.75), ("FC04.123", 1.0, 3.0, None, 43.0, None)]


def test_points_peaks_and_closures(spark, folder, tmp_path):
    tables = results.read_results(spark, folder, ["PO", "POMM", "RLL_Qmx"])
    assert workflows.po_combine(tables)["combined_PO"].count() == 10 + 3
    peaks = workflows.pomm_combine(tables)["combined_POMM"]
    assert rows(peaks, "Location", "Type", "AbsMax") == [("Flow", "A", 5.0), ("Flow", "A", 7.0), ("Flow", "A", 9.0), ("L1", "Q", 10.0)]
    report = workflows.peak_report(workflows.peaks(tables), "median")
    assert rows(report["aep-max"].filter("Type = 'A'"), "median", "median_tp", "count_tp") == [(7.0, "TP03", 3)] and "mean_peak" not in report["aep-max"].columns
    assert rows(workflows.peak_report(workflows.peaks(tables))["aep-max"], "Type", "AbsMax") == [("A", 9.0), ("Q", 10.0)]
    assert {"aep-dur-mean", "aep-mean-max"} == set(workflows.peak_report(workflows.peaks(tables), "mean", include_all=False))
    sheets = workflows.closure_durations(tables["PO"], [4.0, 10.0])
    assert rows(sheets["Duration_Exceedance"].filter("Location = 'A'"), "tp_text", "threshold", "duration_exceeding") == [("TP01", 10.0, 0.5), ("TP01", 4.0, 1.5), ("TP02", 10.0, 1.0), ("TP02", 4.0, 1.0)]
    assert rows(sheets["Duration_Summary"].filter("Location = 'A'"), "threshold", "central_value", "critical_tp") == [(10.0, 1.0, "TP02"), (4.0, 1.5, "TP01")]
    written = workflows.write({"a": sheets["Duration_Summary"]}, str(tmp_path / "out"), "both")
    assert len(written["a"]) == 2 and spark.read.parquet(written["a"][0]).count() == sheets["Duration_Summary"].count()
    facts = dict(rows(workflows.report_facts(spark, {"combined_POMM": peaks}, {"by": "me"}), "name", "value"))
    assert facts["by"] == "me" and facts["combined_POMM rows"] == "4" and facts["Source directories"].endswith(folder)


def test_checks(spark, folder):
    tables = results.read_results(spark, folder, ["PO", "Q"])
    stable = workflows.stability_report(tables)
    assert stable["all"].count() == 3 + 2 and stable["unstable"].count() == 0
    late = workflows.peak_check_report(tables["PO"], ["flow"], excluded=["b"])
    assert rows(late["all"], "tp_text", "Location", "peak_value", "status") == [("TP01", "A", 12.0, "WARN_2H"), ("TP02", "A", 12.0, "WARN_1H")]
    assert workflows.peak_check_report(tables["PO"], [])["all"].count() == 0


LOG = """Build: 2025.1 iDP
Simulations Log Folder == C:\\logs\\someone
Computer Name: PC 1
Simulation Started: 2025-Nov-28 00:27.
Specified Events:
 -e1   Q100
 -e2   2hr

Specified Scenarios:
 -s1   Exg

BC Database == ..\\bc\\dbase.csv
Geometry Control File == ..\\model\\a.tgc
BC Event File == ..\\bc\\older.tef
Trying to open (I) file C:\\bc\\events.tef...OK.  File Unit: 12
Number of defined variables: 2
 Set Variable ~E1~ == Q100
 Set Variable DEPTH == 1.5

BC Event Source == ~E1~ | old
BC Event Source == ~E1~ | Q100.csv
Input File: C:\\runs\\EG16_Q100_2hr_Exg_006.tcf
Start Time (h): 0.0
End Time (h): 3.5
Initialisation Times
Clock Time: 0:0:1 [0.0001 h]
Final Times
Clock Time: 0:0:9 [0.0025 h]
Processor Time: 0:0:18 [0.005 h]
Simulation FINISHED
Final Cumulative ME: -0.50%
Final Cumulative ME: 9.00%
"""


def test_log_report(spark, tmp_path):
    (tmp_path / "EG16_Exg_TP03_Q100_2hr_006.tlf").write_text(LOG)
    (tmp_path / "broken.tlf").write_text(LOG.replace("Simulation FINISHED", ""))
    (tmp_path / "nohead.tlf").write_text(LOG.replace("Computer Name: PC 1\n", ""))
    (tmp_path / "nomass.tlf").write_text(LOG.replace("Final Cumulative", "Cumulative").replace("Nov-28", "Dec-01"))
    logs_ = results.read_results(spark, str(tmp_path), ["TLF"])["TLF"]
    sheets = workflows.log_report(logs_)
    assert [r["completion"] for r in sheets["Log_Summary"].collect()] == [1, 2]
    r = logs_.filter("completion = 2").first()
    assert (r["version"], r["username"], r["computer"], str(r["start"])) == ("2025.1 iDP", "someone", "PC 1", "2025-11-28 00:27:00")
    assert (r["bc_dbase"], r["tgc"], r["tef"], r["tcf"], r["model_end"], r["mass_error"]) == ("dbase.csv", "a.tgc", "events.tef", "EG16_Q100_2hr_Exg_006.tcf", 3.5, -0.5)
    assert (r["init_runtime"], r["init_cpu"], r["final_runtime"], r["final_cpu"]) == (0.0001, None, 0.0025, 0.005)
    assert r["settings"] == {"-e1": "Q100", "-e2": "2hr", "-s1": "Exg", "DEPTH": "1.5", "bcdbase: -e1": "Q100.csv"}
    assert (r["trim_tcf"], r["tp_text"]) == ("EG16_TP03_006", "TP03")
    assert sheets["settings"].count() == 10


def test_names_must_tell(spark):
    df = spark.createDataFrame([("a_TP03_2.5p_060m",)], "n string")
    assert [tuple(r) for r in df.select(*[logs.checked(F.col("n"), k) for k in ("tp", "duration", "aep")]).collect()] == [("03", "060", "2.5")]
    with pytest.raises(Exception, match="no tp"):
        df.select(logs.checked(F.lit("plain"), "tp").alias("x")).collect()


def test_hydrologic_closures(spark, tmp_path):
    batch = "Peak Description\n Run Duration Unit AEP TPat Peak0001\n 1 24 hour 1% 10 12.5 Y 100\n 2 24 hour 1% 11 12.5 Y 100\n Run,    Representative hydrograph\n"
    (tmp_path / "batch.out").write_text(batch)
    for tp, v in ((10, 10.0), (11, 4.0)):
        (tmp_path / f"aep1_du24hourtp{tp}.csv").write_text(f"title\ntitle\nInc,Time (hrs),Calculated hydrograph:  Loc1\n1,0,0\n2,1,{v}\n3,2,{v}\n")
    sheets = workflows.hydrologic_closure_durations(readers.read_lines(spark, str(tmp_path / "batch.out")), readers.read_lines(spark, str(tmp_path), "*.csv"), [3.0, 5.0])
    assert rows(sheets["Duration_Exceedance"], "location", "tp_text", "threshold", "duration_exceeding") == [("Loc1", "10", 3.0, 2.0), ("Loc1", "10", 5.0, 2.0), ("Loc1", "11", 3.0, 2.0)]
    assert rows(sheets["Duration_Summary"], "threshold", "central_value", "low_value", "high_value") == [(3.0, 2.0, 2.0, 2.0), (5.0, 2.0, 0.0, 2.0)]


def test_missing_runs(spark):
    df = spark.createDataFrame([("R", "1p", d, f"TP{k:02d}") for d, n in (("60m", 10), ("90m", 9)) for k in range(1, n + 1)] + [("R", "1p", "90m", "x")], "trim_runcode string, AEP string, Duration string, TP string")
    sheets = workflows.missing_runs_report(df)
    assert rows(sheets["missing"], "duration", "missing_tp") == [("90m", "TP10")]
    assert rows(sheets["coverage"], "duration", "message") == [("60m", "complete"), ("90m", "TP10")]


def test_column_order(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "z int, path int, R2 int, R1 int, b int, mean_x int")
    assert columns.reordered(df, ["b", "none"], ["R"], ["z"], ["path"]).columns == ["b", "R1", "R2", "z", "mean_x", "path"]
    assert columns.paths_last(df).columns == ["z", "R2", "R1", "b", "mean_x", "path"]
    assert columns.grouped_order(df, [["b"], ["R1", "R2"]], ["path"]).columns == ["b", "R1", "R2", "z", "mean_x", "path"]
    assert columns.without_columns(df, ["MEAN"]).columns == ["z", "path", "R2", "R1", "b"]
    with pytest.raises(KeyError, match="aep"):
        columns.first_present(df, {"aep": ["AEP_text"]})
    values = spark.createDataFrame([("n", "10"), ("n", "9"), ("n", "9"), ("t", "10"), ("t", "x9")], "k string, v string")
    assert rows(columns.unique_sorted(values, ["k"], "v"), "k", "values") == [("n", ["9", "10"]), ("t", ["10", "x9"])]
    assert results.normalised_types(["PO", "x", "PO"], ["PO", "Q"]) == (["PO"], ["x"]) and results.normalised_locations([" a", "a", "", None]) == ["a"]
