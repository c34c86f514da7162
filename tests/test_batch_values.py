"""Batch reports of any number of printed locations."""

from tidewell.sources import readers


def test_every_value_of_a_run_is_read_with_its_name(spark, tmp_path):
    names = [f"L{i}" for i in range(150)]
    text = "x\n Peak  Description\n 01 Calc\n Run        Duration Unit AEP TP " + " ".join(names) + "\n 1 24 hour 1% 10 " + " ".join(str(i) for i in range(150)) + "\nRun,    Representative hydrograph\n"
    (tmp_path / "batch.out").write_text(text)
    lines = readers.read_lines(spark, str(tmp_path / "batch.out"))
    assert readers.batch_runs(lines).first()["values"] == [float(i) for i in range(150)]
    got = readers.batch_peaks(lines).orderBy("place").collect()
    assert [(r["run"], r["aep"], r["tp"], r["place"], r["name"], r["value"]) for r in got] == [(1, "1", 10, i, names[i], float(i)) for i in range(150)]


def test_values_without_a_header_have_no_names(spark, tmp_path):
    (tmp_path / "batch.out").write_text(" Peak  Description\n 1 24 hour 1% 10 12.5 Y 100\n 2 24 hour 1% 11 1 N\n")
    got = readers.batch_peaks(readers.read_lines(spark, str(tmp_path / "batch.out"))).orderBy("run", "place").collect()
    assert [(r["run"], r["name"], r["value"]) for r in got] == [(1, None, 12.5), (1, None, 1.0), (1, None, 100.0), (2, None, 1.0), (2, None, 0.0)]
