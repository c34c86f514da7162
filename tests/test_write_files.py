"""Named text files written in tasks: whole, in order, and replaced by a repeated write."""

import os

from tidewell.sources import sinks


def test_files_are_whole_and_in_order(spark, tmp_path):
    rows = [("a/x.csv", i, f"é{i}") for i in range(2500)] + [("/b c [1].txt", 1, None), ("/b c [1].txt", 0, "head"), (" ", 0, "no file"), (None, 0, "no file"), ("", 0, "no file")]
    lines = spark.createDataFrame(rows, "path string, line int, text string").repartition(7)
    folder = tmp_path / "out put"
    for _ in range(2):
        assert sinks.write_files(lines, str(folder)) == {"files": 2, "lines": 2502}
        found = sorted(os.path.relpath(os.path.join(at, n), folder) for at, _, names in os.walk(folder) for n in names)
        assert found == ["a/x.csv", "b c [1].txt"]
    assert (folder / "a/x.csv").read_text().splitlines() == [f"é{i}" for i in range(2500)]
    assert (folder / "b c [1].txt").read_text() == "head\n\n"
    sinks.write_files(lines.filter("path = 'a/x.csv' and line < 2"), str(folder))
    assert (folder / "a/x.csv").read_text() == "é0\né1\n"


def test_no_lines_write_nothing(spark, tmp_path):
    assert sinks.write_files(spark.createDataFrame([], "path string, line int, text string"), str(tmp_path / "none")) == {"files": 0, "lines": 0}
    assert not (tmp_path / "none").exists()
