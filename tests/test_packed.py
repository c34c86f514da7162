"""The packed source of series: the rows of the readers of lines, however files are cut; columns that are chosen."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.sources import ingest, packed, readers, results

KINDS = {"Q": "_1d_Q.csv", "V": "_1d_V.csv", "CF": "_1d_CF.csv", "H": "_1d_H.csv", "PO": "_PO.csv"}


def random_file(rng: random.Random, kind: str) -> bytes:
    """A table with blanks, missing and spare cells, quotes, cells that are no numbers, and any ends of lines."""
    n, end = rng.randrange(0, 5), rng.choice(["\n", "\r\n", "\r"])
    names = [rng.choice(["a", "b", "c d", "x.1", "x.2", "y.1", "z", "FC 1", ""]) for _ in range(n)]
    unit = rng.choice(["", " [run]", " [m3/s] "])
    quote = lambda x: f'"{x}"' if rng.random() < 0.2 else x
    if kind == "PO":
        heads = [["d", rng.choice(["Time", "t"]), *[rng.choice(["Flow", "Level"]) for _ in names]], ["d", rng.choice(["Time", "TIME", "t"]), *names, *["extra"] * rng.randrange(2)]]
    else:
        heads = [["d", "Time (h)", *[quote(f"{rng.choice([packed.PREFIXES[kind], ''])}{x}{unit}") for x in names]]]
    value = lambda: quote(rng.choice(["1", "2.5", "-3e2", "", " ", "NaN", "oops", " 7 ", "Infinity", "1d", "+4", "é", 'say ""so"", now', ""]))
    body = [[quote("d"), rng.choice(["0", "0.5", "1", "noon", " 2 ", ""]), *[value() for _ in range(max(0, n + rng.randrange(-1, 2)))]] for _ in range(rng.randrange(0, 9))]
    lines = [",".join(x) for x in heads + body]
    for _ in range(rng.randrange(3)):
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", "  ", "note"]))
    return (end.join(lines) + rng.choice(["", end])).encode()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, root = random.Random(5), tmp_path_factory.mktemp("random results")
    for kind, suffix in KINDS.items():
        for k in range(25):
            (root / f"R{k} [x]+50%_TP{k % 10 + 1:02d}{suffix}").write_bytes(random_file(rng, kind))
    return str(root)


def listed(spark, folder):
    return [(r["path"], r["length"], r["data_type"]) for r in results.listing(spark, folder).collect()]


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("kind", ["Q", "CF", "H", "PO"])  # V is read as Q
def test_rows_are_those_of_the_readers_of_lines(spark, folder, kind):
    files = [f for f in listed(spark, folder) if f[2] == kind]
    lines = readers.read_lines(spark, [readers.literal_path(p) for p, _, _ in files])
    want = rows(results.READERS[kind](lines))
    assert len(want) > 10
    for task_bytes in (40, packed.TASK_BYTES):
        assert rows(results.packed_series(packed.series(spark, files, task_bytes=task_bytes).withColumnRenamed("time", "time_text"), kind)) == want
    assert rows(results.read_results(spark, folder, [kind])[kind]) == rows(results.tidy(lines, kind))
    assert rows(results.read_results(spark, folder, [kind], ["x", "a", " c d "])[kind]) == rows(results.tidy(lines, kind, ["x", "a", "c d"]))


def test_every_cut_gives_the_whole(tmp_path):
    rng, reader = random.Random(8), packed.SeriesReader({"files": "[]"})
    for kind in KINDS:
        for _ in range(60):
            data = random_file(rng, kind)
            (tmp_path / "f").write_bytes(data)
            read = lambda start, end: [x for b in reader.piece(f"file:{tmp_path}/f", kind, start, end) for x in b.to_pylist()]  # noqa: E731, B023
            for step in (1, 7, 50):
                assert [x for s in range(0, len(data), step) for x in read(s, min(len(data), s + step))] == read(0, len(data))


def test_scans_of_one_source_keep_to_themselves(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"R{k}_1d_Q.csv").write_text("d,Time (h),Q a,Q b\nd,0,1,2\nd,1,3,4\n")
    q = results.read_results(spark, str(tmp_path), ["Q"])["Q"].select("internalName", "Time", F.col("Chan ID").alias("id"), "Q")
    part = q.filter("id = 'a'").select("internalName", "Time", F.col("Q").alias("a"))
    assert q.join(part, ["internalName", "Time"]).count() == 12 and q.unionByName(q.filter("id = 'b' and internalName = 'R1'")).count() == 14
    totals = q.groupBy("id").agg(F.sum("Q").alias("t"))
    assert q.join(totals, "id").filter("id = 'b'").select("t").distinct().collect()[0][0] == 18.0


def test_what_is_not_wanted_is_not_made(tmp_path):
    path = tmp_path / "a_1d_Q.csv"
    path.write_text("d,Time (h),Q a,Q b,Q c\n" + "".join(f"d,{i},{i}1,{i}2,{i}3\n" for i in range(30)))
    reader = packed.SeriesReader({"files": f'[["file:{path}", {path.stat().st_size}, "Q"]]', "entities": '["c", "d"]', "task_bytes": "100"})
    tasks = reader.partitions()
    assert len(tasks) > 3
    made = [r for t in tasks for b in reader.read(t) for r in b.to_pylist()]
    assert [(r["time"], r["entity"], r["text"]) for r in made] == [(str(i), "c", f"{i}3") for i in range(30)]


def test_small_files_share_tasks_and_large_ones_come_apart():
    tasks = packed.packed([(f"f{i}", 10, "Q") for i in range(8)] + [("big", 250, "Q")], task_bytes=100, open_bytes=20)
    assert [len(t.pieces) for t in tasks] == [4, 4, 1, 1, 1]
    assert [p[2:] for t in tasks for p in t.pieces if p[0] == "big"] == [(0, 100), (100, 200), (200, 250)]
    assert packed.packed([]) == []


def test_no_files_give_empty_tables(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    tables = results.read_results(spark, str(tmp_path))
    assert set(tables) == {*results.READERS, "ccA"} and all(t.count() == 0 for t in tables.values())
    assert {"Chan ID", "internalName", "Q"} <= set(tables["Q"].columns)


def test_names_that_are_patterns_or_encoded(spark, tmp_path):
    folder, cache = tmp_path / "in put", str(tmp_path / "cache")
    folder.mkdir()
    (folder / "M [1] 5%+Exg_TP01_1d_Q.csv").write_text("d,Time (h),Q a\nd,0,1\n")
    (folder / "M 1 5%+Exg_TP02_1d_Cmx.csv").write_text("Chan ID,Time Qmax,Qmax,Time Vmax,Vmax\na,1,10,1,1\n")
    ingest.refresh(spark, str(folder), cache)
    tables = results.read_results(spark, str(folder), ["Q", "Cmx"])
    for kind, name in {"Q": "M [1] 5%+Exg_TP01", "Cmx": "M 1 5%+Exg_TP02"}.items():
        assert {r[0] for r in ingest.table(spark, cache, kind).select("internalName").collect()} == {name}
        assert rows(ingest.table(spark, cache, kind)) == rows(tables[kind])
    assert ingest.failures(spark, cache).count() == 0 and tables["Q"].select(F.col("directory_path")).first()[0].endswith("/in put")


def test_locations_by_data_type(spark, tmp_path):
    assert results.locations_of({"Q": ["a", " a "], "po": "b", "PO": ["c"]}, "PO") == ["c"] and results.locations_of({"po": "b"}, "PO") == ["b"]
    assert results.locations_of({"Q": ["a"]}, "V") == [] and results.locations_of(["x", ""], "V") == ["x"] and results.locations_of(None, "V") == []
    for kind in ("Q", "V"):
        (tmp_path / f"R_1d_{kind}.csv").write_text(f"d,Time (h),{kind} a,{kind} b\nd,0,1,2\n")
    tables = results.read_results(spark, str(tmp_path), ["Q", "V"], {"q": ["b"]})
    assert {r[0] for r in tables["Q"].select("Chan ID").collect()} == {"b"} and tables["V"].count() == 2
