"""Polygons, dictionaries, columns that data name, duplicate files and chosen runs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell import workflows
from tidewell.operators import combine, dictionary, polygons
from tidewell.sources import files, sinks


def shape(spark, named):
    return spark.createDataFrame([(k, [(float(x), float(y)) for x, y in v]) for k, v in named.items()], f"k string, v array<{polygons.POINT}>")


def inside(x, y, v):
    hit = False
    for (ax, ay), (bx, by) in zip(v, [*v[1:], v[0]], strict=True):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            hit = not hit
    return hit


SHAPES = {
    "square": [(0, 0), (4, 0), (4, 4), (0, 4)], "triangle": [(1, 1), (9, 2), (3, 8)], "arrow": [(0, 0), (6, 3), (0, 6), (2, 3)], "sliver": [(-3, -1), (7, -0.9), (7, -0.8)],
    "comb": [(0, 10), (0, 16), (1, 16), (1, 11), (2, 11), (2, 16), (3, 16), (3, 10)], "backwards": [(-5, 5), (-5, 9), (-1, 9), (-1, 5)],
}


@pytest.mark.parametrize("size", [0.7, 2.0, 50.0])
def test_points_in_polygons(spark, size):
    rnd = random.Random(1)
    points = [(i, rnd.choice([rnd.uniform(-6, 10), float(rnd.randint(-6, 10))]), rnd.choice([rnd.uniform(-2, 17), float(rnd.randint(-2, 17))])) for i in range(600)]
    points += [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate(p for v in SHAPES.values() for p in v)]
    got = polygons.points_in_polygons(spark.createDataFrame(points, "n long, x double, y double"), shape(spark, SHAPES), "x", "y", "k", "v", size)
    assert sorted((r["n"], r["k"]) for r in got.collect()) == sorted((n, k) for n, x, y in points for k, v in SHAPES.items() if inside(x, y, v))


@pytest.mark.parametrize("size", [0.7, 3.0])
def test_cell_areas_add_up(spark, size):
    got = polygons.cell_areas(shape(spark, SHAPES), "k", "v", size)
    sums = {r["k"]: r["a"] for r in got.groupBy("k").agg(F.sum("area").alias("a")).collect()}
    for k, v in SHAPES.items():
        whole = abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(v, [*v[1:], v[0]], strict=True))) / 2
        assert sums[k] == pytest.approx(whole, rel=1e-9), k
    assert got.filter(F.col("area") > size * size * (1 + 1e-9)).count() == 0


def test_area_means(spark):
    grid = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(4) for j in range(4)], "i long, j long, value double")
    got = {r["k"]: (r["area"], r["mean"]) for r in polygons.area_means(grid, shape(spark, {"a": [(0, 0), (2, 0), (2, 1), (0, 1)], "b": [(0.5, 0), (1.5, 0), (1.5, 1), (0.5, 1)], "c": [(3, 3), (9, 3), (9, 4), (3, 4)]}), "k", "v", 1.0, "value").collect()}
    assert got == {"a": (2.0, 5.0), "b": (1.0, 5.0), "c": (1.0, 33.0)}


@pytest.mark.parametrize("prefix", ["", "R/same/start/é"])
def test_codes_are_in_the_order_of_the_text(spark, prefix):
    rnd = random.Random(2)
    values = [prefix + "".join(rnd.choice("abzAZ_é\U0001f6000") for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "s string")
    codes = dictionary.ordered_codes(df, "s")
    order = sorted(set(values), key=lambda v: v.encode())
    assert {r["value"]: r["code"] for r in codes.collect()} == {v: i for i, v in enumerate(order)}
    named = dictionary.ordered_codes(df, "s", "(none)")
    assert named.count() == len(order) + 1
    got = dictionary.encoded(df, "s", codes, "c").collect()
    assert all(r["c"] == (-1 if r["s"] is None else order.index(r["s"])) for r in got) and len(got) == 401
    new = spark.createDataFrame([("0first",), (prefix + "~last",), (order[0],)], "s string")
    every, mapping = dictionary.merged(codes, new, "s")
    again = sorted({*order, "0first", prefix + "~last"}, key=lambda v: v.encode())
    assert {r["value"]: r["code"] for r in every.collect()} == {v: i for i, v in enumerate(again)}
    renewed = dictionary.renewed(dictionary.encoded(df, "s", codes, "c"), "c", mapping).collect()
    assert all(r["c"] == (-1 if r["s"] is None else again.index(r["s"])) for r in renewed)


def test_codes_of_one_value_and_of_none(spark):
    assert [tuple(r) for r in dictionary.ordered_codes(spark.createDataFrame([("x",)] * 3, "s string"), "s").collect()] == [("x", 0)]
    assert dictionary.ordered_codes(spark.createDataFrame([(None,)], "s string"), "s").collect() == []


def test_columns_that_data_name(spark):
    df = spark.createDataFrame([("a", ["x", "y", "z"], {"aep": "1p", "k": "clash"}), ("b", ["w"], {"tp": "TP01"})], "k string, t array<string>, m map<string,string>")
    wide = dictionary.token_columns(df, "t")
    assert wide.columns[3:] == ["R01", "R02", "R03"] and sorted((r["R01"], r["R03"]) for r in wide.collect()) == [("w", None), ("x", "z")]
    with pytest.raises(ValueError, match="3 places"):
        dictionary.token_columns(df, "t", limit=2)
    flat = dictionary.flattened(df, "m")
    assert flat.columns == ["k", "t", "aep", "k_meta", "tp"] and sorted((r["k"], r["aep"], r["k_meta"], r["tp"]) for r in flat.collect()) == [("a", "1p", "clash", None), ("b", None, None, "TP01")]
    with pytest.raises(ValueError, match="more than 2 keys"):
        dictionary.flattened(df, "m", limit=2)
    with pytest.raises(ValueError, match="k_meta"):
        dictionary.flattened(df.withColumn("k_meta", F.lit(1)), "m")


def test_duplicate_files_in_stages(spark, tmp_path, monkeypatch):
    one, two = tmp_path / "one", tmp_path / "two"
    for d in (one, two):
        d.mkdir()
    long = b"h" * files.EDGE + b"middle" + b"t" * files.EDGE
    for path, content in {one / "a.tif": b"same", one / "B.tif": b"same", two / "a.tif": b"same", two / "c.tif": b"same", one / "d.tif": b"diff", one / "a.csv": b"same", one / "l1.flt": long, two / "l2.flt": long, two / "l3.flt": long.replace(b"middle", b"muddle"), one / "e.tif": b""}.items():
        path.write_bytes(content)
    listing = files.find_files(spark, [str(tmp_path)])
    short = lambda p: p.split(str(tmp_path) + "/")[1]
    got = sorted((r["action"], short(r["path"]), short(r["keep"]), [short(f) for f in r["files"]]) for r in files.duplicate_actions(listing).collect())
    assert got == [
        ("delete", "one/B.tif", "one/a.tif", []), ("delete", "two/a.tif", "one/a.tif", []), ("delete", "two/c.tif", "one/a.tif", []), ("delete", "two/l2.flt", "one/l1.flt", []),
        ("placeholder", "two/a.tif.DUPLICATE_REMOVED.txt", "one/a.tif", ["two/a.tif", "two/c.tif"]), ("placeholder", "two/l2.flt.DUPLICATE_REMOVED.txt", "one/l1.flt", ["two/l2.flt"]),
    ]
    own = sorted((r["action"], short(r["path"])) for r in files.duplicate_actions(listing, across=False).collect())
    assert own == [("delete", "one/B.tif"), ("delete", "two/c.tif")]


def test_only_chosen_runs_are_read(spark, tmp_path, monkeypatch):
    series = [(f"R{r}", "C1", float(t), float(r * 10 + t)) for r in range(8) for t in range(3)] + [("R3", "C2", 0.0, 1.0)]
    sinks.write_cache(spark.createDataFrame(series, "internalName string, `Chan ID` string, Time double, Q double"), str(tmp_path / "cache"), ["internalName"])
    peaks = [("base", "1p", "C1", d, f"R{r}", float(q)) for d, r, q in (("60m", 0, 1), ("60m", 1, 3), ("120m", 2, 10), ("120m", 3, 14), ("120m", 4, 30))]
    values = spark.createDataFrame(peaks, "trim_runcode string, aep_text string, `Chan ID` string, duration_text string, internalName string, Q double")
    values.write.parquet(str(tmp_path / "peaks"))
    got = workflows.critical_series(spark, str(tmp_path / "cache"), spark.read.parquet(str(tmp_path / "peaks")))
    assert sorted((r["internalName"], r["Chan ID"], r["Time"]) for r in got.collect()) == [("R3", "C1", 0.0), ("R3", "C1", 1.0), ("R3", "C1", 2.0)]
    assert re.search(r"PartitionFilters: \[[^\]]*internalName#\d+ (= R3|IN \(R3\))", got._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(sinks, "CHOSEN", 0)
    assert workflows.critical_series(spark, str(tmp_path / "cache"), spark.read.parquet(str(tmp_path / "peaks"))).count() == 3


@pytest.mark.parametrize("spread", [0.5, 5.0, 60.0])
def test_nearest_points(spark, spread):
    rnd = random.Random(3)
    draw = lambda n, first: [(first + i, round(rnd.gauss(0, spread), 2), round(rnd.gauss(0, spread), 2)) for i in range(n)]
    left, right = draw(150, 0), draw(200, 1000)
    right += [(2000 + i, x, y) for i, (_, x, y) in enumerate(right[:20])]  # equal places
    got = combine.nearest(spark.createDataFrame(left, "l long, x double, y double"), spark.createDataFrame(right, "r long, x double, y double"), "l", "r", "x", "y", 3.0)
    want = {}
    for n, x, y in left:
        near = min(((x - u) * (x - u) + (y - v) * (y - v), r) for r, u, v in right)
        if near[0] <= 9.0:
            want[n] = near[1]
    assert {r["l"]: r["r"] for r in got.collect()} == want
