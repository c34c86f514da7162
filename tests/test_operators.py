"""Hand-computed cases of the operators."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import hydro, scenario
from tidewell.operators import combine, ensemble, quality, reshape, series


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_peaks_count_members_and_durations(spark):
    df = spark.createDataFrame([("1%", "1h", "TP01", 10.0), ("1%", "1h", "TP02", 20.0), ("1%", "2h", "TP01", 15.0), ("2%", "1h", "TP01", 5.0), (None, "1h", "TP01", 99.0)], "aep string, dur string, tp string, v double")
    peaks = ensemble.peak_by_group(df, ["aep"], "dur", "v", ["tp"])
    assert rows(peaks, "aep", "dur", "tp", "v", "count_tp", "count_tp_aep", "count_duration") == [("1%", "1h", "TP02", 20.0, 2, 5, 3), ("1%", "2h", "TP01", 15.0, 1, 5, 3), ("2%", "1h", "TP01", 5.0, 1, 1, 1)]
    assert rows(ensemble.peak_of_peaks(peaks, ["aep"], "v", ["dur"]), "aep", "v", "count_tp_aep") == [("1%", 20.0, 2), ("2%", 5.0, 1)]


@pytest.mark.parametrize(
    ("values", "median", "closest"), [([1.0, 2.0, 3.0], 2.0, 2.0), ([4.0, 1.0, 3.0, 2.0], 3.0, 2.0), ([None, 1.0], 1.0, 1.0), ([None, None], None, None)]
)
def test_upper_middle_and_closest_to_mean(spark, values, median, closest):
    df = spark.createDataFrame([("g", f"TP{i}", f"n{i}", v) for i, v in enumerate(values)], "g string, tp string, name string, v double")
    r = ensemble.ensemble_statistics(df, ["g"], "v", "tp", "name").first()
    assert (r["median"], r["mean_peak"], r["count_tp"]) == (median, closest, len(values))


def test_mean_without_zeroes_of_zeroes_is_null(spark):
    df = spark.createDataFrame([("g", "a", "a", 0.0), ("g", "b", "b", 0.0)], "g string, tp string, name string, v double")
    r = ensemble.ensemble_statistics(df, ["g"], "v", "tp", "name").first()
    assert r["mean_excluding_zeroes"] is None and r["mean_including_zeroes"] == 0


def test_critical_duration_ties_are_settled_as_text(spark):
    data = [("g", d, f"t{i}", f"n{i}", v) for d, vs in (("5", [1.0, 6.0, 3.0]), ("10", [3.0, 6.0, 1.0])) for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "g string, dur string, tp string, name string, v double")
    r = ensemble.critical_median(df, ["g"], "dur", "v", "tp", "name").first()
    assert (r["dur"], r["median"], r["count_all"], r["count_duration"], r["low_all"], r["high_all"]) == ("10", 3.0, 6, 2, 1.0, 6.0)


def test_nan_becomes_null(spark):
    df = ensemble.nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "a double, b int"))
    assert rows(df, "a", "b") == [(2.0, 2), (None, 1)]


def test_exceedance_both_ways(spark):
    df = spark.createDataFrame([("a", t * 0.5, v) for t, v in enumerate([0.0, 5.0, 10.0, 20.0])] + [("b", 0.0, 50.0)], "k string, t double, v double")
    for f in (series.exceedance_durations, series.exceedance_durations_plain):
        assert rows(f(df, ["k"], "t", "v", [5.0, 10.0, 30.0]), "k", "threshold", "duration_exceeding") == [("a", 10.0, 0.5), ("a", 5.0, 1.0)]


def test_exceedance_leaves_unknown_values_out_and_keeps_null_keys(spark):
    data = [(None, 0.0, 9.0), (None, 1.0, None), (None, 4.0, 9.0), ("a", None, 9.0), ("a", 0.0, 9.0), ("a", 2.0, 1.0)]
    df = spark.createDataFrame(data, "k string, t double, v double")
    for f in (series.exceedance_durations, series.exceedance_durations_plain):
        got = [tuple(r) for r in f(df, ["k"], "t", "v", [5.0]).select("k", "n_above", "step", "duration_exceeding").collect()]
        assert sorted(got, key=str) == [("a", 1, 2.0, 2.0), (None, 2, 4.0, 8.0)]


def test_crossing_records(spark):
    lit = F.lit
    one = lambda *a, **k: spark.range(1).select(hydro.crossing(*a, **k).alias("x")).first()["x"]
    x = one(lit(2.0), lit(10.0), lit(9.5), lit(1.2), lit(10.4), lit("c"), lit(20.0), lit(2.3), us_level=lit(11.6), us_obvert=lit(0.0), ds_obvert=lit(10.7))
    assert [round(v, 6) for v in x["flow"]] == [1.8, 2.0, 2.2] and tuple(x["tailwater"]) == (10.4, 9.5)
    assert x["roadway"]["width"] == pytest.approx(7.2) and x["roadway"]["elevations"][0] == pytest.approx(12.1)
    assert (x["barrel"]["shape"], x["barrel"]["material"], x["barrel"]["barrels"]) == ("CIRCLE", "CORRUGATED_STEEL", 2)
    y = one(lit(0.001), lit(1.0), lit(1.0), lit(0.3), lit(0.5), lit(None).cast("string"), lit(None).cast("double"), lit(9.0), channel=lit("A_1_R"))
    assert [round(v, 6) for v in y["flow"]] == [0.005, 0.01, 0.015] and y["tailwater"]["invert"] == pytest.approx(0.45) and y["roadway"]["width"] == 5.0
    assert (y["barrel"]["shape"], y["barrel"]["material"], y["barrel"]["barrels"], y["barrel"]["length"]) == ("BOX", "CONCRETE", 1, 0.0)
    assert one(lit(0.0), lit(1.0), lit(1.0), lit(0.3), lit(0.5), lit("C"), lit(1.0), lit(1.0)) is None


def test_static_columns_of_several_rows_are_the_least(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    static = spark.createDataFrame([("a", 5, "y"), ("a", 3, "z"), ("a", 3, "q")], "k string, size int, kind string")
    assert rows(combine.add_static(df, static, ["k"]), "k", "v", "size", "kind") == [("a", 1.0, 3, "q"), ("b", 2.0, None, None)]
    target = df.withColumn("size", F.lit(9))
    assert rows(combine.update_attributes(target, static, ["k"]), "k", "size", "matched") == [("a", 3, True), ("b", 9, False)]


def test_closure_summary_fills_zeroes_only_if_asked(spark):
    df = spark.createDataFrame([("x", "1", "A", 5.0, 4.0), ("x", "1", "B", 5.0, 2.0), ("x", "1", "A", 9.0, 1.0)], "k string, dur string, tp string, threshold double, hours double")
    plain = rows(series.closure_summary(df, ["k"], "dur", "tp", "hours", False), "threshold", "central_value", "low_value")
    filled = rows(series.closure_summary(df, ["k"], "dur", "tp", "hours", True), "threshold", "central_value", "low_value")
    assert plain == [(5.0, 4.0, 2.0), (9.0, 1.0, 1.0)] and filled == [(5.0, 4.0, 2.0), (9.0, 1.0, 0.0)]


def test_stability_ladder(spark):
    data = {"none": [None], "few": [1.0, 2.0], "flat": [1.0, 1.0, 1.0], "ok": [0.0, 1.0, 2.0, 1.0], "wild": [0.0, 5.0] * 8}
    df = spark.createDataFrame([(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)], "k string, i int, v double")
    got = dict(rows(series.stability_check(df, ["k"], ["i"], "v"), "k", "status"))
    assert got == {"none": "NO_DATA", "few": "INSUFFICIENT_POINTS", "flat": "FLAT", "ok": "OK", "wild": "UNSTABLE"}


def test_peak_check_warns_of_late_peaks(spark):
    data = {"late": [0.0, 1.0, 2.0, 3.0], "hour": [0.0, 9.0, 1.0], "early": [0.0, -9.0, 1.0, 0.0], "flat": [1.0, 1.0, 1.0], "none": [None, None]}
    df = spark.createDataFrame([(k, float(i), v) for k, vs in data.items() for i, v in enumerate(vs)], "k string, t double, v double")
    got = rows(series.peak_check(df, ["k"], ["t"], "t", "v"), "k", "peak_kind", "peak_above_start", "end_minus_start", "hours_from_end", "end_percent_of_peak", "status")
    assert got == [
        ("early", "min", -9.0, 0.0, 2.0, 0.0, "OK"), ("flat", "flat", 0.0, 0.0, 2.0, 0.0, "OK"), ("hour", "max", 9.0, 1.0, 1.0, pytest.approx(100 / 9), "WARN_2H"),
        ("late", "max", 3.0, 3.0, 0.0, 100.0, "WARN_1H"), ("none", None, None, None, None, None, "NO_DATA"),
    ]


def test_overlay_prefers_the_right_side(spark):
    left = spark.createDataFrame([("C1", 1.0), ("C2", 2.0)], "id string, v double")
    right = spark.createDataFrame([("C1", 10.0, 99.0), ("C3", None, 5.0)], "id string, v double, extra double")
    assert rows(combine.overlay(left, right, ["id"]), "id", "v", "extra") == [("C1", 10.0, 99.0), ("C2", 2.0, None), ("C3", None, 5.0)]


def test_geometry_alone_needs_some_maximum(spark):
    maxima = spark.createDataFrame([("R2", "C", 1.0)], "run string, id string, q double")
    geometry = spark.createDataFrame([("R1", "C", 7.0)], "run string, id string, invert double")
    assert combine.combine_maximums([maxima], geometry, "run", "id").count() == 2
    assert combine.combine_maximums([maxima.limit(0)], geometry, "run", "id").count() == 0


def test_ambiguous_ids_stay(spark):
    full = spark.createDataFrame([("r", "K1", "FC04.123"), ("r", "K2", "A"), ("r", "K2", "B")], "run string, k string, id string")
    cut = spark.createDataFrame([("r", "K1", "FC04.12"), ("r", "K2", "x")], "run string, k string, id string")
    assert rows(combine.align_ids(cut, full, ["run"], "k", "id"), "k", "id") == [("K1", "FC04.123"), ("K2", "x")]


def test_headwater_ratio(spark):
    df = spark.createDataFrame([(12.0, 10.0, 2.0), (12.0, 10.0, 0.0), (None, 10.0, 2.0)], "h double, i double, d double")
    assert [r[0] for r in df.select(combine.headwater_ratio(F.col("h"), F.col("i"), F.col("d"))).collect()] == [1.0, None, None]


def test_missing_members_need_a_complete_set(spark):
    full = [("r", "1%", f"TP{i:02d}") for i in range(1, 11)]
    df = spark.createDataFrame(full + [("r", "2%", f"TP{i:02d}") for i in range(1, 10)], "run string, aep string, tp string")
    assert rows(quality.missing_members(df, ["run", "aep"], "tp"), "aep", "missing_tp") == [("2%", "TP10")]
    assert quality.missing_members(df.filter("aep = '2%'"), ["run", "aep"], "tp").count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(" A ", 1), ("b", 2)], "Location string, n int")
    assert quality.entity_filter(df, ["A"]).count() == 1
    assert quality.entity_filter(df.withColumnRenamed("Location", "other"), ["A"]).count() == 2
    assert df.filter(quality.allowed(F.col("Location"), [], empty_allows=False)).count() == 0
    assert df.filter(quality.allowed(F.col("Location"), [], ["B"])).count() == 1
    assert quality.header_status(["a"], ["a", "b"]) == "FAILURE" and quality.header_status(["b", "a"], ["a", "b"], True) == "HEADER_MISMATCH"


def test_suffix_pivot_drops_other_suffixes(spark):
    df = spark.createDataFrame([(1.0, "C1.1", 10.0), (1.0, "C1.2", 9.0), (1.0, "C1.3", 8.0), (1.0, "a.b.1", 3.0)], "t double, node string, h double")
    assert rows(reshape.suffix_pivot(df, ["t"], "node", "h", {"1": "us", "2": "ds"}), "entity", "us", "ds") == [("C1", 10.0, 9.0), ("a.b", 3.0, None)]


def test_tiles_are_half_open(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (0.5, 1.5), (1.5, 1.5)], "x double, y double")
    assert rows(reshape.tiles(df, "x", "y", 1.0), "tile_i", "tile_j") == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_polygon_edge_is_inside(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 1.0)], "x double, y double")
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert [r[0] for r in df.select(reshape.in_polygon(F.col("x"), F.col("y"), square)).collect()] == [True, True, True, False]


def test_names(spark):
    df = spark.createDataFrame([("R01_TP12_2.0p_120m_POMM.csv",), ("M_PMPF_1.5hours+tp3_1d_Q.CSV",), ("plain.txt",)], "n string")
    code = scenario.run_code(F.col("n"))
    got = df.select(scenario.data_type(F.col("n")), scenario.tp_text(code), scenario.aep_text(code), scenario.duration_text(code), scenario.trim_code(code)).collect()
    assert tuple(got[0]) == ("POMM", "TP12", "2.0p", "120m", "R01")
    assert tuple(got[1]) == ("Q", "TP03", "PMPF", "1.5hours", "M")
    assert tuple(got[2]) == (None, None, None, None, "plain.txt")


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(scenario.dms_to_degrees(F.lit("45°30'0\""))) == 45.5 and get(scenario.dms_to_degrees(F.lit("x"))) == 0.0
    keys = {"fc 04.129_C": None, "fc  04.129": "FC|04.12", "A B 3": "A B|3.00", "A_B3.5": "A_B|3.50", "x-1.239": "X|-1.23", "159.975": "|159.97", "nan": None, " ": None}
    assert {k: get(scenario.match_key(F.lit(k))) for k in keys} == keys
    labels = {"T3": "TP03", "run_TP7_x": "TP07", "tp 12": "TP12", "pattern 4 of it": "TP04", "x": None, "none": None, "123": None}
    assert {k: get(scenario.tp_label(F.lit(k))) for k in labels} == labels
    events = {"M_PMP_1p": "PMP", "M_2.00p_PMPF": "2.00p", "M_1.234p_x": None, "pmpf.csv": "PMPF", "5P": "5p"}
    assert {k: get(scenario.aep_text(F.lit(k))) for k in events} == events
    assert get(scenario.duration_minutes(F.lit("1.5hr"))) == 90.0
    assert get(scenario.clean_text(F.lit(" nan "))) is None
    assert get(scenario.human_bytes(F.lit(1536))) == "1.5 KB"
    assert get(hydro.bearing(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0))) == 270.0
    assert get(hydro.arf(F.lit(0.5), F.lit(60.0), F.lit(0.01), hydro.EAST_COAST_NORTH)) == 1.0
    assert get(hydro.arf(F.lit(40000.0), F.lit(60.0), F.lit(0.01), hydro.EAST_COAST_NORTH)) is None
