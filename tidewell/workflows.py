"""From result tables to reports: what each report's sheets hold. ``write`` takes any of them to files.

Every workflow takes tables as ``results.read_results`` gives them, so that ``culvert_maximums(read_results(spark, paths))``
goes from paths to a report, and returns its sheets by name; nothing runs before they are written, but for the count by which
``write`` tells whether a sheet fits a spreadsheet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import scenario
from tidewell.operators import columns, combine, ensemble, quality, series
from tidewell.sources import readers, results, sinks

Sheets = dict[str, DataFrame]
RUN = ["internalName", "Chan ID"]
#: Columns that reports begin with, and those that follow the rest of a report's own.
FIRST = ["trim_runcode", "aep_text", "duration_text", "tp_text", "Chan ID", "Time", "Q", "V", "US_h", "DS_h", "US Invert", "DS Invert", "Flags", "Diam_Width", "Height", "Num_barrels", "HW_D", "Length"]
SECOND = ["aep_numeric", "duration_numeric", "tp_numeric", "internalName", "pBlockage", "pSlope"]
#: What peaks are grouped by.
PEAK_KEYS = ["aep_text", "Location", "Type", "trim_runcode"]
#: Thresholds of closures: by 1 up to 10, by 2 up to 100, by 10 up to 2,100.
THRESHOLDS = [float(x) for x in (*range(1, 10), *range(10, 100, 2), *range(100, 2100, 10))]
_PLACES = [*columns.PATH_COLUMNS, "run_tokens"]


def write(sheets: Sheets, folder: str, mode: str = "excel") -> dict[str, list[str]]:
    return sinks.export(sheets, folder, mode)


def _without_places(df: DataFrame) -> DataFrame:
    return df.drop(*_PLACES)


def aligned_geometry(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """The end-of-run culverts, their printed ids replaced by the full ones of the other tables of the run."""
    if "EOF" not in tables:
        return None
    geometry = _without_places(tables["EOF"])
    others = [t.select("internalName", "Chan ID").distinct() for k, t in tables.items() if k in (*results.MAXIMUMS, *results.SERIES)]
    if not others:
        return geometry
    full = combine.union_all(others).distinct().withColumn("_key", scenario.match_key(F.col("Chan ID")))
    keyed = geometry.withColumn("_key", scenario.match_key(F.col("Chan ID")))
    exact = full.select("internalName", "Chan ID", F.lit(True).alias("_exact")).distinct()
    out = keyed.join(combine.resolve_ids(full, ["internalName"], "_key", "Chan ID"), ["internalName", "_key"], "left").join(exact, RUN, "left")
    own = F.when(F.col("_exact").isNull(), F.coalesce("resolved", "Chan ID")).otherwise(F.col("Chan ID"))
    return out.withColumn("Chan ID", own).drop("_key", "resolved", "_exact")


def with_headwater(df: DataFrame) -> DataFrame:
    level = "US_h" if "US_h" in df.columns else "US_H"
    if {level, "US Invert", "Height"} - set(df.columns):
        return df
    return df.withColumn("HW_D", combine.headwater_ratio(F.col(level), F.col("US Invert"), F.col("Height")))


def culvert_maximums(tables: Mapping[str, DataFrame]) -> Sheets:
    """Maxima by run and channel over the end-of-run geometry, and all rows of all tables."""
    parts = [_without_places(tables[k]).drop("Time") for k in results.MAXIMUMS if k in tables]
    geometry = aligned_geometry(tables)
    raw = columns.paths_last(combine.union_all([t for k, t in tables.items() if k in (*results.MAXIMUMS, "EOF")]).drop("run_tokens"))
    maxima = combine.combine_maximums(parts, geometry, *RUN) if parts else geometry.limit(0)
    return {"Maximums": columns.reordered(with_headwater(maxima), FIRST, ["R"], SECOND), "raw_data": raw}


def culvert_series(tables: Mapping[str, DataFrame]) -> Sheets:
    """Series by run, channel and time with the run's static data: the end-of-run values, and the channel table's where null."""
    parts = [_without_places(tables[k]) for k in results.SERIES if k in tables]
    geometry, static = aligned_geometry(tables), None
    if "Chan" in tables:
        static = _without_places(tables["Chan"]) if geometry is None else combine.overlay(_without_places(tables["Chan"]), geometry, RUN)
    static = geometry if static is None else static
    merged = combine.max_of_columns(combine.union_all(parts), [*RUN, "Time"])
    if static is not None:
        merged = combine.add_static(merged, static, RUN)
    return {"1d_timeseries_data": columns.reordered(with_headwater(merged), FIRST, ["R"], SECOND)}


def po_combine(tables: Mapping[str, DataFrame]) -> Sheets:
    return {"combined_PO": columns.sorted_by(columns.paths_last(tables["PO"].drop("run_tokens")), ["internalName", "Location", "Type", "Time"])}


def pomm_combine(tables: Mapping[str, DataFrame]) -> Sheets:
    """Peaks of all kinds: where a table has channels or flows only, these stand for location and peak."""
    return {"combined_POMM": columns.paths_last(peaks(tables).drop("run_tokens"))}


def peaks(tables: Mapping[str, DataFrame]) -> DataFrame:
    both = combine.union_all([tables[k] for k in ("POMM", "RLL_Qmx") if k in tables])
    fill = {"Location": [F.col("Chan ID")], "AbsMax": [F.col("Q")], "Type": [F.lit("Q")]}
    sources = [c for c in ("Chan ID", "Q") if c not in both.columns]
    both = both.withColumns({c: F.lit(None).cast("string" if c == "Chan ID" else "double") for c in sources})
    return both.withColumns({c: F.coalesce(F.col(c), *v) if c in both.columns else F.coalesce(*v) for c, v in fill.items()}).drop(*sources)


def peak_report(pomm: DataFrame, statistic: str = "max", include_all: bool = True, value: str = "AbsMax") -> Sheets:
    """Peaks (max), medians or means of ensembles by duration, and over durations."""
    if statistic == "max":
        by_duration = ensemble.peak_by_group(pomm.drop("run_tokens"), PEAK_KEYS, "duration_text", value, ["tp_text", "internalName"])
        sheets = {"aep-dur-max": by_duration, "aep-max": ensemble.peak_of_peaks(by_duration, PEAK_KEYS, value, ["duration_text"])}
    else:
        medians = ensemble.median_by_group(pomm, PEAK_KEYS, "duration_text", value, "tp_text", "internalName")
        if statistic == "median":
            over = ensemble.median_max(medians, PEAK_KEYS, "duration_text")
            sheets = {"aep-dur-max": columns.without_columns(medians, ["mean"]), "aep-max": columns.without_columns(over, ["mean"])}
        else:
            means = ensemble.mean_by_group(medians, PEAK_KEYS, "duration_text")
            over = ensemble.mean_max(means, PEAK_KEYS, "duration_text")
            sheets = {"aep-dur-mean": columns.without_columns(means, ["median"]), "aep-mean-max": columns.without_columns(over, ["median"])}
    return sheets | ({"POMM": columns.paths_last(pomm.drop("run_tokens"))} if include_all else {})


def report_facts(spark: SparkSession, sheets: Sheets, facts: Mapping[str, str] | None = None) -> DataFrame:
    """(name, value): given facts, the rows of each sheet, and the folders that they are from."""
    rows = [spark.createDataFrame(list((facts or {}).items()), "name string, value string")] if facts else []
    for name, df in sheets.items():
        rows.append(df.agg(F.count("*").cast("string").alias("value")).select(F.lit(f"{name} rows").alias("name"), "value"))
        if "directory_path" in df.columns:
            folders = df.agg(F.array_join(F.array_sort(F.collect_set("directory_path")), "\n").alias("value"))
            rows.append(folders.filter("value <> ''").select(F.lit("Source directories").alias("name"), "value"))
    return combine.union_all(rows).distinct()


#: Columns that culvert statistics are taken of, and which of them chooses the run.
STATISTIC_COLUMNS, ADOPTED = ["Q", "V", "US_h", "DS_h"], ["Q", "US_h", "V", "DS_h"]


def culvert_statistics(maximums: DataFrame, statistic: str = "mean", keys: Sequence[str] = ("trim_runcode", "aep_text", "Chan ID"), include_all: bool = True) -> Sheets:
    """Mean or median of culverts' maxima by duration, and the duration with the largest."""
    have = [c for c in STATISTIC_COLUMNS if c in maximums.columns]
    adopt = ensemble.preferred_column(have, ADOPTED)
    group = [*keys, "duration_text"]
    plain = maximums.withColumnRenamed("Chan ID", "channel")
    keys, group = ([("channel" if k == "Chan ID" else k) for k in x] for x in (keys, group))
    by_duration = ensemble.statistic_of_columns(plain, group, have, statistic, adopt, "internalName")
    over = ensemble.critical_duration(by_duration, keys, "duration_text", f"{adopt}_{statistic}")
    name = {"mean": "mean", "median": "median"}[statistic]
    sheets = {f"aep-dur-{name}": by_duration, f"aep-{name}-max": over} | ({"culvert-maximums": plain} if include_all else {})
    return {k: columns.sorted_by(df, keys).withColumnRenamed("channel", "Chan ID") for k, df in sheets.items()}


CLOSURE_KEYS = ["directory_path", "trim_runcode", "Location", "aep_text", "duration_text", "tp_text"]


def closure_durations(po: DataFrame, thresholds: Sequence[float] = THRESHOLDS, data_type: str = "Flow", zero_fill: bool = False) -> Sheets:
    """How long each series is above each threshold, and the critical duration of each threshold."""
    own = po.filter(F.lower(F.trim("Type")) == data_type.lower()).filter(F.col("Location").isNotNull())
    lasting = series.exceedance_durations(own.select(*CLOSURE_KEYS, "Time", "Value"), CLOSURE_KEYS, "Time", "Value", thresholds)
    return _closures(lasting, ["directory_path", "trim_runcode", "Location", "aep_text"], "aep_text", "duration_text", "tp_text", zero_fill)


def _closures(lasting: DataFrame, keys: list[str], aep: str, duration: str, tp: str, zero_fill: bool) -> Sheets:
    summary = series.closure_summary(lasting, keys, duration, tp, "duration_exceeding", zero_fill)
    by = [*[k for k in keys if k != aep], "threshold", columns.number_in(F.col(aep))]
    return {"Duration_Exceedance": lasting, "Duration_Summary": columns.sorted_by(summary, by)}


def hydrologic_closure_durations(batch_lines: DataFrame, hydrograph_lines: DataFrame, thresholds: Sequence[float] = THRESHOLDS, zero_fill: bool = True) -> Sheets:
    """The same of hydrologic runs: a batch report names runs, whose hydrographs lie beside it under names of their own."""
    runs = readers.batch_runs(batch_lines)
    place = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    aep, hours = F.concat("aep", F.lit("%")), F.concat(scenario.trimmed_number(F.col("duration_hours")), F.lit("hour"))
    runs = runs.select(place.alias("directory_path"), aep.alias("aep_text"), hours.alias("duration_text"), F.col("tp").cast("string").alias("tp_text"))
    runs = runs.withColumn("csv", scenario.csv_path(F.col("directory_path"), F.regexp_replace("aep_text", "%", ""), F.col("duration_text"), F.col("tp_text"))).distinct()
    flows = readers.hydrograph(hydrograph_lines).withColumnRenamed("path", "csv").join(runs, "csv")
    keys = ["directory_path", "location", "aep_text", "duration_text", "tp_text"]
    lasting = series.exceedance_durations(flows, keys, "time", "value", thresholds)
    return _closures(lasting, ["directory_path", "location", "aep_text"], "aep_text", "duration_text", "tp_text", zero_fill)


def critical_series(spark: SparkSession, cache: str, values: DataFrame, keys: Sequence[str] = ("trim_runcode", "aep_text", "Chan ID"), duration: str = "duration_text", value: str = "Q") -> DataFrame:
    """The series of the critical runs: of each group the run closest to the mean of its largest duration, from a cache of
    series that lies in folders by run (``sinks.write_cache`` by internalName). Only these runs' folders are read."""
    chosen = ensemble.critical_runs(values.withColumnRenamed("Chan ID", "channel"), ["channel" if k == "Chan ID" else k for k in keys], duration, value, "internalName")
    chosen = chosen.select(F.col("critical_name").alias("internalName"), F.col("channel").alias("Chan ID"))
    return sinks.read_chosen(spark, cache, chosen, "internalName", ["Chan ID"])


def crossing_project(crossings: DataFrame, title: str, designer: str = "", notes: str = "", by: Sequence[str] = ()) -> DataFrame:
    """A project's record with its crossings (name, crossing) in order of their names; one for each group of ``by``, as a run's."""
    own = crossings.filter(F.col("crossing").isNotNull())
    listed = own.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("name", "crossing"))).alias("crossings"))
    return listed.select(*by, F.lit(title).alias("title"), F.lit(designer).alias("designer"), F.lit(notes).alias("notes"), F.size("crossings").alias("n_crossings"), "crossings")


def stability_report(tables: Mapping[str, DataFrame], kinds: Sequence[str] = ("PO", "Q"), **limits: float) -> Sheets:
    """Status of every series, and those that are unstable."""
    parts = []
    if "PO" in kinds and "PO" in tables:
        parts.append(tables["PO"].select("internalName", F.lit("PO").alias("source"), "Type", "Location", "Time", "Value"))
    if "Q" in kinds and "Q" in tables:
        parts.append(tables["Q"].select("internalName", F.lit("Q").alias("source"), F.lit("Q").alias("Type"), F.col("Chan ID").alias("Location"), "Time", F.col("Q").alias("Value")))
    checked = series.stability_check(combine.union_all(parts), ["internalName", "source", "Type", "Location"], ["Time"], "Value", **limits)
    return {"all": checked, "unstable": checked.filter("status = 'UNSTABLE'")}


def peak_check_report(po: DataFrame, include: Sequence[str] = ("Flow", "H", "Q", "V"), locations: Sequence[str] = (), excluded: Sequence[str] = (), **limits: float) -> Sheets:
    """Series of the wanted types whose peak is late, and all of them with what their run's name tells."""
    own = po.filter(quality.allowed(F.col("Type"), include, empty_allows=False) & quality.allowed(F.col("Location"), locations, excluded))
    keys = ["internalName", "trim_runcode", "aep_text", "duration_text", "tp_text", "Type", "Location"]
    checked = series.peak_check(own, keys, ["Time"], "Time", "Value", **limits)
    return {"all": checked, "warnings": checked.filter(F.col("status").startswith("WARN"))}


def log_report(logs: DataFrame) -> Sheets:
    """A row for each complete run, the latest first, and its settings one by one."""
    each = logs.select("internalName", F.explode("settings").alias("setting", "value"))
    return {"Log_Summary": columns.sorted_by(logs.drop("settings", "run_tokens"), ["start"], descending=True), "settings": each}


def missing_runs_report(runs: DataFrame, count: int = 10) -> Sheets:
    """Ensembles' missing members by run, event and duration, and the grid of what is there."""
    own = columns.first_present(runs, {"trim_run_code": ["trim_runcode", "trim code", "trimcode", "trim"], "aep": ["aep_text"], "duration": ["duration_text"], "tp": ["tp_text"]})
    own = own.withColumn("tp", scenario.member_label(F.col("tp"), count))
    keys = ["trim_run_code", "aep", "duration"]
    return {"missing": quality.missing_members(own, keys, "tp", count), "coverage": quality.coverage_grid(own, *keys, "tp", count)}
