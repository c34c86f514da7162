"""Result files by data type: each layout as a tidy table with the scenario that its file's name tells."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import quality, reshape
from tidewell.sources import files, layouts, logs, packed, readers

#: Which tables give maxima, series, geometry.
MAXIMUMS, SERIES, GEOMETRY = ("Cmx", "Nmx", "Chan", "ccA", "RLL_Qmx"), ("Q", "V", "CF", "H"), ("EOF", "Chan")


def _rows(lines: DataFrame, data_type: str) -> DataFrame:
    """A table of the columns and types that its layout names."""
    layout = layouts.LAYOUTS[data_type]
    return readers.maximums(lines, layout.names, layout.texts, layout.optional)[0]


def cmx(lines: DataFrame) -> DataFrame:
    """A row for each channel's largest flow and one for its largest velocity; rows without anything are dropped."""
    out = reshape.stack_metrics(_rows(lines, "Cmx"), ["path", "Chan ID"], {"q": {"Time": "tq", "Q": "q"}, "v": {"Time": "tv", "V": "v"}}, {"Time": "double", "Q": "double", "V": "double"})
    return out.dropna(how="all", subset=["Chan ID", "Time", "Q", "V"])


def nmx(lines: DataFrame) -> DataFrame:
    """The largest levels at a channel's ends, by the time at which they occur; other nodes are dropped."""
    return reshape.suffix_pivot(_rows(lines, "Nmx"), ["path", "Time"], "node", "h", {"1": "US_h", "2": "DS_h"}).withColumnRenamed("entity", "Chan ID")


def chan(lines: DataFrame) -> DataFrame:
    """Channels with their height, from upstream invert to obvert."""
    return _rows(lines, "Chan").drop("row").withColumn("Height", F.col("US Obvert") - F.col("US Invert"))


def rll_qmx(lines: DataFrame) -> DataFrame:
    return _rows(lines, "RLL_Qmx").select("path", "Chan ID", "Time", "Q", "dQ", "Time dQ", "H")


def _series(kind: str, name: str, prefix: str | None = None, text: bool = False) -> Callable[[DataFrame], DataFrame]:
    def read(lines: DataFrame) -> DataFrame:
        rows = readers.time_series(lines, kind, prefix).withColumnsRenamed({"entity": "Chan ID", "time": "Time"})
        value = F.col("value") if text else readers.number(F.col("value"))
        return rows.select("path", "Time", "Chan ID", value.alias(name)).filter(F.col(name).isNotNull())

    return read


def levels(lines: DataFrame) -> DataFrame:
    return readers.levels(lines).withColumnsRenamed({"entity": "Chan ID", "time": "Time", "us_h": "US_h", "ds_h": "DS_h"})


def po(lines: DataFrame) -> DataFrame:
    return readers.point_output(lines).withColumnsRenamed({"time": "Time", "location": "Location", "type": "Type", "value": "Value", "abs_value": "AbsValue"})


def pomm(lines: DataFrame) -> DataFrame:
    return readers.peak_summary(lines).withColumnsRenamed({"type": "Type", "location": "Location", "max": "Max", "min": "Min", "tmax": "Tmax", "tmin": "Tmin", "abs_max": "AbsMax", "signed_abs_max": "SignedAbsMax"})


def eof(lines: DataFrame) -> DataFrame:
    return readers.culvert_section(lines).drop("line")


#: Reader of each data type from lines; channel areas come from binary tables.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "Cmx": cmx, "Nmx": nmx, "Chan": chan, "RLL_Qmx": rll_qmx, "Q": _series("Q", "Q"), "V": _series("V", "V"), "CF": _series("CF", "CF", "F ", text=True), "H": levels,
    "PO": po, "POMM": pomm, "EOF": eof, "TLF": logs.run_summary,
}
#: Fields of channel areas that are numbers.
AREA_FIELDS = ["pFull_Max", "pTime_Full", "Area_Max", "Area_Culv", "Dur_Full", "Dur_10pFull", "Sur_CD", "Dur_Sur", "pTime_Sur", "TFirst_Sur"]


def channel_areas(cells: DataFrame) -> DataFrame:
    """(path, Chan ID, areas and durations) of (path, row, field, value)."""
    wide = reshape.transpose(cells, ["path"], "row", "field", "value", ["Chan ID", *AREA_FIELDS])
    return wide.select("path", "Chan ID", *[readers.number(F.col(c)).alias(c) for c in AREA_FIELDS])


def normalised_types(requested: Iterable[str] | None, accepted: Sequence[str]) -> tuple[list[str], list[str]]:
    """(types that are accepted, each once in the order asked for; others). Nothing asked for means all."""
    wanted = list(dict.fromkeys(requested or accepted))
    return [t for t in wanted if t in accepted], [t for t in wanted if t not in accepted]


def normalised_locations(locations: Iterable[str] | None) -> list[str]:
    return list(dict.fromkeys(x.strip() for x in locations or () if x and x.strip()))


def locations_of(locations: Iterable[str] | Mapping[str, Iterable[str]] | None, data_type: str) -> list[str]:
    """The locations wanted of a data type: the same of all, or by type, its name as it is before its name in small letters.

    A type that isn't named keeps all its locations.
    """
    if isinstance(locations, Mapping):
        locations = locations.get(data_type, locations.get(data_type.lower()))
    return normalised_locations([locations] if isinstance(locations, str) else locations)


def tidy(lines: DataFrame, data_type: str, locations: Sequence[str] = ()) -> DataFrame:
    """A data type's table of these lines, filtered by location, with the scenario of each file."""
    return named(quality.entity_filter(READERS[data_type](lines), locations))


def named(df: DataFrame) -> DataFrame:
    """``df`` with what the file's name tells; the run code is the run's ``internalName``."""
    if "run_code" not in df.columns:
        df = files.with_scenario(df.withColumn("file", files.file_name(F.col("path"))), "file").drop("data_type")
    df = df.withColumn("directory_path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    return df.withColumnsRenamed({"run_code": "internalName", "trim_run_code": "trim_runcode"})


def plain_path(path: Column) -> Column:
    """A local file's path in one spelling, whichever reader gives it."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def listing(spark: SparkSession, roots: str | Sequence[str], data_types: Sequence[str] | None = None) -> DataFrame:
    """(path, length, modified, data_type) of the result files under the roots; no contents are read."""
    found = files.find_files(spark, [roots] if isinstance(roots, str) else roots).select(plain_path(F.col("path")).alias("path"), "name", "length", "modified")
    kinds = layouts.by_suffix()
    kind = F.coalesce(*[F.when(F.lower("name").endswith(s.lower()), F.lit(t)) for s, t in kinds.items()])
    out = found.select("path", "length", "modified", kind.alias("data_type")).filter("data_type is not null")
    return out.filter(F.col("data_type").isin(list(data_types))) if data_types else out


def packed_series(long: DataFrame, kind: str) -> DataFrame:
    """A series type's table, as its reader gives it, of rows of the packed source."""
    timed = long.withColumn("Time", readers.number(F.col("time_text"))).filter(F.col("Time").isNotNull())
    value = readers.number(F.col("text"))
    if kind == "PO":
        out = timed.select("path", "Time", F.col("entity").alias("Location"), F.col("measure").alias("Type"), value.alias("Value")).filter(F.col("Value").isNotNull())
        return out.withColumn("AbsValue", F.abs("Value"))
    if kind == "H":
        ends = [F.min(F.when(F.col("measure") == k, value)).alias(n) for k, n in (("1", "US_h"), ("2", "DS_h"))]
        out = timed.filter(F.col("measure").isin("1", "2")).groupBy("path", "Time", F.col("entity").alias("Chan ID")).agg(*ends)
        return out.dropna(how="all", subset=["US_h", "DS_h"])
    out = timed.select("path", "Time", F.col("entity").alias("Chan ID"), (F.col("text") if kind == "CF" else value).alias(kind))
    return out.filter(F.col(kind).isNotNull())


def read_results(spark: SparkSession, paths: str | Sequence[str], data_types: Sequence[str] | None = None, locations: Iterable[str] | Mapping[str, Iterable[str]] | None = None) -> dict[str, DataFrame]:
    """Tables by data type of all result files under the paths. Files that lack what their layout needs give no rows.

    The tree is listed once, when the tables are built, and each type reads the files of the listing: series from the packed
    source, which takes the wanted locations' columns alone, others from lines. Locations may be named by data type.
    """
    kinds, _ = normalised_types(data_types, [*READERS, "ccA"])
    out: dict[str, DataFrame] = {}
    listed: dict[str, list[tuple[str, int, str]]] = {k: [] for k in kinds}
    for r in listing(spark, paths, kinds).orderBy("path").collect():
        listed[r["data_type"]].append((r["path"], r["length"], r["data_type"]))
    for kind, own in listed.items():
        wanted = locations_of(locations, kind)
        if kind in packed.PREFIXES:
            long = packed.series(spark, own, wanted).withColumnRenamed("time", "time_text")
            out[kind] = named(packed_series(long, kind))
            continue
        names = [readers.literal_path(p) for p, _, _ in own]
        if kind == "ccA":
            cells = readers.channel_areas(spark, names) if names else spark.createDataFrame([], "path string, row int, field string, value string")
            out[kind] = named(quality.entity_filter(channel_areas(cells), wanted))
        else:
            lines = readers.read_lines(spark, names) if names else spark.createDataFrame([], "path string, line int, text string")
            out[kind] = tidy(lines, kind, wanted)
    return out
