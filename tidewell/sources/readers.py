"""Readers of simulator text: files become lines or cells, and layouts become relational steps on them.

Each reader takes ``lines`` — (path, line, text), lines counted from 0 — so that files can come from any store; a file
that lacks what the layout needs gives no rows and never fails the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.scenario import dms_to_degrees, found
from tidewell.operators import reshape


def literal_path(path: str) -> str:
    """A file's path as Spark takes it: what would be a pattern is escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_path() -> Column:
    """The path of the file that a row is read from, in the spelling of listings."""
    encoded = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Lines of small text files, each read whole so that lines keep their numbers."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(paths, wholetext=True).select(read_path().alias("path"), F.col("value"))
    return raw.select("path", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line", "text"))


def split_cells(text: Column, separator: str = ",") -> Column:
    """The trimmed cells of a line; quoted cells may hold the separator, and lose their quotes."""
    quoted = F.split(text, separator + r'(?=(?:[^"]*"[^"]*")*[^"]*$)')

    def bare(cell: Column) -> Column:
        own = F.trim(cell)
        return F.when(own.rlike(r'(?s)^".*"$') & (F.length(own) > 1), F.replace(F.substring(own, F.lit(2), F.length(own) - 2), F.lit('""'), F.lit('"'))).otherwise(own)

    return F.when(F.contains(text, F.lit('"')), F.transform(quoted, bare)).otherwise(F.transform(F.split(text, separator), lambda x: F.trim(x)))


def cells(lines: DataFrame, separator: str = ",") -> DataFrame:
    """(path, row, col, value) of delimited lines; blank lines are left out."""
    return lines.filter(F.trim("text") != "").select("path", F.col("line").alias("row"), F.posexplode(split_cells(F.col("text"), separator)).alias("col", "value"))


def headed(lines: DataFrame, heads: int = 1, least: int = 1, separator: str = ",") -> DataFrame:
    """(path, row, place, cells, head_1, ...) of the lines that have ``least`` cells: the first ``heads`` of a file go along
    with each of its lines, so that a table is read in one pass over the files and one shuffle by path."""
    own = lines.filter(F.trim("text") != "").select("path", F.col("line").alias("row"), split_cells(F.col("text"), separator).alias("cells")).filter(F.size("cells") >= least)
    line = Window.partitionBy("path").orderBy("row")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumns({"place": F.row_number().over(line)} | {f"head_{k}": F.nth_value("cells", k).over(so_far) for k in range(1, heads + 1)})


def number(text: Column) -> Column:
    """A double, null for what isn't a number and for NaN."""
    return F.nanvl(text.try_cast("double"), F.lit(None))


def time_series(lines: DataFrame, kind: str, clean: str | None = None) -> DataFrame:
    """(path, time, entity, value) of a wide table: first column dropped, second is time, headers ``kind id [unit]``."""
    prefix = clean if clean is not None else f"{kind} "
    start = "^" + "".join("\\" + x if not x.isalnum() else x for x in prefix)
    label = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*\[[^\]]*\]\s*$", ""), start, ""))
    body = headed(lines, least=2).filter("place > 1").withColumn("time", number(F.get("cells", F.lit(1)))).filter("time is not null")
    each = body.select("path", "time", "head_1", F.posexplode("cells").alias("col", "value")).filter((F.col("col") > 1) & (F.col("col") < F.size("head_1")) & (F.col("value") != ""))
    return each.select("path", "time", label(F.get("head_1", "col")).alias("entity"), "value")


def levels(lines: DataFrame) -> DataFrame:
    """(path, time, entity, us_h, ds_h) of a wide table of levels whose columns end in .1 and .2."""
    long = time_series(lines, "H").withColumn("value", number(F.col("value")))
    out = reshape.suffix_pivot(long.select("path", "time", F.regexp_replace("entity", r" +(\.[^.]*)$", "$1").alias("node"), "value"), ["path", "time"], "node", "value", {"1": "us_h", "2": "ds_h"})
    return out.dropna(how="all", subset=["us_h", "ds_h"])


def place_of(labels: Column, wanted: str) -> Column:
    """The place, from 0, of the first label that is ``wanted`` in any case, after the first column; else null."""
    return F.nullif(F.array_position(F.transform(labels, lambda x, i: (i > 0) & (F.lower(x) == wanted)), F.lit(True)), F.lit(0)) - 1


def point_output(lines: DataFrame) -> DataFrame:
    """(path, time, location, type, value, abs_value) of a table with a row of types above one of locations."""
    body = headed(lines, heads=2, least=2).filter("place > 2")
    at = F.coalesce(place_of(F.col("head_2"), "time"), place_of(F.col("head_1"), "time")).cast("int")
    body = body.withColumn("_at", at).withColumn("time", number(F.get("cells", "_at"))).filter("time is not null")
    each = body.select("path", "time", "head_1", "head_2", "_at", F.posexplode("cells").alias("col", "text"))
    each = each.filter((F.col("col") > 0) & (F.col("col") != F.col("_at")) & (F.col("col") < F.least(F.size("head_1"), F.size("head_2")))).withColumn("value", number(F.col("text"))).filter("value is not null")
    return each.select("path", "time", F.trim(F.get("head_2", "col")).alias("location"), F.get("head_1", "col").alias("type"), "value", F.abs("value").alias("abs_value"))


#: Labels of the transposed summary, in order.
SUMMARY = {
    "Location": "type", "Time": "location", "Maximum (Extracted from Time Series)": "max", "Time of Maximum": "tmax",
    "Minimum (Extracted From Time Series)": "min", "Time of Minimum": "tmin",
}


def peak_summary(lines: DataFrame) -> DataFrame:
    """A row for each series of a transposed summary: a label in each row, a series in each column."""
    rows = headed(lines, heads=0, least=2).filter(F.col("place") <= len(SUMMARY))
    own = rows.groupBy("path").agg(*[F.max(F.when(F.col("place") == k, F.slice("cells", 3, F.size("cells")))).alias(x) for k, x in enumerate(SUMMARY.values(), 1)])
    filled = [F.coalesce(F.col(x), F.array().cast("array<string>")).alias(x) for x in SUMMARY.values()]
    each = own.select("path", *filled).select("path", F.explode(F.arrays_zip(*SUMMARY.values())).alias("s"))
    out = each.select("path", "s.type", "s.location", *[number(F.col(f"s.{x}")).alias(x) for x in ("max", "tmax", "min", "tmin")])
    size, signed = reshape.signed_peak(F.col("max"), F.col("min"))
    return out.withColumns({"abs_max": size, "signed_abs_max": signed})


def maximums(lines: DataFrame, columns: dict[str, str], text: Sequence[str] = (), optional: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, status by path) of a table with a header: ``columns`` names what is read and how it is
    called, ``text`` those called so that stay text.

    A file that lacks a column fails and gives no rows, but for ``optional`` ones, which are null there; what else it
    has is left out.
    """
    needed = F.array(*[F.lit(c) for c in columns if c not in optional])
    own = headed(lines)
    lacks = F.size(F.array_except(needed, "head_1"))
    status = own.groupBy("path").agg(F.max(lacks).alias("_l"), F.count("*").alias("_n"))
    status = status.select("path", F.when(F.col("_l") > 0, "FAILURE").when(F.col("_n") == 1, "EMPTY").otherwise("SUCCESS").alias("status"))
    cell = lambda label: F.nullif(F.get("cells", F.array_position("head_1", F.lit(label)).cast("int") - 1), F.lit(""))
    rows = own.filter((F.col("place") > 1) & (lacks == 0))
    return rows.select("path", "row", *[(cell(k) if v in text else number(cell(k))).alias(v) for k, v in columns.items()]), status


#: Columns of the culvert section, in order.
CULVERT_COLUMNS = [
    "Chan ID", "Type", "Num_barrels", "US Invert", "DS Invert", "US Obvert", "DS Obvert", "Length", "pSlope", "n or Cd",
    "Diam_Width", "Height", "Inlet_Height", "Inlet_Width", "Entry Loss", "Exit Loss", "Fixed Loss", "Ent/Exit Losses",
]


def section(lines: DataFrame, starts: str, header: str) -> DataFrame:
    """Lines of a section: after the first line with ``header`` that follows one with ``starts``, up to a blank line."""
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    seen = lines.withColumn("_s", F.max(F.col("text").contains(starts)).over(order))
    inside = seen.withColumn("_h", F.max(F.col("_s") & F.ltrim("text").startswith(header)).over(order)).filter("_h")
    first = inside.groupBy("path").agg(F.min("line").alias("_f"), F.min(F.when(F.trim("text") == "", F.col("line"))).alias("_b"))
    return inside.join(first, "path").filter("line > _f and (_b is null or line < _b)").select("path", "line", F.trim("text").alias("text"))


def culvert_section(lines: DataFrame) -> DataFrame:
    """Culverts of an end-of-run report, its columns two blanks or more apart; dashes and ``Adjusted`` are null.

    What a row has beyond the last column belongs to that; a row with fewer columns is left out.
    """
    parts = section(lines, "CULVERT AND PIPE DATA", "Channel").withColumn("_p", F.split("text", r"\s{2,}"))
    parts, last = parts.filter(F.size("_p") >= len(CULVERT_COLUMNS)), len(CULVERT_COLUMNS) - 1
    own = lambda i: F.col("_p")[i] if i < last else F.array_join(F.slice("_p", last + 1, F.size("_p")), " ")
    field = lambda i: F.when(~own(i).isin("---", "-----", "Adjusted"), own(i))
    return parts.select("path", "line", *[(field(i) if i < 2 else number(field(i))).alias(c) for i, c in enumerate(CULVERT_COLUMNS)])


def _batch_rows(lines: DataFrame) -> DataFrame:
    """Lines of a hydrologic batch report between its two headings, each with its parts and those of the last header."""
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumns({"_a": F.max(F.col("text").rlike(r"Peak\s+Description")).over(order), "_z": F.max(F.col("text").contains("Run,    Representative hydrograph")).over(order)})
    own = own.filter("_a and not _z").withColumn("_p", F.split(F.trim("text"), r"\s+"))
    head = F.when(F.col("text").rlike(r"^\s*Run\s+Duration\b"), F.array_remove("_p", "Unit"))
    return own.withColumn("_head", F.last(head, ignorenulls=True).over(order))


def batch_runs(lines: DataFrame) -> DataFrame:
    """(path, run, duration_hours, aep, tp, values, names) of a hydrologic batch report, between its two headings.

    All values of a run are taken; their names are the header's after run, duration, AEP and pattern, null without one.
    """
    rows = _batch_rows(lines).filter((F.size("_p") >= 7) & F.col("_p")[0].rlike(r"^\d+$"))
    size, unit = number(F.col("_p")[1]), F.lower(F.col("_p")[2])
    hours = F.when(unit.startswith("min"), size / 60).otherwise(size)
    flag = lambda x: F.when(x == "Y", F.lit(1.0)).when(x == "N", F.lit(0.0)).otherwise(number(found(x, r"^(-?[\d.]+)")))
    return rows.select(
        "path", F.col("_p")[0].cast("int").alias("run"), hours.alias("duration_hours"), F.regexp_replace(F.col("_p")[3], "%", "").alias("aep"),
        F.col("_p")[4].try_cast("int").alias("tp"), F.transform(F.slice("_p", 6, F.size("_p")), flag).alias("values"), F.slice("_head", 5, F.size("_head")).alias("names"),
    ).filter("tp is not null")


def batch_peaks(lines: DataFrame) -> DataFrame:
    """(path, run, duration_hours, aep, tp, place, name, value): a row of each value of ``batch_runs``, places from 0."""
    runs = batch_runs(lines)
    each = runs.select("path", "run", "duration_hours", "aep", "tp", "names", F.posexplode("values").alias("place", "value"))
    return each.withColumn("name", F.get("names", "place")).select("path", "run", "duration_hours", "aep", "tp", "place", "name", "value")


def hydrograph(lines: DataFrame, drop: Sequence[str] = ("Inc", "Time (hrs)")) -> DataFrame:
    """(path, time, location, value) of a hydrograph table under two lines of titles."""
    name = lambda x: F.trim(F.regexp_replace(x, r"^Calculated hydrograph:\s*", ""))
    body = headed(lines.filter("line >= 2")).filter("place > 1")
    at = (F.nullif(F.array_position(F.transform("head_1", name), F.lit("Time (hrs)")), F.lit(0)) - 1).cast("int")
    body = body.withColumn("_at", at).filter("_at is not null and _at < size(cells)")
    each = body.select("path", number(F.get("cells", "_at")).alias("time"), "head_1", F.posexplode("cells").alias("col", "text")).filter(F.col("col") < F.size("head_1"))
    each = each.select("path", "time", name(F.get("head_1", "col")).alias("location"), number(F.col("text")).alias("value"))
    return each.filter(~F.col("location").isin(list(drop)) & F.col("value").isNotNull())


def culvert_angles(lines: DataFrame) -> DataFrame:
    """(path, name, angle, degrees) of a survey report: an angle in degrees, minutes and seconds, a quoted name at the end."""
    angle, name = found(F.col("text"), r"(-?\d+(?:\.\d+)?°\d+'\d+(?:\.\d+)?\")"), found(F.col("text"), r'"([^"]+)"\s*$')
    return lines.filter(angle.isNotNull() & name.isNotNull()).select("path", name.alias("name"), angle.alias("angle"), dms_to_degrees(angle).alias("degrees"))


def strings(lines: DataFrame) -> DataFrame:
    """(path, place, group_id, x, y, z) of a string file: a line that begins with 0 starts the next string."""
    p = F.split(F.trim("text"), r"[,\s]+")
    own = lines.filter(F.trim("text") != "").withColumns({"_p": p})
    order = Window.partitionBy("path").orderBy("line")
    own = own.withColumns({"place": F.row_number().over(order), "group_id": F.sum(F.when(F.col("_p")[0] == "0", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    xyz = {k: number(F.try_element_at("_p", F.lit(i))) for i, k in ((2, "y"), (3, "x"), (4, "z"))}
    return own.filter(F.col("_p")[0] != "0").withColumns(xyz).select("path", "place", "group_id", "x", "y", "z")


def triangles(lines: DataFrame, marker: str = "TRISOLATION") -> DataFrame:
    """(path, line, a, b, c): vertex numbers of the triangles after the marker."""
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    p = F.split(F.trim("text"), r"[,\s]+")
    own = lines.withColumns({"_m": F.coalesce(F.max(F.col("text").contains(marker)).over(order), F.lit(False)), "_p": p}).filter("_m").filter(F.size("_p") >= 3)
    return own.select("path", "line", *[F.col("_p")[i].try_cast("int").alias(k) for i, k in enumerate("abc")]).dropna()


def surfaces(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Triangles with their corners; one without all three is dropped."""
    out = faces
    for k in "abc":
        out = out.join(points.select("path", F.col("place").alias(k), F.struct("x", "y", "z").alias(f"p{k}")), ["path", k])
    return out.select("path", "line", "pa", "pb", "pc")


def js_array(pages: DataFrame, variable: str, html: str = "html") -> DataFrame:
    """Objects of a JavaScript array in a page, as maps; trailing commas are allowed, values may be nested.

    The parser of JSON stops where the array's own bracket closes, so the rest of the page may follow.
    """
    raw = F.regexp_extract(html, rf"(?s)\b{variable}\s*=\s*(\[.*)", 1)
    tidy = F.regexp_replace(raw, r"""("(?:[^"\\]|\\.)*+")|,(?=\s*[\]}])""", "$1")
    return pages.withColumn("_o", F.from_json(tidy, "array<map<string,string>>")).select(*pages.columns, F.explode("_o").alias("entry"))


def js_arrays(pages: DataFrame, variables: Sequence[str], key: str, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """((key, variable, place, entry), (key, reason)): the objects of several arrays of each page, and the pages that lack one
    or whose array can't be read."""
    array = lambda v: F.from_json(F.regexp_replace(F.regexp_extract(html, rf"(?s)\b{v}\s*=\s*(\[.*)", 1), r"""("(?:[^"\\]|\\.)*+")|,(?=\s*[\]}])""", "$1"), "array<map<string,string>>")
    told = F.array(*[F.struct(F.lit(v).alias("variable"), F.coalesce(F.col(html), F.lit("")).rlike(rf"\b{v}\s*=\s*\[").alias("there"), array(v).alias("entries")) for v in variables])
    each = pages.select(key, F.explode(told).alias("a")).select(key, "a.variable", "a.there", "a.entries")
    rows = each.select(key, "variable", F.posexplode("entries").alias("place", "entry"))
    reason = F.when(~F.col("there"), F.concat(F.lit("has no "), F.col("variable"))).when(F.col("entries").isNull(), F.concat(F.lit("can't read "), F.col("variable")))
    failed = each.select(key, reason.alias("reason")).filter("reason is not null").groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("reason")), ", ").alias("reason"))
    return rows, failed


def dbf_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, row, field, value) of dBASE tables read as binary files."""
    for batch in batches:
        for path, raw in zip(batch["path"], batch["content"], strict=True):
            out = []
            if len(raw) >= 32:
                count, head, size = int.from_bytes(raw[4:8], "little"), int.from_bytes(raw[8:10], "little"), int.from_bytes(raw[10:12], "little")
                fields, at = [], 1
                for k in range(32, head - 1, 32):
                    if raw[k] == 0x0D:
                        break
                    fields.append((raw[k : k + 11].split(b"\0")[0].decode("latin-1"), at, raw[k + 16]))
                    at += raw[k + 16]
                for r in range(count):
                    record = raw[head + r * size : head + (r + 1) * size]
                    if len(record) == size and record[:1] != b"*":
                        out += [(path, r, name, record[a : a + n].decode("latin-1").strip() or None) for name, a, n in fields]
            yield pd.DataFrame(out, columns=["path", "row", "field", "value"])


def gpkg_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, row, field, value) of the layer ending in 1d_ccA_L of GeoPackages read as binary files; no geometry."""
    import sqlite3

    for batch in batches:
        for path, raw in zip(batch["path"], batch["content"], strict=True):
            out = []
            db = sqlite3.connect(":memory:")
            try:
                db.deserialize(bytes(raw))
                db.execute("PRAGMA query_only = ON")
                layers = [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents") if str(r[0]).lower().endswith("1d_cca_l")]
                for layer in layers[:1]:
                    quoted = '"' + layer.replace('"', '""') + '"'
                    names = [r[1] for r in db.execute(f"PRAGMA table_info({quoted})") if r[1].lower() not in ("geom", "geometry", "fid")]
                    listed = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
                    for r, row in enumerate(db.execute(f"SELECT {listed} FROM {quoted}")):
                        out += [(path, r, n, None if v is None else str(v)) for n, v in zip(names, row, strict=True)]
            except sqlite3.Error:
                out = []  # a damaged file gives no rows
            finally:
                db.close()
            yield pd.DataFrame(out, columns=["path", "row", "field", "value"])


def channel_areas(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, row, field, value) of .dbf and .gpkg files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    schema = "path string, row int, field string, value string"
    dbf = files.filter(F.lower("path").endswith(".dbf")).mapInPandas(dbf_rows, schema)
    out = dbf.unionByName(files.filter(F.lower("path").endswith(".gpkg")).mapInPandas(gpkg_rows, schema))
    names = {"Channel": "Chan ID", "Dur_10pFul": "Dur_10pFull"}
    return out.withColumn("field", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("field")), F.col("field")))
