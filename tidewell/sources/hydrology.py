"""Hydrologic reports: older batch layouts, rainfall tables, design rainfall, hydrographs by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scenario import found, signed_coordinate
from tidewell.operators import reshape
from tidewell.sources import readers

#: A number in running text: digits, a point among or before them, and a sign.
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"


def summary_names(lines: DataFrame) -> DataFrame:
    """(path, names): the map from ``HydNNNN`` to the description that the summary of a batch report gives."""
    order = Window.partitionBy("path").orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("_on", F.max(F.contains("text", F.lit("Peak  Description"))).over(upto)).filter("_on")
    first = own.groupBy("path").agg(F.min("line").alias("_a"), F.min(F.when(F.length(F.trim("text")) <= 3, F.col("line"))).alias("_z"))
    inside = own.join(first, "path").filter("line > _a and (_z is null or line < _z)").withColumn("_t", F.trim("text")).filter(F.contains("_t", F.lit(" ")))
    number, rest = F.regexp_extract("_t", r"^(\S*) (.*)$", 1), F.trim(F.regexp_extract("_t", r"^(\S*) (.*)$", 2))
    last = inside.select("path", "line", F.concat(F.lit("Hyd"), F.lpad(number, 4, "0")).alias("k"), rest.alias("v")).groupBy("path", "k").agg(F.max_by("v", "line").alias("v"))
    return last.groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("names"))


def batch_parameters(lines: DataFrame) -> DataFrame:
    """(path, il, cl, roc, kc, m): losses and routing parameters before the peaks; without them 0, and 1 for the coefficient.

    The line after one of loss parameters holds the initial loss and, as that line says, a continuing loss or a coefficient.
    """
    order = Window.partitionBy("path").orderBy("line")
    own = lines.withColumns({"_before": F.lag("text").over(order), "_on": F.max(F.contains("text", F.lit("Peak  Description"))).over(order.rowsBetween(Window.unboundedPreceding, 0))}).filter("not _on")
    part = F.split(F.trim("text"), r"\s+")
    values = F.when(F.contains("_before", F.lit("Loss parameters")), part)
    continuing = F.contains("_before", F.lit("Cont"))
    at = lambda c, i: F.try_element_at(c, F.lit(i)).try_cast("double")
    named = F.when(F.contains("text", F.lit("Parameters")) & values.isNull(), part)
    last = lambda c, default: F.coalesce(F.max_by(c, F.when(c.isNotNull(), F.col("line"))), F.lit(default))
    return own.groupBy("path").agg(
        last(at(values, 1), 0.0).alias("il"), last(F.when(continuing, at(values, 2)), 0.0).alias("cl"), last(F.when(~continuing, at(values, 2)), 1.0).alias("roc"),
        last(at(named, 4), 0.0).alias("kc"), last(at(named, -1), 0.0).alias("m"),
    )


def batch_runs_with_parameters(lines: DataFrame) -> DataFrame:
    """A row for each run with its named peaks as a map, its file's parameters, and the descriptions of its hydrographs."""
    runs = readers.batch_runs(lines)
    named = F.map_from_entries(F.arrays_zip(F.slice("names", 1, F.least(F.size("names"), F.size("values"))).alias("k"), F.slice("values", 1, F.least(F.size("names"), F.size("values"))).alias("v")))
    out = runs.withColumn("peaks", F.when(F.col("names").isNotNull(), named)).drop("names", "values")
    return out.join(batch_parameters(lines), "path", "left").join(summary_names(lines).withColumnRenamed("names", "hydrographs"), "path", "left")


def peak_table(lines: DataFrame) -> DataFrame:
    """(path, row, field, value) of the table of runs in a report, columns two blanks apart; rows of other lengths are left out.

    With ``report_parameters`` this is the reader of reports of single models.
    """
    own = lines.withColumn("_p", F.split(F.trim("text"), r"\s{2,}"))
    heads = own.filter(F.contains("text", F.lit("Run        Duration             AEP"))).groupBy("path").agg(F.max("line").alias("_h"), F.max_by("_p", "line").alias("_names"))
    rows = own.join(heads, "path").filter((F.col("line") > F.col("_h")) & (F.size("_p") == F.size("_names")))
    return rows.select("path", F.col("line").alias("row"), F.explode(F.arrays_zip(F.col("_names").alias("field"), F.col("_p").alias("value"))).alias("x")).select("path", "row", "x.field", "x.value")


def report_parameters(lines: DataFrame) -> DataFrame:
    """(path, kc, m, initial_loss, continuing_loss) of a report; of several lines the last counts."""
    numbers = F.regexp_extract_all("text", F.lit(f"({NUMBER})"), F.lit(1))
    told = lambda label, i: F.max_by(F.get(numbers, i).try_cast("double"), F.when(F.contains("text", F.lit(label)) & (F.size(numbers) >= 2), F.col("line")))
    return lines.groupBy("path").agg(
        told("Parameters:  kc =", 0).alias("kc"), told("Parameters:  kc =", 1).alias("m"), told("Initial loss (mm)", 0).alias("initial_loss"), told("Initial loss (mm)", 1).alias("continuing_loss")
    )


#: Fragments of column labels and what they are written as.
LABELS = {
    "Time Incs": "Time Increment", "Sub- catch ment": "Sub-catchment area", "Sub- catc ment": "Sub-catchment area", "Sub-catchment": "Sub-catchment area",
    "Inte stn. area": "Inter-station area", "Inter stn. area": "Inter-station area",
}


def column_names(heads: Column, sample: Column) -> Column:
    """Names of a table's columns from the lines above it (an array) and its first row.

    The ink profile of the headings tells which places any of them uses. A column is a word of the first row, widened over
    the ink that touches it, but not beyond its neighbours; its name is what the headings have there. A single letter in the
    last heading names a sub-area.
    """
    width = F.greatest(F.length(sample), F.coalesce(F.array_max(F.transform(heads, lambda h: F.length(h))), F.lit(0)))
    at = lambda text, i: F.coalesce(F.nullif(F.substring(text, i, F.lit(1)), F.lit("")), F.lit(" "))
    places = F.sequence(F.lit(1), width)
    ink = F.array_join(F.transform(places, lambda i: F.when(F.exists(heads, lambda h: at(h, i) != " "), "#").otherwise(" ")), "")
    begins = F.filter(places, lambda i: (at(sample, i) != " ") & ((i == 1) | (at(sample, i - 1) == " ")))
    ends = F.filter(places, lambda i: (at(sample, i) != " ") & (at(sample, i + 1) == " "))
    ink_from = lambda i: F.length(F.regexp_extract(F.substring(ink, i, width), "^(#*)", 1))
    ink_up_to = lambda i: F.length(F.regexp_extract(F.substring(ink, F.lit(1), i), "(#*)$", 1))
    after = lambda k: F.coalesce(F.get(begins, k + 1), width + 1)
    last = lambda k: F.least(F.get(ends, k) + ink_from(F.get(ends, k) + 1), after(k) - 1)

    def name(word: Column, k: Column) -> Column:
        first = F.greatest(word - ink_up_to(word - 1), F.coalesce(F.when(k > 0, last(k - 1)), F.lit(0)) + 1)
        parts = F.transform(heads, lambda h: F.trim(F.substring(h, first, last(k) - first + 1)))
        label = F.array_join(F.filter(parts, lambda p: p != ""), " ")
        for old, new in LABELS.items():
            label = F.replace(label, F.lit(old), F.lit(new))
        label = F.nullif(F.trim(F.regexp_replace(label, r"\s+", " ")), F.lit(""))
        letter = F.element_at(parts, -1)
        return F.when(letter.rlike(r"^\p{L}$"), F.concat(F.lit("Sub-area "), letter)).otherwise(F.coalesce(label, F.concat(F.lit("Column "), (k + 1).cast("string"))))

    return F.transform(begins, name)


def _rainfall_files(lines: DataFrame, start: int, end: int, heads: int) -> DataFrame:
    """(path, step, heads, rows) of each file, in one pass: its time step, the last headings above the table, the table."""
    blank = F.trim("text") == ""
    above, inside = ~blank & (F.col("line") < start - 1), ~blank & F.col("line").between(start - 1, end - 1)
    nearest = F.row_number().over(Window.partitionBy("path").orderBy(F.when(above, F.col("line")).desc_nulls_last()))
    label = "Time increment (hours)"
    step = F.regexp_replace(F.substring_index("text", label, -1), r"^\s*=\s*", "").alias("step")
    step = readers.number(F.split(step, r"\s")[0])
    lines = lines.withColumn("_near", nearest)
    row = F.struct("line", "text")
    texts = lambda chosen: F.sort_array(F.collect_list(F.when(chosen, row)))
    own = lines.groupBy("path").agg(F.min_by(step, F.when(F.contains("text", F.lit(label)), F.col("line"))).alias("step"), texts(above & (F.col("_near") <= heads)).alias("_heads"), texts(inside).alias("rows"))
    return own.withColumn("heads", F.col("_heads.text")).drop("_heads")


def rainfall(lines: DataFrame, start: int, end: int, heads: int = 3) -> DataFrame:
    """(path, increment, time, name, value) of the rainfall tables in lines ``start`` to ``end``, counted from 1.

    Each file tells its own time step, and its headings name the columns. Files without a step, a heading or rows are left
    out; ``rainfall_failures`` names them.
    """
    files = _rainfall_files(lines, start, end, heads).filter(F.col("step").isNotNull() & (F.size("heads") > 0) & (F.size("rows") > 0))
    named = files.select("path", "step", column_names(F.col("heads"), F.col("rows")[0]["text"]).alias("names"), F.explode("rows").alias("r"))
    values = F.transform(F.split(F.trim(F.col("r.text")), r"\s+"), lambda v: F.coalesce(readers.number(v), F.lit(0.0)))
    own = named.select("path", "step", F.col("r.line").alias("row"), "names", values.alias("values"))
    each = own.select("path", "step", "row", F.col("values")[0].alias("increment"), "names", F.posexplode("values").alias("col", "value")).filter((F.col("col") > 0) & (F.col("col") < F.size("names")))
    return _hyetograph(each.withColumn("name", F.get("names", "col")))


def rainfall_failures(lines: DataFrame, start: int, end: int, heads: int = 3) -> DataFrame:
    """(path, reason) of the files that ``rainfall`` leaves out."""
    reason = F.when(F.col("step").isNull(), "no time increment").when(F.size("rows") == 0, "no rows of a table").when(F.size("heads") == 0, "no headings")
    return _rainfall_files(lines, start, end, heads).select("path", reason.alias("reason")).filter("reason is not null")


def rainfall_cells(lines: DataFrame, start: int, end: int) -> DataFrame:
    """(path, row, col, value) of the table in lines ``start`` to ``end``, counted from 1; what isn't a number is 0."""
    own = lines.filter(F.col("line").between(start - 1, end - 1) & (F.trim("text") != ""))
    cells = own.select("path", F.col("line").alias("row"), F.posexplode(F.split(F.trim("text"), r"\s+")).alias("col", "value"))
    return cells.withColumn("value", F.coalesce(readers.number(F.col("value")), F.lit(0.0)))


def rainfall_table(cells: DataFrame, names: Sequence[str], step: float) -> DataFrame:
    """(path, increment, time, name, value) of rainfall cells whose first column counts increments of ``step`` hours.

    Rain of a sub-area in the first increment is moved into the second, and a last increment without rain is added.
    """
    counts = cells.filter("col = 0").select("path", "row", F.col("value").alias("increment"))
    known = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("col") + 1)
    long = cells.filter((F.col("col") > 0) & (F.col("col") < len(names))).join(counts, ["path", "row"])
    return _hyetograph(long.select("path", "row", "increment", known.alias("name"), "value", F.lit(float(step)).alias("step")))


def _hyetograph(long: DataFrame) -> DataFrame:
    """Moves the first increment's rain and adds the last increment, of rows (path, row, increment, name, value, step)."""
    line, whole = Window.partitionBy("path", "name").orderBy("row"), Window.partitionBy("path", "name")
    moves = F.col("name").startswith("Sub-area ")
    long = long.withColumns({"_r": F.row_number().over(line), "_before": F.lag("value").over(line), "_n": F.count("*").over(whole)})
    moved = F.when(moves & (F.col("_n") > 1) & (F.col("_r") == 1), F.least(F.col("value"), F.lit(0.0))).when(moves & (F.col("_r") == 2) & (F.col("_before") > 0), F.col("value") + F.col("_before")).otherwise(F.col("value"))
    own = F.struct(F.col("increment").alias("increment"), moved.alias("value"))
    added = F.struct((F.col("increment") + 1).alias("increment"), F.lit(0.0).alias("value"))
    each = long.select("path", "name", "step", F.explode(F.when(F.col("_r") == F.col("_n"), F.array(own, added)).otherwise(F.array(own))).alias("x"))
    return each.select("path", "x.increment", (F.col("x.increment") * F.col("step")).alias("time"), "name", "x.value")


def padded_table(lines: DataFrame, start: int, end: int, step: float) -> DataFrame:
    """(path, increment, time, name, value) of a ragged table: increments, the catchment, and sub-areas by letter."""
    cells = rainfall_cells(lines, start, end)
    letters = ["Increments", "Catchment", *(f"Sub-Area {chr(65 + i)}" for i in range(26))]
    width = cells.groupBy("path").agg(F.max("col").alias("_w"))
    rows = cells.select("path", "row").distinct().join(width, "path").select("path", "row", F.explode(F.sequence(F.lit(0), F.col("_w"))).alias("col"))
    return rainfall_table(rows.join(cells, ["path", "row", "col"], "left"), letters, step)


#: Places of cells in a table of design rainfall, rows and columns counted from 0.
DESIGN_CELLS = {"location_label": (4, 1), "req_lat": (5, 2), "req_long": (5, 4), "grid_lat": (6, 2), "grid_long": (6, 4)}


def design_rainfall(lines: DataFrame, lookup: DataFrame | None = None, raw: str = "raw") -> DataFrame:
    """A row for each duration and event of tables of design rainfall, with their place; ``lookup`` describes events."""
    c = readers.cells(lines)
    at = lambda k: F.max(F.when((F.col("row") == DESIGN_CELLS[k][0]) & (F.col("col") == DESIGN_CELLS[k][1]), F.col("value")))
    place = c.groupBy("path").agg(*[at(k).alias(k) for k in DESIGN_CELLS])
    sign = {k: signed_coordinate(F.col(k), "lat" if k.endswith("lat") else "long") for k in DESIGN_CELLS if k != "location_label"}
    first = c.filter((F.col("col") == 0) & F.contains("value", F.lit("Duration"))).groupBy("path").agg(F.min("row").alias("_h"))
    body = c.join(first, "path")
    heads = body.filter("row = _h and col > 1").select("path", "col", F.col("value").alias("aep"))
    names = body.filter("row > _h and col < 2").groupBy("path", "row").agg(F.max(F.when(F.col("col") == 0, F.col("value"))).alias("duration"), F.max(F.when(F.col("col") == 1, F.col("value"))).alias("m"))
    values = body.filter("row > _h and col > 1").join(heads, ["path", "col"]).join(names, ["path", "row"])
    out = values.select("path", "duration", F.col("m").try_cast("double").cast("int").alias("minutes"), "aep", readers.number(F.col("value")).alias("value")).join(place, "path").withColumns(sign)
    return out if lookup is None else out.join(lookup.withColumnRenamed(raw, "aep"), "aep", "left")


#: What the names of design rainfall's files end with, and how the kinds are called.
DESIGN_KINDS = {"_ifds": "ifds", "_rare": "rare", "_very_frequent": "very_frequent"}


def design_kind(name: Column) -> Column:
    """(location, kind) of a design rainfall file's name; null for others."""
    hits = [F.when(F.instr(name, mark) > 0, F.struct(F.substring(name, F.lit(1), F.instr(name, mark) - 1).alias("location"), F.lit(kind).alias("kind"))) for mark, kind in DESIGN_KINDS.items()]
    return F.coalesce(*hits)


def combined_design_rainfall(lines: DataFrame, lookup: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of ``design_rainfall`` with location and kind, (location, kind, n_files, n_rows) of what there was)."""
    from tidewell.sources.files import file_name

    own = lines.withColumn("_k", design_kind(file_name(F.col("path")))).filter("_k is not null")
    read = design_rainfall(own.select("path", "line", "text"), lookup)
    rows = read.withColumn("_k", design_kind(file_name(F.col("path")))).withColumns({"location": F.col("_k.location"), "kind": F.col("_k.kind")}).drop("_k")
    files = own.select("_k.*", "path").groupBy("location", "kind").agg(F.count_distinct("path").alias("n_files"))
    counts = rows.groupBy("location", "kind").agg(F.count("*").alias("n_rows"))
    return rows, files.join(counts, ["location", "kind"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def hydrograph_name(name: Column) -> Column:
    """(creek, aep, duration, tp) of a hydrograph file's name; null for others."""
    p = r"(?i)^([^_]+)_\d+_\s*aep(\d+)_du(\d+)hourtp(\d+)"
    part = lambda k, a, b: F.concat(F.lit(a), found(name, p, k), F.lit(b))
    return F.when(name.rlike(p), F.struct(found(name, p, 1).alias("creek"), part(2, "aep", "").alias("aep"), part(3, "du", "hour").alias("duration"), part(4, "tp", "").alias("tp")))


def selected_hydrographs(lines: DataFrame, wanted: Sequence[tuple[str, str]], location: str) -> DataFrame:
    """One location's series from the files whose (aep, tp) are wanted, with what their names tell."""
    from tidewell.sources.files import file_name

    own = lines.withColumn("_n", hydrograph_name(file_name(F.col("path")))).filter("_n is not null")
    chosen = F.concat_ws("/", "_n.aep", "_n.tp").isin([f"{a}/{t}" for a, t in wanted])
    series = readers.hydrograph(own.filter(chosen).select("path", "line", "text")).filter(F.col("location") == location)
    return series.withColumn("_n", hydrograph_name(file_name(F.col("path")))).select("path", "_n.*", "time", "location", "value")


def mean_level(us: Column, ds: Column) -> Column:
    """The mean of two levels, or the one that is known."""
    return F.coalesce((us + ds) / 2, us, ds)


def as_series(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """(Time, Location, Value) of any table: ``names`` gives its columns for them."""
    return df.select(*[reshape.quoted(names.get(c, c)).alias(c) for c in ("Time", "Location", "Value")])
