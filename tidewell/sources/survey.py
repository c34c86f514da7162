"""Survey and terrain text: culverts of two reports, point files, blocks, profiles, command lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.scenario import first_text, kept_runs
from tidewell.operators import reshape, series
from tidewell.sources import readers

#: Encodings by the bytes that a file begins with.
MARKS = [("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE")]
#: Columns of the culvert table, and the fields that a culvert takes from its first or second row.
CULVERT = ["string name", "pit centre x", "pit centre y", "invert us", "invert ds", "pipe type", "diameter", "width", "number of pipes", "separation", "*direction"]
NUMBERS = ["US_X", "US_Y", "DS_X", "DS_Y", "Invert US", "Invert DS", "Diameter", "Width", "Separation"]
NO_ANGLE = "0°0'0\""


def read_marked_lines(spark: SparkSession, paths: str | Sequence[str], glob: str) -> DataFrame:
    """Lines of small files whose first bytes tell their encoding; without a mark it is UTF-8."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).select("path", "content")
    head, text = F.hex(F.substring("content", 1, 3)), None
    for mark, name in MARKS:
        own = F.decode(F.expr(f"substring(content, {len(mark) // 2 + 1})"), name)
        text = F.when(head.startswith(mark), own) if text is None else text.when(head.startswith(mark), own)
    return raw.withColumn("text", text.otherwise(F.decode("content", "UTF-8"))).select("path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line", "text"))


def culvert_pairs(lines: DataFrame) -> DataFrame:
    """Culverts of a tab-separated table without its first and third line: rows go in pairs, upstream and downstream.

    Pairs of two names are left out, as is a last single row. A field that is blank in its own row is taken from the other.
    """
    c = readers.cells(lines.filter("line <> 0 and line <> 2"), "\t")
    c = c.join(c.groupBy("path").agg(F.min("row").alias("_h")), "path")
    head = c.filter("row = _h").select("path", "col", F.lower("value").alias("label")).filter(F.col("label").isin(CULVERT))
    whole = head.groupBy("path").agg(F.countDistinct("label").alias("n")).filter(F.col("n") == len(CULVERT)).select("path")
    wide = reshape.transpose(c.filter("row > _h").join(head, ["path", "col"]).join(whole, "path"), ["path"], "row", "label", "value", CULVERT)
    pairs = series.row_pairs(wide.toDF("path", "row", *[f"c{i}" for i in range(len(CULVERT))]), ["path"], ["row"], [f"c{i}" for i in range(len(CULVERT))])
    us, ds = ({n: F.col(f"c{i}_{side}") for i, n in enumerate(CULVERT)} for side in ("first", "second"))
    number = lambda *cells: F.coalesce(readers.number(first_text(*cells)), F.lit(0.0))
    same = F.trim(us["string name"]).eqNullSafe(F.trim(ds["string name"]))
    return pairs.filter(same).select(
        "path", F.trim(us["string name"]).alias("Name"), number(us["pit centre x"]).alias("US_X"), number(us["pit centre y"]).alias("US_Y"), number(ds["pit centre x"]).alias("DS_X"), number(ds["pit centre y"]).alias("DS_Y"),
        number(ds["invert us"], us["invert us"]).alias("Invert US"), number(us["invert ds"], ds["invert ds"]).alias("Invert DS"),
        number(us["diameter"], ds["diameter"]).alias("Diameter"), number(us["width"], ds["width"]).alias("Width"),
        F.coalesce(first_text(us["number of pipes"], ds["number of pipes"]).try_cast("int"), F.lit(0)).alias("Number of Pipes"), number(us["separation"], ds["separation"]).alias("Separation"),
        F.coalesce(first_text(us["pipe type"], ds["pipe type"]), F.lit("Unknown")).alias("Pipe Type"), F.coalesce(first_text(us["*direction"], ds["*direction"]), F.lit("Unknown")).alias("Direction"),
    )


def combined_culverts(angles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Culverts of both reports by name: numbers are 0 where unknown, pipes null, and the angle that of none."""
    out = pairs.drop("path").join(angles.select(F.col("name").alias("Name"), F.col("angle").alias("Angle"), F.col("degrees").alias("Angle_Degrees")), "Name", "full_outer")
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in NUMBERS}
    return out.withColumns(filled | {"Angle": F.coalesce("Angle", F.lit(NO_ANGLE)), "Angle_Degrees": F.coalesce("Angle_Degrees", F.lit(0.0))})


def missing_culverts(combined: DataFrame) -> DataFrame:
    """(Name, missing): culverts that one of the two reports lacks."""
    lacks = F.array_compact(F.array(F.when(F.col("Angle") == NO_ANGLE, F.lit("rpt")), F.when((F.col("US_X") == 0) | (F.col("DS_X") == 0), F.lit("txt"))))
    return combined.select("Name", F.explode(lacks).alias("missing"))


def points(lines: DataFrame) -> DataFrame:
    """(path, x, y, z) of white-space separated points; other lines are left out."""
    p = F.split(F.trim("text"), r"\s+")
    at = lambda i: readers.number(F.try_element_at(p, F.lit(i)))
    return lines.select("path", at(1).alias("x"), at(2).alias("y"), at(3).alias("z")).dropna()


def ordered_grid(df: DataFrame, fill: float) -> DataFrame:
    """All pairs of a file's x and y from north to south and west to east, as lines, with ``fill`` for unknown heights."""
    xs, ys = df.select("path", "x").distinct(), df.select("path", "y").distinct()
    out = xs.join(ys, "path").join(df.groupBy("path", "x", "y").agg(F.max("z").alias("z")), ["path", "x", "y"], "left").withColumn("z", F.coalesce("z", F.lit(fill)))
    return out.orderBy("path", F.desc("y"), "x").select("path", "x", "y", "z", F.concat_ws(" ", "x", "y", "z").alias("text"))


def without_sentinel(lines: DataFrame, value: float | str, drop_malformed: bool = False) -> DataFrame:
    """Lines whose third field isn't the sentinel: as a number if that is one, else as text.

    Lines of fewer fields, or of another third field than a number where one is looked for, are malformed; they stay
    unless they are to be dropped. Blank lines stay.
    """
    field = F.try_element_at(F.split(F.trim("text"), r"[\s,]+"), F.lit(3))
    if isinstance(value, str):
        return lines.filter(~F.coalesce(field == value, F.lit(False)))
    z = field.try_cast("double")
    keep = ~F.coalesce(z == float(value), F.lit(False))
    return lines.filter(keep & (z.isNotNull() | (F.trim("text") == ""))) if drop_malformed else lines.filter(keep)


def tagged_points(lines: DataFrame, starts: str, layer: str) -> DataFrame:
    """(path, object, layer, place, x, y, z): points under lines that begin an object; a line that names a layer holds on."""
    text, line = F.col("text"), Window.partitionBy("path").orderBy("line")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumns({"object": F.sum(F.when(text.rlike(starts), 1).otherwise(0)).over(upto), "layer": F.last(F.when(text.rlike(layer), F.regexp_extract(text, layer, 1)), ignorenulls=True).over(upto)})
    p = F.split(F.trim("text"), r"[\s,]+")
    xyz = {k: readers.number(F.try_element_at(p, F.lit(i))) for i, k in ((1, "x"), (2, "y"), (3, "z"))}
    out = own.withColumns(xyz).filter("object > 0 and x is not null and y is not null")
    return out.select("path", "object", "layer", F.row_number().over(Window.partitionBy("path", "object").orderBy("line")).alias("place"), "x", "y", "z")


def distinct_rounded(df: DataFrame, order: str, digits: int = 3) -> DataFrame:
    """The first point, by ``order``, of those that are equal when rounded."""
    keys = [F.round(c, digits).alias(f"_{c}") for c in ("x", "y", "z")]
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(whole, order).alias("p")).select("p.*")


def profile_areas(df: DataFrame, keys: Sequence[str], x: str, y: str, cross_x: str, cross_y: str, slope: str) -> DataFrame:
    """(keys, below, above): areas between a profile and a line through its first point, before and after they cross.

    ``slope`` is the line's; the profile's first x and least y are the line's start. Areas are those of the polygons by
    the sum of cross products of neighbouring corners.
    """
    span = Window.partitionBy(*keys)
    own = df.withColumns({"_x0": F.min(x).over(span), "_x1": F.max(x).over(span), "_y0": F.min(y).over(span)})
    one = own.withColumn("_p", F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).groupBy(*keys, "_x0", "_x1", "_y0", cross_x, cross_y, slope).agg(F.sort_array(F.collect_list("_p")).alias("_all"))
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    cross = corner(F.col(cross_x), F.col(cross_y))
    first = F.concat(F.filter("_all", lambda p: p["x"] < F.col(cross_x)), F.array(cross, corner(F.col("_x0"), F.col("_y0"))))
    last = F.concat(F.array(cross), F.filter("_all", lambda p: p["x"] > F.col(cross_x)), F.array(corner(F.col("_x1"), F.col("_y0") + F.col(slope) * (F.col("_x1") - F.col("_x0"))), cross))

    def area(polygon: Column) -> Column:
        turned = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
        parts = F.zip_with(polygon, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)) / 2

    known = F.col(cross_x).isNotNull()
    return one.select(*keys, F.when(known, area(first)).otherwise(0.0).alias("below"), F.when(known, area(last)).otherwise(0.0).alias("above"))


def without_comment(text: Column) -> Column:
    """A command line up to a comment mark after a blank that isn't within quotes."""
    return F.rtrim(F.regexp_extract(text, r"""^((?:"[^"]*(?:"|$)|(?! (?:::|#|;|//|REM|rem|!))[^"])*)""", 1))


def run_list(lines: DataFrame) -> DataFrame:
    """(path, line, combo): the distinct combinations of flags of command lists, as maps, as they come.

    A flag is ``-e`` or ``-s`` with a digit from 1 to 9, with the word after it; of equal flags in a line the last counts.
    Values that differ by case alone are one, and the first that comes stays. Flags of processors, what follows a comment
    mark, and lines that begin with one, ``@`` before it or not, are left out.
    """
    commented = r"(?i)^\s*(?:@?(?:rem\b|::|#|;|//)|$)"
    plain = F.trim(F.regexp_replace("text", r"(?i)(?<!\S)-pu\d+(?!\S)", " "))
    own = lines.filter(~F.col("text").rlike(commented)).select("path", "line", without_comment(plain).alias("text"))
    pair = r"(?i)-([es][1-9])\s+(\S+)"
    keys, values = (F.transform(F.regexp_extract_all("text", F.lit(pair), F.lit(i)), f) for i, f in ((1, lambda k: F.lower(k)), (2, lambda v: F.trim(v))))
    each = own.select("path", "line", F.posexplode(F.arrays_zip(keys.alias("k"), values.alias("v"))).alias("i", "x"))
    last = each.groupBy("path", "line", "x.k").agg(F.max_by("x.v", "i").alias("v"))
    combos = last.groupBy("path", "line").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("c"))
    same = F.transform("c", lambda e: F.struct(e["k"].alias("k"), F.lower(e["v"]).alias("v")))
    first = combos.groupBy(same.alias("_same")).agg(F.min(F.struct("path", "line", "c")).alias("x"))
    return first.select("x.path", "x.line", F.map_from_entries("x.c").alias("combo"))


def run_variables(combos: DataFrame) -> DataFrame:
    """(flag, values): the distinct values of each flag, in order whatever their case, with a blank between them."""
    each = combos.select(F.explode("combo").alias("flag", "v")).distinct()
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.lower("v").alias("o"), F.col("v").alias("v")))), lambda e: e["v"])
    return each.groupBy("flag").agg(F.array_join(ordered, " ").alias("values"))


def runnable(combos: DataFrame, required: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Combinations that have every required flag, with the arguments that they give in the order of the flags."""
    need = F.array(*[F.lit(k) for k in required]).cast("array<string>")
    flags = [*order, *(k for k in required if k not in order)]
    words = F.concat_ws(" ", *[F.when(F.col("combo")[k].isNotNull(), F.concat(F.lit(f"-{k} "), F.col("combo")[k])) for k in flags]) if flags else F.lit("")
    return combos.filter(F.size(F.array_except(need, F.map_keys("combo"))) == 0).withColumn("arguments", words)


def layer_name(text: Column) -> Column:
    """At most 50 characters of a layer's name, with ``_`` for what layers can't be called."""
    return F.left(kept_runs(text, r"A-Za-z0-9_", "layer"), F.lit(50))


def crossing_label(run: Column, channel: Column, row: Column) -> Column:
    """What is known of a culvert, or that it isn't."""
    parts = F.concat_ws(" / ", F.nullif(F.trim(run), F.lit("")), F.nullif(F.trim(channel), F.lit("")), F.concat(F.lit("row="), row.cast("string")))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("unknown culvert"))


def notes(**parts: Column) -> Column:
    """``name=value`` of what is known, with semicolons between."""
    return F.concat_ws("; ", *[F.when(F.length(v.cast("string")) > 0, F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in parts.items()])


def on_drive(path: Column, shares: dict[str, str]) -> Column:
    """A path on a network share as one on the drive that stands for it."""
    out = path
    for share, drive in shares.items():
        out = F.when(F.lower(path).startswith(share.lower()), F.concat(F.lit(drive), F.substring(path, F.lit(len(share) + 1), F.length(path)))).otherwise(out)
    return out


def relative_to(path: Column, base: str, outside: Column | None = None) -> Column:
    """The path below a folder; the path itself, or ``outside``, elsewhere."""
    root = base.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path if outside is None else outside)


def rgb(colour: Column) -> Column:
    """(r, g, b) of a colour's number, red in the highest byte."""
    byte = lambda k: F.shiftright(colour, k).bitwiseAND(255)
    return F.struct(byte(16).alias("r"), byte(8).alias("g"), byte(0).alias("b"))


def of_channel(name: Column, channel: str) -> Column:
    """Whether a boundary's name is of the upstream or downstream end of a channel."""
    plain = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in channel)
    return name.rlike(f"{plain}_[UD]")


def write_subsets(df: DataFrame, key: str, folder: str) -> None:
    """One folder of files for each value of the key."""
    df.withColumn("_by", F.col(f"`{key}`")).write.mode("overwrite").partitionBy("_by").parquet(folder)
