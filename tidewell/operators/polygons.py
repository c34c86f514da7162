"""Sets of polygons: points in them by a join of grid cells, and the areas of their overlap with a grid.

A polygon, given as an array of (x, y) without the first point again, is cut into cells of a grid: cells that an edge passes
and cells wholly inside. Points meet polygons by an equi-join of cells; only in cells of an edge is a point held against the
polygon's edges. Edges go by their cells column by column, insides by the crossings of each row of cells, so that work grows
with edges and cells and never with points times polygons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
#: Share of a cell by which an edge's cells are widened, beyond what rounding can shift.
MARGIN = 1e-6


def point(x: Column | float, y: Column | float) -> Column:
    lit = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(lit(x).alias("x"), lit(y).alias("y"))


def turned(vertices: Column) -> Column:
    """The vertices from the second on, and the first at the end."""
    return F.concat(F.slice(vertices, F.lit(2), F.size(vertices)), F.slice(vertices, 1, 1))


def edges(vertices: Column) -> Column:
    return F.zip_with(vertices, turned(vertices), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def holds(x: Column, y: Column, vertices: Column) -> Column:
    """Whether a point is inside a simple polygon or on one of its edges."""
    cross = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
    between = lambda v, p, q: (v >= F.least(p, q)) & (v <= F.greatest(p, q))
    on = F.exists(edges(vertices), lambda e: (cross(e) == 0) & between(x, e["a"]["x"], e["b"]["x"]) & between(y, e["a"]["y"], e["b"]["y"]))
    meets = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"]))
    return on | (F.size(F.filter(edges(vertices), meets)) % 2 == 1)


def area(vertices: Column) -> Column:
    """By the shoelace formula, whichever way round the vertices go."""
    parts = F.zip_with(vertices, turned(vertices), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)) / 2


def covering(polygons: DataFrame, key: str, vertices: str, size: float) -> DataFrame:
    """(key, i, j, inside): the cells of a grid that each polygon touches; ``inside`` where none of its edges passes."""
    sides = polygons.select(key, F.explode(edges(F.col(vertices))).alias("e")).select(key, "e.a", "e.b")
    cell = lambda v: F.floor(v / size)
    low, high = (lambda c: F.least(f"a.{c}", f"b.{c}")), (lambda c: F.greatest(f"a.{c}", f"b.{c}"))
    columns = sides.withColumn("i", F.explode(F.sequence(cell(low("x") - size * MARGIN), cell(high("x") + size * MARGIN))))
    slope = (F.col("b.y") - F.col("a.y")) / F.nullif(F.col("b.x") - F.col("a.x"), F.lit(0.0))
    at = lambda x: F.coalesce(F.col("a.y") + slope * (x - F.col("a.x")), F.col("a.y"))
    left, right = F.greatest(F.col("i") * size, low("x")), F.least((F.col("i") + 1) * size, high("x"))
    span = columns.withColumns({"_p": F.when(F.col("a.x") == F.col("b.x"), low("y")).otherwise(at(left)), "_q": F.when(F.col("a.x") == F.col("b.x"), high("y")).otherwise(at(right))})
    rows = F.sequence(cell(F.least("_p", "_q") - size * MARGIN), cell(F.greatest("_p", "_q") + size * MARGIN))
    border = span.select(key, "i", F.explode(rows).alias("j")).distinct()
    # rows of cells are crossed at their middle; between the first and second crossing, the third and fourth, ... it is inside
    middle = (F.col("j") + 0.5) * size
    crossed = sides.withColumn("j", F.explode(F.sequence(cell(low("y")), cell(high("y"))))).filter((F.col("a.y") > middle) != (F.col("b.y") > middle))
    crossed = crossed.select(key, "j", (F.col("a.x") + (middle - F.col("a.y")) * (F.col("b.x") - F.col("a.x")) / (F.col("b.y") - F.col("a.y"))).alias("_x"))
    row = Window.partitionBy(key, "j").orderBy("_x")
    pairs = crossed.withColumns({"_r": F.row_number().over(row), "_z": F.lead("_x").over(row)}).filter("_r % 2 = 1")
    first, last = F.ceil(F.col("_x") / size - 0.5), F.ceil(F.col("_z") / size - 0.5) - 1
    inner = pairs.select(key, F.explode(F.when(first <= last, F.sequence(first, last))).alias("i"), "j").distinct()
    inner = inner.join(border, [key, "i", "j"], "left_anti")
    return border.withColumn("inside", F.lit(False)).unionByName(inner.withColumn("inside", F.lit(True)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, key: str, vertices: str, size: float) -> DataFrame:
    """The points with the key of each polygon that holds them; a point in several comes several times, one in none goes."""
    cells = covering(polygons, key, vertices, size)
    placed = points.withColumns({"i": F.floor(F.col(x) / size), "j": F.floor(F.col(y) / size)})
    met = placed.join(cells, ["i", "j"])
    near = met.filter(~F.col("inside")).join(polygons.select(key, F.col(vertices).alias("_v")), key).filter(holds(F.col(x), F.col(y), F.col("_v")))
    return met.filter("inside").select(*points.columns, key).unionByName(near.select(*points.columns, key))


def clipped(vertices: Column, sides: Column) -> Column:
    """The vertices of what is left of a polygon within half-planes (a, b, c): where a x + b y is c at least."""
    shape = f"array<{POINT}>"
    beyond = lambda p, s: s["a"] * p["x"] + s["b"] * p["y"] - s["c"]

    def meeting(p: Column, q: Column, s: Column) -> Column:
        share = beyond(p, s) / (beyond(p, s) - beyond(q, s))
        return point(p["x"] + share * (q["x"] - p["x"]), p["y"] + share * (q["y"] - p["y"]))

    def cut(own: Column, s: Column) -> Column:
        step = lambda p, q: F.concat(F.when((beyond(p, s) >= 0) != (beyond(q, s) >= 0), F.array(meeting(p, q, s))).otherwise(F.array().cast(shape)), F.when(beyond(q, s) >= 0, F.array(q)).otherwise(F.array().cast(shape)))
        return F.flatten(F.zip_with(own, turned(own), step)).cast(shape)

    return F.aggregate(sides, vertices.cast(shape), cut)


def cell_areas(polygons: DataFrame, key: str, vertices: str, size: float) -> DataFrame:
    """(key, i, j, area): how much of each cell of a grid each polygon covers."""
    cells = covering(polygons, key, vertices, size)
    own = polygons.select(key, F.transform(F.col(vertices), lambda p: point(p["x"], p["y"])).alias("_v"))
    border = cells.filter(~F.col("inside")).join(own, key)
    side = lambda x, y, c: F.struct(F.lit(float(x)).alias("a"), F.lit(float(y)).alias("b"), (c * float(size)).cast("double").alias("c"))
    sides = F.array(side(1, 0, F.col("i")), side(-1, 0, -F.col("i") - 1), side(0, 1, F.col("j")), side(0, -1, -F.col("j") - 1))
    left = border.select(key, "i", "j", clipped(F.col("_v"), sides).alias("_left"))
    cut = left.select(key, "i", "j", area(F.col("_left")).alias("area")).filter("area > 0")
    return cells.filter("inside").select(key, "i", "j", F.lit(float(size * size)).alias("area")).unionByName(cut)


def area_means(grid: DataFrame, polygons: DataFrame, key: str, vertices: str, size: float, value: str) -> DataFrame:
    """(key, area, mean): the mean of a grid's values (i, j, value) over each polygon, weighted by area."""
    met = cell_areas(polygons, key, vertices, size).join(grid.select("i", "j", value), ["i", "j"]).filter(F.col(value).isNotNull())
    return met.groupBy(key).agg(F.sum("area").alias("area"), (F.sum(F.col(value) * F.col("area")) / F.sum("area")).alias("mean"))
