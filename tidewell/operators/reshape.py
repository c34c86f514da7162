"""Wide to long and back, transposition, stacking of metrics, cross products of run variables, grids and tiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """A row for each value that is not null."""
    return df.unpivot([quoted(c) for c in ids], [quoted(c) for c in columns], name, value).filter(quoted(value).isNotNull())


def split_suffix(column: str) -> tuple[Column, Column]:
    """What stands before and after the last dot; both null without one."""
    part = lambda k: F.when(quoted(column).rlike(r"^.*\.[^.]*$"), F.regexp_extract(quoted(column), r"^(.*)\.([^.]*)$", k))
    return part(1), part(2)


def suffix_pivot(df: DataFrame, ids: Sequence[str], node: str, value: str, names: dict[str, str]) -> DataFrame:
    """Values of ``base.1`` and ``base.2`` side by side; other suffixes are dropped."""
    base, suffix = split_suffix(node)
    long = df.select(*[quoted(c) for c in ids], base.alias("entity"), suffix.alias("_suffix"), quoted(value).alias("_v"))
    picked = [F.min(F.when(F.col("_suffix") == s, F.col("_v"))).alias(n) for s, n in names.items()]
    return long.filter(F.col("_suffix").isin(list(names))).groupBy(*[quoted(c) for c in ids], "entity").agg(*picked)


def stack_metrics(df: DataFrame, ids: Sequence[str], metrics: dict[str, dict[str, str]], kinds: dict[str, str]) -> DataFrame:
    """A row for each metric: ``metrics`` gives the source column of each output column, others are null."""
    one = lambda m: F.struct(*[(quoted(m[c]) if c in m else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    return df.select(*[quoted(c) for c in ids], F.explode(F.array(*[one(m) for m in metrics.values()])).alias("m")).select(*[quoted(c) for c in ids], "m.*")


def transpose(cells: DataFrame, keys: Sequence[str], column: str, label: str, value: str, labels: Sequence[str]) -> DataFrame:
    """Labelled rows of cells as columns, a row for each former column."""
    return cells.groupBy(*keys, column).pivot(label, list(labels)).agg(F.min(value))


def cross_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every combination of the distinct values of each column; the columns must have few."""
    out = df.select(columns[0]).distinct()
    for c in columns[1:]:
        out = out.crossJoin(df.select(c).distinct())
    return out


def cross_product(spark, variables: dict[str, Sequence[str]]) -> DataFrame:
    """All combinations of run variables, a bounded table of parameters."""
    frames = [spark.createDataFrame([(v,) for v in values], f"`{name}` string") for name, values in variables.items()]
    return reduce(lambda a, b: a.crossJoin(b), frames)


def fill_grid(points: DataFrame, x: str, y: str, z: str, fill: float) -> DataFrame:
    """Every pair of an x and a y that occur, with ``fill`` where there is no point. The grid is what is asked for."""
    grid = points.select(x).distinct().crossJoin(points.select(y).distinct())
    least = points.groupBy(x, y).agg(F.max(z).alias(z))
    return grid.join(least, [x, y], "left").withColumn(z, F.coalesce(z, F.lit(fill)))


def tiles(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Points with the tile that holds them, counted from the least x and y; tiles are half open."""
    corner = F.broadcast(points.agg(F.min(x).alias("_x0"), F.min(y).alias("_y0")))
    out = points.crossJoin(corner)
    return out.withColumns({"tile_i": F.floor((F.col(x) - F.col("_x0")) / size), "tile_j": F.floor((F.col(y) - F.col("_y0")) / size)}).drop("_x0", "_y0")


def tile_bounds(spark, xmin: float, ymin: float, xmax: float, ymax: float, size: float) -> DataFrame:
    n, m = (max(1, int(-(-(b - a) // size))) for a, b in ((xmin, xmax), (ymin, ymax)))
    cells = spark.range(n * m).select((F.col("id") % n).alias("tile_i"), F.floor(F.col("id") / n).alias("tile_j"))
    return cells.withColumns({"x0": xmin + F.col("tile_i") * size, "y0": ymin + F.col("tile_j") * size})


def thin(cells: DataFrame, row: str, col: str, z: str, factor: int) -> DataFrame:
    return cells.filter((F.col(row) % factor == 0) & (F.col(col) % factor == 0) & F.col(z).isNotNull())


def raster_max(cells: DataFrame, row: str, col: str, z: str) -> DataFrame:
    return cells.groupBy(row, col).agg(F.max(z).alias(z))


def raster_difference(a: DataFrame, b: DataFrame, row: str, col: str, z: str) -> DataFrame:
    return a.join(b.withColumnRenamed(z, "_z"), [row, col]).select(row, col, (F.col(z) - F.col("_z")).alias("difference"))


def masked(values: DataFrame, mask: DataFrame, row: str, col: str, z: str, scale: int, depth: str, least: float, nodata: float) -> DataFrame:
    """Values where the coarse cell's greatest depth reaches ``least``, else ``nodata``."""
    coarse = lambda c: F.floor(F.col(c) / scale)
    deep = mask.groupBy(coarse(row).alias("_r"), coarse(col).alias("_c")).agg(F.max(depth).alias("_d"))
    out = values.withColumns({"_r": coarse(row), "_c": coarse(col)}).join(deep, ["_r", "_c"], "left")
    return out.withColumn(z, F.when(F.col("_d") >= least, F.col(z)).otherwise(F.lit(nodata))).drop("_r", "_c", "_d")


def in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Whether a point is inside or on the edge, after a bounding box; the polygon is a parameter."""
    edges = list(zip(polygon, [*polygon[1:], polygon[0]], strict=True))
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    crossed, on = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in edges:
        turn = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on = on | ((turn == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            crossed = crossed + F.when(((y < y1) != (y < y2)) & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))), 1).otherwise(0)
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (on | (crossed % 2 == 1))


def signed_peak(high: Column, low: Column) -> tuple[Column, Column]:
    """(size, value) of whichever of two extremes is farther from 0; the high one if they are as far."""
    return F.greatest(F.abs(high), F.abs(low)), F.when(F.abs(high) >= F.abs(low), high).otherwise(low)
