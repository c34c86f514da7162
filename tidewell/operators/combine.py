"""Unions, joins and overlays of result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ensemble import drop_null_keys


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def max_of_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The largest value of every other column for each group; text compares by code points."""
    return drop_null_keys(df, keys).groupBy(*keys).agg(*[F.max(f"`{c}`").alias(c) for c in df.columns if c not in keys])


def overlay(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join; a column of both takes the right value, and the left one where that is null."""
    both = [c for c in left.columns if c in right.columns and c not in keys]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in both})
    out = left.join(renamed, list(keys), "full_outer")
    rest = [c for c in right.columns if c not in (*both, *keys)]
    return out.select(*keys, *[F.coalesce(f"_r_{c}", c).alias(c) if c in both else F.col(c) for c in left.columns if c not in keys], *rest)


def add_static(df: DataFrame, static: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of those static columns that ``df`` lacks; of several rows of a key the least by these columns, in order."""
    new = [c for c in static.columns if c not in df.columns]
    one = static.groupBy(*keys).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in new])).alias("_one")) if new else static.select(*keys).distinct()
    return df.join(one, list(keys), "left").select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_one.`{c}`").alias(c) for c in new])


def lookup(df: DataFrame, known: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join of columns of a lookup table, replacing any of these names; of several rows of a key the least one's."""
    others = [c for c in df.columns if c not in columns]
    return add_static(df.select(*[F.col(f"`{c}`") for c in others]), known.select(*keys, *columns), keys)


def outer_all(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of all frames on the keys; other columns must have names of their own."""
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), frames)


def last_file_of_run(df: DataFrame, run: str, order: str) -> DataFrame:
    """Rows of the last file of each run."""
    return df.withColumn("_last", F.max(order).over(Window.partitionBy(run))).filter(F.col("_last") == F.col(order)).drop("_last")


def combine_maximums(tables: Sequence[DataFrame], geometry: DataFrame | None, run: str, entity: str) -> DataFrame:
    """Maxima of all tables by run and entity over a geometry overlay, whose values win; runs with geometry alone are
    added if there are maxima at all."""
    out = max_of_columns(union_all(tables), [run, entity])
    if geometry is None:
        return out
    some = out.select(F.lit(1).alias("_any")).limit(1)
    return overlay(out, geometry.join(some, F.lit(True), "left_semi"), [run, entity])


def combine_timeseries(tables: Sequence[DataFrame], static: DataFrame, run: str, entity: str, time: str) -> DataFrame:
    return add_static(max_of_columns(union_all(tables), [run, entity, time]), static, [run, entity])


def headwater_ratio(head: Column, invert: Column, height: Column) -> Column:
    return F.when(height != 0, (head - invert) / height)


def resolve_ids(full: DataFrame, keys: Sequence[str], key: str, identifier: str) -> DataFrame:
    """(keys, key, resolved): identifiers that are the only one of their match key."""
    found = full.filter(F.col(key).isNotNull()).groupBy(*keys, key).agg(F.min(identifier).alias("resolved"), F.max(identifier).alias("_hi"))
    return found.filter(F.col("resolved") == F.col("_hi")).drop("_hi")


def align_ids(df: DataFrame, full: DataFrame, keys: Sequence[str], key: str, identifier: str) -> DataFrame:
    """``df`` with truncated identifiers replaced by the full one of the same match key, if there is just one."""
    out = df.join(resolve_ids(full, keys, key, identifier), [*keys, key], "left")
    return out.withColumn(identifier, F.coalesce("resolved", identifier)).drop("resolved")


def update_attributes(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Common columns of ``target`` taken from the source row of equal keys, where there is one; ``matched`` says so.

    Of several source rows the least by these columns, in order, is taken.
    """
    common = [c for c in target.columns if c in source.columns and c not in keys]
    taken = source.groupBy(*keys).agg(F.min(F.struct(F.lit(True).alias("_there"), *common)).alias("_s"))
    out = target.join(taken, list(keys), "left").withColumn("matched", F.col("_s").isNotNull())
    return out.select(*[F.when(F.col("matched"), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) if c in common else F.col(c) for c in target.columns], "matched")


def normalise_files(df: DataFrame, columns: Sequence[str], file_id: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """(facts with a file id, dimension of files); the id is a hash of the file's columns."""
    ident = F.xxhash64(*columns)
    return df.withColumn(file_id, ident).drop(*columns), df.select(ident.alias(file_id), *columns).distinct()


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


#: Parts of a grid cell's side that dense cells are told apart by.
FINE = 8


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, x: str, y: str, max_dist: float) -> DataFrame:
    """The nearest right point within ``max_dist`` of each left point; of several as near the one of the least id.

    Cells of a grid of that size are cut into small ones. A left point meets the small cells that hold any point, 64 of each
    of nine cells at most, and keeps those whose nearest corner is no farther than the farthest corner of another; only the
    points in these are measured, however many lie in the cells around.
    """
    small = max_dist / FINE
    at = lambda c, size: F.floor(F.col(c) / size)
    points = right.select(right_id, F.col(x).alias("_rx"), F.col(y).alias("_ry"), at(x, small).alias("_u"), at(y, small).alias("_v"))
    held = points.select("_u", "_v").distinct().select(F.floor(F.col("_u") / FINE).alias("_i"), F.floor(F.col("_v") / FINE).alias("_j"), "_u", "_v")
    around = F.explode(F.expr("transform(sequence(0, 8), i -> named_struct('i', cast(i div 3 as long) - 1, 'j', i % 3 - 1))"))
    probe = left.select(left_id, F.col(x).alias("_x"), F.col(y).alias("_y"), around.alias("_o"), F.floor(at(x, small) / FINE).alias("_i"), F.floor(at(y, small) / FINE).alias("_j"))
    probe = probe.select(left_id, "_x", "_y", (F.col("_i") + F.col("_o.i")).alias("_i"), (F.col("_j") + F.col("_o.j")).alias("_j"))
    away = lambda p, c: F.greatest(F.lit(0.0), F.col(c) * small - F.col(p), F.col(p) - (F.col(c) + 1) * small)
    across = lambda p, c: F.greatest(F.abs(F.col(p) - F.col(c) * small), F.abs(F.col(p) - (F.col(c) + 1) * small))
    square = lambda a, b: a * a + b * b
    met = probe.join(held, ["_i", "_j"]).withColumns({"_low": square(away("_x", "_u"), away("_y", "_v")), "_high": square(across("_x", "_u"), across("_y", "_v"))})
    met = met.filter(F.col("_low") <= max_dist * max_dist * (1 + 1e-9))
    own = met.groupBy(left_id, "_x", "_y").agg(F.min("_high").alias("_most"), F.collect_list(F.struct("_u", "_v", "_low")).alias("_cells"))
    kept = own.select(left_id, "_x", "_y", F.explode(F.filter("_cells", lambda c: c["_low"] <= F.col("_most") * (1 + 1e-9))).alias("_c"))
    near = kept.select(left_id, "_x", "_y", "_c._u", "_c._v").join(points, ["_u", "_v"]).withColumn("_d2", square(F.col("_x") - F.col("_rx"), F.col("_y") - F.col("_ry")))
    best = near.filter(F.col("_d2") <= max_dist * max_dist).groupBy(left_id).agg(F.min(F.struct("_d2", right_id)).alias("b"))
    return best.select(left_id, F.col(f"b.{right_id}").alias(right_id), F.sqrt("b._d2").alias("distance"))
