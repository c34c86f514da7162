"""Time-series operators: exceedance durations, closure summaries, stability and peak checks, ordered helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ensemble import drop_null_keys, ensemble_statistics


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of which a null equals a null."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    equal = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(named, equal).drop(*[f"_k_{k}" for k in keys])


def _counted(df: DataFrame, keys: Sequence[str], time: str, what: Column) -> DataFrame:
    """(keys, time, _b, _n): rows of a series counted by time and by ``what``. All that is asked of a series comes from this
    one shuffle; each use reads ``_n``, so that all uses have the same columns and Spark runs it once."""
    return df.filter(F.col(time).isNotNull()).groupBy(*keys, time, what.alias("_b")).agg(F.count("*").alias("_n"))


def _steps(counted: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    rows = counted.filter("_n > 0")
    least = rows.groupBy(*keys).agg(F.min(time).alias("_t0"))
    after = join_keys(rows, least, keys).filter(F.col(time) > F.col("_t0"))
    return after.groupBy(*keys, "_t0").agg((F.min(time) - F.col("_t0")).alias("step")).drop("_t0")


def first_steps(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """(keys, step): the difference of the two least distinct times, kept as two values and never as a list."""
    return _steps(_counted(df, keys, time, F.lit(0)), keys, time)


def exceedance_durations(df: DataFrame, keys: Sequence[str], time: str, value: str, thresholds: Sequence[float]) -> DataFrame:
    """Time that each series is above each threshold: the count of values above times the first step; zeros are left out.

    Each value is put into a bucket once and counts are summed from the highest bucket down, so rows don't multiply with
    thresholds. Rows without time or value count for nothing, the step included; keys may be null. A series with one
    distinct time has no step and no rows.
    """
    limits = sorted(set(thresholds))
    above = F.array(*[F.lit(float(t)) for t in limits])
    counted = _counted(df.filter(F.col(time).isNotNull()).filter(F.col(value).isNotNull()), keys, time, F.size(F.filter(above, lambda t: F.col(value) > t)))
    down = Window.partitionBy(*keys).orderBy(F.desc("_b"))
    counts = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    counts = counts.withColumn("_c", F.sum("_n").over(down)).withColumn("_next", F.coalesce(F.lead("_b").over(down), F.lit(0)))
    each = counts.withColumn("_i", F.explode(F.when(F.col("_next") < F.col("_b"), F.sequence(F.col("_next") + 1, F.col("_b")))))
    each = each.select(*keys, F.element_at(above, F.col("_i")).alias("threshold"), F.col("_c").alias("n_above"))
    return join_keys(each, _steps(counted, keys, time), keys).withColumn("duration_exceeding", F.col("n_above") * F.col("step"))


def exceedance_durations_plain(df: DataFrame, keys: Sequence[str], time: str, value: str, thresholds: Sequence[float]) -> DataFrame:
    """The same by one conditional sum for each threshold."""
    df = df.dropna(subset=[time, value])
    sums = [F.sum(F.when(F.col(value) > t, 1).otherwise(0)).alias(f"_t{i}") for i, t in enumerate(thresholds)]
    wide = df.groupBy(*keys).agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("n_above")) for i, t in enumerate(thresholds)]))
    each = wide.select(*keys, rows.alias("r")).select(*keys, "r.threshold", "r.n_above").filter("n_above > 0")
    return join_keys(each, first_steps(df, keys, time), keys).withColumn("duration_exceeding", F.col("n_above") * F.col("step"))


def zero_filled(exceeding: DataFrame, keys: Sequence[str], member: Sequence[str], value: str) -> DataFrame:
    """Adds a zero for each threshold that a member of a group doesn't exceed, if the group exceeds it and the member
    any: the members and the thresholds that exist are paired within the group.

    A member's thresholds, few as they are, go into one row; keys and members that are null have no rows.
    """
    own = drop_null_keys(exceeding, [*keys, *member]).groupBy(*keys, *member).agg(F.collect_list(F.struct(F.col("threshold").alias("t"), F.col(value).alias("v"))).alias("_own"))
    limits = own.select(*keys, F.explode("_own").alias("_e")).groupBy(*keys).agg(F.collect_set(F.col("_e.t")).alias("_limits"))
    each = own.join(limits, list(keys)).select(*keys, *member, "_own", F.explode("_limits").alias("threshold"))
    held = F.filter("_own", lambda e: e["t"] == F.col("threshold"))
    return each.select(*keys, *member, "threshold", F.coalesce(F.get(held, F.lit(0))["v"], F.lit(0.0)).alias(value))


def closure_summary(exceeding: DataFrame, keys: Sequence[str], duration: str, tp: str, value: str, zero_fill: bool) -> DataFrame:
    """Central, low, high and average time above a threshold: the duration with the largest upper-middle value."""
    if zero_fill:
        exceeding = zero_filled(exceeding, keys, [duration, tp], value)
    group = [*keys, "threshold"]
    stats = ensemble_statistics(exceeding, [*group, duration], value, tp, tp)
    best = F.min_by(F.struct("median", duration, "median_tp", "mean_including_zeroes", "mean_tp", "mean_peak"), F.struct(F.col("median").isNull(), -F.col("median"), F.col(duration)))
    out = stats.groupBy(*group).agg(best.alias("b"), F.min("low").alias("low_value"), F.max("high").alias("high_value"))
    names = {"median": "central_value", duration: "critical_duration", "median_tp": "critical_tp", "mean_including_zeroes": "average_value", "mean_tp": "closest_tp", "mean_peak": "closest_value"}
    return out.select(*group, *[F.col(f"b.{a}").alias(b) for a, b in names.items()], "low_value", "high_value")


def stability_check(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
    flat_tol: float = 1e-6, rel_tol: float = 0.02, abs_tol: float = 1e-3, max_sign_changes: int = 10, min_points: int = 3,
) -> DataFrame:
    """Counts changes of direction between the steps of a series that pass the tolerance, and gives a status.

    The tolerance is the larger of ``abs_tol`` and ``rel_tol`` times the range; smaller steps are left out before.
    """
    series = Window.partitionBy(*keys)
    line = series.orderBy(*order)
    known = df.filter(F.col(value).isNotNull())
    tolerance = F.greatest(F.lit(abs_tol), F.lit(rel_tol) * (F.max(value).over(series) - F.min(value).over(series)))
    step = known.withColumns({"_d": F.col(value) - F.lag(value).over(line), "_tol": tolerance})
    signs = step.filter(F.abs("_d") > F.col("_tol")).withColumn("_s", F.signum("_d"))
    flips = signs.withColumn("_flip", (F.col("_s") * F.lag("_s").over(line) < 0).cast("int")).groupBy(*keys).agg(F.coalesce(F.sum("_flip"), F.lit(0)).alias("sign_changes"))
    ordered = F.struct(*order)
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n_points"), F.min_by(value, F.when(F.col(value).isNotNull(), ordered)).alias("first_value"),
        F.max_by(value, F.when(F.col(value).isNotNull(), ordered)).alias("last_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
    )
    out = out.join(flips, list(keys), "left").withColumn("sign_changes", F.coalesce("sign_changes", F.lit(0)))
    n, span = F.col("n_points"), F.col("max_value") - F.col("min_value")
    status = F.when(n == 0, "NO_DATA").when(n < max(min_points, 2), "INSUFFICIENT_POINTS").when(span <= flat_tol, "FLAT")
    return out.withColumn("status", status.when(F.col("sign_changes") > max_sign_changes, "UNSTABLE").otherwise("OK"))


def peak_check(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, value: str, warn_1: float = 1.0, warn_2: float = 2.0, flat_tol: float = 1e-6) -> DataFrame:
    """How long before its end a series is farthest from its first known value, and a warning if that is late.

    The end is the last row with a time; its value may be unknown. A series that moves by ``flat_tol`` at most is of the
    kind ``flat``, and is warned of like any other; its end is 0 per cent of the peak if it is at the start's value.
    """
    ordered, known = F.struct(*order), F.when(F.col(value).isNotNull(), F.struct(*order))
    timed = F.when(F.col(time).isNotNull(), ordered)
    start = df.groupBy(*keys).agg(F.min_by(value, known).alias("start_value"), F.max_by(time, timed).alias("end_time"), F.max_by(value, timed).alias("end_value"))
    far = F.struct(F.col("_far").isNull(), -F.col("_far"), *[F.col(c) for c in order])
    moved = join_keys(df, start, keys).withColumn("_far", F.abs(F.col(value) - F.col("start_value")))
    out = moved.groupBy(*keys, "start_value", "end_time", "end_value").agg(F.min_by(value, far).alias("peak_value"), F.min_by(F.when(F.col(value).isNotNull(), F.col(time)), far).alias("peak_time"))
    above, ends = F.col("peak_value") - F.col("start_value"), F.col("end_value") - F.col("start_value")
    hours = F.col("end_time") - F.col("peak_time")
    kind = F.when(above.isNull(), None).when(F.abs(above) <= flat_tol, "flat").when(above > 0, "max").otherwise("min")
    share = F.when(F.abs(above) > flat_tol, F.abs(ends) / F.abs(above) * 100).when(F.abs(ends) <= flat_tol, 0.0)
    status = F.when(F.col("start_value").isNull(), "NO_DATA").when(F.col("peak_time").isNull(), "TIME_PARSE_FAIL").when(hours < warn_1, "WARN_1H").when(hours < warn_2, "WARN_2H").otherwise("OK")
    return out.withColumns({"peak_kind": kind, "peak_above_start": above, "end_minus_start": ends, "hours_from_end": hours, "end_percent_of_peak": share, "status": status}).withColumn(
        "end_value", F.when(F.col("start_value").isNotNull(), F.col("end_value"))
    )


def running_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column) -> DataFrame:
    """A group number that rises at each row where ``starts`` holds, and the place of a row in its series."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"group_id": F.sum(F.when(starts, 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(line)})


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last known ``value`` up to each row."""
    line = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(line))


def row_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Folds rows 1 and 2, 3 and 4, ... into one; a last single row is dropped."""
    line = Window.partitionBy(*keys).orderBy(*order)
    seconds = {f"{c}_second": F.lead(c).over(line) for c in columns}
    out = df.withColumns({"_r": F.row_number().over(line), "_more": F.lead(F.lit(1)).over(line), **seconds})
    return out.filter("_r % 2 = 1 and _more is not null").withColumn("pair", ((F.col("_r") + 1) / 2).cast("int")).select(*keys, "pair", *[F.col(c).alias(f"{c}_first") for c in columns], *seconds)


def equal_area_slope(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Area under a profile by trapezoids above its lowest end, and the slope of the triangle of equal area."""
    line = Window.partitionBy(*keys).orderBy(x, y)
    part = (F.col(x) - F.lag(x).over(line)) * (F.col(y) + F.lag(y).over(line)) / 2
    out = df.withColumn("_a", part).groupBy(*keys).agg(F.sum("_a").alias("area"), (F.max(x) - F.min(x)).alias("length"))
    return out.withColumn("slope", F.when(F.col("length") != 0, 2 * F.col("area") / (F.col("length") * F.col("length"))))


def level_crossings(df: DataFrame, keys: Sequence[str], x: str, y: str, level: Column) -> DataFrame:
    """Where a piecewise linear profile meets ``level``."""
    line = Window.partitionBy(*keys).orderBy(x, y)
    d = df.withColumn("_d", F.col(y) - level).withColumns({"_x0": F.lag(x).over(line), "_d0": F.lag("_d").over(line)})
    return d.filter("_d0 * _d < 0").withColumn("crossing", F.col("_x0") + (F.col(x) - F.col("_x0")) * F.col("_d0") / (F.col("_d0") - F.col("_d"))).drop("_d", "_x0", "_d0")


def plot_times(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str = "Time", name: str = "plot_time") -> DataFrame:
    """``df`` with a time to draw by: the column's timestamp, rows without one left out; the row's place where there is no such column."""
    if time in df.columns:
        kind = dict(df.dtypes)[time]
        own = F.col(time).cast("timestamp") if kind.startswith(("timestamp", "date")) else F.try_to_timestamp(F.col(time).cast("string"))
        return df.withColumn(name, own).filter(F.col(name).isNotNull())
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
