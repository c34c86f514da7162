"""Ensemble statistics: peaks, upper-middle medians, runs closest to the mean and critical durations.

Keys with a null are dropped, as the summaries name each group. Values that are NaN must be null beforehand
(``nan_to_null``). Every choice among equals is settled by the tie columns, ascending.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all known; said of each key, as joins say it, so that Spark sees one and the same shuffle."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def largest(value: str, ties: Sequence[str]) -> Column:
    """What ``min_by`` orders by to take the largest value, nulls last, then the ties ascending."""
    return F.struct(F.col(value).isNull(), -F.col(value), *[F.col(t) for t in ties])


def arg_max(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], *aggregates: Column) -> DataFrame:
    """The whole row of the largest value for each group, with further aggregates of the group."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), largest(value, ties)).alias("_best")
    out = drop_null_keys(df, keys).groupBy(*keys).agg(best, *aggregates)
    names = [c for c in out.columns if c not in (*keys, "_best")]
    return out.select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in rest], *names)


def peak_by_group(df: DataFrame, keys: Sequence[str], duration: str, value: str, ties: Sequence[str]) -> DataFrame:
    """The peak row for each group and duration, with the sizes that the peak report gives.

    ``count_tp`` is the group's size; over a group's durations ``count_tp_aep`` sums that size once for each row, and
    ``count_duration`` counts the rows.
    """
    out = arg_max(df, [*keys, duration], value, ties, F.count("*").alias("count_tp"))
    over = Window.partitionBy(*keys)
    n = F.col("count_tp")
    return out.withColumns({"count_tp_aep": F.sum(n * n).over(over), "count_duration": F.sum(n).over(over)})


def peak_of_peaks(peaks: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """The peak over durations; ``count_tp_aep`` becomes the number of durations' rows."""
    return arg_max(peaks.drop("count_tp_aep"), keys, value, ties, F.count("*").alias("count_tp_aep"))


#: Parts that an octave of values is cut into, and the bucket of nulls, which come first.
PARTS, NULLS = 8, -1_000_000
#: Rows of a table of groups that are broadcast at most.
FEW = 200_000


def bucket(value: Column) -> Column:
    """A number that rises with the value: few different ones whatever the number of rows, so that large groups come apart.

    Values of either sign go by their logarithm; 0 and null have buckets of their own.
    """
    size = 100_000 + F.floor(F.log2(F.abs(value)) * PARTS)
    place = F.when(value.isNull(), F.lit(NULLS)).when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size)
    return F.coalesce(place.cast("int"), F.lit(NULLS))


def meet(rows: DataFrame, few: DataFrame, on: Sequence[str], counted: DataFrame, nullable: Sequence[str] = ()) -> DataFrame:
    """``rows`` whose columns ``on`` are in ``few``, with its other columns; nulls meet in the ``nullable`` ones.

    ``counted`` has as many rows as ``few`` or more. Up to FEW of them ``few`` is broadcast and the rows stay where they are,
    beyond that both are shuffled; the way that isn't taken ends at a table of one row, before it reads or shuffles any.
    """
    size = counted.agg(F.count("*").alias("_size"))
    when = lambda df, which: df.join(F.broadcast(size.filter(which).select("_size")), F.lit(True), "left_semi")
    few = few.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) if c in nullable else F.col(c) == F.col(f"_on_{c}") for c in on]
    small = rows.join(F.broadcast(when(few, F.col("_size") <= FEW)), same)
    return small.unionByName(when(rows, F.col("_size") > FEW).join(few, same)).drop(*[f"_on_{c}" for c in on])


def _placed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Buckets (_b, _n) with their group's size ``_total``, and where in it the middle place lies, ``_place``, if it does."""
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.floor(F.col("_total") / 2) - before
    return parts.withColumn("_total", F.sum("_n").over(group)).withColumn("_place", place).withColumn("_place", F.when((F.col("_place") >= 0) & (F.col("_place") < F.col("_n")), F.col("_place")))


def ensemble_statistics(df: DataFrame, keys: Sequence[str], value: str, tp: str, name: str) -> DataFrame:
    """Median, mean and extremes of each ensemble, with the runs at the upper-middle place and closest to the mean.

    The median is the element at int(n / 2), counted from 0, in ascending order with nulls first; nulls count. Of runs as
    close to the mean the one of the least value, pattern and name is taken.

    Groups may be few and large, and many of their rows may have one value. No row is shuffled but those that can matter:
    buckets of values, with their first and last row, tell which one holds the middle place and which the mean. Only where
    these rows don't settle it the table is read again for the rows of that bucket, as counts by value and pattern, and once
    more for the names within the value and pattern of the middle place, if it is neither the first nor the last of them.
    Both times the table's own shuffles, if it has any, are used again. Nothing is kept or run while the query is built.
    """
    rows = drop_null_keys(df, keys).select(*keys, F.col(value).cast("double").alias("_v"), F.col(tp).alias("_t"), F.col(name).alias("_i")).withColumn("_b", bucket(F.col("_v")))
    group = Window.partitionBy(*keys)
    parts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"), F.min(F.struct("_v", "_t", "_i")).alias("_lo"), F.min(F.struct((-F.col("_v")).alias("_v"), "_t", "_i")).alias("_hi"))
    total, valued = (lambda c: F.sum(c).over(group)), F.col("_b") != NULLS
    known, whole = (total(F.when(valued & (F.col("_b") != without), F.col("_n"))) for without in (NULLS, 0))
    parts = _placed(parts, keys).withColumn("_mean", total("_s") / known).withColumn("_mb", bucket(F.col("_mean")))
    side = lambda which, c: F.min(F.when(valued & which, F.col(c))).over(group)
    own, under, over = (F.col("_b") == F.col("_mb")), (F.col("_b") < F.col("_mb")), (F.col("_b") > F.col("_mb"))
    told = {
        "_whole": total("_s") / whole, "_low": F.min("_lo._v").over(group), "_high": -F.min("_hi._v").over(group), "_none": F.min(F.when(~valued, F.col("_lo"))).over(group),
        "_under": side(under, "_hi"), "_over": side(over, "_lo"), "_own": side(own, "_lo"), "_own_hi": side(own, "_hi"),
    }
    groups = parts.withColumns(told).filter(F.col("_place").isNotNull()).drop("_b", "_s", "_hi", "_mb")
    opened = parts.filter((F.col("_place") > 0) | (valued & own & (F.col("_n") > 2) & (F.col("_lo._v") < -F.col("_hi._v")))).select(*keys, "_b", "_place", F.when(own, F.col("_mean")).alias("_mean"))
    values = meet(rows, opened, [*keys, "_b"], opened).groupBy(*keys, "_b", "_v", "_t").agg(
        F.count("*").alias("_c"), F.min(F.struct("_t", "_i")).alias("_first"), F.max("_i").alias("_last"), F.first("_place").alias("_place"), F.first("_mean").alias("_mean")
    )
    order = Window.partitionBy(*keys, "_b").orderBy(F.col("_v").asc_nulls_first(), F.col("_t").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_at", F.col("_place") - F.coalesce(F.sum("_c").over(order), F.lit(0)))
    here = (F.col("_at") >= 0) & (F.col("_at") < F.col("_c"))
    distance = lambda v, t, i: F.struct(F.abs(v - F.col("_mean")).alias("d"), v.alias("v"), t.alias("t"), i.alias("i"))
    row = lambda c, sign=1: F.when(F.col(c).isNotNull(), distance(F.col(f"{c}._v") * sign, F.col(f"{c}._t"), F.col(f"{c}._i")))
    picked = values.groupBy(*keys).agg(
        F.max(F.when(here, F.struct("_v", "_at", "_c", "_first", "_last"))).alias("_m"), F.min(F.when(F.col("_mean").isNotNull() & F.col("_v").isNotNull(), distance(F.col("_v"), F.col("_first._t"), F.col("_first._i")))).alias("_close"),
    )
    within = picked.filter((F.col("_m._at") > 0) & (F.col("_m._at") < F.col("_m._c") - 1)).select(*keys, F.col("_m._v").alias("_v"), F.col("_m._first._t").alias("_t"), F.col("_m._at").alias("_ma"))
    names = meet(rows.drop("_b"), within, [*keys, "_v", "_t"], opened, ["_v", "_t"]).groupBy(*keys, "_i").agg(F.count("*").alias("_c"), F.first("_ma").alias("_ma"))
    names = names.withColumn("_to", F.sum("_c").over(group.orderBy(F.col("_i").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    names = names.filter((F.col("_to") > F.col("_ma")) & (F.col("_to") - F.col("_c") <= F.col("_ma"))).groupBy(*keys).agg(F.min(F.struct("_i")).alias("_within"))
    out = groups.join(picked, list(keys), "left").join(names, list(keys), "left")
    out = out.withColumn("_near", F.least("_close", row("_own"), row("_own_hi", -1), row("_under", -1), row("_over")))
    first = F.col("_place") == 0
    median_name = F.when(first, F.col("_lo._i")).when(F.col("_within").isNotNull(), F.col("_within._i")).when(F.col("_m._at") == 0, F.col("_m._first._i")).otherwise(F.col("_m._last"))
    columns = {"median": F.when(first, F.col("_lo._v")).otherwise(F.col("_m._v")), "median_tp": F.when(first, F.col("_lo._t")).otherwise(F.col("_m._first._t")), "median_name": median_name}
    columns |= {"mean_including_zeroes": F.col("_mean"), "mean_excluding_zeroes": F.col("_whole"), "low": F.col("_low"), "high": F.col("_high"), "count_tp": F.col("_total")}
    columns |= {"mean_peak": F.col("_near.v"), "mean_tp": F.coalesce("_near.t", "_none._t"), "mean_name": F.coalesce("_near.i", "_none._i")}
    out = out.select(*keys, *[c.alias(n) for n, c in columns.items()])
    return out.withColumn("mean_is_median", F.col("mean_name").eqNullSafe(F.col("median_name")))


def upper_medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Size, extremes and the upper-middle value of each group, as ``ensemble_statistics`` has them, without its runs.

    Only the bucket of the middle place is opened, as counts by value, and only if it holds several values.
    """
    rows = drop_null_keys(df, keys).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_b", bucket(F.col("_v")))
    parts = _placed(rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), keys)
    group = Window.partitionBy(*keys)
    groups = parts.withColumns({"low": F.min("_lo").over(group), "high": F.max("_hi").over(group)})
    groups = groups.filter(F.col("_place").isNotNull() & (F.col("low").isNull() | (F.col("low") <= F.col("high"))))  # both are named wherever it is used: one shuffle
    opened = parts.filter((F.col("_place") > 0) & (F.col("_lo") < F.col("_hi"))).select(*keys, "_b", "_place")
    values = meet(rows, opened, [*keys, "_b"], opened).groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_c"), F.first("_place").alias("_at"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    middle = values.withColumn("_to", upto).filter(F.col("_to") > F.col("_at")).groupBy(*keys).agg(F.min("_v").alias("_m"))
    return groups.join(middle, list(keys), "left").select(*keys, F.coalesce("_m", "_lo").alias("median"), "low", "high", F.col("_total").alias("count_tp"))


def median_by_group(df: DataFrame, keys: Sequence[str], duration: str, value: str, tp: str, name: str) -> DataFrame:
    """Ensemble statistics for each group and duration, with counts over the group's durations."""
    over = Window.partitionBy(*keys)
    out = ensemble_statistics(df, [*keys, duration], value, tp, name)
    return out.withColumns({"count_tp_aep": F.sum("count_tp").over(over), "count_duration": F.count("*").over(over)})


def median_max(medians: DataFrame, keys: Sequence[str], duration: str) -> DataFrame:
    """For each group the duration of the largest median and, chosen on its own, that of the largest mean."""
    cols = ["median", "median_tp", "median_name", "low", "high", "count_tp"]
    means = ["mean_peak", "mean_tp", "mean_name", "mean_including_zeroes"]
    take = lambda names, by: F.min_by(F.struct(duration, *names), largest(by, [duration]))
    out = medians.groupBy(*keys).agg(take(cols, "median").alias("m"), take(means, "mean_peak").alias("a"), F.count("*").alias("count_tp_aep"))
    picked = [F.col(f"m.{duration}").alias("median_duration"), *[F.col(f"m.{c}").alias(c) for c in cols]]
    return out.select(*keys, *picked, F.col(f"a.{duration}").alias("mean_duration"), *[F.col(f"a.{c}").alias(c) for c in means], "count_tp_aep")


def mean_by_group(medians: DataFrame, keys: Sequence[str], duration: str) -> DataFrame:
    """The mean's columns of ``median_by_group``."""
    return medians.select(*keys, duration, "mean_including_zeroes", "mean_peak", "mean_tp", "mean_name", "low", "high", "count_tp", "count_tp_aep", "count_duration")


def mean_max(means: DataFrame, keys: Sequence[str], duration: str) -> DataFrame:
    """The duration of the largest run closest to the mean, with the sum of sizes and the number of durations."""
    return arg_max(means.drop("count_tp_aep", "count_duration"), keys, "mean_peak", [duration], F.sum("count_tp").alias("count_tp_aep"), F.count("*").alias("count_duration"))


def critical_median(df: DataFrame, keys: Sequence[str], duration: str, value: str, tp: str, name: str) -> DataFrame:
    """Statistics of the duration with the largest median; low, high and count are over all durations.

    Durations are text, so of equal medians the duration that sorts first as text wins.
    """
    stats = ensemble_statistics(df, [*keys, duration], value, tp, name)
    over_all = [F.min("low").alias("low_all"), F.max("high").alias("high_all"), F.sum("count_tp").alias("count_all"), F.count("*").alias("count_duration")]
    return arg_max(stats, keys, "median", [duration], *over_all).drop("low", "high", "count_tp")


def statistic_of_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str], statistic: str, adopt: str, name: str) -> DataFrame:
    """Mean, or upper-middle median, of several columns for each group, their extremes, and the run whose ``adopt``
    value is closest to that column's statistic."""
    df = drop_null_keys(df, keys).select(*keys, *columns, F.col(name).alias("_name"))
    spans = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    if statistic == "mean":
        stats = df.groupBy(*keys).agg(F.count("*").alias("count_bin"), *[F.avg(c).alias(f"{c}_mean") for c in columns], *spans)
    else:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns]))
        long = df.select(*keys, each.alias("_e")).select(*keys, "_e._column", "_e._value")
        medians = upper_medians(long, [*keys, "_column"], "_value")
        of = lambda c, what: F.max(F.when(F.col("_column") == c, F.col(what)))
        spans = [of(c, what).alias(f"{c}_{n}") for c in columns for n, what in (("min", "low"), ("max", "high"))]
        stats = medians.groupBy(*keys).agg(F.max("count_tp").alias("count_bin"), *[of(c, "median").alias(f"{c}_median") for c in columns], *spans)
    near = F.struct(F.col(adopt).isNull(), F.abs(F.col(adopt) - F.col("_s")), F.col("_name"))
    told = [c for c in stats.columns if c not in keys]
    rows = meet(df.select(*keys, adopt, "_name"), stats.select(*keys, F.col(f"{adopt}_{statistic}").alias("_s")), keys, stats)
    adopted = rows.groupBy(*keys).agg(F.min_by("_name", near).alias("adopted_name"), F.min_by(adopt, near).alias("adopted_value"))
    return stats.join(adopted, list(keys)).select(*keys, *told, "adopted_name", "adopted_value")


def preferred_column(columns: Sequence[str], preferred: Sequence[str]) -> str:
    return next((c for c in preferred if c in columns), columns[0])


def critical_duration(stats: DataFrame, keys: Sequence[str], duration: str, value: str) -> DataFrame:
    """The duration with the largest statistic, and how many durations have one."""
    return arg_max(stats, keys, value, [duration], F.count(value).alias("duration_bin"))


def critical_runs(df: DataFrame, keys: Sequence[str], duration: str, value: str, name: str) -> DataFrame:
    """The run closest to the mean of the duration whose mean is largest, for each group."""
    means = drop_null_keys(df, [*keys, duration]).groupBy(*keys, duration).agg(F.avg(value).alias("mean"))
    top = arg_max(means, keys, "mean", [duration])
    near = F.struct(F.abs(F.col(value) - F.col("mean")), F.col(name))
    runs = df.join(top, [*keys, duration]).filter(F.col(value).isNotNull())
    return runs.groupBy(*keys, duration, "mean").agg(F.min_by(name, near).alias("critical_name"), F.min_by(value, near).alias("critical_value"))
