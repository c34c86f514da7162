"""One query for each operator on the star schema, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import hydro, scenario
from tidewell.operators import combine, ensemble, quality, reshape, series as ts
from tidewell.plans.bindings import SERIES, STORM, series, storm, table
from tidewell.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ["aep", "location", "type", "run"]
K = "aep, location, type, run"
#: Averages are compared at four digits; the shift keeps exact halves from rounding either way.
DIGITS, SHIFT = 4, 1e-9


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + SHIFT, DIGITS) for c in columns})


# ---- ensembles

PEAKS = f"""peaks AS (SELECT {K}, duration, tp, name, abs_max, v, us_h, ds_h, n AS count_tp, sum(n * n) OVER (PARTITION BY {K}) AS count_tp_aep, sum(n) OVER (PARTITION BY {K}) AS count_duration FROM
  (SELECT *, row_number() OVER (PARTITION BY {K}, duration ORDER BY abs_max DESC NULLS LAST, tp, name) AS rn, count(*) OVER (PARTITION BY {K}, duration) AS n FROM storm) WHERE rn = 1)"""


def _peaks(spark, d):
    return ensemble.peak_by_group(storm(spark, d), KEYS, "duration", "abs_max", ["tp", "name"])


@query("peak_by_group", f"WITH {STORM}, {PEAKS} SELECT {K}, duration, tp, name, abs_max, v, us_h, ds_h, count_tp, CAST(count_tp_aep AS BIGINT) AS count_tp_aep, CAST(count_duration AS BIGINT) AS count_duration FROM peaks")
def peak_by_group(spark, d):
    return _peaks(spark, d)


@query("peak_of_peaks", f"""WITH {STORM}, {PEAKS} SELECT {K}, duration, tp, name, abs_max, n AS count_tp_aep FROM
  (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY abs_max DESC NULLS LAST, duration, tp, name) AS rn, count(*) OVER (PARTITION BY {K}) AS n FROM peaks) WHERE rn = 1""")
def peak_of_peaks(spark, d):
    out = ensemble.peak_of_peaks(_peaks(spark, d), KEYS, "abs_max", ["duration", "tp", "name"])
    return out.select(*KEYS, "duration", "tp", "name", "abs_max", "count_tp_aep")


def stats_sql(source: str, keys: str, value: str, tp: str, name: str, out: str = "stats") -> str:
    return f"""{out} AS (SELECT {keys}, max(CASE WHEN rn = n // 2 + 1 THEN {value} END) AS median, max(CASE WHEN rn = n // 2 + 1 THEN {tp} END) AS median_tp, max(CASE WHEN rn = n // 2 + 1 THEN {name} END) AS median_name,
  avg({value}) AS mean_including_zeroes, avg(CASE WHEN {value} <> 0 THEN {value} END) AS mean_excluding_zeroes, min({value}) AS low, max({value}) AS high, count(*) AS count_tp,
  max(CASE WHEN cn = 1 THEN {value} END) AS mean_peak, max(CASE WHEN cn = 1 THEN {tp} END) AS mean_tp, max(CASE WHEN cn = 1 THEN {name} END) AS mean_name
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {value} IS NULL, abs({value} - m), {value}, {tp}, {name}) AS cn FROM
   (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {value} ASC NULLS FIRST, {tp}, {name}) AS rn, count(*) OVER (PARTITION BY {keys}) AS n, avg({value}) OVER (PARTITION BY {keys}) AS m FROM {source}))
  GROUP BY {keys})"""


MEDIANS = stats_sql("storm", f"{K}, duration", "abs_max", "tp", "name")


def _medians(spark, d):
    return ensemble.median_by_group(storm(spark, d), KEYS, "duration", "abs_max", "tp", "name")


@query("upper_median_by_group", f"""WITH {STORM}, {MEDIANS} SELECT {K}, duration, median, median_tp, median_name, round(mean_including_zeroes + 1e-9, 4) AS mean_including_zeroes, round(mean_excluding_zeroes + 1e-9, 4) AS mean_excluding_zeroes,
  low, high, count_tp, mean_peak, mean_tp, mean_name, mean_name = median_name AS mean_is_median, CAST(sum(count_tp) OVER (PARTITION BY {K}) AS BIGINT) AS count_tp_aep, count(*) OVER (PARTITION BY {K}) AS count_duration FROM stats""")
def upper_median_by_group(spark, d):
    return rounded(_medians(spark, d), "mean_including_zeroes", "mean_excluding_zeroes")


@query("median_max", f"""WITH {STORM}, {MEDIANS}, a AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY median DESC NULLS LAST, duration) AS r1, row_number() OVER (PARTITION BY {K} ORDER BY mean_peak DESC NULLS LAST, duration) AS r2, count(*) OVER (PARTITION BY {K}) AS c FROM stats)
 SELECT x.aep, x.location, x.type, x.run, x.duration AS median_duration, x.median, x.median_tp, x.median_name, x.low, x.high, x.count_tp, y.duration AS mean_duration, y.mean_peak, y.mean_tp, y.mean_name, round(y.mean_including_zeroes + 1e-9, 4) AS mean_including_zeroes, x.c AS count_tp_aep
 FROM a x JOIN a y ON x.r1 = 1 AND y.r2 = 1 AND x.aep = y.aep AND x.location = y.location AND x.type = y.type AND x.run = y.run""")
def median_max(spark, d):
    return rounded(ensemble.median_max(_medians(spark, d), KEYS, "duration"), "mean_including_zeroes")


@query("mean_by_group", f"""WITH {STORM}, {MEDIANS} SELECT {K}, duration, round(mean_including_zeroes + 1e-9, 4) AS mean_including_zeroes, mean_peak, mean_tp, mean_name, low, high, count_tp,
  CAST(sum(count_tp) OVER (PARTITION BY {K}) AS BIGINT) AS count_tp_aep, count(*) OVER (PARTITION BY {K}) AS count_duration FROM stats""")
def mean_by_group(spark, d):
    return rounded(ensemble.mean_by_group(_medians(spark, d), KEYS, "duration"), "mean_including_zeroes")


@query("mean_max", f"""WITH {STORM}, {MEDIANS} SELECT {K}, duration, mean_peak, mean_tp, mean_name, CAST(s AS BIGINT) AS count_tp_aep, c AS count_duration FROM
  (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY mean_peak DESC NULLS LAST, duration) AS r, sum(count_tp) OVER (PARTITION BY {K}) AS s, count(*) OVER (PARTITION BY {K}) AS c FROM stats) WHERE r = 1""")
def mean_max(spark, d):
    means = ensemble.mean_by_group(_medians(spark, d), KEYS, "duration")
    return ensemble.mean_max(means, KEYS, "duration").select(*KEYS, "duration", "mean_peak", "mean_tp", "mean_name", "count_tp_aep", "count_duration")


@query("critical_median", f"""WITH {STORM}, {MEDIANS} SELECT {K}, duration, median, median_tp, median_name, lo AS low_all, hi AS high_all, CAST(s AS BIGINT) AS count_all, c AS count_duration FROM
  (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY median DESC NULLS LAST, duration) AS r, min(low) OVER (PARTITION BY {K}) AS lo, max(high) OVER (PARTITION BY {K}) AS hi, sum(count_tp) OVER (PARTITION BY {K}) AS s, count(*) OVER (PARTITION BY {K}) AS c FROM stats) WHERE r = 1""")
def critical_median(spark, d):
    out = ensemble.critical_median(storm(spark, d), KEYS, "duration", "abs_max", "tp", "name")
    return out.select(*KEYS, "duration", "median", "median_tp", "median_name", "low_all", "high_all", "count_all", "count_duration")


COLS = ["abs_max", "v", "us_h", "ds_h"]


def _culvert_sql(statistic: str) -> str:
    def stat(c: str) -> str:
        return f"avg({c}) OVER w AS s_{c}" if statistic == "mean" else f"row_number() OVER (PARTITION BY {K}, duration ORDER BY {c} ASC NULLS FIRST, name) AS r_{c}"

    picked = ", ".join(f"s_{c}" if statistic == "mean" else f"max(CASE WHEN r_{c} = n // 2 + 1 THEN {c} END) OVER w AS s_{c}" for c in COLS)
    return f"""a AS (SELECT {K}, duration, name, abs_max, v, us_h, ds_h, count(*) OVER w AS n, {", ".join(stat(c) for c in COLS)} FROM storm WINDOW w AS (PARTITION BY {K}, duration)),
  b AS (SELECT {K}, duration, name, abs_max, v, us_h, ds_h, {picked} FROM a WINDOW w AS (PARTITION BY {K}, duration)),
  c AS (SELECT *, row_number() OVER (PARTITION BY {K}, duration ORDER BY abs_max IS NULL, abs(abs_max - s_abs_max), name) AS near FROM b),
  cul AS (SELECT {K}, duration, count(*) AS count_bin, {", ".join(f"round(max(s_{c}) + 1e-9, 4) AS {c}_{statistic}, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in COLS)}, max(CASE WHEN near = 1 THEN name END) AS adopted_name, max(CASE WHEN near = 1 THEN abs_max END) AS adopted_value FROM c GROUP BY {K}, duration)"""


def _culvert(spark, d, statistic):
    out = ensemble.statistic_of_columns(storm(spark, d), [*KEYS, "duration"], COLS, statistic, "abs_max", "name")
    return rounded(out, *[f"{c}_{statistic}" for c in COLS])


@query("culvert_stat_mean", f"WITH {STORM}, {_culvert_sql('mean')} SELECT * FROM cul")
def culvert_stat_mean(spark, d):
    return _culvert(spark, d, "mean")


@query("culvert_stat_median", f"WITH {STORM}, {_culvert_sql('median')} SELECT * FROM cul")
def culvert_stat_median(spark, d):
    return _culvert(spark, d, "median")


for _s in ("mean", "median"):

    def _critical(spark, d, s=_s):
        value = ensemble.preferred_column([f"{c}_{s}" for c in COLS], [f"abs_max_{s}", f"v_{s}"])
        out = ensemble.critical_duration(_culvert(spark, d, s), KEYS, "duration", value)
        return out.select(*KEYS, "duration", value, "adopted_name", "duration_bin")

    query(f"critical_duration_{_s}", f"""WITH {STORM}, {_culvert_sql(_s)} SELECT {K}, duration, abs_max_{_s}, adopted_name, n AS duration_bin FROM
  (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY abs_max_{_s} DESC NULLS LAST, duration) AS r, count(abs_max_{_s}) OVER (PARTITION BY {K}) AS n FROM cul) WHERE r = 1""")(_critical)


@query("critical_series", f"""WITH {STORM}, m AS (SELECT {K}, duration, round(avg(abs_max) + 1e-9, 4) AS mean, row_number() OVER (PARTITION BY {K} ORDER BY avg(abs_max) DESC NULLS LAST, duration) AS r, avg(abs_max) AS exact FROM storm GROUP BY {K}, duration),
  j AS (SELECT s.*, m.mean, row_number() OVER (PARTITION BY s.aep, s.location, s.type, s.run ORDER BY abs(abs_max - exact), name) AS near FROM storm s JOIN m ON r = 1 AND s.aep = m.aep AND s.location = m.location AND s.type = m.type AND s.run = m.run AND s.duration = m.duration)
 SELECT {K}, duration, mean, name AS critical_name, abs_max AS critical_value FROM j WHERE near = 1""")
def critical_series(spark, d):
    return rounded(ensemble.critical_runs(storm(spark, d), KEYS, "duration", "abs_max", "name"), "mean")


# ---- series

LIMITS = [float(x) for x in range(2, 502, 2)]
STEPS = "steps AS (SELECT location, type, min(time) FILTER (WHERE time > t0) - min(t0) AS step FROM (SELECT *, min(time) OVER (PARTITION BY location, type) AS t0 FROM series WHERE value IS NOT NULL) GROUP BY location, type)"
EXCEED = f"""{STEPS}, ex AS (SELECT location, type, CAST(threshold AS DOUBLE) AS threshold, count(*) AS n_above, count(*) * min(step) AS duration_exceeding
  FROM series JOIN steps USING (location, type) CROSS JOIN range(2, 502, 2) r(threshold) WHERE value > threshold AND step IS NOT NULL GROUP BY location, type, threshold)"""


def _exceed(spark, d):
    return ts.exceedance_durations(series(spark, d), ["location", "type"], "time", "value", LIMITS)


@query("exceedance_bucketed", f"WITH {SERIES}, {EXCEED} SELECT location, type, threshold, n_above, round(duration_exceeding + 1e-9, 4) AS duration_exceeding FROM ex")
def exceedance_bucketed(spark, d):
    return rounded(_exceed(spark, d), "duration_exceeding").select("location", "type", "threshold", "n_above", "duration_exceeding")


@query("exceedance_durations", f"WITH {SERIES}, {EXCEED} SELECT location, type, threshold, n_above, round(duration_exceeding + 1e-9, 4) AS duration_exceeding FROM ex WHERE threshold % 50 = 0")
def exceedance_durations(spark, d):
    out = ts.exceedance_durations_plain(series(spark, d), ["location", "type"], "time", "value", [x for x in LIMITS if x % 50 == 0])
    return rounded(out, "duration_exceeding").select("location", "type", "threshold", "n_above", "duration_exceeding")


MEMBERS = "mem AS (SELECT location, type AS aep, CAST(run % 5 AS VARCHAR) AS duration, 'TP' || lpad(CAST(run % 10 AS VARCHAR), 2, '0') AS tp, threshold, CAST(count(*) AS DOUBLE) AS hours FROM series CROSS JOIN (VALUES (20.0), (40.0), (80.0)) t(threshold) WHERE value > threshold GROUP BY ALL)"


def _members(spark, d):
    s = series(spark, d).filter("value is not null")
    limit = F.explode(F.filter(F.array(*[F.lit(x) for x in (20.0, 40.0, 80.0)]), lambda t: F.col("value") > t))
    s = s.select("location", F.col("type").alias("aep"), (F.col("run") % 5).cast("string").alias("duration"), F.concat(F.lit("TP"), F.lpad((F.col("run") % 10).cast("string"), 2, "0")).alias("tp"), limit.alias("threshold"))
    return s.groupBy("location", "aep", "duration", "tp", "threshold").agg(F.count("*").cast("double").alias("hours"))


def _closure_sql(source: str) -> str:
    return f"""{stats_sql(source, "location, aep, threshold, duration", "hours", "tp", "tp")}, b AS (SELECT *, row_number() OVER (PARTITION BY location, aep, threshold ORDER BY median DESC NULLS LAST, duration) AS r, min(low) OVER (PARTITION BY location, aep, threshold) AS lo, max(high) OVER (PARTITION BY location, aep, threshold) AS hi FROM stats)
 SELECT location, aep, CAST(threshold AS DOUBLE) AS threshold, median AS central_value, duration AS critical_duration, median_tp AS critical_tp, round(mean_including_zeroes + 1e-9, 4) AS average_value, mean_tp AS closest_tp, mean_peak AS closest_value, lo AS low_value, hi AS high_value FROM b WHERE r = 1"""


@query("closure_summary", f"WITH {SERIES}, {MEMBERS}, {_closure_sql('mem')}")
def closure_summary(spark, d):
    return rounded(ts.closure_summary(_members(spark, d), ["location", "aep"], "duration", "tp", "hours", False), "average_value")


@query("closure_summary_zero_fill", f"""WITH {SERIES}, {MEMBERS}, fil AS (SELECT m.location, m.aep, m.duration, m.tp, t.threshold, coalesce(e.hours, 0) AS hours FROM (SELECT DISTINCT location, aep, duration, tp FROM mem) m
  JOIN (SELECT DISTINCT location, aep, threshold FROM mem) t ON m.location = t.location AND m.aep = t.aep LEFT JOIN mem e ON e.location = m.location AND e.aep = m.aep AND e.duration = m.duration AND e.tp = m.tp AND e.threshold = t.threshold), {_closure_sql("fil")}""")
def closure_summary_zero_fill(spark, d):
    return rounded(ts.closure_summary(_members(spark, d), ["location", "aep"], "duration", "tp", "hours", True), "average_value")


@query("stability_check", f"""WITH {SERIES}, k AS (SELECT *, value - lag(value) OVER w AS d, greatest(1e-3, 0.02 * (max(value) OVER (PARTITION BY location, type) - min(value) OVER (PARTITION BY location, type))) AS tol FROM series WHERE value IS NOT NULL WINDOW w AS (PARTITION BY location, type ORDER BY time, event_id)),
  s AS (SELECT location, type, time, event_id, sign(d) AS s FROM k WHERE abs(d) > tol), f AS (SELECT location, type, s * lag(s) OVER (PARTITION BY location, type ORDER BY time, event_id) < 0 AS flip FROM s),
  g AS (SELECT location, type, count(*) FILTER (WHERE flip) AS sign_changes FROM f GROUP BY ALL),
  o AS (SELECT location, type, count(value) AS n_points, arg_min(value, (time, event_id)) FILTER (WHERE value IS NOT NULL) AS first_value, arg_max(value, (time, event_id)) FILTER (WHERE value IS NOT NULL) AS last_value, min(value) AS min_value, max(value) AS max_value FROM series GROUP BY ALL)
 SELECT o.location, o.type, n_points, first_value, last_value, min_value, max_value, coalesce(sign_changes, 0) AS sign_changes,
  CASE WHEN n_points = 0 THEN 'NO_DATA' WHEN n_points < 3 THEN 'INSUFFICIENT_POINTS' WHEN max_value - min_value <= 1e-6 THEN 'FLAT' WHEN coalesce(sign_changes, 0) > 10 THEN 'UNSTABLE' ELSE 'OK' END AS status
 FROM o LEFT JOIN g ON o.location = g.location AND o.type = g.type""")
def stability_check(spark, d):
    return ts.stability_check(series(spark, d), ["location", "type"], ["time", "event_id"], "value")


@query("peak_check", f"""WITH {SERIES}, st AS (SELECT location, type, arg_min(value, (time, event_id)) FILTER (WHERE value IS NOT NULL) AS start_value, max(time) AS end_time, arg_max((value,), (time, event_id))[1] AS end_value FROM series GROUP BY ALL),
  f AS (SELECT s.location, s.type, start_value, end_time, end_value, value, time, event_id, value - start_value AS up, end_value - start_value AS ends, row_number() OVER (PARTITION BY s.location, s.type ORDER BY abs(value - start_value) DESC NULLS LAST, time, event_id) AS r FROM series s JOIN st ON s.location = st.location AND s.type = st.type)
 SELECT location, type, start_value, round(end_time + 1e-9, 4) AS end_time, CASE WHEN start_value IS NOT NULL THEN end_value END AS end_value, value AS peak_value, CASE WHEN value IS NOT NULL THEN round(time + 1e-9, 4) END AS peak_time, CASE WHEN abs(up) <= 1e-6 THEN 'flat' WHEN up > 0 THEN 'max' WHEN up < 0 THEN 'min' END AS peak_kind,
  round(up + 1e-9, 4) AS peak_above_start, round(ends + 1e-9, 4) AS end_minus_start, CASE WHEN value IS NOT NULL THEN round(end_time - time + 1e-9, 4) END AS hours_from_end, round(CASE WHEN abs(up) > 1e-6 THEN abs(ends) / abs(up) * 100 WHEN abs(ends) <= 1e-6 THEN 0.0 END + 1e-9, 4) AS end_percent_of_peak,
  CASE WHEN start_value IS NULL THEN 'NO_DATA' WHEN end_time - time < 1 THEN 'WARN_1H' WHEN end_time - time < 2 THEN 'WARN_2H' ELSE 'OK' END AS status FROM f WHERE r = 1""")
def peak_check(spark, d):
    out = ts.peak_check(series(spark, d), ["location", "type"], ["time", "event_id"], "time", "value")
    return rounded(out, "end_time", "peak_time", "peak_above_start", "end_minus_start", "hours_from_end", "end_percent_of_peak")


@query("running_groups", """SELECT user_id, event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS group_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS place FROM events""")
def running_groups(spark, d):
    out = ts.running_groups(table(spark, d, "events"), ["user_id"], ["event_id"], F.col("event_type") == "signup")
    return out.select("user_id", "event_id", "group_id", "place")


@query("carry_forward", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS header_value FROM events")
def carry_forward(spark, d):
    out = ts.carry_forward(table(spark, d, "events"), ["user_id"], ["event_id"], F.when(F.col("event_type") == "signup", F.col("value")), "header_value")
    return out.select("user_id", "event_id", "header_value")


@query("row_pairing", """SELECT user_id, ((r + 1) // 2)::INTEGER AS pair, event_id AS event_id_first, value AS value_first, e2 AS event_id_second, v2 AS value_second FROM (SELECT user_id, event_id, value, lead(event_id) OVER w AS e2, lead(value) OVER w AS v2, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r % 2 = 1 AND e2 IS NOT NULL""")
def row_pairing(spark, d):
    return ts.row_pairs(table(spark, d, "events"), ["user_id"], ["event_id"], ["event_id", "value"])


@query("trapezoid_slope", f"""WITH {SERIES}, a AS (SELECT location, time, (time - lag(time) OVER w) * (value + lag(value) OVER w) / 2 AS a FROM series WHERE value IS NOT NULL WINDOW w AS (PARTITION BY location ORDER BY time, value))
 SELECT location, round(sum(a), 3) AS area, round(max(time) - min(time) + 1e-9, 4) AS length, round(CASE WHEN max(time) <> min(time) THEN 2 * sum(a) / ((max(time) - min(time)) * (max(time) - min(time))) END + 1e-9, 4) AS slope FROM a GROUP BY location""")
def trapezoid_slope(spark, d):
    out = ts.equal_area_slope(series(spark, d).filter("value is not null"), ["location"], "time", "value")
    return out.withColumns({"area": F.round("area", 3), "length": F.round(F.col("length") + SHIFT, 4), "slope": F.round(F.col("slope") + SHIFT, 4)})


@query("level_crossings", f"""WITH {SERIES}, a AS (SELECT location, time, value - 100.0 AS d, lag(time) OVER w AS t0, lag(value - 100.0) OVER w AS d0 FROM series WHERE value IS NOT NULL WINDOW w AS (PARTITION BY location ORDER BY time, value))
 SELECT location, round(time + 1e-9, 4) AS time, round(t0 + (time - t0) * d0 / (d0 - d) + 1e-9, 4) AS crossing FROM a WHERE d0 * d < 0""")
def level_crossings(spark, d):
    out = ts.level_crossings(series(spark, d).filter("value is not null"), ["location"], "time", "value", F.lit(100.0))
    return rounded(out.select("location", "time", "crossing"), "time", "crossing")

# ---- joins, unions, overlays


@query("max_all_columns", f"WITH {STORM} SELECT run, location, max(aep) AS aep, max(duration) AS duration, max(type) AS type, max(tp) AS tp, max(abs_max) AS abs_max, max(v) AS v, max(us_h) AS us_h, max(ds_h) AS ds_h FROM storm GROUP BY run, location")
def max_all_columns(spark, d):
    return ensemble_max(storm(spark, d).drop("name"), ["run", "location"])


def ensemble_max(df, keys):
    return combine.max_of_columns(df, keys)


@query("ts_max_all", f"WITH {SERIES} SELECT location, floor(time) AS hour, max(value) AS value, max(type) AS type FROM series GROUP BY location, floor(time)")
def ts_max_all(spark, d):
    s = series(spark, d).select("location", F.floor("time").cast("double").alias("hour"), "value", "type")
    return combine.max_of_columns(s, ["location", "hour"])


GEOMETRY = "SELECT CASE WHEN l_partkey % 3 = 0 THEN -l_partkey ELSE l_partkey END AS id, max(l_quantity) AS v, max(l_tax) AS only_left FROM lineitem GROUP BY ALL"


def _odd_apart(key):
    """Odd keys get a number that no even one has, so that some keys have no match."""
    return F.when(F.col(key) % 2 == 0, F.col(key)).otherwise(F.col(key) + 1_000_000_000_000)


ODD_APART = "CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE p_partkey + 1000000000000 END"


def _overlay_sides(spark, d):
    left = table(spark, d, "lineitem").groupBy(F.when(F.col("l_partkey") % 3 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("id")).agg(F.max("l_quantity").alias("v"), F.max("l_tax").alias("only_left"))
    right = table(spark, d, "part").select(_odd_apart("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("v"), F.col("p_brand").alias("only_right"))
    return left, right


@query("geometry_overlay", f"WITH a AS ({GEOMETRY}), b AS (SELECT {ODD_APART} AS id, CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END AS v, p_brand AS only_right FROM part) SELECT coalesce(a.id, b.id) AS id, coalesce(b.v, a.v) AS v, only_left, only_right FROM a FULL JOIN b ON a.id = b.id")
def geometry_overlay(spark, d):
    return combine.overlay(*_overlay_sides(spark, d), ["id"])


@query("combine_maximums", """WITH u AS (SELECT l_returnflag AS run, l_partkey AS id, l_quantity AS q, NULL AS vel, NULL AS mark FROM lineitem UNION ALL SELECT l_returnflag, l_partkey, NULL, l_tax, l_linestatus FROM lineitem),
 m AS (SELECT run, id, max(q) AS q, max(vel) AS vel, max(mark) AS mark FROM u GROUP BY run, id), g AS (SELECT 'A' AS run, p_partkey AS id, p_retailprice AS vel, p_brand AS brand FROM part)
 SELECT coalesce(m.run, g.run) AS run, coalesce(m.id, g.id) AS id, q, coalesce(g.vel, m.vel) AS vel, mark, brand FROM m FULL JOIN g ON m.run = g.run AND m.id = g.id""")
def combine_maximums(spark, d):
    line = table(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "run", "l_partkey": "id"})
    parts = [line.select("run", "id", F.col("l_quantity").alias("q")), line.select("run", "id", F.col("l_tax").alias("vel"), F.col("l_linestatus").alias("mark"))]
    geometry = table(spark, d, "part").select(F.lit("A").alias("run"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("vel"), F.col("p_brand").alias("brand"))
    return combine.combine_maximums(parts, geometry, "run", "id")


@query("combine_timeseries", f"WITH {SERIES}, m AS (SELECT type, location, floor(time) AS hour, max(value) AS value FROM series GROUP BY ALL) SELECT type, location, hour, value, c_mktsegment, c_acctbal FROM m LEFT JOIN customer ON c_custkey = location")
def combine_timeseries(spark, d):
    s = series(spark, d).select("type", "location", F.floor("time").cast("double").alias("hour"), "value")
    static = table(spark, d, "customer").select(F.col("c_custkey").alias("location"), "c_mktsegment", "c_acctbal")
    return combine.add_static(combine.max_of_columns(s, ["type", "location", "hour"]), static, ["location"])


@query("union_by_name", "SELECT n_name AS name, n_regionkey AS region, NULL AS balance FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def union_by_name(spark, d):
    return combine.union_all([table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))])


@query("headwater_ratio", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_tax <> 0 THEN (l_quantity - l_discount) / l_tax END AS hw_d FROM lineitem")
def headwater_ratio(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", combine.headwater_ratio(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")).alias("hw_d"))


@query("id_alignment", """WITH f AS (SELECT n_name AS region, c_name || '.' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS id, upper(c_name) || '.' || lpad(CAST(c_custkey % 1000 // 10 AS VARCHAR), 2, '0') AS printed FROM (SELECT n_name, c_custkey, 'Customer ' || (c_custkey // 7) AS c_name FROM customer JOIN nation ON c_nationkey = n_nationkey)),
 k AS (SELECT region, id, printed, regexp_extract(printed, '^CUSTOMER (.*)$', 1) AS k FROM f), r AS (SELECT region, k, min(id) AS resolved FROM k GROUP BY region, k HAVING min(id) = max(id))
 SELECT c.region, 'CUSTOMER|' || c.k AS k, coalesce(resolved, c.printed) AS id FROM (SELECT DISTINCT region, k, printed FROM k) c LEFT JOIN r ON c.region = r.region AND c.k = r.k""")
def id_alignment(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("Customer "), F.expr("c_custkey div 7").cast("string"), F.lit("."))
    cents = F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")
    both = c.select(F.col("n_name").alias("region"), F.concat(name, cents).alias("id"), F.concat(F.upper(name), F.substring(cents, 1, 2)).alias("printed"))
    full = both.select("region", "id", scenario.match_key(F.col("id")).alias("k"))
    cut = both.select("region", F.col("printed").alias("id")).distinct().withColumn("k", scenario.match_key(F.col("id")))
    return combine.align_ids(cut, full, ["region"], "k", "id")


@query("attribute_update", f"SELECT c_custkey, u.p_size AS size, CASE WHEN u.k IS NOT NULL THEN u.p_brand ELSE c_mktsegment END AS label, u.k IS NOT NULL AS matched FROM customer LEFT JOIN (SELECT *, {ODD_APART} AS k FROM part) u ON k = c_custkey")
def attribute_update(spark, d):
    target = table(spark, d, "customer").select("c_custkey", F.lit(None).cast("int").alias("size"), F.col("c_mktsegment").alias("label"))
    source = table(spark, d, "part").select(_odd_apart("p_partkey").alias("c_custkey"), F.col("p_size").alias("size"), F.col("p_brand").alias("label"))
    return combine.update_attributes(target, source, ["c_custkey"])


@query("lookup_join", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT *, CASE WHEN r_regionkey > 1 THEN r_regionkey ELSE -1 END AS k FROM region) ON n_regionkey = k")
def lookup_join(spark, d):
    s = combine.lookup(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), table(spark, d, "nation"), ["n_nationkey"], ["n_name", "n_regionkey"])
    region = table(spark, d, "region").select(F.when(F.col("r_regionkey") > 1, F.col("r_regionkey")).otherwise(-1).alias("n_regionkey"), "r_name")
    return combine.lookup(s, region, ["n_regionkey"], ["r_name"]).select("s_suppkey", "n_name", "r_name")


@query("nway_outer", f"""WITH {STORM}, {stats_sql("storm", "duration, aep", "abs_max", "tp", "name", "a")}, {stats_sql("storm", "duration, aep", "v", "tp", "name", "b")} SELECT coalesce(a.duration, b.duration) AS duration, coalesce(a.aep, b.aep) AS aep, a.median AS m1, a.median_tp AS t1, b.median AS m2, b.median_tp AS t2 FROM a FULL JOIN b ON a.duration = b.duration AND a.aep = b.aep""")
def nway_outer(spark, d):
    s = storm(spark, d)
    stats = [ensemble.ensemble_statistics(s, ["duration", "aep"], c, "tp", "name").select("duration", "aep", F.col("median").alias(f"m{i}"), F.col("median_tp").alias(f"t{i}")) for i, c in ((1, "abs_max"), (2, "v"))]
    return combine.outer_all(stats, ["duration", "aep"])


@query("file_dimension", "SELECT DISTINCT l_returnflag AS kind, l_linestatus AS folder, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem")
def file_dimension(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("folder"), "l_quantity")
    facts, files = combine.normalise_files(line, ["kind", "folder"])
    return facts.groupBy("file_id").agg(F.count("*").alias("n")).join(files, "file_id").select("kind", "folder", "n")


@query("weighted_mean", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 3) AS weighted_mean FROM lineitem GROUP BY l_returnflag")
def weighted_mean(spark, d):
    return combine.weighted_mean(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity").withColumn("weighted_mean", F.round("weighted_mean", 3))


@query("nearest_join", """WITH p AS (SELECT p_partkey AS part_id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 20 AS y FROM part), s AS (SELECT s_suppkey AS supp_id, s_acctbal / 200 AS x, CAST(s_nationkey AS DOUBLE) * 3 AS y FROM supplier),
 j AS (SELECT part_id, supp_id, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) AS d2 FROM p JOIN s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 25.0) SELECT part_id, supp_id, round(sqrt(d2), 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY d2, supp_id) AS r FROM j) WHERE r = 1""")
def nearest_join(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("y"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supp_id"), (F.col("s_acctbal") / 200).alias("x"), (F.col("s_nationkey").cast("double") * 3).alias("y"))
    return combine.nearest(p, s, "part_id", "supp_id", "x", "y", 5.0).withColumn("distance", F.round("distance", 4))


# ---- filters and checks


@query("entity_filter", "SELECT n_name AS \"Location\", n_regionkey FROM nation WHERE trim(n_name) IN ('NATION_1', 'NATION_7', 'NATION_20')")
def entity_filter(spark, d):
    return quality.entity_filter(table(spark, d, "nation").select(F.col("n_name").alias("Location"), "n_regionkey"), ["NATION_1", " NATION_7", "NATION_20", ""])


@query("include_exclude", "SELECT event_id, event_type FROM events WHERE lower(event_type) IN ('click', 'view', 'error') AND lower(event_type) NOT IN ('error')")
def include_exclude(spark, d):
    return table(spark, d, "events").filter(quality.allowed(F.col("event_type"), ["Click ", "VIEW", "error"], ["ERROR"])).select("event_id", "event_type")


@query("drop_all_null", f"WITH {SERIES} SELECT event_id, value FROM series WHERE value IS NOT NULL OR event_id % 14 <> 0")
def drop_all_null(spark, d):
    s = series(spark, d).withColumn("other", F.when(F.col("event_id") % 14 != 0, F.col("event_id")))
    return quality.drop_all_null(s, ["value", "other"]).select("event_id", "value")


SETS = f"WITH {STORM}, e AS (SELECT 'TP' || lpad(CAST(i AS VARCHAR), 2, '0') AS tp FROM range(1, 8) r(i)), g AS (SELECT DISTINCT aep, location, v FROM storm), h AS (SELECT DISTINCT aep, location, v, tp FROM storm)"


ON_SET = "g.aep = h.aep AND g.location = h.location AND g.v = h.v AND e.tp = h.tp"


@query("completed_sets", SETS + f" SELECT g.aep, g.location, g.v, string_agg(e.tp, ',' ORDER BY e.tp) FILTER (WHERE h.tp IS NULL) AS missing, count(h.tp) = 7 AS complete FROM g CROSS JOIN e LEFT JOIN h ON {ON_SET} GROUP BY g.aep, g.location, g.v")
def completed_sets(spark, d):
    sets = quality.member_sets(storm(spark, d), ["aep", "location", "v"], "tp", 7)
    return sets.withColumn("missing", F.nullif(F.array_join("missing", ","), F.lit("")))


@query("missing_patterns", SETS + f", m AS (SELECT g.aep, g.location, g.v, e.tp, h.tp AS got FROM g CROSS JOIN e LEFT JOIN h ON {ON_SET}) SELECT aep, location, v, tp AS missing_tp FROM m WHERE got IS NULL AND EXISTS (SELECT 1 FROM m GROUP BY aep, location, v HAVING count(got) = 7)")
def missing_patterns(spark, d):
    return quality.missing_members(storm(spark, d), ["aep", "location", "v"], "tp", 7)


@query("coverage_grid", f"""WITH {STORM}, s AS (SELECT location AS run, aep, duration || v AS duration, tp FROM storm), e AS (SELECT 'TP' || lpad(CAST(i AS VARCHAR), 2, '0') AS tp FROM range(1, 8) r(i)),
 g AS (SELECT a.run, a.aep, b.duration FROM (SELECT DISTINCT run, aep FROM s) a JOIN (SELECT DISTINCT run, duration FROM s) b ON a.run = b.run), h AS (SELECT DISTINCT * FROM s),
 m AS (SELECT g.run, g.aep, g.duration, count(*) FILTER (WHERE h.tp IS NULL) AS n, string_agg(e.tp, ',' ORDER BY e.tp) FILTER (WHERE h.tp IS NULL) AS t FROM g CROSS JOIN e LEFT JOIN h ON g.run = h.run AND g.aep = h.aep AND g.duration = h.duration AND e.tp = h.tp GROUP BY ALL)
 SELECT run, aep, duration, n::INTEGER AS n_missing, CASE WHEN n = 0 THEN 'complete' WHEN n >= 6 THEN n || ' missing' ELSE t END AS message FROM m""")
def coverage_grid(spark, d):
    return quality.coverage_grid(storm(spark, d).select(F.col("location").alias("run"), "aep", F.concat("duration", F.col("v").cast("string")).alias("duration"), "tp"), "run", "aep", "duration", "tp", 7)


@query("duplicate_groups", "SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS first_member, max(l_partkey) AS last_member FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return quality.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query("duplicate_content", """WITH h AS (SELECT doc_id, lang, strlen(text)::INTEGER AS size, sha256(text) AS digest FROM documents), g AS (SELECT lang, size, digest, min(doc_id) AS kept, count(*) AS copies FROM h GROUP BY ALL HAVING count(*) > 1)
 SELECT doc_id, h.lang, h.size, h.digest, kept, copies FROM h JOIN g ON h.lang = g.lang AND h.size = g.size AND h.digest = g.digest WHERE doc_id <> kept""")
def duplicate_content(spark, d):
    out = quality.duplicate_contents(table(spark, d, "documents"), "doc_id", "text", "lang")
    return out.select("doc_id", "lang", "size", "digest", "kept", "copies")


# ---- reshaping, grids


@query("wide_to_long", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'Q' AS channel, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'ds1.1', l_tax FROM lineitem WHERE l_tax > 0")
def wide_to_long(spark, d):
    line = table(spark, d, "lineitem")
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    wide = line.select(*ids, F.col("l_quantity").alias("Q"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("ds1.1"))
    return reshape.wide_to_long(wide, ids, ["Q", "ds1.1"], "channel", "value")


@query("suffix_pivot", """SELECT event_type AS kind, 'U' || user_id AS entity, min(value) FILTER (WHERE event_id % 3 = 1) AS us_h, min(value) FILTER (WHERE event_id % 3 = 2) AS ds_h FROM events WHERE event_id % 3 IN (1, 2) GROUP BY ALL""")
def suffix_pivot(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("."), (F.col("event_id") % 3).cast("string")).alias("Node ID"), "value")
    return reshape.suffix_pivot(e, ["kind"], "Node ID", "value", {"1": "us_h", "2": "ds_h"})


@query("node_suffix_split", "SELECT page_id, regexp_extract(url, '^(.*)\\.([^.]*)$', 1) AS base, regexp_extract(url, '^(.*)\\.([^.]*)$', 2) AS suffix FROM pages")
def node_suffix_split(spark, d):
    base, suffix = reshape.split_suffix("url")
    return table(spark, d, "pages").select("page_id", base.alias("base"), suffix.alias("suffix"))


@query("q_v_stack", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount AS time, l_quantity AS q, NULL AS v FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_tax, NULL, l_extendedprice FROM lineitem")
def q_v_stack(spark, d):
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return reshape.stack_metrics(table(spark, d, "lineitem"), ids, {"q": {"time": "l_discount", "q": "l_quantity"}, "v": {"time": "l_tax", "v": "l_extendedprice"}}, {"time": "double", "q": "double", "v": "double"})


@query("transpose_summary", "SELECT user_id, min(value) FILTER (WHERE event_type = 'click') AS click, min(value) FILTER (WHERE event_type = 'view') AS view, min(value) FILTER (WHERE event_type = 'error') AS error FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY user_id")
def transpose_summary(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("click", "view", "error"))
    return reshape.transpose(e, [], "user_id", "event_type", "value", ["click", "view", "error"])


@query("signed_abs_max", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(abs(hi), abs(lo)) AS abs_max, CASE WHEN abs(hi) >= abs(lo) THEN hi ELSE lo END AS signed_abs_max FROM (SELECT *, l_discount AS hi, -l_tax AS lo FROM lineitem)")
def signed_abs_max(spark, d):
    hi, lo = F.col("l_discount"), -F.col("l_tax")
    size, signed = reshape.signed_peak(hi, lo)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", size.alias("abs_max"), signed.alias("signed_abs_max"))


@query("run_matrix", f"WITH {STORM} SELECT * FROM (SELECT DISTINCT aep FROM storm) a CROSS JOIN (SELECT DISTINCT duration FROM storm) b CROSS JOIN (SELECT DISTINCT tp FROM storm) c")
def run_matrix(spark, d):
    return reshape.cross_of(storm(spark, d), ["aep", "duration", "tp"])


POINTS = "pts AS (SELECT l_quantity AS x, CAST(l_linenumber AS DOUBLE) AS y, l_extendedprice AS z, l_orderkey AS k FROM lineitem)"


def _points(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), F.col("l_extendedprice").alias("z"), F.col("l_orderkey").alias("k"))


@query("grid_fill", f"WITH {POINTS}, q AS (SELECT x, y * 10 + k % 977 AS y, z FROM pts) SELECT a.x, b.y, coalesce(max(z), -9999) AS z FROM (SELECT DISTINCT x FROM q) a CROSS JOIN (SELECT DISTINCT y FROM q) b LEFT JOIN q ON q.x = a.x AND q.y = b.y GROUP BY a.x, b.y")
def grid_fill(spark, d):
    return reshape.fill_grid(_points(spark, d).withColumn("y", F.col("y") * 10 + F.col("k") % 977), "x", "y", "z", -9999.0)


@query("tile_counts", f"WITH {POINTS}, c AS (SELECT min(x) AS x0, min(y) AS y0 FROM pts) SELECT CAST(floor((x - x0) / 7) AS BIGINT) AS tile_i, CAST(floor((y - y0) / 7) AS BIGINT) AS tile_j, count(*) AS n FROM pts, c GROUP BY ALL")
def tile_counts(spark, d):
    return reshape.tiles(_points(spark, d), "x", "y", 7.0).groupBy("tile_i", "tile_j").agg(F.count("*").alias("n"))


@query("thin_points", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_tax AS z FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber % 5 = 0 AND l_tax IS NOT NULL")
def thin_points(spark, d):
    return reshape.thin(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_tax").alias("z")), "l_orderkey", "l_linenumber", "z", 5)


@query("raster_max", f"WITH {POINTS} SELECT x, y, max(z) AS z FROM pts GROUP BY x, y")
def raster_max(spark, d):
    return reshape.raster_max(_points(spark, d), "x", "y", "z")


@query("raster_diff", f"WITH {POINTS}, a AS (SELECT x, y, max(z) AS z FROM pts WHERE k % 2 = 0 GROUP BY x, y), b AS (SELECT x, y, max(z) AS z FROM pts WHERE k % 2 = 1 GROUP BY x, y) SELECT a.x, a.y, round(a.z - b.z, 4) AS difference FROM a JOIN b ON a.x = b.x AND a.y = b.y")
def raster_diff(spark, d):
    a, b = (reshape.raster_max(_points(spark, d).filter(F.col("k") % 2 == i), "x", "y", "z") for i in (0, 1))
    return reshape.raster_difference(a, b, "x", "y", "z").withColumn("difference", F.round("difference", 4))


@query("masked_velocity", f"WITH {POINTS}, m AS (SELECT CAST(floor(x / 4) AS BIGINT) AS r, CAST(floor(y / 4) AS BIGINT) AS c, max(z) AS d FROM pts WHERE k % 3 = 0 GROUP BY ALL) SELECT x, y, k, CASE WHEN d >= 50000 THEN z ELSE -1 END AS z FROM pts LEFT JOIN m ON CAST(floor(x / 4) AS BIGINT) = r AND CAST(floor(y / 4) AS BIGINT) = c")
def masked_velocity(spark, d):
    p = _points(spark, d)
    mask = p.filter("k % 3 = 0").select("x", "y", F.col("z").alias("depth"))
    return reshape.masked(p, mask, "x", "y", "z", 4, "depth", 50000.0, -1.0)


@query("point_in_polygon", f"WITH {POINTS} SELECT x, y, k FROM pts WHERE x BETWEEN 10 AND 40 AND y BETWEEN 2 AND 6 AND (x - 10) * 4 >= (y - 2) * 0 AND y <= 2 + (40 - x) * 4 / 30")
def point_in_polygon(spark, d):
    return _points(spark, d).filter(reshape.in_polygon(F.col("x"), F.col("y"), [(10, 2), (40, 2), (10, 6)])).select("x", "y", "k")


# ---- names and scalars

NAME = "'R0' || (event_id % 3) || '_Exg' || CASE WHEN event_id % 2 = 0 THEN '+' ELSE '_' END || 'TP' || lpad(CAST(event_id % 12 AS VARCHAR), 2, '0') || '_' || (event_id % 5 + 1) || '.0p_' || (event_id % 4 * 60 + 120) || 'm_' || CASE event_id % 3 WHEN 0 THEN 'POMM.csv' WHEN 1 THEN '1d_cmx.csv' ELSE 'PO.csv' END"


def _names(spark, d):
    i = F.col("event_id")
    text = lambda c: c.cast("string")
    kind = F.when(i % 3 == 0, "POMM.csv").when(i % 3 == 1, "1d_cmx.csv").otherwise("PO.csv")
    name = F.concat(F.lit("R0"), text(i % 3), F.lit("_Exg"), F.when(i % 2 == 0, "+").otherwise("_"), F.lit("TP"), F.lpad(text(i % 12), 2, "0"), F.lit("_"), text(i % 5 + 1), F.lit(".0p_"), text(i % 4 * 60 + 120), F.lit("m_"), kind)
    return table(spark, d, "events").select("event_id", name.alias("name"))


@query("scenario_parse", f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'POMM' WHEN 1 THEN 'Cmx' ELSE 'PO' END AS data_type, 'TP' || lpad(CAST(event_id % 12 AS VARCHAR), 2, '0') AS tp, (event_id % 4 * 60 + 120) || 'm' AS duration, (event_id % 5 + 1) || '.0p' AS aep,
 regexp_replace({NAME}, '(_POMM|_1d_cmx|_PO)\\.csv$', '') AS run_code, 'R0' || (event_id % 3) || '_Exg' AS trim_code, CAST(event_id % 5 + 1 AS DOUBLE) AS aep_number FROM events""")
def scenario_parse(spark, d):
    n = files.with_scenario(_names(spark, d))
    return n.select("event_id", "data_type", F.col("tp_text").alias("tp"), F.col("duration_text").alias("duration"), F.col("aep_text").alias("aep"), "run_code", F.col("trim_run_code").alias("trim_code"), F.col("aep_numeric").alias("aep_number"))


@query("run_tokens", f"SELECT event_id, i::INTEGER AS place, t AS token FROM (SELECT event_id, unnest(string_split(translate({NAME}, '+', '_'), '_')) AS t, generate_subscripts(string_split(translate({NAME}, '+', '_'), '_'), 1) AS i FROM events)")
def run_tokens(spark, d):
    return _names(spark, d).select("event_id", F.posexplode(scenario.tokens(F.col("name"))).alias("place", "token")).withColumn("place", F.col("place") + 1)


@query("tp_label", "SELECT event_id, 'TP' || lpad(CAST(event_id % 12 AS VARCHAR), 2, '0') AS a, 'TP' || lpad(CAST(event_id % 7 AS VARCHAR), 2, '0') AS b, NULL AS c FROM events")
def tp_label(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", scenario.tp_label(F.concat(F.lit("x_tp "), (i % 12).cast("string"))).alias("a"), scenario.tp_label((i % 7).cast("string")).alias("b"), scenario.tp_label(F.lit("none")).alias("c"))


@query("duration_minutes", "SELECT event_id, CAST(event_id % 9 * 60 AS DOUBLE) AS hours, CAST(event_id % 90 AS DOUBLE) AS minutes, CAST(event_id % 50 AS DOUBLE) AS bare FROM events")
def duration_minutes(spark, d):
    i = F.col("event_id")
    say = lambda n, unit: scenario.duration_minutes(F.concat((i % n).cast("string"), F.lit(unit)))
    return table(spark, d, "events").select("event_id", say(9, " hours").alias("hours"), say(90, "min").alias("minutes"), say(50, "").alias("bare"))


@query("match_key", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'A B|' || n || '.00' WHEN 1 THEN 'A_B|' || n || '.' || substr(f, 1, 2) WHEN 2 THEN 'P|-' || n || '.' || substr(f, 1, 1) || '0' WHEN 3 THEN '|' || n || '.' || substr(f, 1, 2) END AS k
 FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS n, lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS f FROM customer)""")
def match_key(spark, d):
    k = F.col("c_custkey")
    n, f, of = k.cast("string"), F.lpad((k % 1000).cast("string"), 3, "0"), k % 5
    name = F.when(of == 0, F.concat(F.lit(" a \t b  "), n)).when(of == 1, F.concat(F.lit("A_b"), n, F.lit("."), f)).when(of == 2, F.concat(F.lit("p-"), n, F.lit("."), F.substring(f, 1, 1)))
    name = name.when(of == 3, F.concat(n, F.lit("."), f)).otherwise(F.concat(F.lit("fc "), n, F.lit(".5_C")))
    return table(spark, d, "customer").select("c_custkey", scenario.match_key(name).alias("k"))


@query("slug_names", "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'item') AS slug FROM pages")
def slug_names(spark, d):
    return table(spark, d, "pages").select("page_id", scenario.slug(F.col("url")).alias("slug"))


@query("remove_token", "SELECT page_id, array_to_string(list_concat(list_slice(p, 1, 1), list_slice(p, 3, len(p))), '_') AS base FROM (SELECT page_id, string_split(replace(url, '/', '_'), '_') AS p FROM pages)")
def remove_token(spark, d):
    return table(spark, d, "pages").select("page_id", scenario.without_token(F.replace("url", F.lit("/"), F.lit("_")), 1).alias("base"))


@query("dms_degrees", "SELECT c_custkey, round(c_custkey % 180 + (c_custkey % 60) / 60.0 + (c_custkey % 50) / 3600.0, 6) AS degrees FROM customer")
def dms_degrees(spark, d):
    k = F.col("c_custkey")
    text = F.concat((k % 180).cast("string"), F.lit("°"), (k % 60).cast("string"), F.lit("'"), (k % 50).cast("string"), F.lit('"'))
    return table(spark, d, "customer").select("c_custkey", F.round(scenario.dms_to_degrees(text), 6).alias("degrees"))


def _arf_sql(area: str, dur: str, aep: str) -> str:
    rare = f"(0.3 + log10({aep}))"
    short = lambda a, d: f"least(1.0, 1 - 0.287 * (power({a}, 0.265) - 0.439 * log10({d})) * power({d}, -0.36) + 2.26e-3 * power({a}, 0.226) * power({d}, 0.125) * {rare} + 0.0141 * power({a}, 0.213) * power(10.0, -0.021 * power({d} - 180, 2) / 1440) * {rare})"
    long = lambda a, d: f"least(1.0, 1 - 0.327 * (power({a}, 0.241) - 0.448 * log10({d})) * power({d}, -0.36) + 0.00096 * power({a}, 0.48) * power({d}, -0.21) * {rare} + 0.012 * power(10.0, -0.0013 * {a} * {d} / 1440) * {rare})"
    large = lambda a: f"CASE WHEN {dur} <= 720 THEN {short(a, dur)} WHEN {dur} >= 1440 THEN {long(a, dur)} ELSE {short(a, '720.0')} + ({long(a, '1440.0')} - {short(a, '720.0')}) * ({dur} - 720) / 720 END"
    return f"CASE WHEN {area} > 30000 OR {dur} > 10080 THEN NULL WHEN {area} <= 1 THEN 1.0 WHEN {area} < 10 THEN 1 - 0.6614 * (1 - ({large('10.0')})) * (power({area}, 0.4) - 1) ELSE {large(area)} END"


@query("arf_table", f"""SELECT p_partkey, round({_arf_sql('area', 'dur', 'aep')}, 6) AS arf
 FROM (SELECT p_partkey, CAST(p_size * (1 + p_partkey % 3 * 50) AS DOUBLE) AS area, CAST(60 + p_partkey * 37 % 10500 AS DOUBLE) AS dur, CASE p_partkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.1 ELSE 0.01 END AS aep FROM part)""")
def arf_table(spark, d):
    k = F.col("p_partkey")
    area, dur, aep = (F.col("p_size") * (1 + k % 3 * 50)).cast("double"), (60 + k * 37 % 10500).cast("double"), F.when(k % 3 == 0, 0.5).when(k % 3 == 1, 0.1).otherwise(0.01)
    rows = table(spark, d, "part").select("p_partkey", area.alias("area"), dur.alias("dur"), aep.alias("aep"))
    return rows.select("p_partkey", F.round(hydro.arf(F.col("area"), F.col("dur"), F.col("aep"), hydro.EAST_COAST_NORTH), 6).alias("arf"))


@query("bearing", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS bearing FROM (SELECT *, degrees(atan2(l_quantity - 25, l_linenumber - 3.5)) AS a FROM lineitem)")
def bearing(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(hydro.bearing(F.lit(25.0), F.lit(3.5), F.col("l_quantity"), F.col("l_linenumber")), 6).alias("bearing"))


@query("grid_snap", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(l_quantity / 4.0, 0) * 4.0 AS snapped FROM lineitem")
def grid_snap(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", hydro.round_to_grid(F.col("l_quantity"), 4.0).alias("snapped"))


@query("crossing_records", """WITH c AS (SELECT *, l_quantity - 5 AS q, l_discount * 10 AS ui, l_tax * 10 AS di, CAST(l_linenumber AS DOUBLE) AS h, CASE WHEN l_partkey % 4 <> 0 THEN l_quantity / 10 END AS ds, l_extendedprice / 1000 AS a, CASE WHEN l_suppkey % 3 > 0 THEN l_quantity / 8 END AS us, CASE WHEN l_suppkey % 5 > 1 THEN l_tax * 90 WHEN l_suppkey % 5 = 1 THEN 0.0 END AS uo FROM lineitem)
 SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(0.005, q * 0.9) AS minimum, q AS design, greatest(q + 0.005, q * 1.1) AS maximum, ds AS tailwater, least(di, ds - 0.05) AS tailwater_invert, greatest(5.0, 6 * h) AS width, greatest(us, ds, coalesce(nullif(uo, 0.0), ui + h), di + h) + 0.5 AS crest,
 CASE WHEN l_returnflag = 'R' OR l_returnflag = 'N' AND l_linestatus = 'F' THEN 'BOX' ELSE 'CIRCLE' END AS shape, CASE l_returnflag WHEN 'R' THEN 'CONCRETE' WHEN 'A' THEN 'CORRUGATED_STEEL' ELSE 'CONCRETE' END AS material,
 CASE WHEN l_returnflag = 'R' OR l_returnflag = 'N' AND l_linestatus = 'F' THEN 1 ELSE greatest(1.0, round_even(a / (pi() * power(h / 2, 2)), 0))::INTEGER END AS barrels FROM c WHERE q > 0 AND h > 0 AND ds IS NOT NULL""")
def crossing_records(spark, d):
    c = F.col
    level = F.when(c("l_partkey") % 4 != 0, c("l_quantity") / 10)
    flag = F.when(c("l_returnflag") == "A", "c").otherwise(c("l_returnflag"))
    channel = F.concat(F.lit("C1_"), F.when(c("l_linestatus") == "F", "r").otherwise("x"))
    obvert = F.when(c("l_suppkey") % 5 > 1, c("l_tax") * 90).when(c("l_suppkey") % 5 == 1, F.lit(0.0))
    made = hydro.crossing(
        c("l_quantity") - 5, c("l_discount") * 10, c("l_tax") * 10, c("l_linenumber").cast("double"), level, flag, F.lit(12.0), c("l_extendedprice") / 1000,
        us_level=F.when(c("l_suppkey") % 3 > 0, c("l_quantity") / 8), us_obvert=obvert, channel=channel,
    )
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    out = table(spark, d, "lineitem").select(*ids, made.alias("x")).filter("x is not null")
    record = ["x.flow.minimum", "x.flow.design", "x.flow.maximum", c("x.tailwater.elevation").alias("tailwater"), c("x.tailwater.invert").alias("tailwater_invert"), "x.roadway.width"]
    return out.select(*ids, *record, c("x.roadway.elevations")[0].alias("crest"), "x.barrel.shape", "x.barrel.material", "x.barrel.barrels")


@query("style_counts", "SELECT event_type, n, event_id FROM (SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 20")
def style_counts(spark, d):
    return quality.counts_with_first(table(spark, d, "events"), ["event_type"], "event_id", 20).select("event_type", "n", "event_id")


@query("numbered_names", "SELECT doc_id, lang || CASE WHEN r > 1 THEN '(' || (r - 1) || ')' ELSE '' END AS name FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents)")
def numbered_names(spark, d):
    rows = quality.numbered(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", "r")
    return rows.select("doc_id", scenario.numbered_name(F.col("lang"), F.col("r")).alias("name"))


@query("js_array_extract", r"SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS href FROM pages")
def js_array_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("href"))


@query("section_extract", r"SELECT page_id, regexp_extract(html, '<h1>([\s\S]*?)</h1>', 1) AS title, len(regexp_extract_all(html, '<p>'))::INTEGER AS paragraphs FROM pages")
def section_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"<h1>([\s\S]*?)</h1>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("paragraphs"))


@query("log_kv", r"SELECT doc_id, l.n::INTEGER AS line, trim(regexp_extract(l.t, '^([A-Za-z ]+)[=:](.*)$', 1)) AS k, trim(regexp_extract(l.t, '^([A-Za-z ]+)[=:](.*)$', 2)) AS v FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'n': i - 1, 't': x})) AS l FROM documents) WHERE regexp_matches(l.t, '^[A-Za-z ]+[=:]')")
def log_kv(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).filter(F.col("t").rlike("^[A-Za-z ]+[=:]"))
    part = lambda k: F.trim(F.regexp_extract("t", "^([A-Za-z ]+)[=:](.*)$", k))
    return lines.select("doc_id", "line", part(1).alias("k"), part(2).alias("v"))
