"""Readers and workflows on files' lines that are made of the star schema, with the SQL that must give their rows.

The tables are written as the lines of result files of each layout; a reader or a workflow must find again what went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import workflows
from tidewell.functions import scenario
from tidewell.operators import columns
from tidewell.plans.bindings import SERIES, STORM, series, storm, table
from tidewell.plans.catalog import ORACLE_SQL, query, rounded
from tidewell.sources import hydrology, readers, results, survey
from tidewell.streaming import incremental


def text(c: Column) -> Column:
    return c.cast("string")


def joined(separator: str, *cells: Column | str) -> Column:
    return F.concat_ws(separator, *[F.lit(c) if isinstance(c, str) else F.coalesce(text(c), F.lit("")) for c in cells])


def lines_of(rows: DataFrame, path: Column, line: Column, own: Column, *heads: str) -> DataFrame:
    """(path, line, text) of the rows, under the given first lines of each path; rows' lines count from 0."""
    body = rows.select(path.alias("path"), (line + len(heads)).cast("int").alias("line"), own.alias("text"))
    top = body.select("path").distinct().select("path", F.posexplode(F.array(*[F.lit(h) for h in heads])).alias("line", "text"))
    return top.unionByName(body)


def result_path(run: Column, suffix: str) -> Column:
    return F.concat(F.lit("/results/R"), text(run), F.lit("_TP"), F.lpad(text(run % 10 + 1), 2, "0"), F.lit("_1.0p_120m"), F.lit(suffix))


RUN_SQL = "'R' || run || '_TP' || lpad(CAST(run % 10 + 1 AS VARCHAR), 2, '0') || '_1.0p_120m'"
CHANNELS = "ch AS (SELECT c_nationkey AS run, 'C' || c_custkey AS id, CAST(c_custkey % 24 AS DOUBLE) AS tq, CASE WHEN c_custkey % 9 > 0 THEN c_acctbal END AS q, c_custkey % 7 / 2 AS tv, CAST(c_custkey % 11 AS DOUBLE) AS v FROM customer)"


def _channels(spark, d) -> DataFrame:
    c = F.col("c_custkey")
    q = F.when(c % 9 > 0, F.col("c_acctbal"))
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("run"), c.alias("k"), F.concat(F.lit("C"), text(c)).alias("id"), (c % 24).cast("double").alias("tq"), q.alias("q"), (c % 7 / 2).alias("tv"), (c % 11).cast("double").alias("v"))


def _cmx_lines(spark, d) -> DataFrame:
    row = joined(",", F.col("id"), F.col("tq"), F.col("q"), F.col("tv"), F.col("v"))
    return lines_of(_channels(spark, d), result_path(F.col("run"), "_1d_Cmx.csv"), F.col("k"), row, "Chan ID,Time Qmax,Qmax,Time Vmax,Vmax")


@query("read_cmx", f"""WITH {CHANNELS} SELECT {RUN_SQL} AS run, id, tq AS time, q, NULL::DOUBLE AS v, 'TP' || lpad(CAST(run % 10 + 1 AS VARCHAR), 2, '0') AS tp FROM ch
 UNION ALL SELECT {RUN_SQL}, id, tv, NULL, v, 'TP' || lpad(CAST(run % 10 + 1 AS VARCHAR), 2, '0') FROM ch""")
def read_cmx(spark, d):
    out = results.tidy(_cmx_lines(spark, d), "Cmx")
    return out.select(F.col("internalName").alias("run"), F.col("Chan ID").alias("id"), F.col("Time").alias("time"), F.col("Q").alias("q"), F.col("V").alias("v"), F.col("tp_text").alias("tp"))


@query("read_nmx", "SELECT 'N' || (c_custkey // 3) AS id, min(CASE WHEN c_custkey % 3 = 1 THEN c_acctbal END) AS us, min(CASE WHEN c_custkey % 3 = 2 THEN c_acctbal END) AS ds FROM customer WHERE c_custkey % 3 > 0 GROUP BY ALL")
def read_nmx(spark, d):
    c = F.col("c_custkey")
    row = joined(",", F.concat(F.lit("N"), text(F.expr("c_custkey div 3")), F.lit("."), text(c % 3)), "1.5", F.col("c_acctbal"))
    lines = lines_of(table(spark, d, "customer"), F.lit("/r/a_1d_Nmx.csv"), c, row, "Node ID,Time Hmax,Hmax")
    return results.tidy(lines, "Nmx").select(F.col("Chan ID").alias("id"), F.col("US_h").alias("us"), F.col("DS_h").alias("ds"))


@query("read_channels", "SELECT 'P' || p_partkey AS id, round(p_retailprice - p_size, 6) AS height, CASE p_partkey % 2 WHEN 0 THEN 'C' END AS flags FROM part")
def read_channels(spark, d):
    row = joined(",", F.concat(F.lit("P"), text(F.col("p_partkey"))), F.col("p_retailprice"), F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, F.lit("C")))
    lines = lines_of(table(spark, d, "part"), F.lit("/r/a_1d_Chan.csv"), F.col("p_partkey"), row, "Channel,LBUS Obvert,US Invert,Flags")
    return results.tidy(lines, "Chan").select(F.col("Chan ID").alias("id"), F.round("Height", 6).alias("height"), F.col("Flags").alias("flags"))


CELLS = "cells AS (SELECT o_orderpriority AS p, o_custkey % 60 AS r, o_orderkey % 6 AS k, max(o_totalprice) AS v FROM orders GROUP BY ALL)"


def _wide_lines(spark, d, suffix: str, start: list[str], heads: list[str]) -> DataFrame:
    """Tables of six columns by order priority, a row for each sixtieth of the customers, unknown where nobody ordered."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), (F.col("o_custkey") % 60).alias("r"), (F.col("o_orderkey") % 6).cast("int").alias("k"), "o_totalprice")
    picked = [F.max(F.when(F.col("k") == i, F.col("o_totalprice"))).alias(f"v{i}") for i in range(6)]
    wide = o.groupBy("p", "r").agg(*picked)
    row = joined(",", *start, F.col("r").cast("double"), *[F.col(f"v{i}") for i in range(6)])
    return lines_of(wide, F.concat(F.lit("/r/"), F.translate("p", " ", "x"), F.lit(suffix)), F.col("r"), row, *heads)


@query("read_point_output", f"WITH {CELLS} SELECT translate(p, ' ', 'x') AS run, CAST(r AS DOUBLE) AS time, 'L' || k AS location, CASE WHEN k < 3 THEN 'Flow' ELSE 'Level' END AS type, v AS value FROM cells")
def read_point_output(spark, d):
    lines = _wide_lines(spark, d, "_PO.csv", ["d"], ["d,Time,Flow,Flow,Flow,Level,Level,Level", "d,Time,L0,L1,L2,L3,L4,L5"])
    return results.tidy(lines, "PO").select(F.col("internalName").alias("run"), F.col("Time").alias("time"), F.col("Location").alias("location"), F.col("Type").alias("type"), F.col("Value").alias("value"))


@query("read_flow_series", f"WITH {CELLS} SELECT translate(p, ' ', 'x') AS run, CAST(r AS DOUBLE) AS time, 'c' || k AS id, v AS q FROM cells WHERE k <> 5")
def read_flow_series(spark, d):
    heads = ["d,Time (h)," + ",".join(f"Q c{i} [run 1]" for i in range(6))]
    out = results.tidy(_wide_lines(spark, d, "_1d_Q.csv", ["d"], heads), "Q", [f"c{i}" for i in range(5)])
    return out.select(F.col("internalName").alias("run"), F.col("Time").alias("time"), F.col("Chan ID").alias("id"), F.col("Q").alias("q"))


@query("read_level_series", f"WITH {CELLS} SELECT translate(p, ' ', 'x') AS run, CAST(r AS DOUBLE) AS time, 'c' || (k // 2) AS id, max(CASE WHEN k % 2 = 0 THEN v END) AS us, max(CASE WHEN k % 2 = 1 THEN v END) AS ds FROM cells GROUP BY ALL")
def read_level_series(spark, d):
    heads = ["d,Time (h)," + ",".join(f"H c{i // 2}.{i % 2 + 1} [run 1]" for i in range(6))]
    out = results.tidy(_wide_lines(spark, d, "_1d_H.csv", ["d"], heads), "H")
    return out.select(F.col("internalName").alias("run"), F.col("Time").alias("time"), F.col("Chan ID").alias("id"), F.col("US_h").alias("us"), F.col("DS_h").alias("ds"))


@query("read_culvert_section", "SELECT 'X ' || p_partkey AS id, CAST(p_size AS DOUBLE) AS barrels, p_retailprice AS us_invert, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS DOUBLE) END AS height FROM part")
def read_culvert_section(spark, d):
    size = F.col("p_size")
    height = F.when(size % 3 > 0, text(size)).otherwise(F.when(size % 2 == 0, "-----").otherwise("Adjusted"))
    row = joined("  ", F.concat(F.lit("X "), text(F.col("p_partkey"))), "C", size, F.col("p_retailprice"), *["1.0"] * 7, height, *["0.5"] * 6)
    lines = lines_of(table(spark, d, "part"), F.concat(F.lit("/r/b"), text(F.pmod(F.xxhash64("p_partkey"), F.lit(499))), F.lit(".eof")), F.col("p_partkey"), row, "top", "CULVERT AND PIPE DATA", "", "Channel  Type")
    return results.tidy(lines, "EOF").select(F.col("Chan ID").alias("id"), F.col("Num_barrels").alias("barrels"), F.col("US Invert").alias("us_invert"), F.col("Height").alias("height"))


@query("read_peak_summary", "SELECT s_name AS type, s_acctbal AS high, -1.0 - s_suppkey AS low, greatest(abs(s_acctbal), s_suppkey + 1)::DOUBLE AS abs_max, CASE WHEN abs(s_acctbal) >= s_suppkey + 1 THEN s_acctbal ELSE -1.0 - s_suppkey END AS signed FROM supplier")
def read_peak_summary(spark, d):
    s = F.col("s_suppkey")
    labels = list(readers.SUMMARY)
    cells = [F.col("s_name"), F.lit("Flow"), F.col("s_acctbal"), F.lit("1.0"), -s - 1, F.lit("2.0")]
    each = table(spark, d, "supplier").select(s.alias("s"), F.posexplode(F.array(*[text(c) for c in cells])).alias("line", "v")).withColumn("f", F.pmod(F.xxhash64("s"), F.lit(97)))
    rows = each.groupBy("f", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "v"))), lambda x: x["v"]), ",").alias("v"))
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("line") + 1)
    lines = rows.select(F.concat(F.lit("/r/a"), text(F.col("f")), F.lit("_POMM.csv")).alias("path"), "line", joined(",", "x", label, F.col("v")).alias("text"))
    out = results.tidy(lines, "POMM")
    return out.select(F.col("Type").alias("type"), F.col("Max").alias("high"), (F.col("Min") + 0.0).alias("low"), F.col("AbsMax").alias("abs_max"), F.col("SignedAbsMax").alias("signed"))


@query("workflow_culvert_maximums", f"""WITH {CHANNELS}, m AS (SELECT {RUN_SQL} AS run, id, q, v, n FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM ch)) SELECT run, id, q, v, us, inv, CASE WHEN h <> 0 THEN (us - inv) / h END AS hw FROM
 (SELECT *, CASE WHEN n % 4 > 0 THEN n + 5.0 END AS us, CASE WHEN n % 5 > 0 THEN CAST(n AS DOUBLE) END AS inv, CASE WHEN n % 5 > 0 THEN CAST(n % 3 AS DOUBLE) END AS h FROM m)""")
def workflow_culvert_maximums(spark, d):
    c, k = _channels(spark, d), F.col("k")
    node = joined(",", F.concat("id", F.lit(".1")), "1.0", k + 5.0)
    nmx = lines_of(c.filter(k % 4 > 0), result_path(F.col("run"), "_1d_Nmx.csv"), k, node, "Node ID,Time Hmax,Hmax")
    row = joined("  ", F.col("id"), "C", "1", k, *["1.0"] * 7, k % 3, *["0.5"] * 6)
    eof = lines_of(c.filter(k % 5 > 0), result_path(F.col("run"), ".eof"), k, row, "CULVERT AND PIPE DATA", "Channel  Type")
    tables = {"Cmx": results.tidy(_cmx_lines(spark, d), "Cmx"), "Nmx": results.tidy(nmx, "Nmx"), "EOF": results.tidy(eof, "EOF")}
    out = workflows.culvert_maximums(tables)["Maximums"]
    return out.select(F.col("internalName").alias("run"), F.col("Chan ID").alias("id"), F.col("Q").alias("q"), F.col("V").alias("v"), F.col("US_h").alias("us"), F.col("US Invert").alias("inv"), F.col("HW_D").alias("hw"))


@query("workflow_culvert_series", f"""WITH {CELLS} SELECT translate(p, ' ', 'x') AS run, CAST(r AS DOUBLE) AS time, 'c' || k AS id, v AS q, CAST(k * 2 AS DOUBLE) AS length FROM cells""")
def workflow_culvert_series(spark, d):
    q = _wide_lines(spark, d, "_1d_Q.csv", ["d"], ["d,Time (h)," + ",".join(f"Q c{i} [run]" for i in range(6))])
    rows = q.select(F.regexp_replace("path", "_1d_Q.csv$", "_1d_Chan.csv").alias("p")).distinct().select("p", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    chan = lines_of(rows, F.col("p"), F.col("i"), joined(",", F.concat(F.lit("c"), text(F.col("i"))), "2.0", "1.0", F.col("i") * 2), "Channel,LBUS Obvert,US Invert,Length")
    out = workflows.culvert_series({"Q": results.tidy(q, "Q"), "Chan": results.tidy(chan, "Chan")})["1d_timeseries_data"]
    return out.select(F.col("internalName").alias("run"), F.col("Time").alias("time"), F.col("Chan ID").alias("id"), F.col("Q").alias("q"), F.col("Length").alias("length"))


def _pomm(spark, d) -> DataFrame:
    named = {"aep": "aep_text", "duration": "duration_text", "location": "Location", "type": "Type", "run": "trim_runcode", "tp": "tp_text", "name": "internalName", "abs_max": "AbsMax"}
    return storm(spark, d).withColumnsRenamed(named).withColumn("run_tokens", F.array())


_KEYS = "aep AS aep_text, location AS \"Location\", type AS \"Type\", run AS trim_runcode"


def _keyed(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*workflows.PEAK_KEYS, *names)


@query("workflow_peak_report", f"SELECT {_KEYS}, duration AS duration_text, tp AS tp_text, abs_max AS \"AbsMax\", count_tp_aep FROM ({ORACLE_SQL['peak_of_peaks']})")
def workflow_peak_report(spark, d):
    return _keyed(workflows.peak_report(_pomm(spark, d))["aep-max"], "duration_text", "tp_text", "AbsMax", "count_tp_aep")


@query("workflow_median_report", f"SELECT {_KEYS}, median_duration, median, median_tp, count_tp FROM ({ORACLE_SQL['median_max']})")
def workflow_median_report(spark, d):
    return _keyed(workflows.peak_report(_pomm(spark, d), "median")["aep-max"], "median_duration", "median", "median_tp", "count_tp")


@query("workflow_mean_report", f"SELECT {_KEYS}, duration AS duration_text, mean_peak, mean_tp FROM ({ORACLE_SQL['mean_max']})")
def workflow_mean_report(spark, d):
    return _keyed(workflows.peak_report(_pomm(spark, d), "mean")["aep-mean-max"], "duration_text", "mean_peak", "mean_tp")


def _po(spark, d) -> DataFrame:
    s = series(spark, d).withColumnsRenamed({"location": "Location", "type": "Type", "time": "Time", "value": "Value"})
    none = F.lit(None).cast("string")
    return s.withColumns({"Location": text(F.col("Location")), "directory_path": F.lit("/r"), "trim_runcode": F.lit("R"), "aep_text": text(F.col("run") % 3), "duration_text": none, "tp_text": F.lit("TP01"), "internalName": F.lit("R_1")})


@query("workflow_closure_durations", f"""WITH {SERIES}, p AS (SELECT CAST(location AS VARCHAR) AS location, CAST(run % 3 AS VARCHAR) AS aep, time, value FROM series WHERE type = 'view' AND value IS NOT NULL),
 t AS (SELECT *, min(time) OVER (PARTITION BY location, aep) AS t0 FROM p), st AS (SELECT location, aep, min(time) FILTER (WHERE time > t0) - min(t0) AS step FROM t GROUP BY ALL)
 SELECT p.location, p.aep, CAST(x AS DOUBLE) AS threshold, count(*) AS n_above, round(count(*) * min(step) + 1e-9, 4) AS duration_exceeding FROM p JOIN st ON p.location = st.location AND p.aep = st.aep CROSS JOIN range(50, 500, 50) r(x) WHERE value > x AND step IS NOT NULL GROUP BY ALL""")
def workflow_closure_durations(spark, d):
    out = workflows.closure_durations(_po(spark, d), [float(x) for x in range(50, 500, 50)], " View".strip())["Duration_Exceedance"]
    return rounded(out, "duration_exceeding").select(F.col("Location").alias("location"), F.col("aep_text").alias("aep"), "threshold", "n_above", "duration_exceeding")


@query("workflow_peak_checks", f"SELECT CAST(location AS VARCHAR) AS location, peak_value, status FROM ({ORACLE_SQL['peak_check']}) WHERE type = 'click' AND location <> 7")
def workflow_peak_checks(spark, d):
    po = _po(spark, d)
    out = workflows.peak_check_report(po.drop("aep_text").withColumn("aep_text", F.lit("1p")), ["CLICK "], excluded=["7"])["all"]
    return out.select(F.col("Location").alias("location"), "peak_value", "status")


@query("workflow_stability", f"SELECT CAST(location AS VARCHAR) AS location, type, n_points, sign_changes, status FROM ({ORACLE_SQL['stability_check']})")
def workflow_stability(spark, d):
    out = workflows.stability_report({"PO": _po(spark, d)})["all"]
    return out.select(F.col("Location").alias("location"), F.col("Type").alias("type"), "n_points", "sign_changes", "status")


@query("workflow_log_summary", """SELECT 'R' || c_custkey || '_Exg' || (c_custkey % 4) AS run, 'v' || (c_custkey % 7) AS version, TIMESTAMP '2025-11-01 00:00:00' + INTERVAL (c_custkey % 1400) MINUTE AS start, c_custkey / 4 AS runtime, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS mass_error,
 CASE WHEN c_custkey % 3 > 0 THEN 2 ELSE 1 END AS completion, 'Exg' || (c_custkey % 4) AS scenario, 'R' || c_custkey AS trim_tcf FROM customer WHERE c_custkey % 5 > 0""")
def workflow_log_summary(spark, d):
    k = F.col("c_custkey")
    say = [
        F.concat(F.lit("Build: v"), text(k % 7)), F.lit("Computer Name: PC"), F.concat(F.lit("Simulation Started: 2025-Nov-01 "), F.lpad(text(F.floor(k % 1400 / 60)), 2, "0"), F.lit(":"), F.lpad(text(k % 1400 % 60), 2, "0")),
        F.lit("No Specified Events."), F.lit("Specified Scenarios:"), F.concat(F.lit(" -s1  Exg"), text(k % 4)), F.lit(""), F.lit("Final Times"), F.concat(F.lit("Clock Time: x ["), F.format_string("%.2f", k / 4), F.lit(" h]")),
        F.when(k % 5 > 0, "Simulation FINISHED").otherwise("aborted"), F.when(k % 3 > 0, F.concat(F.lit("Final Cumulative ME: "), text(F.col("c_acctbal")), F.lit("%"))).otherwise("no mass error"),
    ]
    path = F.concat(F.lit("/logs/R"), text(k), F.lit("_Exg"), text(k % 4), F.lit(".tlf"))
    lines = table(spark, d, "customer").select(path.alias("path"), F.posexplode(F.array(*say)).alias("line", "text"))
    out = results.tidy(lines, "TLF")
    return workflows.log_report(out)["Log_Summary"].join(out.select("internalName", F.col("settings")["-s1"].alias("scenario")), "internalName").select(
        F.col("internalName").alias("run"), "version", "start", F.col("final_runtime").alias("runtime"), "mass_error", "completion", "scenario", "trim_tcf"
    )


@query("read_batch_runs", "SELECT o_orderkey::INTEGER AS run, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 99 / 60 ELSE CAST(o_custkey % 99 AS DOUBLE) END AS hours, CAST(o_custkey % 50 AS VARCHAR) AS aep, (o_orderkey % 10)::INTEGER AS tp, o_totalprice AS peak FROM orders")
def read_batch_runs(spark, d):
    unit = F.when(F.col("o_custkey") % 2 == 0, "min").otherwise("hour")
    row = joined(" ", F.col("o_orderkey"), F.col("o_custkey") % 99, unit, F.concat(text(F.col("o_custkey") % 50), F.lit("%")), F.col("o_orderkey") % 10, "1.5", "Y", F.col("o_totalprice"))
    lines = lines_of(table(spark, d, "orders"), F.concat(F.lit("/r/batch"), text(F.pmod(F.xxhash64("o_orderkey"), F.lit(997))), F.lit(".out")), F.col("o_orderkey") * 2, row, "Peak  Description", " Run Duration Unit AEP TPat A B Peak1")
    out = readers.batch_peaks(lines).filter("name = 'Peak1'")
    return out.select("run", F.col("duration_hours").alias("hours"), "aep", "tp", F.col("value").alias("peak"))


@query("read_js_array", "SELECT page_id, url AS u, '[' || page_id || ']' AS n FROM pages")
def read_js_array(spark, d):
    quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce("url", F.lit(None).cast("string")).alias("u"))), r'(?s)^\{"u":(".*")\}$', 1)
    quoted = F.when(F.col("url").isNull(), "null").otherwise(quoted)
    page = F.concat(F.lit('<script>var rows = [{"u": '), quoted, F.lit(', "n": ['), text(F.col("page_id")), F.lit("],},]; var other = [1];</script>"))
    pages = table(spark, d, "pages").select("page_id", page.alias("html"))
    return readers.js_array(pages, "rows").select("page_id", F.col("entry")["u"].alias("u"), F.col("entry")["n"].alias("n"))


@query("read_strings", "SELECT l_orderkey AS o, CAST(l_extendedprice AS DOUBLE) AS x, l_tax AS y, l_discount AS z FROM lineitem")
def read_strings(spark, d):
    row = joined(" ", "1", F.col("l_tax"), F.col("l_extendedprice"), F.col("l_discount"))
    path = F.concat(F.lit("/r/"), text(F.col("l_orderkey")), F.lit(".str"))
    lines = lines_of(table(spark, d, "lineitem"), path, F.monotonically_increasing_id() % 1_000_000_000, row, "0 header")
    return readers.strings(lines).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("o"), "x", "y", "z")


@query("read_survey_angles", "SELECT 'Culvert ' || s_suppkey AS name, round(s_suppkey % 180 + (s_suppkey % 60) / 60.0, 6) AS degrees FROM supplier")
def read_survey_angles(spark, d):
    s = F.col("s_suppkey")
    row = F.concat(F.lit("  1.0 2.0 "), text(s % 180), F.lit("°"), text(s % 60), F.lit("'0\" 3.0 \"Culvert "), text(s), F.lit('"'))
    lines = table(spark, d, "supplier").select(F.lit("/r/a.rpt").alias("path"), s.cast("int").alias("line"), row.alias("text"))
    return readers.culvert_angles(lines).select("name", F.round("degrees", 6).alias("degrees"))


@query("unique_sorted", "SELECT c_mktsegment AS k, array_to_string(list_sort(list_distinct(list(c_nationkey))), ',') AS v FROM customer GROUP BY ALL")
def unique_sorted(spark, d):
    out = columns.unique_sorted(table(spark, d, "customer"), ["c_mktsegment"], "c_nationkey")
    return out.select(F.col("c_mktsegment").alias("k"), F.array_join("values", ",").alias("v"))


@query("merged_peaks", f"WITH {STORM} SELECT location, max(abs_max) AS peak FROM storm GROUP BY location")
def merged_peaks(spark, d):
    s = storm(spark, d).select("location", "abs_max", "name")
    known, new = (s.filter(F.pmod(F.xxhash64("name"), F.lit(2)) == i) for i in (0, 1))
    first = incremental.merge_peaks(None, known, ["location"], "abs_max", ["name"])
    return incremental.merge_peaks(first, new, ["location"], "abs_max", ["name"]).select("location", F.col("abs_max").alias("peak"))


@query("member_labels", "SELECT event_id, CASE WHEN event_id % 14 BETWEEN 1 AND 10 THEN 'TP' || lpad(CAST(event_id % 14 AS VARCHAR), 2, '0') ELSE '' END AS a FROM events")
def member_labels(spark, d):
    n = F.col("event_id") % 14
    return table(spark, d, "events").select("event_id", scenario.member_label(F.when(n % 2 == 0, F.concat(F.lit(" tp"), text(n))).otherwise(text(n))).alias("a"))


@query("sentinel_points", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE NOT (l_quantity % 3 = 0)")
def sentinel_points(spark, d):
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    z = F.when(F.col("l_quantity") % 3 == 0, F.when(F.col("l_quantity") % 2 == 0, "-9999").otherwise("-9999.0")).when(F.col("l_quantity") % 5 == 0, "odd").otherwise("1.5")
    lines = table(spark, d, "lineitem").select(*ids, joined(" ", F.col("l_tax"), F.col("l_discount"), z).alias("text"))
    return survey.without_sentinel(lines, -9999.0).select(*ids)


@query("command_list", """SELECT DISTINCT 'Q' || (c_custkey % 5) AS e1, CASE WHEN c_custkey % 3 > 0 THEN 'Exg' || (c_custkey % 3) END AS s1 FROM customer WHERE c_custkey % 11 > 1
 UNION SELECT 'kept', NULL FROM customer WHERE c_custkey % 11 = 1""")
def command_list(spark, d):
    k = F.col("c_custkey")
    scene = F.when(k % 3 > 0, F.concat(F.lit(" -s1 Exg"), text(k % 3))).otherwise(" -s Exg")
    line = F.when(k % 11 == 0, F.concat(F.when(k % 2 == 0, "::").otherwise(" @REM"), F.lit(" solver -e1 never"), text(k))).when(k % 11 == 1, "! solver -e1 kept")
    line = line.otherwise(F.concat(F.lit("solver -b -e1 Q"), text(k % 5), scene, F.lit(" -pu0 # -e2 none")))
    lines = table(spark, d, "customer").select(F.concat(F.lit("/r/list"), text(k % 64), F.lit(".bat")).alias("path"), k.cast("int").alias("line"), line.alias("text"))
    return survey.run_list(lines).select(F.col("combo")["e1"].alias("e1"), F.col("combo")["s1"].alias("s1"))


@query("culvert_pairs", "SELECT 'K' || s_suppkey AS name, s_acctbal AS us_x, CAST(s_suppkey AS DOUBLE) AS ds_x, CASE WHEN s_suppkey % 2 = 0 THEN 1.5 ELSE 2.5 END AS diameter, (s_suppkey % 4)::INTEGER AS pipes FROM supplier WHERE s_suppkey % 5 > 0")
def culvert_pairs(spark, d):
    s = F.col("s_suppkey")
    even = s % 2 == 0
    up = joined("\t", F.concat(F.lit("K"), text(s)), F.col("s_acctbal"), "1", "2", "", "RCP", F.when(even, F.lit("1.5")), "", s % 4, "", "")
    down = joined("\t", F.concat(F.when(s % 5 > 0, "K").otherwise("other"), text(s)), s, "1", "", "3", "", F.when(even, F.lit("9.9")).otherwise("2.5"), "", "", "", "")
    rows = table(spark, d, "supplier").select(s.alias("s"), F.posexplode(F.array(up, down)).alias("i", "t"))
    lines = lines_of(rows, F.concat(F.lit("/r/a"), text(F.col("s") % 61), F.lit(".txt")), F.col("s") * 2 + F.col("i"), F.col("t"), "title", "\t".join(survey.CULVERT), "units")
    return survey.culvert_pairs(lines).select(F.col("Name").alias("name"), F.col("US_X").alias("us_x"), F.col("DS_X").alias("ds_x"), F.col("Diameter").alias("diameter"), F.col("Number of Pipes").alias("pipes"))


@query("design_rainfall", "SELECT n_name AS place, -1.0 - n_nationkey AS lat, i::INTEGER AS minutes, CASE k WHEN 0 THEN '1EY' ELSE '1%' END AS aep, CAST(i * (n_nationkey + 1) * (k + 1) AS DOUBLE) AS value FROM nation CROSS JOIN range(1, 31) r(i) CROSS JOIN range(0, 2) c(k)")
def design_rainfall(spark, d):
    n = F.col("n_nationkey")
    head = F.array(*[F.lit("c")] * 4, F.concat(F.lit("x,"), F.col("n_name")), F.concat(F.lit("x,Requested,"), text(n + 1), F.lit(",long,1")), F.lit("x,Nearest,1,long,1"), F.lit("note"), F.lit("Duration,Duration in min,1EY,1%"))
    body = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(text(i), F.lit(" min,"), text(i), F.lit(","), text(i * (n + 1)), F.lit(","), text(i * (n + 1) * 2)))
    lines = table(spark, d, "nation").select(F.concat(F.lit("/r/"), text(n)).alias("path"), F.posexplode(F.concat(head, body)).alias("line", "text"))
    return hydrology.design_rainfall(lines).select(F.col("location_label").alias("place"), F.col("req_lat").alias("lat"), "minutes", "aep", "value")
