"""Queries on sets of polygons, dictionaries and columns that data name, and on workflows that reports leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import workflows
from tidewell.functions import hydro
from tidewell.operators import combine, dictionary, polygons, quality
from tidewell.plans.bindings import STORM, storm, table
from tidewell.plans.catalog import NAME, ORACLE_SQL, POINTS, _names, _points, query
from tidewell.plans.reports import _cmx_lines, _po, _pomm, joined, lines_of, text
from tidewell.sources import files, hydrology, readers, results, survey

TRIANGLES = "tri AS (SELECT n_nationkey AS n, n_nationkey * 2.0 AS ux, 0.0 AS uy, n_nationkey * 2.0 + 30 AS vx, 1.0 AS vy, n_nationkey + 5.0 AS wx, 8.0 AS wy FROM nation)"


def _triangles(spark, d):
    n = F.col("n_nationkey")
    corners = F.array(polygons.point(n * 2, 0.0), polygons.point(n * 2 + 30, 1.0), polygons.point(n + 5, 8.0))
    return table(spark, d, "nation").select(n.alias("n"), corners.alias("corners"))


_SIDE = lambda p, q: f"(t.{q}x - t.{p}x) * (y - t.{p}y) - (t.{q}y - t.{p}y) * (x - t.{p}x)"


@query("points_in_polygons", f"""WITH {POINTS}, {TRIANGLES} SELECT n, count(*) AS points, sum(k)::BIGINT AS orders FROM pts JOIN tri t ON
 ({_SIDE('u', 'v')} >= 0 AND {_SIDE('v', 'w')} >= 0 AND {_SIDE('w', 'u')} >= 0) OR ({_SIDE('u', 'v')} <= 0 AND {_SIDE('v', 'w')} <= 0 AND {_SIDE('w', 'u')} <= 0) GROUP BY n""")
def points_in_polygons(spark, d):
    met = polygons.points_in_polygons(_points(spark, d), _triangles(spark, d), "x", "y", "n", "corners", 1.5)
    return met.groupBy("n").agg(F.count("*").alias("points"), F.sum("k").alias("orders"))


@query("polygon_cell_areas", f"WITH {TRIANGLES} SELECT n, round(abs((vx - ux) * (wy - uy) - (vy - uy) * (wx - ux)) / 2, 6) AS area FROM tri")
def polygon_cell_areas(spark, d):
    return polygons.cell_areas(_triangles(spark, d), "n", "corners", 0.75).groupBy("n").agg(F.round(F.sum("area"), 6).alias("area"))


@query("polygon_area_means", """WITH g AS (SELECT CAST(l_quantity AS BIGINT) AS i, l_linenumber AS j, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
 b AS (SELECT s_suppkey AS s, CAST(s_suppkey % 40 + 0.25 AS DOUBLE) AS x0, CAST(s_suppkey % 40 + 1.5 + s_suppkey % 5 AS DOUBLE) AS x1, CAST(s_suppkey % 4 + 0.5 AS DOUBLE) AS y0, CAST(s_suppkey % 4 + 2.75 AS DOUBLE) AS y1 FROM supplier),
 o AS (SELECT s, v, (least(x1, i + 1) - greatest(x0, i)) * (least(y1, j + 1) - greatest(y0, j)) AS a FROM b JOIN g ON i < x1 AND i + 1 > x0 AND j < y1 AND j + 1 > y0)
 SELECT s, round(sum(a), 6) AS area, round(sum(a * v) / sum(a), 4) AS mean FROM o GROUP BY s""")
def polygon_area_means(spark, d):
    grid = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.avg("l_extendedprice").alias("v"))
    s = F.col("s_suppkey")
    x0, x1, y0, y1 = s % 40 + 0.25, s % 40 + 1.5 + s % 5, s % 4 + 0.5, s % 4 + 2.75
    boxes = table(spark, d, "supplier").select(s.alias("s"), F.array(polygons.point(x0, y0), polygons.point(x1, y0), polygons.point(x1, y1), polygons.point(x0, y1)).alias("box"))
    out = polygons.area_means(grid, boxes, "s", "box", 1.0, "v")
    return out.select("s", F.round("area", 6).alias("area"), F.round("mean", 4).alias("mean"))


@query("ordered_codes", "SELECT page_id, CASE WHEN url IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY url NULLS LAST) - 1 END AS code FROM pages")
def ordered_codes(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return dictionary.encoded(pages, "url", dictionary.ordered_codes(pages, "url"), "code").select("page_id", "code")


@query("merged_codes", "SELECT value, code, was FROM (SELECT s AS value, dense_rank() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT source AS s FROM documents UNION SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) WHERE s IS NOT NULL) LEFT JOIN (SELECT DISTINCT source AS o, dense_rank() OVER (ORDER BY source) - 1 AS was FROM documents WHERE source IS NOT NULL) ON o = value")
def merged_codes(spark, d):
    docs = table(spark, d, "documents").select("source", "lang")
    every, mapping = dictionary.merged(dictionary.ordered_codes(docs, "source"), docs, "lang")
    return every.join(mapping, "code", "left").select("value", "code", F.col("old_code").alias("was"))


_CODE = f"regexp_replace({NAME}, '(_POMM|_1d_cmx|_PO)\\.csv$', '')"


@query("token_columns", f"WITH t AS (SELECT event_id, string_split(translate({_CODE}, '+', '_'), '_') AS t FROM events) SELECT event_id, t[1] AS \"R01\", t[2] AS \"R02\", t[3] AS \"R03\", t[4] AS \"R04\", t[5] AS \"R05\" FROM t")
def token_columns(spark, d):
    out = dictionary.token_columns(files.with_scenario(_names(spark, d)), "run_tokens")
    return out.select("event_id", *[c for c in out.columns if c.startswith("R0")])


@query("flattened_columns", "SELECT event_id, CAST(event_type AS VARCHAR) AS event_type, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN 'x' || event_id END AS event_type_meta FROM events")
def flattened_columns(spark, d):
    entries = F.map_concat(F.from_json("props", "map<string,string>"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("event_type"), F.concat(F.lit("x"), text(F.col("event_id"))))).otherwise(F.create_map().cast("map<string,string>")))
    return dictionary.flattened(table(spark, d, "events").select("event_id", "event_type", entries.alias("entries")), "entries").select("event_id", "event_type", "k", "event_type_meta")


@query("rainfall_tables", """WITH v AS (SELECT n_nationkey AS n, i, CAST(i * (n_nationkey + 1) AS DOUBLE) AS mean, CASE i WHEN 1 THEN 0.0 WHEN 2 THEN 3.0 + n_nationkey * 2 ELSE CAST(i + n_nationkey AS DOUBLE) END AS a FROM nation CROSS JOIN range(1, 13) r(i))
 SELECT n, CAST(i AS DOUBLE) AS increment, i * (n % 4 + 1) / 2 AS time, 'Mean' AS name, mean AS value FROM v UNION ALL SELECT n, i, i * (n % 4 + 1) / 2, 'Sub-area A', a FROM v
 UNION ALL SELECT n_nationkey, 13, 13 * (n_nationkey % 4 + 1) / 2, c, 0.0 FROM nation CROSS JOIN (VALUES ('Mean'), ('Sub-area A')) x(c)""")
def rainfall_tables(spark, d):
    n = F.col("n_nationkey")
    head = F.array(F.concat(F.lit("Time increment (hours)= "), text((n % 4 + 1) / 2)), F.lit("note"), F.lit("Time     Mean"), F.lit(""), F.lit("Incs                A"))
    body = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lpad(text(i), 4, " "), F.lpad(text(i * (n + 1)), 9, " "), F.lpad(text(i + n), 8, " ")))
    lines = table(spark, d, "nation").select(F.concat(F.lit("/r/"), text(n), F.lit(".out")).alias("path"), F.posexplode(F.concat(head, body)).alias("line", "text"))
    out = hydrology.rainfall(lines, 6, 17)
    return out.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("n"), "increment", "time", "name", "value")


@query("workflow_po_combine", "SELECT user_id AS location, event_type AS type, count(*) AS n, count(CASE WHEN event_id % 7 <> 0 THEN 1 END) AS known FROM events GROUP BY ALL")
def workflow_po_combine(spark, d):
    po = _po(spark, d).withColumns({"run_tokens": F.array(), "path": F.lit("/r/a_PO.csv"), "file": F.lit("a_PO.csv")})
    out = workflows.po_combine({"PO": po})["combined_PO"]
    return out.groupBy(F.col("Location").cast("long").alias("location"), F.col("Type").alias("type")).agg(F.count("*").alias("n"), F.count("Value").alias("known"))


@query("workflow_pomm_combine", f"""WITH {STORM} SELECT location, type, count(*) AS n, round(sum(abs_max), 2) AS total FROM storm GROUP BY ALL
 UNION ALL SELECT 'C' || c_custkey, 'Q', 1, round(c_acctbal, 2) FROM customer""")
def workflow_pomm_combine(spark, d):
    other = table(spark, d, "customer").select(F.concat(F.lit("C"), text(F.col("c_custkey"))).alias("Chan ID"), F.col("c_acctbal").alias("Q"), F.lit("q").alias("internalName"), F.array().alias("run_tokens"))
    out = workflows.pomm_combine({"POMM": _pomm(spark, d), "RLL_Qmx": other})["combined_POMM"]
    return out.groupBy(F.col("Location").alias("location"), F.col("Type").alias("type")).agg(F.count("*").alias("n"), F.round(F.sum("AbsMax"), 2).alias("total"))


_STAT = ORACLE_SQL["culvert_stat_median"]


@query("workflow_culvert_statistics", f"SELECT aep AS aep_text, location AS channel, type, run AS trim_runcode, duration, abs_max_median AS \"Q_median\", adopted_name, n AS duration_bin FROM (SELECT *, row_number() OVER (PARTITION BY aep, location, type, run ORDER BY abs_max_median DESC NULLS LAST, duration) AS r, count(abs_max_median) OVER (PARTITION BY aep, location, type, run) AS n FROM ({_STAT})) WHERE r = 1")
def workflow_culvert_statistics(spark, d):
    names = {"aep": "aep_text", "duration": "duration_text", "location": "Chan ID", "run": "trim_runcode", "name": "internalName", "abs_max": "Q", "v": "V", "us_h": "US_h", "ds_h": "DS_h"}
    out = workflows.culvert_statistics(storm(spark, d).withColumnsRenamed(names), "median", ["aep_text", "Chan ID", "type", "trim_runcode"], include_all=False)["aep-median-max"]
    return out.select("aep_text", F.col("Chan ID").alias("channel"), "type", "trim_runcode", F.col("duration_text").alias("duration"), F.round(F.col("Q_median") + 1e-9, 4).alias("Q_median"), "adopted_name", "duration_bin")


@query("workflow_missing_runs", f"""WITH {STORM}, have AS (SELECT DISTINCT run, aep, duration, tp FROM storm WHERE abs_max > 102000), sets AS (SELECT run, aep, duration, count(*) AS n FROM have GROUP BY ALL),
 miss AS (SELECT s.run, s.aep, s.duration, 'TP' || lpad(CAST(i AS VARCHAR), 2, '0') AS tp FROM sets s CROSS JOIN range(1, 8) r(i) WHERE EXISTS (SELECT 1 FROM sets WHERE n = 7))
 SELECT m.run, m.aep, m.duration, m.tp FROM miss m ANTI JOIN have h ON m.run = h.run AND m.aep = h.aep AND m.duration = h.duration AND m.tp = h.tp""")
def workflow_missing_runs(spark, d):
    runs = storm(spark, d).filter("abs_max > 102000").select(F.col("run").alias("trim_runcode"), "aep", "duration", "tp")
    out = workflows.missing_runs_report(runs, 7)["missing"]
    return out.select(F.col("trim_run_code").alias("run"), "aep", "duration", F.col("missing_tp").alias("tp"))


@query("workflow_report_facts", f"WITH {STORM} SELECT 'storm rows' AS name, CAST(count(*) AS VARCHAR) AS value FROM storm UNION ALL SELECT 'events rows', CAST(count(*) AS VARCHAR) FROM events UNION ALL SELECT 'Source directories', string_agg(DISTINCT '/runs/' || event_type, chr(10) ORDER BY '/runs/' || event_type) FROM events UNION ALL VALUES ('made by', 'me')")
def workflow_report_facts(spark, d):
    events = table(spark, d, "events").select("event_id", F.concat(F.lit("/runs/"), "event_type").alias("directory_path"))
    return workflows.report_facts(spark, {"storm": storm(spark, d), "events": events}, {"made by": "me"})


@query("run_variables", "SELECT flag, string_agg(v, ' ' ORDER BY lower(v), v) AS values FROM (SELECT DISTINCT 'e1' AS flag, 'Q' || (c_custkey % 37) AS v FROM customer UNION SELECT 's1', CASE c_custkey % 2 WHEN 0 THEN 'exg' ELSE 'Dev' END || (c_custkey % 3) FROM customer) GROUP BY flag")
def run_variables(spark, d):
    k = F.col("c_custkey")
    line = F.concat(F.lit("run -e1 Q"), text(k % 37), F.lit(" -s1 "), F.when(k % 2 == 0, "exg").otherwise("Dev"), text(k % 3))
    lines = table(spark, d, "customer").select(F.concat(F.lit("/r/"), text(k % 64)).alias("path"), k.cast("int").alias("line"), line.alias("text"))
    return survey.run_variables(survey.run_list(lines))


@query("distinct_points", "SELECT x, y, z, min(k) AS k FROM (SELECT round(l_quantity, 3) AS x, round(l_tax, 3) AS y, round(l_discount, 3) AS z, l_orderkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY x, y, z")
def distinct_points(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_tax").cast("double").alias("y"), F.col("l_discount").cast("double").alias("z"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    out = survey.distinct_rounded(rows, "k")
    return out.select(*[F.round(c, 3).alias(c) for c in "xyz"], "k")


@query("combined_culverts", "SELECT 'K' || s_suppkey AS name, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal ELSE 0.0 END AS us_x, CASE WHEN s_suppkey % 4 > 0 THEN round(s_suppkey % 180 + (s_suppkey % 60) / 60.0, 6) ELSE 0.0 END AS degrees FROM supplier WHERE s_suppkey % 3 > 0 OR s_suppkey % 4 > 0")
def combined_culverts(spark, d):
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier")
    up = joined("\t", F.concat(F.lit("K"), text(s)), F.col("s_acctbal"), "1", "2", "", "RCP", "1.5", "", "1", "", "")
    down = joined("\t", F.concat(F.lit("K"), text(s)), "7", "1", "", "3", "", "", "", "", "", "")
    both = rows.filter(s % 3 > 0).select(s.alias("s"), F.posexplode(F.array(up, down)).alias("i", "t"))
    txt = lines_of(both, F.concat(F.lit("/r/"), text(F.col("s") % 50), F.lit(".txt")), F.col("s") * 2 + F.col("i"), F.col("t"), "title", "\t".join(survey.CULVERT), "units")
    row = F.concat(F.lit("  1.0 2.0 "), text(s % 180), F.lit("°"), text(s % 60), F.lit("'0\" 3.0 \"K"), text(s), F.lit('"'))
    rpt = rows.filter(s % 4 > 0).select(F.concat(F.lit("/r/"), text(s % 50), F.lit(".rpt")).alias("path"), s.cast("int").alias("line"), row.alias("text"))
    out = survey.combined_culverts(readers.culvert_angles(rpt), survey.culvert_pairs(txt))
    return out.select(F.col("Name").alias("name"), F.col("US_X").alias("us_x"), F.round("Angle_Degrees", 6).alias("degrees"))


@query("profile_areas", "SELECT s_suppkey AS k, CAST((2 + s_suppkey % 5) * (2 + s_suppkey % 5) AS DOUBLE) AS below, CAST((2 + s_suppkey % 5) * (2 + s_suppkey % 5) AS DOUBLE) AS above FROM supplier")
def profile_areas(spark, d):
    """A profile that is flat, rises twice as steep as the line and is flat again: two triangles of equal area."""
    corners = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (1.0, 0.0), (3.0, 4.0), (4.0, 4.0))])
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (2.0 + F.col("s_suppkey") % 5).alias("h"), F.explode(corners).alias("p"))
    rows = rows.select("k", (F.col("p.x") * F.col("h")).alias("x"), (F.col("p.y") * F.col("h")).alias("y"), (2 * F.col("h")).alias("cx"), (2 * F.col("h")).alias("cy"), F.lit(1.0).alias("s"))
    return survey.profile_areas(rows, ["k"], "x", "y", "cx", "cy", "s")


@query("workflow_hydrologic_closures", """WITH f AS (SELECT n_nationkey AS n, tp, i, CAST((n_nationkey + tp * 3 + i * 5) % 17 AS DOUBLE) AS v FROM nation CROSS JOIN range(1, 6) t(tp) CROSS JOIN range(0, 24) s(i))
 SELECT n, CAST(tp AS VARCHAR) AS tp, CAST(x AS DOUBLE) AS threshold, count(*) AS n_above, count(*) / 2 AS duration_exceeding FROM f CROSS JOIN (VALUES (3), (8), (15)) l(x) WHERE v > x GROUP BY ALL""")
def workflow_hydrologic_closures(spark, d):
    n = F.col("n_nationkey")
    place = F.concat(F.lit("/runs/n"), text(n))
    members = table(spark, d, "nation").select(n, place.alias("place"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("tp"))
    told = members.select(F.concat("place", F.lit("/batch.out")).alias("path"), F.col("tp"), F.concat(F.lit(" "), text(F.col("tp")), F.lit(" 24 hour 1% "), text(F.col("tp")), F.lit(" 12.5 Y 100")).alias("t"))
    batch = lines_of(told, F.col("path"), F.col("tp"), F.col("t"), "Peak  Description", " Run Duration Unit AEP TPat Peak0001")
    value = lambda i: (n + F.col("tp") * 3 + i * 5) % 17
    body = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.concat_ws(",", text(i + 1), text(i / 2), text(value(i))))
    flows = members.select(F.concat("place", F.lit("/aep1_du24hourtp"), text(F.col("tp")), F.lit(".csv")).alias("path"), F.posexplode(F.concat(F.array(F.lit("t"), F.lit("t"), F.lit("Inc,Time (hrs),Calculated hydrograph:  Out")), body)).alias("line", "text"))
    out = workflows.hydrologic_closure_durations(batch, flows, [3.0, 8.0, 15.0])["Duration_Exceedance"]
    return out.select(F.regexp_extract("directory_path", r"n(\d+)$", 1).cast("long").alias("n"), F.col("tp_text").alias("tp"), "threshold", "n_above", "duration_exceeding")


@query("layout_faults", "SELECT 'R' || s_suppkey AS file, CASE s_suppkey % 4 WHEN 1 THEN 'lacks Vmax' WHEN 2 THEN 'line 3, Qmax: x' || s_suppkey || ' is no double' ELSE 'has no rows' END AS reason FROM supplier WHERE s_suppkey % 4 > 0")
def layout_faults(spark, d):
    from tidewell.sources import layouts

    s = F.col("s_suppkey")
    head = F.when(s % 4 == 1, F.lit("Chan ID,Time Qmax,Qmax,Time Vmax")).otherwise(F.lit("Chan ID,Time Qmax,Qmax,Time Vmax,Vmax"))
    second = F.concat(F.lit("b,1,"), F.when(s % 4 == 2, F.concat(F.lit("x"), text(s))).otherwise(text(s)), F.lit(",1,1"))
    body = F.when(s % 4 == 3, F.array(head)).otherwise(F.array(head, F.lit("a,1,2,3,4"), second))
    lines = table(spark, d, "supplier").select(F.concat(F.lit("R"), text(s)).alias("path"), F.posexplode(body).alias("line", "text"))
    return layouts.faults(lines, layouts.LAYOUTS["Cmx"]).select(F.col("path").alias("file"), "reason")


@query("weighted_maxima", "SELECT c_nationkey AS run, round(sum(c_acctbal * (c_custkey % 11)) / sum(c_custkey % 11), 4) AS mean FROM customer WHERE c_custkey % 9 > 0 GROUP BY ALL HAVING sum(c_custkey % 11) > 0")
def weighted_maxima(spark, d):
    rows = results.tidy(_cmx_lines(spark, d), "Cmx")
    own = rows.groupBy("internalName", "Chan ID").agg(F.max("Q").alias("q"), F.max("V").alias("v")).filter("q is not null")
    out = combine.weighted_mean(own.filter("v > 0"), ["internalName"], "q", "v")
    return out.select(F.regexp_extract("internalName", r"^R(\d+)", 1).cast("long").alias("run"), F.round("weighted_mean", 4).alias("mean"))


@query("name_contains", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example') OR NOT EXISTS (SELECT 1 FROM pages WHERE contains(lower(url), 'example'))")
def name_contains(spark, d):
    return quality.containing(table(spark, d, "pages").select("page_id", "url"), "url", "EXAMPLE")


@query("crossing_names", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'Scenario' WHEN l_linenumber % 3 = 1 THEN 'Run_' || l_orderkey ELSE 'R_' || l_orderkey END || '_at_' || CASE WHEN l_linenumber % 2 = 0 THEN 'CHAN' ELSE 'C_' || l_linenumber END AS name FROM lineitem""")
def crossing_names(spark, d):
    n, key = F.col("l_linenumber"), text(F.col("l_orderkey"))
    internal = F.when(n % 3 == 1, F.concat(F.lit("Run #"), key)).otherwise(" ")
    trimmed = F.when(n % 3 == 2, F.concat(F.lit("R+"), key))
    channel = F.when(n % 2 == 1, F.concat(F.lit("C."), text(n)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hydro.crossing_name(internal, trimmed, channel, "{internal} at {channel}").alias("name"))


@query("page_arrays", "SELECT page_id, 'rows' AS variable, 0 AS place, url AS u FROM pages WHERE page_id % 5 > 0 UNION ALL SELECT page_id, 'more', i::INTEGER, CAST(page_id + i AS VARCHAR) FROM pages CROSS JOIN range(0, 2) r(i) WHERE page_id % 5 > 0")
def page_arrays(spark, d):
    k = F.col("page_id")
    rows = F.to_json(F.array(F.create_map(F.lit("u"), F.col("url"))))
    more = F.concat(F.lit('[{"u": "'), text(k), F.lit('",}, {"u": '), text(k + 1), F.lit("},]"))
    html = F.when(k % 5 > 0, F.concat(F.lit("<script>var rows = "), rows, F.lit("; var more = "), more, F.lit("; x = 1;</script>"))).otherwise("nothing here")
    found, _ = readers.js_arrays(table(spark, d, "pages").select("page_id", "url", html.alias("html")), ["rows", "more"], "page_id")
    return found.select("page_id", "variable", "place", F.col("entry")["u"].alias("u"))


@query("page_failures", "SELECT page_id, 'has no more, has no rows' AS reason FROM pages WHERE page_id % 5 = 0")
def page_failures(spark, d):
    k = F.col("page_id")
    html = F.when(k % 5 > 0, F.lit('var rows = []; var more = [{"u": 1}];')).otherwise("nothing here")
    return readers.js_arrays(table(spark, d, "pages").select("page_id", html.alias("html")), ["rows", "more"], "page_id")[1]


@query("design_rainfall_kinds", "SELECT 'Town' || n_nationkey AS location, k AS kind, 1::BIGINT AS n_files, 6::BIGINT AS n_rows FROM nation CROSS JOIN (VALUES ('ifds'), ('rare'), ('very_frequent')) x(k)")
def design_rainfall_kinds(spark, d):
    n = F.col("n_nationkey")
    head = F.array(*[F.lit("c")] * 4, F.lit("x,Town"), F.lit("x,Requested,1,long,1"), F.lit("x,Nearest,1,long,1"), F.lit("note"), F.lit("Duration,Duration in min,1EY,1%"))
    body = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(text(i), F.lit(" min,"), text(i), F.lit(","), text(i * (n + 1)), F.lit(","), text(i)))
    kinds = F.explode(F.array(*[F.lit(x) for x in (*hydrology.DESIGN_KINDS, "_other")]))
    each = table(spark, d, "nation").select(n, kinds.alias("mark"))
    lines = each.select(F.concat(F.lit("/r/Town"), text(n), "mark", F.lit("_depths.csv")).alias("path"), F.posexplode(F.concat(head, body)).alias("line", "text"))
    return hydrology.combined_design_rainfall(lines)[1]
