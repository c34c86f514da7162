"""Queries on files: the tables are written as result files first, then found, read, cached and renewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.plans.bindings import new_folder, table
from tidewell.plans.catalog import ORACLE_SQL, query
from tidewell.plans.reports import CELLS, _cmx_lines, _wide_lines, joined, lines_of, text
from tidewell.sources import ingest, results, sinks, versions

FLOWS = ["d,Time (h)," + ",".join(f"Q c{i} [run 1]" for i in range(6))]


def _flow_lines(spark, d) -> DataFrame:
    return _wide_lines(spark, d, "_1d_Q.csv", ["d"], FLOWS)


def _flows(df: DataFrame) -> DataFrame:
    return df.select(F.col("internalName").alias("run"), F.col("Time").alias("time"), F.col("Chan ID").alias("id"), F.col("Q").alias("q"))


@query("packed_flow_series", ORACLE_SQL["read_flow_series"])
def packed_flow_series(spark, d):
    folder = new_folder(spark, "flows")
    sinks.write_files(_flow_lines(spark, d), folder)
    return _flows(results.read_results(spark, folder, ["Q"], [f"c{i}" for i in range(5)])["Q"])


@query("locations_by_type", f"WITH {CELLS} SELECT 'Q' AS kind, 'c' || k AS id, count(v) AS n, round(sum(v), 2) AS total FROM cells WHERE k IN (1, 4) GROUP BY k UNION ALL SELECT 'V', 'c' || k, count(v), round(sum(v), 2) FROM cells GROUP BY k")
def locations_by_type(spark, d):
    """Flows at two locations, and velocities at all."""
    folder = new_folder(spark, "flows")
    velocities = _wide_lines(spark, d, "_1d_V.csv", ["d"], [FLOWS[0].replace("Q ", "V ")])
    sinks.write_files(_flow_lines(spark, d).unionByName(velocities), folder)
    tables = results.read_results(spark, folder, ["Q", "V"], {"q": ["c1", " c4 "]})
    sums = [tables[k].groupBy(F.lit(k).alias("kind"), F.col("Chan ID").alias("id")).agg(F.count(k).alias("n"), F.round(F.sum(k), 2).alias("total")) for k in ("Q", "V")]
    return sums[0].unionByName(sums[1])


@query("packed_results", f"""WITH {CELLS} SELECT 'PO' AS kind, translate(p, ' ', 'x') AS run, CAST(r AS DOUBLE) AS time, 'L' || k AS place, v AS value FROM cells WHERE v IS NOT NULL
 UNION ALL SELECT 'H', translate(p, ' ', 'x'), CAST(r AS DOUBLE), 'c' || (k // 2), max(v) FROM cells GROUP BY p, r, k // 2
 UNION ALL SELECT 'Cmx', run, time, id, coalesce(q, v) FROM ({ORACLE_SQL['read_cmx']})""")
def packed_results(spark, d):
    """Several types from one listing: points, levels and maxima."""
    folder = new_folder(spark, "results")
    levels = ["d,Time (h)," + ",".join(f"H c{i // 2}.{i % 2 + 1} [run 1]" for i in range(6))]
    points = ["d,Time,Flow,Flow,Flow,Level,Level,Level", "d,Time,L0,L1,L2,L3,L4,L5"]
    lines = _wide_lines(spark, d, "_PO.csv", ["d"], points).unionByName(_wide_lines(spark, d, "_1d_H.csv", ["d"], levels)).unionByName(_cmx_lines(spark, d))
    sinks.write_files(lines, folder)
    tables = results.read_results(spark, folder, ["PO", "H", "Cmx"])
    own = lambda kind, place, value: tables[kind].select(F.lit(kind).alias("kind"), F.col("internalName").alias("run"), F.col("Time").alias("time"), F.col(place).alias("place"), value.alias("value"))
    out = own("PO", "Location", F.col("Value")).unionByName(own("H", "Chan ID", F.greatest("US_h", "DS_h")))
    return out.unionByName(own("Cmx", "Chan ID", F.coalesce("Q", "V")))


def _renewed(spark, d) -> str:
    """A cache that has seen files come, change, fail and go: five files of flows, by order priority."""
    folder, cache = new_folder(spark, "flows"), new_folder(spark, "cache")
    lines = _flow_lines(spark, d)
    of = lambda *digits: F.substring(F.regexp_extract("path", r"([^/]*)$", 1), 1, 1).isin(*digits)
    sinks.write_files(lines.filter(of("1", "3", "4", "5")), folder)
    ingest.refresh(spark, folder, cache)
    changed = lines.filter(of("1")).withColumn("text", F.when(F.col("line") == 0, F.replace("text", F.lit("c0"), F.lit("d0"))).otherwise(F.col("text")))
    failed = lines.filter(of("4")).withColumn("text", F.element_at(F.split("text", ","), 1))
    sinks.write_files(lines.filter(of("2")).unionByName(changed).unionByName(failed), folder)
    versions.drop(spark, f"{folder}/r/5-LOW_1d_Q.csv")
    ingest.refresh(spark, folder, cache)
    return cache


@query("cache_refresh", f"WITH {CELLS} SELECT translate(p, ' ', 'x') AS run, CAST(r AS DOUBLE) AS time, CASE WHEN p[1] = '1' AND k = 0 THEN 'd0' ELSE 'c' || k END AS id, v AS q FROM cells WHERE p[1] IN ('1', '2', '3')")
def cache_refresh(spark, d):
    return _flows(ingest.table(spark, _renewed(spark, d), "Q"))


@query("cache_manifest", f"""WITH {CELLS}, n AS (SELECT translate(p, ' ', 'x') AS run, p[1] AS c, count(*) AS n FROM cells GROUP BY ALL)
 SELECT run, CASE c WHEN '4' THEN 'FAILURE' ELSE 'SUCCESS' END AS status, CASE c WHEN '4' THEN 0 ELSE n END AS n_rows, CASE c WHEN '3' THEN 0 ELSE 1 END::BIGINT AS version FROM n WHERE c <> '5'""")
def cache_manifest(spark, d):
    """What the cache says of its files: a file that has not changed keeps its version, a removed one is gone."""
    run = F.regexp_extract("path", r"([^/]*)_1d_Q\.csv$", 1)
    return ingest.manifest(spark, _renewed(spark, d)).select(run.alias("run"), "status", "n_rows", "version")


@query("written_files", "SELECT 'tile_' || (s_nationkey) || '.csv' AS name, count(*) + 1 AS n_lines, string_agg(s_suppkey || ',' || s_name, '|' ORDER BY s_suppkey) AS body FROM supplier GROUP BY s_nationkey")
def written_files(spark, d):
    """One named file for each nation's suppliers, written and read back."""
    folder = new_folder(spark, "tiles")
    path = F.concat(F.lit("tile_"), text(F.col("s_nationkey")), F.lit(".csv"))
    sinks.write_files(lines_of(table(spark, d, "supplier"), path, F.col("s_suppkey"), joined(",", F.col("s_suppkey"), F.col("s_name")), "id,name"), folder)
    back = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1).alias("name"), F.split(F.rtrim("value", F.lit("\n")), "\n").alias("own"))
    return back.select("name", F.size("own").cast("long").alias("n_lines"), F.array_join(F.slice("own", 2, F.size("own")), "|").alias("body"))
