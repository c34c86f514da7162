"""The star schema in terms of results: ``storm`` rows are ensemble members, ``series`` rows are time series."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name where driver and executors share one; local mode makes its own if none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidewell-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def storm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order's, customer's, nation's and region's names. Orders meet their customers first, so that
    lineitem is shuffled once. The joins' small sides are left to the optimizer, which broadcasts what its statistics prove small."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "c_mktsegment", "c_nationkey")
    out = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    return out.select(
        F.col("o_orderpriority").alias("aep"), F.col("c_mktsegment").alias("duration"), F.col("n_name").alias("location"), F.col("l_linestatus").alias("type"),
        F.col("r_name").alias("run"), F.concat(F.lit("TP"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).alias("tp"), name.alias("name"),
        F.col("l_extendedprice").alias("abs_max"), F.col("l_quantity").alias("v"), F.col("l_discount").alias("us_h"), F.col("l_tax").alias("ds_h"),
    )


STORM = """storm AS (SELECT o_orderpriority AS aep, c_mktsegment AS duration, n_name AS location, l_linestatus AS type, r_name AS run,
  'TP' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS tp, l_orderkey || '_' || l_partkey || '_' || l_suppkey || '_' || l_linenumber AS name,
  l_extendedprice AS abs_max, l_quantity AS v, l_discount AS us_h, l_tax AS ds_h
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as series by user and type; every seventh value is unknown."""
    e = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return e.select(
        F.col("user_id").alias("location"), F.col("event_type").alias("type"), "event_id", (micros / 3.6e9).alias("time"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.get_json_object("props", "$.k").cast("int").alias("run"),
    )


SERIES = """series AS (SELECT user_id AS location, event_type AS type, event_id, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP)) / 3.6e9 AS time,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS run FROM events)"""
