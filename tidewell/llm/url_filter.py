"""URL filters: host-suffix and path-prefix expressions, equi-joined on short hash prefixes, then confirmed.

Each distinct (host, path) is expanded into its host suffixes times the prefixes of its path that rules can have (one
for each distinct length of a rule's path). A four-byte prefix of the expression's SHA-256 is the join key; the full
digest confirms the match, so a chance hit of a short prefix is dropped. The longest rule wins; between rules of equal
text, block wins.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule. Hosts keep ports and
user names. Repeated rows each get their verdict. Columns beside id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table

#: Rules up to this many bytes of expressions are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
PREFIX_HEX = 8
#: Hosts of their own that urls without a host are dealt to.
SPREAD = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The production rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules with their digest; a host and path given twice counts once, as block if any of them blocks."""
    made = spark.createDataFrame(rules, "host string, path string, action string")
    made = made.groupBy(F.concat("host", "path").alias("rule"), "path").agg(F.max("action").alias("action"))
    return made.withColumn("digest", F.sha2("rule", 256)).withColumn("key", F.substring("digest", 1, PREFIX_HEX))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules`` as made by ``rule_table``."""
    size = rules.agg(F.collect_set(F.length("path")).alias("lengths"), F.sum(F.length("rule") + 128).alias("bytes")).first()
    lengths = sorted(size["lengths"])
    said = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    pages = pages.select(*said, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    places = pages.select("host", "path").filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    prefixes = F.array_compact(F.array(*fitting)) if fitting else F.array().cast("array<string>")
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    expanded = places.select("host", "path", F.explode(expressions).alias("expression"))
    expanded = expanded.withColumn("own", F.sha2("expression", 256)).withColumn("key", F.substring("own", 1, PREFIX_HEX))
    known = rules.select("key", "digest", "rule", "action")
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    hits = expanded.join(known, "key").filter("own = digest")
    chosen = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "action", "rule")).alias("best"))
    chosen = chosen.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    # urls without a host, however many, go to hosts of their own that no rule fits
    apart = F.when(F.col("host") == "", F.concat(F.lit("/"), (F.monotonically_increasing_id() % SPREAD).cast("string"))).otherwise(F.col("host"))
    rows = pages.select(F.struct(*said).alias("row"), apart.alias("sought"), "host", "path")
    out = rows.join(chosen.toDF("sought", "path", "rule", "verdict"), ["sought", "path"], "left")
    return out.select("row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rhost, rpath, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
d AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS verdict
      FROM d JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
