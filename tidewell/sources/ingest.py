"""A cache of result files that knows its files: only new and changed ones are parsed, removed ones fall out.

A refresh lists the folders once and holds the listing (path, length, time of change) against the manifest. Files of the same
length and another time are compared by digest, and keep their rows if it is the same. What is new or changed is read once,
all types together, and written as whole texts; the readers of each type, and the check of its layout, work on that table.
Rows and manifest go under one commit (``versions``), so that readers see the state before or after a refresh.

A file that isn't of its layout gives no rows; its manifest row says why, and ``failures`` lists these. It never stops others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import quality
from tidewell.sources import files, layouts, readers, results, versions

MANIFEST = "path string, data_type string, length long, modified timestamp, digest string, status string, reason string, n_rows long, batch string, version long"
SUCCESS, FAILURE, REMOVED = "SUCCESS", "FAILURE", "REMOVED"


def manifest(spark: SparkSession, cache: str) -> DataFrame:
    """The last manifest row of each file that is still there."""
    known = versions.history(spark, cache)
    rows = [f"{cache}/{c['folder']}/manifest" for c in known]
    every = spark.read.schema(MANIFEST).parquet(*rows) if rows else spark.createDataFrame([], MANIFEST)
    columns = [F.col(c) for c in every.columns if c != "path"]
    last = every.groupBy("path").agg(F.max_by(F.struct(*columns), "version").alias("m")).select("path", "m.*")
    return last.filter(F.col("status") != REMOVED)


def _texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = spark.read.text([readers.literal_path(p) for p in paths], wholetext=True).select(readers.read_path().alias("path"), F.col("value"))
    return raw.select("path", F.sha2("value", 256).alias("digest"), F.col("value").alias("content"))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("path", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("line", "text"))


def _digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = spark.read.format("binaryFile").load([readers.literal_path(p) for p in paths])
    return raw.select(results.plain_path(F.col("path")).alias("path"), F.sha2("content", 256).alias("digest"))


def refresh(spark: SparkSession, roots: str | Sequence[str], cache: str, data_types: Sequence[str] | None = None) -> dict[str, int]:
    """Brings the cache up to the files under the roots; returns how many were added, changed, touched, removed and left alone."""
    batch = uuid.uuid4().hex
    folder, work = f"{cache}/data/{batch}", f"{cache}/work/{batch}"
    results.listing(spark, roots, data_types).write.parquet(f"{work}/listing")
    now = spark.read.parquet(f"{work}/listing")
    known = manifest(spark, cache)
    if data_types:
        known = known.filter(F.col("data_type").isin(list(data_types)))
    before = known.select("path", *[F.col(c).alias(f"_{c}") for c in known.columns if c != "path"])
    both = now.join(before, "path", "full")
    same_length = F.col("length") == F.col("_length")
    what = F.when(F.col("_length").isNull(), "added").when(F.col("length").isNull(), "removed").when(same_length & (F.col("modified") == F.col("_modified")), "same")
    both = both.withColumn("what", what.when(same_length, "touched").otherwise("changed"))
    both.write.parquet(f"{work}/compared")
    compared = spark.read.parquet(f"{work}/compared")
    counts = {r["what"]: r["n"] for r in compared.groupBy("what").agg(F.count("*").alias("n")).collect()}
    if set(counts) <= {"same"}:
        versions.drop(spark, work)
        return {w: counts.get(w, 0) for w in ("added", "changed", "touched", "removed", "same")}

    # the paths to be read are few beside the listing that Spark's own file index keeps on the driver
    paths = lambda kinds: compared.filter(F.col("what").isin(kinds)).select("path", "data_type", "_digest").collect()
    touched = {r["path"]: r["_digest"] for r in paths(["touched"])}
    alike = set()
    if touched:
        alike = {r["path"] for r in _digests(spark, list(touched)).collect() if r["digest"] == touched[r["path"]]}
    todo = [(r["path"], r["data_type"]) for r in paths(["added", "changed", "touched"]) if r["path"] not in alike]
    by_type: dict[str, list[str]] = {}
    for path, kind in todo:
        by_type.setdefault(kind, []).append(path)
    binary = by_type.pop("ccA", [])
    text_paths = [p for own in by_type.values() for p in own]
    status = []
    if todo:
        _digests(spark, [p for p, _ in todo]).write.parquet(f"{work}/digests")
    if text_paths:
        kinds = spark.createDataFrame([(p, k) for k, own in by_type.items() for p in own], "path string, data_type string")
        _texts(spark, text_paths).join(kinds, "path").write.partitionBy("data_type").parquet(f"{work}/texts")
        for kind in by_type:
            lines = _lines(spark.read.schema("path string, content string").parquet(f"{work}/texts/data_type={kind}"))
            results.READERS[kind](lines).write.parquet(f"{folder}/rows/{kind}")
            status.append(_status(spark, f"{folder}/rows/{kind}", kind, layouts.faults(lines, layouts.LAYOUTS[kind])))
    if binary:
        areas = results.channel_areas(readers.channel_areas(spark, [readers.literal_path(p) for p in binary])).withColumn("path", results.plain_path(F.col("path")))
        areas.write.parquet(f"{folder}/rows/ccA")
        status.append(_status(spark, f"{folder}/rows/ccA", "ccA", spark.createDataFrame([], "path string, reason string")))

    parsed = compared.filter(F.col("what").isin("added", "changed", "touched"))
    version = F.lit(len(versions.history(spark, cache))).cast("long").alias("version")
    kept = parsed.filter(F.col("path").isin(list(alike))).select("path", "data_type", "length", "modified", *[F.col(f"_{c}").alias(c) for c in ("digest", "status", "reason", "n_rows", "batch")], version)
    gone = compared.filter("what = 'removed'").select("path", F.col("_data_type").alias("data_type"), F.col("_length").alias("length"), F.col("_modified").alias("modified"), F.col("_digest").alias("digest"), F.lit(REMOVED).alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(0).cast("long").alias("n_rows"), F.lit(batch).alias("batch"), version)
    rows = kept.unionByName(gone)
    if todo:
        told = status[0]
        for s in status[1:]:
            told = told.unionByName(s)
        fresh = parsed.filter(~F.col("path").isin(list(alike))).select("path", "data_type", "length", "modified")
        fresh = fresh.join(spark.read.parquet(f"{work}/digests"), "path", "left").join(told, ["path", "data_type"], "left")
        reason = F.coalesce("reason", F.when(F.coalesce("n_rows", F.lit(0)) == 0, F.lit("gives no rows")))
        fresh = fresh.select("path", "data_type", "length", "modified", "digest", F.when(reason.isNull(), SUCCESS).otherwise(FAILURE).alias("status"), reason.alias("reason"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(batch).alias("batch"), version)
        rows = rows.unionByName(fresh)
    rows.write.parquet(f"{folder}/manifest")
    versions.commit(spark, cache, batch, f"data/{batch}")
    versions.drop(spark, work)
    out = {w: counts.get(w, 0) for w in ("added", "changed", "touched", "removed", "same")}
    return out | {"changed": out["changed"] + out["touched"] - len(alike), "touched": len(alike)}


def _status(spark: SparkSession, written: str, kind: str, faults: DataFrame) -> DataFrame:
    """(path, data_type, n_rows, reason) of the files of a type that gave rows or failed."""
    counts = spark.read.parquet(written).groupBy("path").agg(F.count("*").alias("n_rows"))
    return counts.join(faults, "path", "full").select("path", F.lit(kind).alias("data_type"), "n_rows", "reason")


def raw(spark: SparkSession, cache: str, data_type: str) -> DataFrame | None:
    """A type's rows as its reader gave them, of the files that are there and sound; None where there never was one."""
    current = manifest(spark, cache).filter((F.col("data_type") == data_type) & (F.col("status") == SUCCESS)).select("path", "batch")
    parts = []
    for c in versions.history(spark, cache):
        path = f"{cache}/{c['folder']}/rows/{data_type}"
        if versions.exists(spark, path):
            parts.append(spark.read.parquet(path).withColumn("batch", F.lit(c["batch"])))
    if not parts:
        return None
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(current, ["path", "batch"], "left_semi").drop("batch")


def table(spark: SparkSession, cache: str, data_type: str, locations: Iterable[str] | Mapping[str, Iterable[str]] | None = None) -> DataFrame | None:
    """A type's tidy table with the scenario of each file, as ``results.read_results`` gives it."""
    rows = raw(spark, cache, data_type)
    return None if rows is None else results.named(quality.entity_filter(rows, results.locations_of(locations, data_type)))


def failures(spark: SparkSession, cache: str) -> DataFrame:
    """(path, data_type, status, reason) of the files that gave no rows."""
    return manifest(spark, cache).filter(F.col("status") == FAILURE).select("path", "data_type", "status", "reason")
