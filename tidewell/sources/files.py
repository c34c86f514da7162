"""File discovery on whatever store Spark reads: listings as DataFrames."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import scenario


def glob_regex(glob: str) -> str:
    """The case-insensitive regex of a glob with * and ?."""
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in glob) + "$"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store that Arrow opens inside tasks, and a path's place there, under the name that Spark gives it."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    authority, _, place = rest.lstrip("/").partition("/")
    store, root = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority}/")
    return store, f"{root.rstrip('/')}/{place}"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def find_files(spark: SparkSession, roots: Sequence[str], include: Sequence[str] = ("*",), exclude: Sequence[str] = (), recursive: bool = True, non_empty: bool = True) -> DataFrame:
    """(path, name, folder, length, modified) of the files under the roots; each path once. No contents are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    out = reader.load(list(dict.fromkeys(roots))).select("path", "length", F.col("modificationTime").alias("modified"))
    name = file_name(F.col("path"))
    keep, drop = F.lit(False), F.lit(False)
    for g in include:
        keep = keep | name.rlike(glob_regex(g))
    for g in exclude:
        drop = drop | name.rlike(glob_regex(g))
    out = out.filter(keep & ~drop).dropDuplicates(["path"])
    if non_empty:
        out = out.filter("length > 0")
    return out.withColumns({"name": name, "folder": F.regexp_extract("path", r"^(.*)/[^/]*$", 1)})


def collect_files(spark: SparkSession, roots: Sequence[str], data_types: Sequence[str] | None = None) -> DataFrame:
    """Result files with their data type and scenario."""
    out = with_scenario(find_files(spark, roots)).filter("data_type is not null")
    return out.filter(F.col("data_type").isin(list(data_types))) if data_types else out


def with_scenario(files: DataFrame, name: str = "name") -> DataFrame:
    """Adds data type, run code, its tokens and the scenario that a file's name tells."""
    out = files.withColumns({"data_type": scenario.data_type(F.col(name)), "run_code": scenario.run_code(F.col(name))})
    code = F.col("run_code")
    out = out.withColumns({"tp_text": scenario.tp_text(code), "duration_text": scenario.duration_text(code), "aep_text": scenario.aep_text(code)})
    tp, duration, aep = (F.col(c) for c in ("tp_text", "duration_text", "aep_text"))
    numbers = {"tp_numeric": scenario.number_of(tp).cast("int"), "duration_numeric": scenario.duration_minutes(duration), "aep_numeric": scenario.number_of(aep)}
    out = out.withColumns({"trim_run_code": scenario.trim_code(code, tp, duration, aep), "run_tokens": scenario.tokens(code)} | numbers)
    names = ["data_type", "run_code", "trim_run_code", "run_tokens", "tp_text", "duration_text", "aep_text", *numbers]
    return out.select(*[F.col(f"`{c}`") for c in files.columns if c not in names], *names)


def summary(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.max_by("path", F.struct("length", "path")).alias("largest"))


#: Bytes of a file's head and of its tail that the second stage compares, and that are read at a time in the third.
EDGE, BLOCK = 1 << 16, 1 << 20


def _opened(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store.open_input_file(inner)


def edge_digest(path: str) -> str:
    with _opened(path) as f:
        size = f.size()
        digest = hashlib.sha256(f.read(min(EDGE, size)))
        if size > EDGE:
            f.seek(max(EDGE, size - EDGE))
            digest.update(f.read())
    return digest.hexdigest()


def whole_digest(path: str) -> str:
    digest = hashlib.sha256()
    with _opened(path) as f:
        while block := f.read(BLOCK):
            digest.update(block)
    return digest.hexdigest()


def _digested(files: DataFrame, name: str, digest: Callable[[str], str]) -> DataFrame:
    """``files`` with a digest of each; null for one that can't be opened, which then equals no other."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def safe(path: str) -> str | None:
            try:
                return digest(path)
            except OSError:
                return None

        for batch in batches:
            made = pa.array([safe(p) for p in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return files.mapInArrow(rows, ", ".join(f"{c} {t}" for c, t in files.dtypes) + f", {name} string")


def duplicate_actions(files: DataFrame, across: bool = True, placeholder: str = ".DUPLICATE_REMOVED.txt") -> DataFrame:
    """(action, path, keep, suffix, length, digest, files): what to do about files (path, folder, length) of equal content.

    In stages, each only for files that the one before left equal: suffix and length, digest of head and tail, digest of
    all. Of equal files the first by name, whatever its case, is kept and the others are deleted; where files go from a
    folder that doesn't hold the kept one, a placeholder named after the first of them tells so. ``across`` compares folders
    with each other.
    """
    suffix = F.lower(F.regexp_extract(file_name(F.col("path")), r"(\.[^.]*)$", 1))
    own = files.select("path", "folder", "length", suffix.alias("suffix")).filter("length > 0")
    keys = ["suffix", "length"] + ([] if across else ["folder"])
    several = lambda df, by: df.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).filter("_n > 1").drop("_n")
    near = several(_digested(several(own, keys), "edge", edge_digest).filter("edge is not null"), [*keys, "edge"])
    same = _digested(near.drop("edge"), "digest", whole_digest).filter("digest is not null")
    first = Window.partitionBy(*keys, "digest").orderBy(F.lower("path"), "path")
    kept = same.withColumns({"keep": F.first("path").over(first), "_folder": F.first("folder").over(first)})
    gone = kept.filter(F.col("path") != F.col("keep"))
    rows = gone.groupBy("folder", "_folder", "suffix", "length", "digest", "keep").agg(F.sort_array(F.collect_list(F.struct(F.lower("path").alias("o"), "path"))).alias("f"))
    paths = F.transform("f", lambda e: e["path"])
    act = lambda action, path, told: F.struct(F.lit(action).alias("action"), path.alias("path"), told.alias("files"))
    one = F.array().cast("array<string>")
    deletes = F.transform(paths, lambda p: act("delete", p, one))
    writes = F.when(F.col("folder") != F.col("_folder"), F.array(act("placeholder", F.concat(paths[0], F.lit(placeholder)), paths))).otherwise(F.array().cast("array<struct<action:string,path:string,files:array<string>>>"))
    each = rows.select("keep", "suffix", "length", "digest", F.explode(F.concat(deletes, writes)).alias("a"))
    return each.select("a.action", "a.path", "keep", "suffix", "length", "digest", "a.files")


def duplicate_report(actions: DataFrame) -> DataFrame:
    """(keep, lines): for each kept file what a report says of it: its size and digest, and what is deleted and written."""
    said = F.when(F.col("action") == "delete", F.concat(F.lit("delete "), "path")).otherwise(F.concat(F.lit("placeholder "), "path", F.lit(" for "), F.array_join("files", ", ")))
    own = actions.groupBy("keep", "length", "digest").agg(F.sort_array(F.collect_list(said)).alias("said"), F.count(F.when(F.col("action") == "delete", 1)).alias("n"))
    head = F.concat(F.lit("keep "), "keep", F.lit(" ("), F.col("length").cast("string"), F.lit(" bytes, "), "digest", F.lit("), "), F.col("n").cast("string"), F.lit(" deleted"))
    return own.select("keep", F.concat(F.array(head), F.col("said")).alias("lines"))
