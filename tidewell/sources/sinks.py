"""Writers: Parquet and CSV by Spark, a partitioned cache, a data dictionary, and limits of spreadsheets."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.files import located

#: Rows and columns of a spreadsheet.
MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384


def sheet_name(text: str) -> str:
    """Runs of letters, digits, _ and - joined by ``_``, as ``scenario.sheet_name``."""
    return "_".join(re.findall(r"[A-Za-z0-9_-]+", text)) or "Sheet"


def exceeds_limits(df: DataFrame) -> bool:
    """Whether a spreadsheet can't hold the rows, with a header, or the columns."""
    return len(df.columns) > MAX_COLUMNS or df.limit(MAX_ROWS).count() >= MAX_ROWS


def export(frames: Mapping[str, DataFrame], folder: str, mode: str = "parquet", compression: str = "gzip") -> dict[str, list[str]]:
    """Writes each frame as Parquet, CSV or both, under its sheet's name; returns the paths.

    ``excel`` is written as CSV, which no limit of rows binds, with Parquet beside it where a spreadsheet would overflow.
    """
    paths: dict[str, list[str]] = {}
    for name, df in frames.items():
        kinds = {"parquet": ["parquet"], "csv": ["csv"], "both": ["parquet", "csv"], "excel": ["csv", *["parquet"] * exceeds_limits(df)] if mode == "excel" else []}[mode]
        for kind in kinds:
            path = f"{folder}/{sheet_name(name)}.{kind}"
            writer = df.write.mode("overwrite")
            writer.option("compression", compression).parquet(path) if kind == "parquet" else writer.option("header", True).csv(path)
            paths.setdefault(name, []).append(path)
    return paths


def _file_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(folder)
        name, out, part, n = None, None, None, 0

        def done() -> pa.RecordBatch:
            out.close()
            store.move(part, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "n_lines"])

        for batch in batches:
            for own, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if own != name:
                    if name is not None:
                        yield done()
                    name, n = own, 0
                    store.create_dir(f"{root}/{own}".rpartition("/")[0], recursive=True)
                    part = f"{root}/{own}.{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(part)
                out.write(((text or "") + "\n").encode())
                n += 1
        if name is not None:
            yield done()

    return write


def write_files(lines: DataFrame, folder: str) -> dict[str, int]:
    """One text file for each ``path``, under the folder, of (path, line, text) in order of line; returns files and lines.

    A task streams its files one after another, each under another name until it is whole, so that a repeated task only
    replaces a file by its like. Null and blank paths name no file.
    """
    dealt = lines.filter(F.trim("path") != "").select(F.ltrim("path", F.lit("/")).alias("path"), "line", F.col("text").cast("string").alias("text"))
    dealt = dealt.repartition("path").sortWithinPartitions("path", "line").select("path", "text")
    told = dealt.mapInArrow(_file_writer(folder), "path string, n_lines long").agg(F.count("*").alias("files"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("lines"))
    return told.first().asDict()


def write_cache(df: DataFrame, path: str, by: Sequence[str] = ("data_type", "run")) -> None:
    """A cache whose folders are the columns that reads filter by."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def read_cache(spark: SparkSession, path: str, **wanted: Sequence[str]) -> DataFrame:
    df = spark.read.parquet(path)
    for column, values in wanted.items():
        df = df.filter(F.col(column).isin(list(values)))
    return df


#: Chosen rows that a read is pruned by.
CHOSEN = 10_000


def read_chosen(spark: SparkSession, path: str, chosen: DataFrame, by: str, on: Sequence[str] = ()) -> DataFrame:
    """Rows of a cache whose ``by`` folder, and ``on`` columns, are among the chosen ones.

    The chosen rows are worked out when the read is built. Up to CHOSEN of them name the only folders that are listed and
    read; where there are more, the cache is joined with them.
    """
    wanted = chosen.select(by, *on).filter(F.col(by).isNotNull()).distinct()
    first = wanted.limit(CHOSEN + 1).collect()
    rows = spark.read.parquet(path)
    if len(first) <= CHOSEN:
        rows = rows.filter(F.col(by).isin(sorted({r[0] for r in first})))
        wanted = spark.createDataFrame(first, wanted.schema)
    return rows.join(wanted, [by, *on])


def column_widths(df: DataFrame) -> DataFrame:
    """The length of the longest value or name of each column, and two more."""
    widths = df.agg(*[F.greatest(F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)), F.lit(len(c))).alias(c) for c in df.columns])
    return widths.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "width").withColumn("width", F.col("width") + 2)


def data_dictionary(spark: SparkSession, frames: Mapping[str, DataFrame], known: Mapping[str, str], by_sheet: Mapping[tuple[str, str], str] | None = None) -> DataFrame:
    """(sheet, column, description, type) of every column; a description of the sheet goes before the general one."""
    rows = [
        (sheet, name, (by_sheet or {}).get((sheet, name)) or known.get(name) or "TODO: describe", kind)
        for sheet, df in frames.items()
        for name, kind in df.dtypes
    ]
    return spark.createDataFrame(rows, "sheet string, column string, description string, type string")
