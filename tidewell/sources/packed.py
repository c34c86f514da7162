"""Wide series files as a data source: small files are packed into tasks by bytes, large ones come apart, columns are chosen.

The listing is made once by the caller and is what tasks are planned from. A task takes pieces of files up to ``task_bytes``;
a file beyond that is several pieces, each of which reads the file's headings first and then the lines that begin in its
range. Of the entities that aren't wanted no cell is converted or sent to Spark. Cells stay text: the numbers are Spark's.

The wanted entities are an option of the scan and no pushed filter: all scans of one such source within a plan share what was
pushed last, so that a table joined with a filtered part of itself would lose rows.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewell.sources.files import located

FORMAT = "tidewell_series"
#: ``measure`` is a point output's type, a level's end (1 upstream, 2 downstream), else the data type.
SCHEMA = "path string, data_type string, time string, entity string, measure string, text string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Bytes of a task, what opening a file counts for, and bytes that are converted at once.
TASK_BYTES, OPEN_BYTES, BLOCK = 128 << 20, 1 << 20, 4 << 20
#: What stands before the ids in the headings of each type, and the rows of headings that it has.
PREFIXES = {"Q": "Q ", "V": "V ", "CF": "F ", "H": "H ", "PO": ""}
HEADS = {"PO": 2}
LINE_ENDS = re.compile(r"\r\n|\n|\r")
OUTSIDE_QUOTES = re.compile(r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
UNIT = re.compile(r"\s*\[[^\]]*\]\s*$", re.ASCII)


@dataclass
class Pieces(InputPartition):
    """(path, data type, first byte, byte after the last) of what one task reads."""

    pieces: list[tuple[str, str, int, int]]


def packed(files: Sequence[tuple[str, int, str]], task_bytes: int = TASK_BYTES, open_bytes: int = OPEN_BYTES) -> list[Pieces]:
    """The pieces of (path, length, data type) in tasks of at most ``task_bytes``, or one piece."""
    tasks: list[Pieces] = []
    left = 0
    for path, length, kind in files:
        for start in range(0, length, task_bytes):
            end = min(start + task_bytes, length)
            if not tasks or end - start > left:
                tasks.append(Pieces([]))
                left = task_bytes
            tasks[-1].pieces.append((path, kind, start, end))
            left -= end - start + open_bytes
    return tasks


def opened(path: str) -> io.BufferedReader:
    store, place = located(path)
    return io.BufferedReader(store.open_input_file(place), 1 << 20)


def cells_of(line: str) -> list[str]:
    """A line's trimmed cells, as ``readers.split_cells``."""
    if '"' not in line:
        return [c.strip(" ") for c in line.split(",")]
    own = [c.strip(" ") for c in OUTSIDE_QUOTES.split(line)]
    return [c[1:-1].replace('""', '"') if len(c) > 1 and c[0] == c[-1] == '"' else c for c in own]


def columns_of(kind: str, heads: list[list[str]]) -> tuple[int, list[tuple[int, str, str]]]:
    """The time's column, -1 without one, and (column, entity, measure) of the others."""
    if kind == "PO":
        types, places = heads
        named = [next((i for i, x in enumerate(h) if i and x.lower() == "time"), -1) for h in (places, types)]
        at = named[0] if named[0] > 0 else named[1]
        return at, [(i, p.strip(" "), t) for i, (t, p) in enumerate(zip(types, places, strict=False)) if i and i != at]
    out = []
    for i, own in list(enumerate(heads[0]))[2:]:
        name = UNIT.sub("", own).removeprefix(PREFIXES[kind]).strip(" ")
        if kind != "H":
            out.append((i, name, kind))
        elif "." in name:
            base, _, end = name.rpartition(".")
            out.append((i, base.strip(" "), end))
    return 1, out


def rows_of(lines: list[str], at: int, columns: list[tuple[int, str, str]]) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
    """Times of the lines that have one; line and column numbers of the cells that aren't empty, and these."""
    times, which, place, texts = [], [], [], []
    for line in lines:
        quoted = '"' in line
        cells = cells_of(line) if quoted else line.split(",")
        if len(cells) < 2 or at >= len(cells):
            continue
        for k, (i, _, _) in enumerate(columns):
            if i < len(cells) and (text := cells[i] if quoted else cells[i].strip(" ")):
                which.append(len(times))
                place.append(k)
                texts.append(text)
        times.append(cells[at].strip(" "))
    return times, np.array(which, np.int64), np.array(place, np.int64), texts


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = [tuple(f) for f in json.loads(options["files"])]
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        self.wanted = set(json.loads(options.get("entities", "[]")))

    def partitions(self) -> list[Pieces]:
        return packed(self.files, self.task_bytes) or [Pieces([])]  # Spark reads one partition where a source plans none

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            yield from self.piece(*piece)

    def piece(self, path: str, kind: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        with opened(path) as file:
            heads: list[list[str]] = []
            beside: list[str] = []  # lines that a lone carriage return ends come with the headings
            while len(heads) < HEADS.get(kind, 1):
                raw = file.readline()
                if not raw:
                    return
                for line in LINE_ENDS.split(raw.decode("utf-8", "replace")):
                    if len(heads) == HEADS.get(kind, 1):
                        beside.append(line)
                    elif len(cells := cells_of(line)) > 1:
                        heads.append(cells)
            at, columns = columns_of(kind, heads)
            columns = [c for c in columns if not self.wanted or c[1] in self.wanted]
            if at < 0 or not columns:
                return
            if start == 0:
                yield from self.batches(path, kind, at, columns, beside)
            if start > file.tell():
                file.seek(start - 1)
                file.readline()
            while (here := file.tell()) < end:
                size = min(BLOCK, end - here)
                raw = file.readlines(size - 1) if size > 1 else [file.readline()]  # stops beyond its hint; none is 0
                if not raw or not raw[0]:
                    return
                yield from self.batches(path, kind, at, columns, LINE_ENDS.split(b"".join(raw).decode("utf-8", "replace")))

    def batches(self, path: str, kind: str, at: int, columns: list[tuple[int, str, str]], lines: list[str]) -> Iterator[pa.RecordBatch]:
        times, which, place, texts = rows_of(lines, at, columns)
        if texts:
            entities, measures = (pa.array([c[k] for c in columns], pa.string()).take(pa.array(place)) for k in (1, 2))
            own = [pa.array([x] * len(texts), pa.string()) for x in (path, kind)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(times, pa.string()).take(pa.array(which)), entities, measures, pa.array(texts, pa.string())], NAMES)


class SeriesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SeriesReader:
        return SeriesReader(self.options)


def series(spark: SparkSession, files: Sequence[tuple[str, int, str]], entities: Sequence[str] = (), task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, data_type, time, entity, measure, text) of the (path, length, data type) listed; all entities if none is named.

    The listing is on the driver, as Spark's own index of files is.
    """
    spark.dataSource.register(SeriesSource)
    own = {"files": json.dumps([list(f) for f in files]), "entities": json.dumps(list(entities)), "task_bytes": task_bytes}
    return spark.read.format(FORMAT).options(**own).load()
