"""Shared helpers of the training-data operators: reading, lineage cuts and word hashing in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

WORD_SPACE = bytes([0x20, *range(0x09, 0x0E)])
SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WORD_SPACE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HEAD = (np.arange(256) & 0xC0) != 0x80
_powers: list[np.ndarray] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode if it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
        root = context._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidewell-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, which cuts its lineage durably."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table of ``materialise`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidewell-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offset of each text; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    size = len(column)
    if not size:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + size + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` bytes together, one text at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 for 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def word_table(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, its code points, for each text the index of its first word, and the total).

    Words are runs of bytes other than space and \\t to \\r; a word never crosses from one text into the next.
    ``lower`` takes A-Z as a-z. Work arrays hold one segment, whatever the length of a text.
    """
    hashes, sizes, done = [], [], 0
    n, begin = len(data), 0
    starts_of_texts = offsets[:-1]
    firsts = []
    while begin < n:
        end = min(n, begin + SEGMENT)
        if end < n:  # cut where a word ends
            at = int(np.searchsorted(offsets, end, side="right")) - 1
            near = int(offsets[at]) if at < len(offsets) else 0
            if near > begin:
                end = near
            else:
                while end < n and not _SPACE[data[end]]:
                    end += 1
        part = data[begin:end]
        space = _SPACE[part]
        word = ~space
        before = np.empty(len(part), bool)
        before[0] = True
        before[1:] = space[:-1]
        lo, hi = np.searchsorted(starts_of_texts, [begin, end])
        inner = starts_of_texts[lo:hi] - begin
        before[inner] = True
        starts = np.flatnonzero(word & before)
        after = np.empty(len(part), bool)
        after[-1] = True
        after[:-1] = space[1:]
        after[inner[inner > 0] - 1] = True
        ends = np.flatnonzero(word & after) + 1
        powers, inverses = _power_tables(len(part) + 1)
        values = (_LOWER[part] if lower else part).astype(np.uint64)
        values += np.uint64(1)
        values *= powers[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        heads = np.zeros(len(part) + 1, np.int32)
        np.cumsum(_HEAD[part], out=heads[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * inverses[starts]))
        sizes.append(heads[ends] - heads[starts])
        firsts.append(done + np.searchsorted(starts, inner))
        done += len(starts)
        begin = end
    index = np.full(len(offsets), done, np.int64)
    known = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    index[: len(known)] = known
    return (
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        np.concatenate(sizes) if sizes else np.zeros(0, np.int32),
        index,
    )


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m].copy()
    for j in range(1, n):
        out *= _BASE
        out += words[j : j + m]
    return mix(out)


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Distinct hashes of the windows of ``n`` words, ascending; with fewer words one hash of the whole sequence."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return mix(ngram_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(ngram_hashes(words, n))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that each hold whole runs of equal keys, from batches of a partition sorted by them.

    Only the last run of a batch waits for the next batch.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        differs = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            differs |= values[1:] != values[:-1]
        cuts = np.flatnonzero(differs) + 1
        same = bool(kept) and all(kept[-1].column(i)[-1] == batch.column(i)[0] for i in (batch.schema.get_field_index(k) for k in keys))
        if kept and not same:
            yield pa.Table.from_batches(kept)
            kept = []
        if len(cuts):
            last = int(cuts[-1])
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)
