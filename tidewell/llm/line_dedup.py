"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling finds repeated runs of lines.

Each document is the sequence of its lines that have a word. Lines found once can't belong to a repeat and only break
sequences. The others' suffixes are ranked by prefix doubling: the rank of 2^(k+1) lines orders the pairs of ranks of the
2^k lines at i and at i + 2^k, sorted by range over the cluster; pairs found at one place alone are ranked no further.
Doubling stops at the longest run of lines that is needed to reach ``min_words`` words, so the array is sorted to that
depth. Equal ranks are its longest-common-prefix intervals: all places that go on with the same lines. A window of the
least lines with ``min_words`` words, from its first line on or back from its last, is two overlapping ranks; wherever
one is found again, the lines of all places but the first (by document id) are deleted. Neighbouring windows together
cover maximal repeated runs to their ends, whatever their length.

Lines are compared whole by a 128-bit digest. Defined results: a null text stays null, an empty one stays empty; lines
without a word stay where other lines of the text remain. Rows of equal id and text are one document and lose the same
lines. Columns beside id and text are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import drop_table, materialise, runs, table

#: Words that a repeated run of lines has at least.
MIN_WORDS = 50
LINES = "doc_key long, doc_id long, s int, line int, words int, digest binary"
WINDOWS = "doc_key long, doc_id long, s int, n int"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [x.split()[0] for x in LINES.split(", ")], [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.binary()]
    for batch in batches:
        rows = []
        for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = 0
            for at, line in enumerate((text or b"").split(b"\n")):
                if words := len(line.split()):
                    rows.append((key, doc_id, s, at, words, xxhash.xxh3_128_digest(line)))
                    s += 1
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def windows(key: np.ndarray, s: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number of lines) of the least windows with ``min_words`` words, forward and backward.

    The places are ordered; a window stays within places of one key whose ``s`` follow each other.
    """
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (s[1:] != s[:-1] + 1)
    part = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(key)) - 1
    upto = np.cumsum(words.astype(np.int64))
    before = upto - words
    last = np.searchsorted(upto, before + min_words, "left")
    first = np.searchsorted(before, upto - min_words, "right") - 1
    here = np.arange(len(key))
    forward, backward = last <= ends[part], first >= starts[part]
    return np.concatenate([here[forward], first[backward]]), np.concatenate([(last - here + 1)[forward], (here - first + 1)[backward]])


def _windower(min_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["doc_key"]):
            key, s, words = (part.column(c).to_numpy() for c in ("doc_key", "s", "words"))
            at, n = windows(key, s, words, min_words)
            own = np.unique(np.stack([at, n]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[own[0]]), part.column("doc_id").combine_chunks().take(pa.array(own[0])), pa.array(s[own[0]]), pa.array(own[1].astype(np.int32))],
                ["doc_key", "doc_id", "s", "n"],
            )

    return rows


def _ranked(places: DataFrame, by: list[str], place: list[str]) -> DataFrame:
    """Ranks, in the order of ``by``, of its values that are found at two places or more, as a table."""
    spark = places.sparkSession
    at = F.xxhash64(*place)
    again = places.groupBy(*by).agg(F.min(at).alias("lo"), F.max(at).alias("hi")).filter("lo <> hi").select(*by)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    again = again.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return materialise(again.withColumn("longer", F.monotonically_increasing_id()), "ranks")


def _key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_key, line) of each line to delete; ``doc_key`` is the hash of id and text, ``line`` counts from 0."""
    source = docs.select(_key(doc_id, text).alias("doc_key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    lines = materialise(source.mapInArrow(_lines, LINES), "lines")
    ranks = _ranked(lines, ["digest"], ["doc_key", "s"])
    places = lines.join(ranks, "digest").select("doc_key", "doc_id", "s", "line", "words", F.col("longer").alias("rank"))
    places = materialise(places.dropDuplicates(["doc_key", "s"]), "places")
    drop_table(lines)
    dealt = places.repartition("doc_key").sortWithinPartitions("doc_key", "s")
    found = materialise(dealt.select("doc_key", "doc_id", "s", "words").mapInArrow(_windower(min_words), WINDOWS), "windows")
    longest = found.agg(F.max("n")).first()[0] or 0
    levels = [places.select("doc_key", "s", "rank")]
    while 2 << (len(levels) - 1) <= longest:
        step = 1 << (len(levels) - 1)
        near = Window.partitionBy("doc_key").orderBy("s").rangeBetween(step, step)
        pairs = levels[-1].withColumn("follows", F.max("rank").over(near)).filter("follows is not null")
        double = _ranked(pairs, ["rank", "follows"], ["doc_key", "s"])
        levels.append(materialise(pairs.join(double, ["rank", "follows"]).select("doc_key", "s", F.col("longer").alias("rank")), "places"))
    named = None
    for k, level in enumerate(levels):
        own = found.filter((F.col("n") >= 1 << k) & (F.col("n") < 2 << k)).withColumn("tail", F.col("n") + F.col("s") - (1 << k))
        own = own.join(level.toDF("doc_key", "s", "head_rank"), ["doc_key", "s"]).join(level.toDF("doc_key", "tail", "tail_rank"), ["doc_key", "tail"])
        named = own if named is None else named.unionByName(own)
    named = materialise(named.select("doc_key", "doc_id", "s", "n", "head_rank", "tail_rank"), "named")
    interval = ["n", "head_rank", "tail_rank"]
    place = F.struct(F.col("doc_id"), F.col("doc_key"), F.col("s"))
    firsts = named.groupBy(*interval).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
    later = named.join(firsts.select(*interval, "first"), interval).filter(~place.eqNullSafe(F.col("first")))
    gone = later.select("doc_key", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("s")).distinct()
    return gone.join(places.select("doc_key", "s", "line"), ["doc_key", "s"]).select("doc_key", "line")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` without the later copies, and ``removed_lines`` with their numbers."""
    gone = repeats(docs, min_words, doc_id, text).groupBy("doc_key").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    rows = docs.select(_key(doc_id, text).alias("doc_key"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    out = rows.join(gone.hint("merge"), "doc_key", "left")  # the same way at every size
    own = F.col("row").getField(text)
    kept = F.filter(F.split(own, "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i))
    made = F.when(F.col("gone").isNull(), own).otherwise(F.array_join(kept, "\n"))
    names = [c for c in docs.columns if c != "removed_lines"]
    columns = [(made if c == text else F.col("row").getField(c)).alias(c) for c in names]
    return out.select(*columns, F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("removed_lines").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"))


def keep_new_lines(docs: DataFrame) -> DataFrame:
    """The rows without later copies of lines; a row that loses all its words goes."""
    out = dedup(docs)
    some = (F.size("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(some).withColumn("n_chars", F.length("text")).select(*docs.columns)
