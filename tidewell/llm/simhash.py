"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked where at most three bits differ.

Documents of one fingerprint are one node. Two fingerprints at three or fewer differing bits agree in one of four blocks of
16 bits, and of the other 48 bits in one of four blocks of 12, so they meet under one of sixteen keys of 28 bits. Within a key
the comparison is bit-sliced: 64 fingerprints are a block, stored as one machine word for each bit ("plane"); one XOR compares
a fingerprint's bit with 64 others, a carry-save counter of two bits and an overflow adds the differences up, and blocks whose
64 distances have all overflowed are abandoned every few planes.

A key may hold many fingerprints. Beyond ``TILE`` its fingerprints are dealt into tiles that separate tasks take. First each
tile is compared with a few pivots of the key alone, its most common fingerprint among them, which links the copies of one
text. After the components are known, those outside the key's largest component are compared with all its tiles; those
inside need no comparison with one another. Tasks give a spanning forest of their links, never all pairs.

Defined results: a text without words, null or empty, has fingerprint zero and is linked like any other; a component's id is
its least known doc_id, null where all are null; rows of equal id are rows of their own. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import SEGMENT, drop_table, materialise, runs, table
from tidewell.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 64
#: The most differing bits of a link: what a counter of two bits holds without overflow.
RADIUS = 3
#: Fingerprints of a key that are compared in one task, fingerprints outside the largest component that go with them, pivots.
TILE, QUERIES, PIVOTS = 4096, 32_768, 64
#: Bits in a block of the first and of the second cut; pairs of fingerprint and block compared at a time; planes between checks.
FIRST, SECOND, LANES, CHECK = 16, 12, 1 << 14, 6
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ROWS, DEALT = "doc_id long, fp long", ["key", "tile", "side"]


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a bounded stretch of it at a time; each stretch begins with the last two words of the one before."""
    begin, carried = 0, []
    while begin < len(raw):
        gap = _GAP.search(raw, begin + SEGMENT)
        end = gap.start() if gap else len(raw)
        words = carried + raw[begin:end].lower().split()
        yield words
        begin, carried = end, words[-(SHINGLE - 1) :]


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: max(0, len(words) - SHINGLE)] + 1).tolist()]
    lasts = ends[SHINGLE - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, lasts, strict=True)], np.uint64)


def fingerprint(raw: bytes | None) -> int:
    """Bits set in over half of the shingles' hashes; zero without words."""
    counts, n, short = np.zeros(BITS, np.int64), 0, []
    for words in _pieces(raw or b""):
        if len(words) < SHINGLE:
            short = words
            continue
        hashes = shingle_hashes(words)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    if not n:
        return int(shingle_hashes(short)[0]) if short else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        fps = np.array([fingerprint(t.as_py()) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; the fingerprint's 64 bits as a long."""
    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text").mapInArrow(_fingerprints, ROWS)


def keys(fp: Column) -> list[Column]:
    """Sixteen keys: number of the key in the top bits, then a block of 16 bits, then one of 12 bits of the rest."""
    out = []
    for i in range(BITS // FIRST):
        block = F.shiftrightunsigned(fp, FIRST * i).bitwiseAND((1 << FIRST) - 1)
        low = fp.bitwiseAND((1 << FIRST * i) - 1)
        high = F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(fp, FIRST * i), FIRST), FIRST * i)
        rest = low.bitwiseOR(high)
        for j in range((BITS - FIRST) // SECOND):
            part = F.shiftrightunsigned(rest, SECOND * j).bitwiseAND((1 << SECOND) - 1)
            number = i * ((BITS - FIRST) // SECOND) + j
            out.append(F.shiftleft(block, SECOND).bitwiseOR(part).bitwiseOR(F.lit(number << FIRST + SECOND)))
    return out


def free_bits(number: int) -> list[int]:
    """The bits that fingerprints of one key of this number may differ in."""
    i, j = divmod(number, (BITS - FIRST) // SECOND)
    rest = [b for b in range(BITS) if b // FIRST != i]
    return rest[: SECOND * j] + rest[SECOND * (j + 1) :]


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of whole blocks of 64 fingerprints: plane b, block k has bit b of each of the block's fingerprints."""
    out = np.empty((BITS, len(fps) // 64), np.uint64)
    for first in range(0, out.shape[1], 2048):
        part = fps[first * 64 : (first + 2048) * 64].astype("<u8").view(np.uint8).reshape(-1, 64, 8)
        bits = np.unpackbits(part, axis=2, bitorder="little").transpose(2, 0, 1)
        out[:, first : first + 2048] = np.ascontiguousarray(np.packbits(bits, axis=2, bitorder="little")).view("<u8")[:, :, 0]
    return out


def close(fps: np.ndarray, block: np.ndarray, sliced: np.ndarray, valid: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a fingerprint and a block, (numbers of the pairs that have any, a word of the members within the radius)."""
    pair = np.arange(len(fps))
    ones, twos, over = (np.zeros(len(fps), np.uint64) for _ in range(3))
    for first in range(0, len(bits), CHECK):
        for b in bits[first : first + CHECK]:
            differ = sliced[b, block] ^ (_ALL * ((fps >> np.uint64(b)) & np.uint64(1)))
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
        live = (~over & valid[block]) != 0
        if not live.all():
            pair, fps, block, ones, twos, over = (x[live] for x in (pair, fps, block, ones, twos, over))
        if not len(pair):
            break
    return pair, ~over & valid[block]


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after links: the least row that is reached; a label is a row whose label is itself."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def linked_rows(fps: np.ndarray, group: np.ndarray, data: np.ndarray, query: np.ndarray, bits: list[int]) -> np.ndarray:
    """For each row the least row that links within its group reach. Rows lie group by group."""
    label = np.arange(len(fps))
    at = np.flatnonzero(data)
    own = group[at]
    begins = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1] if len(own) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[begins, len(own)])
    counts = -(-sizes // 64)
    offsets = np.cumsum(counts) - counts
    number = np.repeat(np.arange(len(begins)), sizes)
    slot = offsets[number] * 64 + np.arange(len(own)) - begins[number]
    cells = int(counts.sum()) * 64
    held, member, used = np.zeros(cells, np.uint64), np.zeros(cells, np.int64), np.zeros(cells, bool)
    held[slot], member[slot], used[slot] = fps[at], at, True
    valid = np.packbits(used.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    sliced = planes(held)

    asks = np.flatnonzero(query)
    there = np.searchsorted(own[begins], group[asks])
    there_in = np.minimum(there, max(len(begins) - 1, 0))
    asks = asks[(there < len(begins)) & (own[begins][there_in] == group[asks])] if len(begins) else asks[:0]
    which = np.searchsorted(own[begins], group[asks])
    first = offsets[which].copy()
    block_of = np.full(len(fps), -1)
    block_of[at] = slot // 64
    # where all rows of a group ask and are asked, a pair is compared from its earlier block alone
    asking = np.bincount(which, minlength=len(begins))
    mutual = (asking == sizes)[which] & (block_of[asks] >= 0)
    first[mutual] = block_of[asks][mutual]
    lanes = offsets[which] + counts[which] - first
    ends = np.cumsum(lanes)
    total = int(ends[-1]) if len(ends) else 0
    for begin in range(0, total, LANES):
        lane = np.arange(begin, min(total, begin + LANES))
        row = np.searchsorted(ends, lane, side="right")
        block = first[row] + lane - (ends[row] - lanes[row])
        row = asks[row]
        # a block that is already linked to the fingerprint as a whole needs no comparison
        labels = label[member.reshape(-1, 64)[block]]
        open_ = ((labels != label[row][:, None]) & used.reshape(-1, 64)[block]).any(axis=1)
        row, block = row[open_], block[open_]
        pair, words = close(fps[row], block, sliced, valid, bits)
        if len(pair):
            hits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            p, k = np.nonzero(hits)
            label = _join_labels(label, row[pair[p]], member[block[pair[p]] * 64 + k])
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b), a the least of those that b reaches in its task, of rows sorted by key, tile, side and fingerprint."""
    for part in runs(batches, DEALT):
        key, tile, side, role = (part.column(c).to_numpy() for c in (*DEALT, "role"))
        fp = part.column("fp").to_numpy().view(np.uint64)
        new = np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]) | (side[1:] != side[:-1])]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        numbers = key >> FIRST + SECOND
        for number in np.unique(numbers[several]):
            at = np.flatnonzero(several & (numbers == number))
            own = fp[at]
            label = linked_rows(own, group[at], role[at] != 1, role[at] != 0, free_bits(int(number)))
            a, b = own[label].view(np.int64), own.view(np.int64)
            apart = a != b
            if apart.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[apart]), pa.array(b[apart])], ["a", "b"])


def _compared(dealt: DataFrame) -> DataFrame:
    """Links among rows (key, tile, side, fp, role); role 0 is asked, 1 asks, 2 does both."""
    ready = dealt.repartition(*DEALT).sortWithinPartitions(*DEALT, "fp")
    return materialise(ready.select(*DEALT, "fp", "role").mapInArrow(_links, "a long, b long"), "links")


def _dealt(rows: DataFrame, tiles: Column, sides: Column, asks: Column) -> DataFrame:
    """Each fingerprint in its tile for every side, and those that ask in every tile for their own side."""
    spot = F.xxhash64("fp", F.lit(1))
    asked = rows.select("key", F.pmod(spot, tiles).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), sides - 1)).alias("side"), "fp", F.lit(0).alias("role"))
    asking = rows.filter(asks).select("key", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), F.pmod(spot, sides).cast("int").alias("side"), "fp", F.lit(1).alias("role"))
    return asked.unionByName(asking)


def linked(nodes: DataFrame) -> DataFrame:
    """(node, root) of the fingerprints (fp, weight) that are linked with any other; the root is the least by its long."""
    keyed = nodes.select("fp", "weight", F.explode(F.array(*keys(F.col("fp")))).alias("key"))
    crowds = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max_by("fp", F.struct("weight", "fp")).alias("mode"))
    hot = materialise(crowds.filter(F.col("n") > TILE).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")), "hot")
    placed = keyed.join(hot, "key", "left")
    cool = placed.filter("n is null").select("key", F.lit(0).alias("tile"), F.lit(0).alias("side"), "fp", F.lit(2).alias("role"))
    pivot = (F.col("fp") == F.col("mode")) | (F.pmod(F.xxhash64("fp", F.lit(2)), F.ceil(F.col("n") / PIVOTS)) == 0)
    crowded = placed.filter("n is not null")
    some = not hot.isEmpty()
    links = _compared(cool.unionByName(_dealt(crowded, F.col("tiles"), F.lit(1), pivot)) if some else cool)
    roots = components(links)
    if not some:
        return roots
    roots = materialise(roots, "roots")
    known = materialise(keyed.join(hot.select("key", "tiles"), "key").join(roots.toDF("fp", "root"), "fp", "left").select("key", "tiles", "fp", F.coalesce("root", "fp").alias("root")), "crowded")
    spans = known.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key")
    spans = spans.agg(F.max_by("root", F.struct("c", "root")).alias("largest"), (F.sum("c") - F.max("c")).alias("others")).filter("others > 0")
    spans = materialise(spans.withColumn("sides", F.ceil(F.col("others") / QUERIES).cast("int")), "spans")
    rest = _dealt(known.join(spans, "key"), F.col("tiles"), F.col("sides"), F.col("root") != F.col("largest"))
    more = _compared(rest)
    roots_again = components(roots.toDF("a", "b").unionByName(more))
    drop_table(known)
    return roots_again


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    rows = materialise(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("weight")), "nodes")
    roots = linked(nodes)
    owned = nodes.join(roots.toDF("fp", "root"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = owned.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = owned.join(least, "root").select("fp", "component_id")
    return rows.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
