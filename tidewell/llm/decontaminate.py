"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items of a few shingles are found by looking up each of a text's shingles among theirs, which misses none. Other test
items are partitioned by size: a class holds those of up to W shingles, W a power of two. A long document is cut into
windows of 1.5 W shingles, half a W apart, so that an item inside it meets a window of its own scale, whose MinHash
values then agree with the item's as often as sets of like size do. A document with an equal value in any window is a
candidate, and the share of the item's distinct shingles that the whole document holds decides. Items come in blocks of
bounded size, each broadcast and held against all documents.

Shingles are five words, A-Z lower-cased; an item of fewer words is one shingle of all of them, sought as such. Defined
results: a null or empty text or item matches nothing. Repeated rows and ties are all returned. Columns beside ids and
texts are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import flat, groups, mix, ngram_hashes, shingle_set, table, word_table

SHINGLE = 5
CONTAINMENT = 0.75
#: Hash functions. An item of more than FEW shingles that a window holds to three quarters has a Jaccard similarity of
#: 0.23 to it or more, so all of them miss it with a probability of 4e-6 at most.
HASHES = 48
#: Test items that are broadcast and sought at a time, and characters that they have together, about.
ITEMS, ITEM_CHARS = 20_000, 32 << 20
#: Items of up to so many shingles are looked up exactly; the smallest size class is twice this.
FEW = 8
#: Leading bits of a hash by which shingles that no item of few has are left out.
MARK_BITS = 22
_rng = np.random.default_rng(20240229)
_TIMES = (_rng.integers(0, 1 << 63, HASHES, np.int64) * 2 + 1).astype(np.uint64)


def values(shingles: np.ndarray, k: int) -> np.ndarray:
    """Values of hash function k; shingles are mixed already, so a product with an odd number orders them anew."""
    return shingles * _TIMES[k]


class Items:
    """Search tables of a block of items: by size class and hash function the least values, sorted, with their items.

    Those of items of few shingles are all their shingles.
    """

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.sets, self.short, by_class = ids, [], defaultdict(list), defaultdict(list)
        few: list[int] = []
        data, offsets = flat(pa.array(texts, pa.string()))
        words, _, index = word_table(data, offsets, lower=True)
        for i in range(len(ids)):
            own = words[index[i] : index[i + 1]]
            self.sets.append(shingle_set(own, SHINGLE))
            if 0 < len(own) < SHINGLE:
                self.short[len(own)].append(i)
            elif 0 < len(self.sets[-1]) <= FEW:
                few.append(i)
            elif len(own):
                by_class[1 << int(len(self.sets[-1]) - 1).bit_length()].append(i)
        every = np.concatenate([np.zeros(0, np.uint64), *(self.sets[i] for i in few)])
        order = np.argsort(every, kind="stable")
        self.few, self.few_items = every[order], np.repeat(np.array(few, np.int64), [len(self.sets[i]) for i in few])[order]
        self.few_mark = np.zeros(1 << MARK_BITS, bool)
        self.few_mark[_mark(self.few)] = True
        for n, members in self.short.items():
            hashes = np.array([self.sets[i][0] for i in members], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.short[n] = hashes[order], np.array(members)[order]
        self.classes = {}
        for size, members in sorted(by_class.items()):
            rows = []
            for k in range(HASHES):
                least = np.array([values(self.sets[i], k).min() for i in members], np.uint64)
                order = np.argsort(least)
                mark = np.zeros(1 << 16, bool)
                mark[(least >> np.uint64(48)).astype(np.int64)] = True
                rows.append((least[order], np.array(members)[order], mark))
            self.classes[size] = rows

    def candidates(self, shingles: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) where an item shares a least value with a window of the text, or one of few shingles any shingle.

        ``shingles`` of all texts stand in a row, ``sizes`` of them for each text. Windows start at every block of the
        smallest class's half; one that runs on into the next text only gains a chance hit.
        """
        found: set[tuple[int, int]] = set()
        if len(shingles) and len(self.few):
            at = np.flatnonzero(self.few_mark[_mark(shingles)])
            lo, hi = np.searchsorted(self.few, shingles[at], "left"), np.searchsorted(self.few, shingles[at], "right")
            text = np.searchsorted(np.cumsum(sizes), at, "right")
            for i, a, b in zip(text[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                found.update((i, j) for j in self.few_items[a:b].tolist())
        if not len(shingles) or not self.classes:
            return found
        fine = min(self.classes) // 2
        blocks = -(-sizes // fine)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        starts = fine * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) + np.repeat(np.cumsum(sizes) - sizes, blocks)
        for k in range(HASHES):
            least_of, width = np.minimum.reduceat(values(shingles, k), starts), fine
            for size, rows in self.classes.items():
                while width < size // 2:
                    least_of, width = _wider(least_of, width // fine), 2 * width
                step = width // fine
                windows = _joined(_wider(least_of, step), least_of, 2 * step)
                least, members, mark = rows[k]
                at = np.flatnonzero(mark[(windows >> np.uint64(48)).astype(np.int64)])
                near = windows[at]
                lo, hi = np.searchsorted(least, near, "left"), np.searchsorted(least, near, "right")
                for i, a, b in zip(owner[at[lo < hi]].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                    found.update((i, j) for j in members[a:b].tolist())
        return found

    def matches(self, words: np.ndarray, index: np.ndarray) -> list[tuple]:
        """(text, item id, shared shingles, the item's shingles) for texts whose words begin at ``index``."""
        out, sizes = [], np.maximum(np.diff(index) - SHINGLE + 1, 0)
        every = ngram_hashes(words, SHINGLE)
        inside = np.ones(len(words), bool)
        for back in range(1, SHINGLE):
            edge = index[1:] - back
            inside[edge[edge >= 0]] = False
        shingles = every[inside[: len(every)]]
        ends = np.cumsum(sizes)
        sets: dict[int, np.ndarray] = {}
        for i, j in sorted(self.candidates(shingles, sizes)):
            if i not in sets:
                sets = {i: np.unique(shingles[ends[i] - sizes[i] : ends[i]])}
            at = np.minimum(np.searchsorted(sets[i], self.sets[j]), len(sets[i]) - 1)
            shared = int((sets[i][at] == self.sets[j]).sum())
            if shared >= CONTAINMENT * len(self.sets[j]):
                out.append((i, self.ids[j], shared, len(self.sets[j])))
        for n, (hashes, members) in self.short.items():
            runs = mix(ngram_hashes(words, n) + np.uint64(n))
            whole = np.ones(len(words), bool)
            for back in range(1, n):
                edge = index[1:] - back
                whole[edge[edge >= 0]] = False
            at = np.flatnonzero(whole[: len(runs)] & np.isin(runs, hashes))
            lo, hi = np.searchsorted(hashes, runs[at], "left"), np.searchsorted(hashes, runs[at], "right")
            text = np.searchsorted(index[1:], at, "right")
            held = {(i, j) for i, a, b in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True) for j in members[a:b].tolist()}
            out += [(i, self.ids[j], 1, 1) for i, j in sorted(held)]
        return out


def _mark(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _joined(first: np.ndarray, second: np.ndarray, after: int) -> np.ndarray:
    """Least of ``first`` at each place and ``second`` so many places on, where there is one."""
    out, n = first.copy(), max(0, len(first) - after)
    np.minimum(first[:n], second[after:], out=out[:n])
    return out


def _wider(least: np.ndarray, step: int) -> np.ndarray:
    return _joined(least, least, step)


def searcher(shared) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            ids, out = batch.column(0), []
            for first, last in groups(offsets):
                begin = offsets[first]
                words, _, index = word_table(data[begin : offsets[last]], offsets[first : last + 1] - begin, lower=True)
                out += [(ids[first + i].as_py(), *found) for i, *found in items.matches(words, index)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_shared", "n_item"])

    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and a test item that it holds, with the exact containment."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, n_shared long, n_item long"
    source = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text")
    items = benchmark.selectExpr(f"cast(`{item_id}` as long) as item_id", f"`{item_text}` as text")
    items = items.filter("text is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-n // ITEMS), -(-chars // ITEM_CHARS)))))
    found = spark.createDataFrame([], schema)
    for block in sorted(r["block"] for r in items.select("block").distinct().collect()):
        rows = items.filter(F.col("block") == block).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))
        found = found.unionByName(source.mapInArrow(searcher(shared), schema))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no test item, each judged by its own text; rows are named by a hash of id and text."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.struct(*docs.columns).alias("row"))
    hits = contaminated(keyed.select("row_key", "row.text"), benchmark, doc_id="row_key").select(F.col("doc_id").alias("row_key")).distinct()
    return keyed.join(hits, "row_key", "left_anti").select("row.*")


OP6_SQL = r"""
WITH w AS (SELECT doc_id AS id, 0 AS kind, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
           UNION ALL SELECT item_id, 1, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM w WHERE kind = 1 AND len(w) > 0),
s AS (SELECT DISTINCT id, kind, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS g FROM w JOIN k ON len(w) >= k AND (kind = 0 OR k = least(len(w), 5))),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM s d JOIN s b ON d.g = b.g AND d.k = b.k AND d.kind = 0 AND b.kind = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= 0.75 * n_item
"""
