"""Merkle manifest of a table: a node store in Parquet, one folder a level, and proofs by merge-scans over it.

A row's leaf is the SHA-256 of its columns. Leaves are sorted by (source, id) in range partitions ("runs"); a run's place in
its source comes from the counts of the runs before it. A source's leaves then lie in pages of 3**7 neighbours. A node takes
three neighbours, and the nodes above a page for seven levels need nothing from other pages, so each level is written by
streaming through the pages of the level below it, without a shuffle; every seventh level gathers what is left of 3**7 pages
(one digest each) into a new page. The subroots, in order of their source, are the leaves of one more tree of the same kind.

A proof is read by coordinate: pages of seven levels meet by (source, page) in a merge-scan, from the top down, and the path
above a page comes with it. ``folded`` computes a root from a leaf and its proof.

Defined results: a null column counts as ``-``; a null source comes first; null ids come first in their source; rows of equal
id are ordered by their leaf, and equal rows have a leaf each; a source of one row has its leaf as subroot, one source has its
subroot as root. An empty table gives an empty manifest whose root is null. Columns that aren't named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialise, new_path, runs, table

#: Children of a node, levels above a page's own that need that page alone, and leaves of a page.
FAN, LEVELS = 3, 7
PAGE = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
DOCUMENT, SOURCE = "struct<doc_id:bigint,altered:string>", "struct<tree:string>"
STEPS = "array<struct<left:string,right:string>>"


def leaf_hash(values: Sequence[Column]) -> Column:
    """SHA-256 of each value's byte count, a colon and the value; ``-`` for a null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tree_name(source: Column) -> Column:
    """Never null, ordered as the source with null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _nodes(spark: SparkSession, path: str, row: str) -> DataFrame:
    return spark.read.schema(f"tree string, block long, nodes long, digests array<string>, rows array<{row}>, level int").parquet(f"{path}/nodes")


def _paged(leaves: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Pages of level 0 of leaves (tree, leaf, row): digests and rows of neighbours, and how many leaves their tree has."""
    sorted_runs = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    place = F.monotonically_increasing_id()
    sorted_runs = sorted_runs.select("tree", "leaf", "row", place.alias("place"))
    sorted_runs = sorted_runs.select("tree", "leaf", "row", F.shiftright("place", 33).alias("run"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at"))
    sorted_runs = materialise(sorted_runs, "runs")
    whole = Window.partitionBy("tree")
    before = F.sum("n").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    counts = sorted_runs.groupBy("tree", "run").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    places = counts.select("tree", "run", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("nodes"))
    placed = sorted_runs.join(materialise(places, "places"), ["tree", "run"]).withColumn("at", F.col("at") + F.col("shift"))
    pages = placed.groupBy("tree", F.floor(F.col("at") / PAGE).alias("block"))
    pages = pages.agg(F.any_value("nodes").alias("nodes"), F.sort_array(F.collect_list(F.struct("at", "leaf", "row"))).alias("leaves"))
    return pages.select("tree", "block", "nodes", F.col("leaves.leaf").alias("digests"), F.col("leaves.row").alias("rows"))


def _level_above(pages: DataFrame) -> DataFrame:
    """The pages of the next level; a tree whose level has one node has none."""
    triples = F.sequence(F.lit(0), F.floor((F.size("digests") - 1) / FAN).cast("int"))
    digests = F.transform(triples, lambda i: F.sha2(F.array_join(F.slice("digests", i * FAN + 1, F.lit(FAN)), ""), 256))
    return pages.filter("nodes > 1").select("tree", "block", F.ceil(F.col("nodes") / FAN).alias("nodes"), digests.alias("digests"))


def _gathered(pages: DataFrame) -> DataFrame:
    """Pages of one digest each put together into pages of their neighbours."""
    wide = pages.groupBy("tree", F.floor(F.col("block") / PAGE).alias("wide")).agg(F.any_value("nodes").alias("nodes"), F.sort_array(F.collect_list(F.struct("block", F.col("digests")[0].alias("digest")))).alias("parts"))
    return wide.select("tree", F.col("wide").alias("block"), "nodes", F.col("parts.digest").alias("digests"))


def _build(leaves: DataFrame, order: Sequence[Column], path: str, row: str) -> None:
    """Writes all levels of the trees of leaves (tree, leaf, row)."""
    spark = leaves.sparkSession
    _paged(leaves, order).write.mode("overwrite").parquet(f"{path}/nodes/level=0")
    nodes, level = _nodes(spark, path, row).agg(F.max("nodes")).first()[0] or 0, 0
    while nodes > 1:
        below = _nodes(spark, path, row).filter(F.col("level") == level)
        nodes, level = -(-nodes // FAN), level + 1
        above = _level_above(below)
        (above if level % LEVELS else _gathered(above)).write.mode("overwrite").parquet(f"{path}/nodes/level={level}")


def _subroots(spark: SparkSession, path: str, row: str) -> DataFrame:
    return _nodes(spark, path, row).filter("nodes = 1").select("tree", F.col("digests")[0].alias("subroot"), "level")


def write(docs: DataFrame, path: str, columns: Sequence[str] = COLUMNS, source: str = "source", doc_id: str = "doc_id", altered: Mapping[str, Column] | None = None) -> None:
    """Writes the manifest of a table: ``path``/leaves with the trees of the sources, ``path``/root with the tree above them.

    ``altered`` has other values of some columns; the leaf that they would give is kept beside the true one, for ``proofs``.
    """
    own = {c: F.col(f"`{c}`") for c in columns}
    after = own | dict(altered or {})
    key, name = F.col(f"`{doc_id}`").cast("long"), tree_name(F.col(f"`{source}`"))
    row = F.struct(key.alias("doc_id"), leaf_hash([after[c] for c in columns]).alias("altered"))
    leaves = docs.select(name.alias("tree"), leaf_hash([own[c] for c in columns]).alias("leaf"), row.alias("row"))
    _build(leaves, [F.col("row.doc_id").asc_nulls_first(), F.col("leaf")], f"{path}/leaves", DOCUMENT)
    tops = _subroots(docs.sparkSession, f"{path}/leaves", DOCUMENT)
    tops = tops.select(F.lit("").alias("tree"), F.col("subroot").alias("leaf"), F.struct("tree").alias("row"))
    _build(tops, [F.col("row.tree")], f"{path}/root", SOURCE)


def root(spark: SparkSession, path: str) -> str | None:
    row = _subroots(spark, f"{path}/root", SOURCE).select("subroot").first()
    return row and row["subroot"]


def _siblings(digests: list[str]) -> tuple[list[str], list[str]]:
    """For each node of a level what stands left and right of it among its parent's children."""
    lefts, rights = [], []
    for first in range(0, len(digests), FAN):
        run = digests[first : first + FAN]
        for k in range(len(run)):
            lefts.append("".join(run[:k]))
            rights.append("".join(run[k + 1 :]))
    return lefts, rights


def _climb(high: int, width: int) -> Callable:
    """The proof of each node of the lowest level of pages of ``width`` nodes, from the pages of levels below ``high`` and the path above them, sorted by page and level."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in runs(batches, ["tree", "block"]):
            for page in _page_slices(pages):
                yield _proofs_of(page, high, width)

    return rows


def _page_slices(pages: pa.Table) -> Iterator[pa.Table]:
    trees, blocks = pages.column("tree").to_pylist(), pages.column("block").to_pylist()
    first = 0
    for i in range(1, len(trees) + 1):
        if i == len(trees) or (trees[i], blocks[i]) != (trees[first], blocks[first]):
            yield pages.slice(first, i - first)
            first = i


def _proofs_of(page: pa.Table, high: int, width: int) -> pa.RecordBatch:
    page = page.combine_chunks()
    levels, nodes = page.column("level").to_pylist(), page.column("nodes").to_pylist()
    lefts_above, rights_above = [], []
    if levels[-1] == high:
        above = page.column("above")[-1].as_py()
        lefts_above, rights_above = [s["left"] for s in above], [s["right"] for s in above]
    digests = page.column("digests")
    steps = [_siblings(digests[k].as_py()) for k, level in enumerate(levels) if level < high and nodes[k] > 1]
    own = digests.chunk(0).slice(0, 1).flatten()
    n, height = len(own), len(steps) + len(lefts_above)
    lefts, rights = [], []
    for out, side, rest in ((lefts, 0, lefts_above), (rights, 1, rights_above)):
        columns = [list(chain.from_iterable(repeat(x, FAN**j) for x in step[side]))[:n] for j, step in enumerate(steps)]
        columns += [[x] * n for x in rest]
        out.extend(chain.from_iterable(zip(*columns, strict=True)) if columns else [])
    proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * height), pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"]))
    kept = page.column("rows").chunk(0)
    kept = kept.slice(0, 1).flatten() if kept[0].is_valid else pa.nulls(n, kept.type.value_type)
    at = np.arange(n) + page.column("block")[0].as_py() * width
    return pa.RecordBatch.from_arrays([pa.array([page.column("tree")[0].as_py()] * n, pa.string()), pa.array(at), own, kept, proof], ["tree", "at", "leaf", "row", "proof"])


def _walk(spark: SparkSession, path: str, row: str, tops: DataFrame | None = None) -> DataFrame:
    """(tree, at, leaf, row, proof) of each leaf; ``tops``: (tree, proof) of the path from a tree's root on."""
    store = _nodes(spark, path, row)
    tier = (store.agg(F.max("level")).first()[0] or 0) // LEVELS
    none = F.lit(None)
    paths = None
    if tops is not None:
        heights = store.filter("nodes = 1").select("tree", F.floor(F.col("level") / LEVELS).alias("tier"))
        paths = materialise(heights.join(tops, "tree").select("tree", F.lit(0).cast("long").alias("block"), "tier", F.col("proof").alias("above")), "paths")
    below = None
    while tier >= 0:
        bottom = tier * LEVELS
        pages = store.filter(F.col("level").between(bottom, bottom + LEVELS - 1)).withColumn("above", none.cast(STEPS))
        highs = [x for x in (below, paths and paths.filter(F.col("tier") == tier).drop("tier")) if x is not None]
        for high in highs:
            shaped = high.select("tree", "block", none.cast("long").alias("nodes"), none.cast("array<string>").alias("digests"), none.cast(f"array<{row}>").alias("rows"), F.lit(bottom + LEVELS).alias("level"), "above")
            pages = pages.unionByName(shaped)
        dealt = pages.repartition("tree", "block").sortWithinPartitions("tree", "block", "level")
        proofs_here = dealt.mapInArrow(_climb(bottom + LEVELS, PAGE), f"tree string, at long, leaf string, row {row}, proof {STEPS}")
        if tier == 0:
            return proofs_here
        below = materialise(proofs_here.select("tree", F.col("at").alias("block"), F.col("proof").alias("above")), "paths")
        tier -= 1


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """(tree, at, leaf, doc_id, altered, subroot, proof) of each row of the manifest; ``proof`` goes up to the root."""
    tops = _walk(spark, f"{path}/root", SOURCE).select("row.tree", F.col("leaf").alias("subroot"), "proof")
    tops = materialise(tops, "subroots")
    rows = _walk(spark, f"{path}/leaves", DOCUMENT, tops.select("tree", "proof"))
    return rows.join(tops.select("tree", "subroot"), "tree").select("tree", "at", "leaf", "row.doc_id", "row.altered", "subroot", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "manifest")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    write(table(spark, sf_dir, "documents"), path, altered={"text": text})
    top = F.lit(root(spark, path)).cast("string")
    rows = proofs(spark, path).select("doc_id", "leaf", "subroot", top.alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("altered"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda s, c: list_reduce(list_prepend(xor(s, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) & 1 AS odd FROM documents),
cut AS (SELECT *, CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END AS cut_text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM crc),
leaves AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut_text) || ':' || cut_text, '-')) AS altered FROM cut),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (SELECT source, 0 AS level, i, leaf AS d, n FROM placed
    UNION ALL SELECT source, level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, level, i // 3, n),
subs AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, i, subroot AS d, n FROM subs UNION ALL SELECT level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, i // 3, n),
own AS (SELECT p.doc_id, p.leaf, p.altered, s.subroot, p.source, p.i, s.i AS si FROM placed p JOIN subs s ON s.source IS NOT DISTINCT FROM p.source),
low AS (SELECT o.source, o.i, 0 AS stage, t.level, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < o.i // CAST(3 ** t.level AS BIGINT)), '') AS l, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > o.i // CAST(3 ** t.level AS BIGINT)), '') AS r
    FROM own o JOIN tree t ON t.source IS NOT DISTINCT FROM o.source AND t.n > 1 AND t.i // 3 = o.i // CAST(3 ** (t.level + 1) AS BIGINT) GROUP BY o.source, o.i, t.level),
high AS (SELECT o.source, o.i, 1 AS stage, t.level, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < o.si // CAST(3 ** t.level AS BIGINT)), '') AS l, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > o.si // CAST(3 ** t.level AS BIGINT)), '') AS r
    FROM own o JOIN top t ON t.n > 1 AND t.i // 3 = o.si // CAST(3 ** (t.level + 1) AS BIGINT) GROUP BY o.source, o.i, t.level),
steps AS (SELECT source, i, list(l || '|' || r ORDER BY stage, level) AS s FROM (SELECT * FROM low UNION ALL SELECT * FROM high) GROUP BY source, i),
done AS (SELECT o.doc_id, o.leaf, o.subroot, (SELECT d FROM top WHERE n = 1) AS root, sha256(replace(array_to_string(coalesce(s.s, []), ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(o.altered, coalesce(s.s, [])), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS folded_root FROM own o LEFT JOIN steps s ON s.source IS NOT DISTINCT FROM o.source AND s.i = o.i)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
