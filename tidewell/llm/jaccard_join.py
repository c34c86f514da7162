"""N-gram Jaccard join by count vectors in R-trees, within neighbourhoods of texts that share a shingle.

A text's point counts its shingles by hashed group. The shingles that two texts share are at most the sum of their
coordinates' minima. For two boxes they are at most the sum of the minima of the upper corners, and half of what the sizes
leave after the distance of the boxes; what these bounds can't exclude is verified on the exact sets.

Random points of many dimensions fill every box of one tree over the whole corpus, so an exact tree search alone would
compare all pairs. Texts are therefore first dealt into neighbourhoods by the prefix principle: two texts of similarity t or
more share one of their n - ceil(t n) + 1 first shingles in any order common to all texts. Frequent shingles, counted over
all texts, come last in that order, so passages that many texts share don't bring texts together. Texts of equal sets are one
node. All nodes that share a shingle with the same least node form that node's neighbourhood.

Links are found in two rounds. In the first each node goes to the two neighbourhoods that it shares most with and that are
least. In the second whole neighbourhoods are searched, but only those that still span several components, and only across
components. In each round points are searched first, a neighbourhood a task; the sets of the nodes that have a candidate
left follow, are verified where they meet, and a union-find there skips pairs that are joined already. So a task gives
fewer links than it has members. Large neighbourhoods are cut into blocks: in the first round each block gets the least
node, in the second the members outside the largest component meet each block and the others stay where they are.

Shingles are five words, A-Z lower-cased; a shorter text is one shingle of all its words. Nodes are named by a 64-bit
digest of the set and shingles by a 64-bit hash, so two different ones are taken for equal with a chance of 2^-64 a pair.
Defined results: a null or empty text, or one without words, has the empty set, is linked with nothing and is its own
component. Repeated rows share a component. Columns beside id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import drop_table, flat, groups, materialise, mix, runs, shingle_set, table, word_table
from tidewell.llm.components import components

SHINGLE = 5
#: Two texts are linked when 100 times their intersection is PERCENT times their union or more.
PERCENT = 75
#: Shingles to a coordinate, at most, and least coordinates of a point; boxes have BOX_GROUPS coordinates at most.
DENSITY, MIN_GROUPS, BOX_GROUPS = 4, 64, 256
#: Shingles are counted in chunks of so many; those in FREQUENT_LOCAL texts of a chunk or more are summed over chunks.
CHUNK, FREQUENT_LOCAL, FREQUENT = 2 << 20, 4, 64
#: Frequent shingles that are broadcast (16 bytes each); were there more, the rarer ones keep their place in the order.
MOST_FREQUENT = 500_000
#: Parts that the postings of a frequent shingle are dealt to.
SALTS = 64
#: Points of a leaf and boxes of an inner node; pairs whose bounds are taken at once, in coordinates.
LEAF, FAN, STEP = 16, 8, 1 << 21
#: Members of a neighbourhood's block, and shingles that they have together, at most (but for longer texts).
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Keys of texts to verify that are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000
FACTOR = 100 + PERCENT


def n_groups(n: int) -> int:
    """Coordinates of the point of a set of n: a power of two, so that those of neighbouring sizes fold."""
    return max(MIN_GROUPS, 1 << max(0, -(-n // DENSITY) - 1).bit_length())


def point(shingles: np.ndarray) -> np.ndarray:
    """Counts by hashed group; adding the halves of a point gives that of half as many groups."""
    g = n_groups(len(shingles))
    counts = np.bincount((mix(shingles) & np.uint64(g - 1)).astype(np.int64), minlength=g)
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def decode(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n_groups(n)}")


def fold(points: np.ndarray, width: int) -> np.ndarray:
    """Points of as many groups by adding halves."""
    while points.shape[-1] > width:
        half = points.shape[-1] // 2
        points = points[..., :half].astype(np.uint32) + points[..., half:]
    return points


def bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Most shingles that sets with these points can share; row by row."""
    width = min(x.shape[-1], y.shape[-1])
    return np.minimum(fold(x, width), fold(y, width)).sum(axis=-1, dtype=np.int64)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle set) of each text of a batch."""
    data, offsets = flat(batch.column(column))
    for first, last in groups(offsets):
        begin = offsets[first]
        words, _, index = word_table(data[begin : offsets[last]], offsets[first : last + 1] - begin, lower=True)
        for i in range(last - first):
            yield first + i, shingle_set(words[index[i] : index[i + 1]], SHINGLE)


def digest(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


DOCS = "doc_id long, row_key long, n long, d long, point binary, frequent binary, counts binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DOCS.split(", ")]
    types = [pa.int64()] * 4 + [pa.binary()] * 3
    held, size, seen = [], 0, set()

    def counted() -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= FREQUENT_LOCAL
        row = (None, None, None, None, None, values[often].tobytes(), n[often].astype(np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    for batch in batches:
        rows = []
        for i, shingles in _sets(batch, 2):
            d = digest(shingles)
            rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(shingles), d, point(shingles).tobytes(), None, None))
            if d not in seen:
                seen.add(d)
                held.append(shingles)
                size += len(shingles)
            if size >= CHUNK:
                yield counted()
                held, size, seen = [], 0, set()
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
    if held:
        yield counted()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shingles, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(shingles, np.int64)), pa.array(np.frombuffer(n, np.int64))], ["s", "n"])


def prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles in the common order, and how many of them are rare: rare ones by hash, then others by count and hash."""
    want = prefix_length(len(shingles))
    if not len(frequent):
        return shingles[:want], want
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    known = frequent[at] == shingles
    rare = shingles[~known]
    if len(rare) >= want:
        return rare[:want], want
    often = np.flatnonzero(known)
    order = np.lexsort((shingles[often], counts[at[often]]))
    return np.concatenate([rare, shingles[often[order[: want - len(rare)]]]]), len(rare)


def _postings(shared) -> Callable:
    """(shingle, node, part): the part is -1 for rare shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            shingle, node, part, size = [], [], [], 0
            for _, shingles in _sets(batch, 0):
                d = digest(shingles)
                if not len(shingles) or d in seen:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(d)
                first, rare = prefix(shingles, frequent, counts)
                shingle.append(first)
                node.append(np.full(len(first), d, np.int64))
                part.append(np.where(np.arange(len(first)) < rare, -1, d % SALTS).astype(np.int32))
                size += len(first)
                if size > 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(part))], ["s", "d", "part"])
                    shingle, node, part, size = [], [], [], 0
            if shingle:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(part))], ["s", "d", "part"])

    return rows


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, size = [], 0
        for _, s in _sets(batch, 0):
            made.append((digest(s), s.tobytes()))
            size += len(s)
            if size > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary())], ["d", "blob"])
                made, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary())], ["d", "blob"])


def needed(size: np.ndarray | int) -> np.ndarray | int:
    """FACTOR times the intersection must reach this for sets of so many shingles together."""
    return PERCENT * size


class Tree:
    """An R-tree of points, bulk-loaded: leaves of LEAF points, inner nodes of FAN boxes, each with both corners.

    Points go in order of group (``apart`` first), of size to a seventh, and of a random projection. A box also knows the
    least and greatest size and component of its points.
    """

    def __init__(self, n: np.ndarray, points: np.ndarray, root: np.ndarray, apart: np.ndarray):
        coarse = fold(points, BOX_GROUPS).astype(np.int32)
        width = coarse.shape[1]
        order = np.lexsort((coarse @ (mix(np.arange(1, width + 1, dtype=np.uint64)) >> np.uint64(44)).astype(np.int64), np.floor(np.log(n) / np.log(8 / 7)), apart))
        self.order, self.n, self.points, self.coarse, self.root = order, n[order], points[order], coarse[order], root[order]
        self.levels: list[tuple[np.ndarray, ...]] = []
        corners, step = (self.coarse, self.coarse, self.n, self.n, self.root, self.root), LEAF
        while not self.levels or len(self.levels[-1][0]) > 1:
            starts = np.arange(0, len(corners[0]), step)
            corners = tuple((np.maximum, np.minimum)[k % 2].reduceat(c, starts, axis=0) for k, c in enumerate(corners))
            self.levels.append(corners)
            step = FAN

    def level(self, k: int) -> tuple[np.ndarray, ...]:
        """Boxes of a level; above the root there are copies of it."""
        return self.levels[min(k, len(self.levels) - 1)]


def _spread(i: np.ndarray, j: np.ndarray, step: int, nx: int, ny: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of i and a child of j."""
    grid = np.arange(step)
    a = np.repeat(i[:, None] * step + grid, step, axis=1).ravel()
    b = np.tile(j[:, None] * step + grid, (1, step)).ravel()
    there = (a < nx) & (b < ny)
    return a[there], b[there]


def _boxes(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of boxes may hold linked points of two components."""
    xu, xl, xmost, xleast, xhi, xlo = x
    yu, yl, ymost, yleast, yhi, ylo = y
    size = xleast[i] + yleast[j]
    close = FACTOR * np.minimum(xmost[i], ymost[j]) >= needed(size)
    close &= (xlo[i] != xhi[i]) | (ylo[j] != yhi[j]) | (xlo[i] != ylo[j])
    keep = np.flatnonzero(close)
    i, j, size = i[keep], j[keep], size[keep]
    if len(i):
        close[keep] = FACTOR * bound(xu[i], yu[j]) >= needed(size)
        gap = np.maximum(np.maximum(xl[i] - yu[j], yl[j] - xu[i]), 0).sum(axis=1, dtype=np.int64)
        most = xmost[i] + ymost[j]
        close[keep] &= FACTOR * (most - gap) >= 2 * needed(most)
    return close


def tree_join(x: Tree, y: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in x, places in y) of two components that the bounds leave: from both roots down, box by box.

    The frontier of a step is bounded: what is over STEP waits on a stack.
    """
    top = max(len(x.levels), len(y.levels)) - 1
    width = x.coarse.shape[1]
    many = max(1, STEP // (width * LEAF * LEAF))
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        if len(i) > many:
            stack.append((k, i[many:], j[many:]))
            i, j = i[:many], j[:many]
        if k == top:
            close = _boxes(x.level(k), y.level(k), i, j)
            i, j = i[close], j[close]
        if k:
            i, j = _spread(i, j, FAN, len(x.level(k - 1)[0]), len(y.level(k - 1)[0]))
            close = _boxes(x.level(k - 1), y.level(k - 1), i, j)
            if close.any():
                stack.append((k - 1, i[close], j[close]))
            continue
        i, j = _spread(i, j, LEAF, len(x.n), len(y.n))
        size = x.n[i] + y.n[j]
        keep = (FACTOR * np.minimum(x.n[i], y.n[j]) >= needed(size)) & (x.root[i] != y.root[j])
        if x is y:
            keep &= i < j
        for a, b in ((x.coarse, y.coarse), (x.points, y.points)):
            i, j, size = i[keep], j[keep], size[keep]
            step = max(1, STEP // a.shape[1])
            most = [bound(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]
            keep = FACTOR * np.concatenate(most or [size]) >= needed(size)
        if len(i):
            yield x.order[i[keep]], y.order[j[keep]]


def cell_pairs(n: np.ndarray, points: list[np.ndarray], root: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of two components, one of ``left`` and one of ``right``, that the bounds leave."""
    width = np.array([len(p) for p in points])
    values, counts = np.unique(root, return_counts=True)
    apart = root == values[counts.argmax()]
    same = bool((left == right).all())

    def tree(at: np.ndarray, g: int) -> Tree | None:
        return Tree(n[at], np.stack([fold(points[k], g) for k in at]), root[at], apart[at]) if len(at) else None

    for g in np.unique(width).tolist():
        x, y = np.flatnonzero((width == g) & left), np.flatnonzero((width == g) & right)
        wide_x, wide_y = np.flatnonzero((width == 2 * g) & left), np.flatnonzero((width == 2 * g) & right)
        tree_x = tree(x, g)
        tree_y = tree_x if same else tree(y, g)
        pairs = [(x, tree_x, y, tree_y), (x, tree_x, wide_y, tree(wide_y, g) if len(x) else None)]
        if not same:
            pairs.append((wide_x, tree(wide_x, g) if len(y) else None, y, tree_y))
        for one, t, other, u in pairs:
            if t is not None and u is not None:
                for i, j in tree_join(t, u):
                    yield one[i], other[j]


class Forest:
    """A union-find over a block's components."""

    def __init__(self, root: np.ndarray):
        self.names, self.at = np.unique(root, return_inverse=True)
        self.up = list(range(len(self.names)))

    def find(self, member: int) -> int:
        k = int(self.at[member])
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def linked_members(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], root: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links among the candidates (i, j) that join what is apart; each member is held against all its candidates at once."""
    forest = Forest(root)
    degree = np.bincount(np.concatenate([i, j]), minlength=len(sets))
    swap = degree[i] < degree[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    order = np.lexsort((j, i, -degree[i]))
    i, j = i[order], j[order]
    cuts = np.flatnonzero((i[1:] != i[:-1])) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
        one = int(i[lo])
        others = [int(k) for k in j[lo:hi] if forest.find(int(k)) != forest.find(one)]
        if not others:
            continue
        own = sets[one]
        sizes = np.array([len(sets[k]) for k in others])
        all_of_them = np.concatenate([sets[k] for k in others])
        at = np.minimum(np.searchsorted(own, all_of_them), len(own) - 1)
        shared = np.add.reduceat((own[at] == all_of_them).astype(np.int64), np.cumsum(sizes) - sizes)
        for k in np.flatnonzero(FACTOR * shared >= needed(sizes + len(own))):
            if forest.join(one, others[k]):
                yield one, others[k]


def values(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The bytes of each row, without a copy of each."""
    whole = column.combine_chunks()
    whole = (whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)).cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


BLOCKS = "lead long, x int, y int, block int, d long, root long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], dict[str, np.ndarray]]]:
    """(bytes of the last column, arrays of the others) of each block pair of several components."""
    names = ["lead", "x", "y"]
    for rows in runs(batches, names):
        own, last = {c: rows.column(c).to_numpy() for c in rows.column_names[:-1]}, values(rows.column(rows.num_columns - 1))
        differs = np.zeros(max(0, rows.num_rows - 1), bool)
        for c in names:
            differs |= own[c][1:] != own[c][:-1]
        cuts = (np.flatnonzero(differs) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, rows.num_rows], strict=True):
            if (own["root"][lo:hi] != own["root"][lo]).any():
                yield last[lo:hi], {c: v[lo:hi] for c, v in own.items()}


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members that have a candidate in their block pair."""
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.int32()) for c in BLOCKS.split(", ")])
    held, size = [], 0
    for raw, own in _blocks(batches):
        points = [decode(x, int(n)) for x, n in zip(raw, own["n"], strict=True)]
        active = np.zeros(len(points), bool)
        for i, j in cell_pairs(own["n"], points, own["root"], own["block"] == own["x"], own["block"] == own["y"]):
            active[i] = active[j] = True
        if active.any():
            held.append([own[c][active] for c in schema.names])
            size += int(active.sum())
        if size > 1 << 14:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer links (a, b) than a block pair has members, which join what is linked."""
    for raw, own in _blocks(batches):
        sets, d, root = [x.view(np.uint64) for x in raw], own["d"], own["root"]
        points, n = [point(x) for x in sets], np.array([len(x) for x in sets])
        found = list(cell_pairs(n, points, root, own["block"] == own["x"], own["block"] == own["y"]))
        if found:
            i, j = (np.concatenate(c) for c in zip(*found, strict=True))
            links = list(linked_members(i, j, sets, root))
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(d[a]), pa.array(d[b])], ["a", "b"])


def _links(members: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """Links among members (lead, x, y, block, d, root), as a table."""
    with_points = members.join(nodes.select("d", "n", "point"), "d").select("lead", "x", "y", "block", "d", "root", "n", "point")
    dealt = with_points.repartition("lead", "x", "y").sortWithinPartitions("lead", "x", "y")
    left = materialise(dealt.mapInArrow(_candidates, BLOCKS), "candidates")
    keys = materialise(left.select("d").distinct().join(nodes.select("d", "row_key"), "d").select("row_key"), "keys")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = source.join(keys, "row_key", "left_semi").dropDuplicates(["row_key"]).select("text")
    sets = texts.mapInArrow(_blobs, "d long, blob binary")
    both = left.join(sets, "d").select("lead", "x", "y", "block", "d", "root", "blob")
    dealt = both.repartition("lead", "x", "y").sortWithinPartitions("lead", "x", "y")
    return materialise(dealt.mapInArrow(_verified, "a long, b long"), "links")


def _many(count: str, shingles: str):
    """Blocks for so many members with so many shingles together."""
    return F.greatest(F.lit(1), F.ceil(F.col(count) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _first_blocks(hoods: DataFrame) -> DataFrame:
    """Each node in the neighbourhood that it shares most with and in the least one; the lead is in each block."""
    shared = hoods.filter("d <> lead").groupBy("d", "n")
    shared = shared.agg(F.min_by("lead", F.struct(-F.col("m"), F.col("lead"))).alias("most"), F.min("lead").alias("low"))
    own = shared.select(F.explode(F.array_distinct(F.array("most", "low"))).alias("lead"), "d", "n")
    leads = own.groupBy("lead").agg(F.count("*").alias("c"), F.sum("n").alias("w")).select("lead", _many("c", "w").alias("blocks"))
    leads = materialise(leads, "leads")
    dealt = own.join(leads, "lead").select("lead", F.pmod(F.xxhash64("d"), "blocks").cast("int").alias("block"), "d")
    heads = leads.select("lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("lead").alias("d"))
    return dealt.union(heads).select("lead", F.col("block").alias("x"), F.col("block").alias("y"), "block", "d", F.col("d").alias("root"))


def _open_blocks(hoods: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the neighbourhoods that span several components, in pairs of blocks.

    Blocks of members outside the largest component come first and meet all blocks; those inside meet only the former.
    """
    members = materialise(hoods.join(roots.toDF("d", "root"), "d", "left").select("lead", "d", "n", F.coalesce("root", "d").alias("root")), "members")
    spans = members.groupBy("lead", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w")).groupBy("lead")
    spans = spans.agg(F.count("*").alias("k"), F.max(F.struct("c", "w", "root")).alias("most"), F.sum("c").alias("c"), F.sum("w").alias("w")).filter("k > 1")
    spans = spans.select("lead", "most.root", (F.col("c") - F.col("most.c")).alias("oc"), (F.col("w") - F.col("most.w")).alias("ow"), F.col("most.c").alias("ic"), F.col("most.w").alias("iw"), "c", "w")
    one = _many("c", "w") == 1
    spans = spans.select("lead", F.col("root").alias("largest"), F.when(one, 0).otherwise(_many("oc", "ow")).alias("outer"), F.when(one, 1).otherwise(_many("ic", "iw")).alias("inner"))
    spans = materialise(spans, "spans")
    dealt = members.join(spans, "lead").withColumn("in", (F.col("root") == F.col("largest")) | (F.col("outer") == 0))
    block = F.when(F.col("in"), F.col("outer") + F.pmod(F.xxhash64("d"), "inner")).otherwise(F.pmod(F.xxhash64("d"), F.when(F.col("outer") > 0, F.col("outer"))))
    last = F.when(F.col("outer") == 0, 0).when(F.col("in"), F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1)
    dealt = dealt.withColumns({"block": block.cast("int"), "other": F.explode(F.sequence(F.lit(0), last))})
    return dealt.select("lead", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "d", "root")


def _linked(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, n, d) of each row, and (d, least_id, root) of each node; equal rows have equal keys."""
    spark = docs.sparkSession
    source = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text")
    source = source.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    described = materialise(source.select("doc_id", "row_key", "text").mapInArrow(_describe, DOCS), "described")
    rows = described.filter("n is not null")
    often = described.filter("frequent is not null").select("frequent", "counts").mapInArrow(_counts, "s long, n long")
    often = often.groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    found = often.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).toPandas()
    frequent = found["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((frequent[order], found["n"].to_numpy(np.int64)[order]))

    nodes = rows.filter("n > 0").groupBy("d").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("least_id"), F.any_value("n").alias("n"), F.any_value("point").alias("point"))
    nodes = materialise(nodes, "nodes")

    # frequent shingles are dealt in parts; what their parts have in common is put together afterwards
    cell = Window.partitionBy("s", "part").orderBy("d")
    whole = cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    postings = source.select("text").mapInArrow(_postings(shared), "s long, d long, part int")
    postings = postings.select("s", "d", "part", F.lag("d").over(cell).alias("before"), F.first("d").over(whole).alias("lead"), F.last("d").over(whole).alias("most"))
    cells = postings.filter("(lead <> most or part >= 0) and (before is null or before <> d)").select("s", "d", "part", "lead")
    cells = materialise(cells, "cells")
    parted = cells.filter("part >= 0")
    leads = parted.groupBy("s").agg(F.min("d").alias("lead"), F.max("d").alias("most")).filter("lead <> most").select("s", "lead")
    cells_of_all = cells.filter("part < 0").select("d", "lead").union(parted.drop("lead").join(F.broadcast(leads), "s").select("d", "lead"))
    hoods = cells_of_all.groupBy("lead", "d").agg(F.count("*").alias("m")).join(nodes.select("d", "n"), "d")
    hoods = materialise(hoods, "hoods")
    drop_table(cells)

    roots = components(_links(_first_blocks(hoods), nodes, source))
    more = _links(_open_blocks(hoods, roots), nodes, source)
    if not more.isEmpty():
        roots = components(roots.toDF("a", "b").union(more))

    least = nodes.select("d", "least_id").join(roots.toDF("d", "root"), "d", "left").select("d", "least_id", F.coalesce("root", "d").alias("root"))
    return rows.select("doc_id", "row_key", "n", "d"), least


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the least id that links reach, its own included."""
    rows, least = _linked(docs, doc_id, text)
    lowest = least.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = least.join(lowest, "root").select("d", "component_id")
    out = rows.select("doc_id", "n", "d").join(known, "d", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: of the least id, and of its rows the one of the least hash of id and text.

    Ids come before null. Rows without words are linked with nothing; of those of equal id and text one stays.
    """
    rows, nodes = _linked(docs, "doc_id", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_"), "doc_id", "row_key"))
    heads = rows.filter("n > 0").groupBy("d").agg(first.alias("head")).join(nodes, "d").groupBy("root").agg(F.min("head").alias("head"))
    kept = heads.select("head.row_key").union(rows.filter("n = 0").select("row_key").distinct()).toDF("row_key")
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key"), F.struct(*docs.columns).alias("row"))
    return keyed.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select("row.*")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""
