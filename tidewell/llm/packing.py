"""Best-fit packing by a configuration linear program over the length histogram.

Only the histogram of piece lengths (at most ``capacity`` counts) comes to the driver. The covering program "least number
of sequences so that each length is served as often as it occurs" is solved by multiplicative weights: each round prices
a configuration (lengths that fill one sequence) by knapsack dynamic programming under the current weights, gives it a
small share, and lowers the weights of the lengths it serves. Weights start at the lengths themselves, the dual prices of a
packing without waste; the knapsack's value also gives a lower bound. Shares are rounded; what they leave is packed
best-fit decreasing, again on the histogram. Pieces are numbered within their length by task and by offsets of tasks, and
find sequence and offset in the small table of configurations.

Defined results: a null or empty text is the end id alone. Longer documents than the capacity are cut, the first piece
taking the remainder. Repeated rows are packed as often as they occur. An empty table gives an empty result. Columns
beside id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialise, table
from tidewell.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0
#: First step: a round gives a configuration this part of what its scarcest length needs; later runs halve it.
STEP = 0.1
RATE = 8.0
#: Mean change of the prices' logarithms after which the knapsack is solved anew.
STALE = 0.1
#: Runs end when sequences and lower bound differ by this part at most, or when a smaller step gains less.
GAP = 0.002
#: What is added to shares before they are rounded down, and the part of a sequence that a configuration may leave empty
#: to be taken at all; of all these ways the one with the fewest sequences is taken.
ROUNDING = [(up, empty) for up in (0.0, 0.5) for empty in (0.0, 0.01, 1.0)]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = total % capacity or capacity
    return [(0, min(first, total))] + [(at, capacity) for at in range(first, total, capacity)]


def piece_rows(path: str, capacity: int, end_id: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encode, end = TaskContext.get().partitionId(), Counter(), encoder(path).encode, np.array([end_id], "<u4").tobytes()
        names = [x.split()[0] for x in PIECES.split(", ")]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return rows


def prices_of_rooms(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The most that pieces which fit into each room are worth (unbounded knapsack)."""
    best, fitting = np.zeros(capacity + 1), np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        k = fitting[room]
        best[room] = max(best[room - 1], (best[room - lengths[:k]] + prices[:k]).max()) if k else best[room - 1]
    return best


def configuration(lengths: np.ndarray, prices: np.ndarray, most: np.ndarray, best: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of lengths, copies) that fill a sequence, each taken where its price and that of the room left are highest.

    ``most`` bounds the copies of a length; prices of -inf are never taken.
    """
    room, used, prices = capacity, {}, prices.copy()
    while k := int(np.searchsorted(lengths, room, "right")):
        worth = best[room - lengths[:k]] + prices[:k]
        at = int(worth.argmax())
        if worth[at] == -np.inf:
            break
        used[at] = used.get(at, 0) + 1
        if used[at] >= most[at]:
            prices[at] = -np.inf
        room -= int(lengths[at])
    return np.array(list(used), np.int64), np.array(list(used.values()), np.float64)


def cover(lengths: np.ndarray, needs: np.ndarray, capacity: int, step: float, start: np.ndarray) -> tuple[dict[tuple, float], float, np.ndarray]:
    """(shares by configuration, lower bound, its prices) of one run of multiplicative weights.

    Each round gives a configuration ``step`` of what its scarcest length needs and multiplies the price of each length
    in it by exp(-RATE times the part of its need that it got). The knapsack table is renewed after so many rounds that
    no price has changed much; its value also gives the dual bound: needs times prices, over the best configuration's.
    """
    served, shares = np.zeros(len(lengths)), {}
    lower, bound_prices = 0.0, start
    prices, moved, best = start.copy(), np.inf, None
    while (short := served < 1 - 1e-9).any():
        if moved > STALE:
            full = start * np.exp(-RATE * served)
            full /= full.max()
            best, moved = prices_of_rooms(lengths, np.where(short, full, 0.0), capacity), 0.0
            bound = float(needs[short] @ full[short]) / best[capacity]
            if bound > lower:
                lower, bound_prices = bound, np.where(short, full, 0.0)
            prices = np.where(short, full, -np.inf)
        at, copies = configuration(lengths, prices, needs, best, capacity)
        part = copies / needs[at]
        share = min(step / float(part.max()), float(((1 - served[at]) / part).min()))
        served[at] += share * part
        prices[at] *= np.exp(-RATE * share * part)
        prices[at[served[at] >= 1 - 1e-9]] = -np.inf
        moved += RATE * share * float(part.sum()) / len(lengths)
        key = tuple(sorted(zip(lengths[at].tolist(), copies.astype(int).tolist(), strict=True)))
        shares[key] = shares.get(key, 0.0) + share
    return shares, lower, bound_prices


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Configurations and how many sequences take each; together they serve every length as often as it occurs.

    Runs of multiplicative weights with ever smaller steps start from the prices of the best dual bound. They end when
    sequences and bound differ by GAP at most, or when a smaller step no longer gains as much.
    The shares are rounded in several ways, and never are more sequences taken than best-fit decreasing alone would.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    plan: list[tuple[Counter, int]] = []
    if full := left.pop(capacity, 0):
        plan.append((Counter({capacity: 1}), full))
    if not left:
        return plan
    lengths = np.array(sorted(left), np.int64)
    needs = np.array([left[k] for k in lengths.tolist()], np.float64)
    prices, lower, least, step = lengths / capacity, 0.0, np.inf, STEP
    plain, plans = plan + best_fit(dict(left), capacity), []
    while True:
        shares, bound, at_bound = cover(lengths, needs, capacity, step, prices)
        if bound > lower:
            lower, prices = bound, np.maximum(at_bound, 1e-6 * at_bound.max())
        plans += [plan + round_shares(shares, dict(left), up, empty, capacity) for up, empty in ROUNDING]
        total, gained = sum(shares.values()), least - sum(shares.values())
        least = min(least, total)
        fewest = min([*plans, plain], key=sequences)
        if sequences(fewest) - full - lower < max(1, GAP * lower) or gained < GAP * lower:
            return fewest
        step /= 2


def sequences(plan: list[tuple[Counter, int]]) -> int:
    return sum(n for _, n in plan)


def round_shares(shares: dict[tuple, float], left: dict[int, int], up: float, empty: float, capacity: int) -> list[tuple[Counter, int]]:
    """Shares rounded down after ``up`` is added, the largest first and as far as lengths last; the rest packed best-fit.

    Configurations that leave more than the part ``empty`` of the capacity are left to best-fit as well.
    """
    plan: list[tuple[Counter, int]] = []
    for key, share in sorted(shares.items(), key=lambda x: (-x[1], x[0])):
        if sum(k * n for k, n in key) < (1 - empty) * capacity:
            continue
        times = min([int(share + up), *(left[k] // n for k, n in key)])
        if times:
            plan.append((Counter(dict(key)), times))
            for k, n in key:
                left[k] -= times * n
    return plan + best_fit(left, capacity)


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Best-fit decreasing on a histogram: sequences that are filled alike are one entry with a count.

    The longest pieces go first, each into the fullest sequence with room. A sequence that takes one piece of a length
    has the least room and takes the next as well, so a whole entry is filled at once.
    """
    by_room: dict[int, list[tuple[Counter, int]]] = {}
    rooms: list[int] = []

    def put(config: Counter, times: int, room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((config, times))

    for k in sorted((k for k, n in left.items() if n > 0), reverse=True):
        n = left[k]
        while n:
            at = bisect_left(rooms, k)
            if at < len(rooms):
                room = rooms[at]
                config, times = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, config, times = capacity, Counter(), n
            many = room // k
            filled = min(times, n // many)
            if filled:
                put(config + Counter({k: many}), filled, room - many * k)
                n, times = n - filled * many, times - filled
            if n and times:
                put(config + Counter({k: min(n, many)}), 1, room - min(n, many) * k)
                n, times = n - min(n, many), times - 1
            if config and times:
                put(config, times, room)
    return [x for room in rooms for x in by_room[room]]


def slots(plan: list[tuple[Counter, int]]) -> np.ndarray:
    """Rows (length, first rank, sequences, first sequence, first offset), by length and rank.

    The configuration's copies of a length take ranks in runs of as many as there are sequences of it.
    """
    rows, used, sequence = [], Counter(), 0
    for config, times in plan:
        offset = 0
        for k, n in sorted(config.items(), reverse=True):
            rows.append((k, used[k], times, sequence, offset))
            used[k] += times * n
            offset += k * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(shared) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        stride = int(known[:, 1].max(initial=0)) + 1
        keys = known[:, 0].astype(object) * stride + known[:, 1] if stride > 1 << 50 else known[:, 0] * stride + known[:, 1]
        for batch in batches:
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            length, rank = get["length"].to_numpy(), get["rank"].to_numpy()
            first = np.searchsorted(known[:, 0], length, "left")
            wanted = length * stride + np.minimum(rank, stride - 1)
            row = known[np.maximum(np.searchsorted(keys, wanted, "right") - 1, first)]
            copy, nth = np.divmod(rank - row[:, 1], row[:, 2])
            columns = [get[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            made = [pa.array(row[:, 3] + nth), pa.array(row[:, 4] + copy * length)]
            yield pa.RecordBatch.from_arrays(columns + made, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece with the sequence and the offset that it is given."""
    spark = docs.sparkSession
    source = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text")
    pieces = materialise(source.mapInArrow(piece_rows(vocabulary, capacity, end_id), PIECES), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(slots(solve(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    return ranked.mapInArrow(place(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
