"""Best-fit packing (op7) by linear grouping: token sequences of at most a given length, as few as possible.

Only the number of pieces of each length reaches the driver, at most `capacity` numbers whatever the input. There,
lengths above a cut are rounded up within groups of equal cardinality, the few group sizes are packed by a
configuration linear programme (column generation), its whole part is taken with actual lengths in place of rounded
ones, and the few that it leaves, then all small lengths, are placed by best fit. The plan is a list of bin kinds with their
multiplicity; pieces find their place by their rank among pieces of equal length, which is counted per partition.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime
from .tokenizer import encoder_of

CAPACITY = 2048
END_ID = 0
#: Lengths of at most this share of the capacity are small.
SMALL_SHARE = 1 / 4
#: Numbers of groups of equal cardinality that are tried.
GROUPS = (16, 24, 32)


def _best_pattern(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The unbounded knapsack: how often to take each size for the most value."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    order = np.array(sizes)
    low = min(sizes)
    for c in range(low, capacity + 1):
        fit = order <= c
        gain = best[c - order[fit]] + values[fit]
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], take[c] = gain[k], np.flatnonzero(fit)[k]
        else:
            best[c], take[c] = best[c - 1], -2
    out, c = [0] * len(sizes), capacity
    while c >= low and take[c] != -1:
        if take[c] == -2:
            c -= 1
        else:
            out[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[list[int], float]]:
    """Patterns and how often to use each, so that together they cover the demand with the least number of bins, fractions allowed."""
    m = len(sizes)
    base = np.zeros((m, m))
    for i, s in enumerate(sizes):
        base[i, i] = capacity // s
    need = np.array(demand, float)
    x = need / np.diag(base)
    for _ in range(rounds):
        duals = np.linalg.solve(base.T, np.ones(m))
        value, pattern = _best_pattern(sizes, np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-7:
            break
        column = np.array(pattern, float)
        move = np.linalg.solve(base, column)
        rising = move > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, x / np.where(rising, move, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * move, 0)
        x[out] = step
        base[:, out] = column
    return [(base[:, k].astype(int).tolist(), float(x[k])) for k in range(m)]


class _Bins:
    """Kinds of open bins by what is left in them: (lengths inside, how many such bins)."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, inside: tuple[int, ...], count: int) -> None:
        if count:
            room = self.capacity - sum(inside)
            if not self.by_room[room]:
                bisect.insort(self.rooms, room)
            self.by_room[room].append((inside, count))

    def best_fit(self, length: int, count: int) -> None:
        """Each piece goes to the bin with the least room that holds it; new bins only when none does."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                per_bin = self.capacity // length
                full, rest = divmod(count, per_bin)
                self.add((length,) * per_bin, full)
                self.add((length,) * rest, 1 if rest else 0)
                return
            room = self.rooms[at]
            inside, bins = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms.pop(at)
            fits = room // length
            used, rest = divmod(count, fits)
            if used >= bins:
                self.add(inside + (length,) * fits, bins)
                count -= bins * fits
            else:
                self.add(inside + (length,) * fits, used)
                self.add(inside + (length,) * rest, 1 if rest else 0)
                self.add(inside, bins - used - (1 if rest else 0))
                return

    def kinds(self) -> list[tuple[tuple[int, ...], int]]:
        merged: dict[tuple[int, ...], int] = defaultdict(int)
        for kinds in self.by_room.values():
            for inside, count in kinds:
                merged[tuple(sorted(inside, reverse=True))] += count
        return sorted(merged.items(), reverse=True)


def plan_bins(lengths: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, small_share: float = SMALL_SHARE) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of bins (their lengths) with multiplicities that hold exactly the given number of pieces of each length.

    Whole pieces fill bins alone. The large ones go by configurations of grouped sizes; the few that the whole part of
    the programme leaves, and then the small ones, go by best fit into what room there is. Of the numbers of groups, the
    one with the fewest bins counts, the first of equal ones.
    """
    if any(k < 1 or k > capacity for k, v in lengths.items() if v > 0):
        raise ValueError("a piece has no tokens or more than fit")
    cut = int(capacity * small_share)
    plans = []
    for n in groups:
        left = {k: v for k, v in lengths.items() if v > 0}
        bins = _Bins(capacity)
        bins.add((capacity,), left.pop(capacity, 0))
        large = {k: left.pop(k) for k in sorted(left) if k > cut}
        if large:
            _configured_bins(large, capacity, n, bins)
        for length in [*sorted(large, reverse=True), *sorted(left, reverse=True)]:
            bins.best_fit(length, (large if length > cut else left)[length])
        plans.append(bins.kinds())
    return min(plans, key=lambda kinds: sum(count for _, count in kinds))


def group_sizes(large: dict[int, int], groups: int) -> tuple[list[int], list[int]]:
    """Linear grouping: the largest length of each of the groups of equal cardinality, falling, and how many pieces round up to it."""
    total = sum(large.values())
    sizes, before = [], 0
    for length in sorted(large, reverse=True):
        # A group begins where its first piece, by rank from the largest, has this length.
        if -(-before * groups // total) < -(-(before + large[length]) * groups // total):
            sizes.append(length)
        before += large[length]
    demand = [0] * len(sizes)
    for length, count in large.items():
        demand[max(i for i, s in enumerate(sizes) if s >= length)] += count
    return sizes, demand


def _configured_bins(large: dict[int, int], capacity: int, groups: int, bins: _Bins) -> int:
    """Adds the bins of the whole part of the programme over grouped sizes, takes their pieces from large, returns how many bins.

    A slot of a configuration gets the largest piece left that rounds up to its size; the last slot, and then the room
    that actual lengths leave of the bin, the largest left that fits. As many bins at a time as take the same lengths.
    """
    sizes, demand = group_sizes(large, groups)
    stock = sorted(large)  # lengths left, rising
    made = 0
    for pattern, amount in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[1]):
        slots = [s for s, k in zip(sizes, pattern, strict=True) for _ in range(k)]
        times = int(amount + 1e-9)
        while times and slots:
            take: dict[int, int] = {}
            room = capacity
            for k in itertools.count(1):
                at = bisect.bisect_right(stock, slots[k - 1] if k < len(slots) else room) - 1
                while at >= 0 and large[stock[at]] <= take.get(stock[at], 0):
                    at -= 1
                if at < 0:
                    break
                take[stock[at]] = take.get(stock[at], 0) + 1
                room -= stock[at]
            if sum(take.values()) < len(slots):
                break  # nothing is left for a slot: the next pass or best fit places the rest
            same = min([times, *(large[length] // k for length, k in take.items())])
            for length, k in take.items():
                large[length] -= k * same
                if not large[length]:
                    del large[length]
                    stock.remove(length)
            bins.add(tuple(length for length, k in take.items() for _ in range(k)), same)
            times -= same
            made += same
    return made


def place_table(kinds: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranks of pieces among those of equal length: sorted keys length << 40 | first rank, the sequence of that rank, the offset."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for inside, count in kinds:
        offset = 0
        for length in inside:
            rows.append((length << 40 | taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    rows.sort()
    return tuple(np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ((), (), ())))


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, joined: bool) -> DataFrame:
    """A row per piece, with its rank among the pieces of its length in its partition; written to the shared folder."""
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local_rank long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, joined)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            out: list[tuple] = []
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                raw = memoryview(ids + end)
                n = len(raw) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    out.append((name, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*out, strict=True))
            types = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return runtime.stored(runtime.docs_of(docs).mapInArrow(runtime.tidy(cut), schema), "pieces")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, joined: bool = False, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """Every piece of every document with its place: sequence_id and offset.

    A document is its ids and the end id; one longer than capacity is cut into pieces of that length, the last may be
    shorter. A NULL text is empty, so its document is the end id. NULL and repeated doc_ids are documents like any other.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    pieces = pieces_of(docs, tokenizer, capacity, end_id, joined)
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    lengths = {int(r[0]): int(r[1]) for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    kinds = plan_bins(lengths, capacity, groups)
    keys, sequences, offsets = place_table(kinds)
    table = spark.sparkContext.broadcast((keys, sequences, offsets))
    before = Window.partitionBy("length").orderBy("part")
    bases = by_part.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = table.value
        for batch in batches:
            key = batch.column(3).to_numpy() << 40 | batch.column(5).to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            columns = [*batch.columns[:5], pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(runtime.tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
