"""Packing by minimum bin slack (op12): token sequences of a given length with next to no padding and few cuts.

Only the number of pieces of each length reaches the driver, at most `capacity` numbers whatever the input. There each
window takes the largest length left and the multiset of remaining lengths that comes closest to its capacity, found by
a subset-sum dynamic programme over bit sets and traced back to counts; windows that take the same lengths are one step
with a multiplicity. What room a window keeps is filled by cutting a piece. The last tokens go to windows whose sizes are
powers of two, which need no padding. Pieces find their place by their rank among pieces of equal length, which is
counted per partition; ids are read again only of the pieces that were cut.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime
from .tokenizer import encoder_of

CAPACITY = 4096
END_ID = 2
#: Bits of a key of the place table: where in a piece a cut begins, and the rank; the length of the piece is above them.
_START_BITS, _RANK_BITS = 13, 36


class Stock:
    """How many pieces of each length are left, as counts and as bit sets."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.counts: dict[int, int] = {}
        self.rising: list[int] = []
        self.mirrored = 0  # bit capacity - l for every length l
        self.total = 0
        for length, count in sorted(counts.items()):
            self.add(length, count)

    def add(self, length: int, count: int) -> None:
        if count and length not in self.counts:
            bisect.insort(self.rising, length)
            self.mirrored |= 1 << (self.capacity - length)
        left = self.counts.get(length, 0) + count
        self.total += length * count
        if left:
            self.counts[length] = left
        elif length in self.counts:
            del self.counts[length]
            self.rising.pop(bisect.bisect_left(self.rising, length))
            self.mirrored ^= 1 << (self.capacity - length)

    def closest(self, target: int) -> dict[int, int]:
        """How often to take each length so that the sum comes as close to target as it can, without going beyond.

        Bit s of the set says that s is the sum of some lengths taken so far, the largest first, each as often as there
        are pieces (in powers of two). A length not yet reached that is just what a sum lacks ends the search.
        """
        sums, mask = 1, (2 << target) - 1
        lacking = self.mirrored >> (self.capacity - target)  # bit s: target - s is a length
        layers: list[tuple[int, int, int]] = []
        last, s = 0, None
        below = target + 1
        for at in range(bisect.bisect_right(self.rising, target) - 1, -1, -1):
            length = self.rising[at]
            met = (sums & lacking) >> max(0, target - below + 1)
            if met:
                s = (met & -met).bit_length() - 1 + max(0, target - below + 1)
                last = target - s
                break
            count, k = min(self.counts[length], target // length), 1
            while count:
                k = min(k, count)
                more = sums | (sums << (length * k)) & mask
                if more != sums:
                    layers.append((sums, length, k))
                    sums = more
                count -= k
                k *= 2
            below = length
            if sums >> target & 1:
                break
        if s is None:
            s = sums.bit_length() - 1
        taken: dict[int, int] = defaultdict(int)
        if last:
            taken[last] += 1
        for before, length, k in reversed(layers):
            if not before >> s & 1:
                taken[length] += k
                s -= length * k
        return dict(taken)


def plan_windows(lengths: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where every piece goes: rows of length, first rank, count, start in the piece, length there, first sequence, offset.

    A row says: of the pieces of that length with ranks from first rank on, the part that begins at start goes to the
    sequences from first sequence on. Pieces with more than one row are cut.
    """
    if any(k < 1 or k > capacity for k, v in lengths.items() if v > 0):
        raise ValueError("a piece has no tokens or more than fit")
    stock = Stock(lengths, capacity)
    # Of each length the pieces left: (length of the uncut piece, first rank, count, start).
    segments: dict[int, deque] = defaultdict(deque)
    for length, count in lengths.items():
        segments[length].append((length, 0, count, 0))
    rows: list[tuple[int, ...]] = []
    sequence = 0

    def take(length: int, count: int) -> Iterator[tuple[int, int, int, int]]:
        held = segments[length]
        stock.add(length, -count)
        while count:
            origin, rank, n, start = held.popleft()
            used = min(n, count)
            if used < n:
                held.appendleft((origin, rank + used, n - used, start))
            count -= used
            yield origin, rank, used, start

    def place(length: int, part: int, times: int, offset: int) -> None:
        """The first part tokens of as many pieces of a length; what is left of them goes back."""
        at = sequence
        for origin, rank, n, start in list(take(length, times)):
            rows.append((origin, rank, n, start, part, at, offset))
            at += n
            if part < length:
                segments[length - part].append((origin, rank, n, start + part))
                stock.add(length - part, n)

    while stock.total:
        size = capacity if stock.total >= capacity else 1 << (stock.total.bit_length() - 1)
        at = bisect.bisect_right(stock.rising, size) - 1
        taken: dict[int, int] = {}
        if at >= 0:
            seed = stock.rising[at]
            stock.add(seed, -1)
            taken = stock.closest(size - seed)
            stock.add(seed, 1)
            taken[seed] = taken.get(seed, 0) + 1
        gap = size - sum(length * k for length, k in taken.items())
        cut = 0
        if gap:  # every piece left is longer than the gap, or the sum would be closer
            cut = next(length for length in reversed(stock.rising) if stock.counts[length] > taken.get(length, 0))
        times = min((stock.counts[length] // (k + (length == cut)) for length, k in taken.items()), default=stock.counts.get(cut, 1))
        if cut and cut not in taken:
            times = min(times, stock.counts[cut])
        if size < capacity:
            times = 1
        offset = 0
        for length in sorted(taken, reverse=True):
            for _ in range(taken[length]):
                place(length, length, times, offset)
                offset += length
        if cut:
            place(cut, gap, times, offset)
        sequence += times
    return np.array(rows, np.int64).reshape(-1, 7)


class PlaceTable:
    """The rows of plan_windows, to look up by length, start and rank."""

    def __init__(self, rows: np.ndarray) -> None:
        keys = self.key(rows[:, 0], rows[:, 3], rows[:, 1])
        order = np.argsort(keys)
        self.keys, self.lengths, self.sequences, self.offsets = keys[order], rows[order, 4], rows[order, 5], rows[order, 6]

    @staticmethod
    def key(length: np.ndarray, start: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length << (_START_BITS + _RANK_BITS)) | (start << _RANK_BITS) | rank

    def find(self, length: np.ndarray, start: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, sequence and offset of the parts that begin there."""
        key = self.key(length, start, rank)
        at = np.searchsorted(self.keys, key, "right") - 1
        return self.lengths[at], self.sequences[at] + key - self.keys[at], self.offsets[at]


def encoded_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, joined: bool) -> DataFrame:
    """A row per piece of at most capacity tokens, with the ids of shorter ones and the rank among those of its length in its partition; stored."""
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, row long, local_rank long, ids binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, joined)
        part, row = TaskContext.get().partitionId(), 0
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            out: list[tuple] = []
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                raw = ids + end
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    piece = raw[4 * start : 4 * min(start + capacity, n)]
                    length = len(piece) // 4
                    kept = None if length == capacity else np.frombuffer(piece, "<u4").astype("<u2").tobytes() if encoder.n_ids <= 1 << 16 else piece
                    out.append((name, start, length, zlib.crc32(piece), n, part, row, seen[length], kept))
                    seen[length] += 1
                    row += 1
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, columns, strict=True)], names)

    return runtime.stored(runtime.docs_of(docs).mapInArrow(cut, schema), "encoded-pieces")


def ranked_pieces(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The pieces without their ids, with their rank among all of their length, and how many there are of each length."""
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    lengths = {int(r[0]): int(r[1]) for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    before = Window.partitionBy("length").orderBy("part")
    bases = by_part.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("base"))
    ranked = pieces.drop("ids").join(bases, ["part", "length"])
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "row", (F.col("base") + F.col("local_rank")).alias("rank")), lengths


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, joined: bool = False) -> DataFrame:
    """A row per piece: doc_id, start in its document, length, ids_crc32, doc_tokens, sequence_id, offset in the sequence.

    A document is its ids and the end id. Pieces of a document are disjoint and hold all its ids; a sequence is filled
    without gaps and has capacity tokens or, among the last ones, a power of two. A NULL text is empty, so its document
    is the end id. NULL and repeated doc_ids are documents like any other. An empty table has no pieces.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    pieces = encoded_pieces(docs, tokenizer, capacity, end_id, joined)
    ranked, lengths = ranked_pieces(pieces)
    if not lengths:
        return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = plan_windows(lengths, capacity)
    table = spark.sparkContext.broadcast(PlaceTable(rows))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, row long, within long"
    names = [c.split()[0] for c in schema.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces placed whole keep their crc32; parts of cut ones have none yet."""
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(7).to_numpy()
            at, within = np.arange(len(length)), np.zeros(len(length), np.int64)
            while len(at):
                n, sequence, offset = table.value.find(length[at], within, rank[at])
                here = batch.take(pa.array(at))
                whole = n == length[at]
                crc = pa.array(here.column(3).to_numpy(), pa.int64(), mask=~whole)
                start = pa.array(here.column(1).to_numpy() + within)
                yield pa.RecordBatch.from_arrays([here.column(0), start, pa.array(n), crc, here.column(4), pa.array(sequence), pa.array(offset), here.column(5), here.column(6), pa.array(within)], names)
                within = within + n
                more = within < length[at]
                at, within = at[more], within[more]

    placed = runtime.stored(ranked.mapInArrow(place, schema), "placed-pieces")
    wanted = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = placed.where(F.col("ids_crc32").isNotNull()).select(*wanted)
    parts = placed.where(F.col("ids_crc32").isNull())
    with_ids = runtime.join_bounded(pieces.where(F.col("ids").isNotNull()).select("part", "row", "ids", F.col("length").alias("piece_length")), parts, ["part", "row"], "inner", int(rows[rows[:, 0] != rows[:, 4], 2].sum()))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = batch.schema.get_field_index
            crcs = []
            for ids, size, begin, n in zip(*[batch.column(get(c)).to_pylist() for c in ("ids", "piece_length", "within", "length")], strict=True):
                width = len(ids) // size
                crcs.append(zlib.crc32(np.frombuffer(ids, f"<u{width}")[begin : begin + n].astype("<u4").tobytes()))
            columns = [pa.array(crcs, pa.int64()) if c == "ids_crc32" else batch.column(get(c)) for c in wanted]
            yield pa.RecordBatch.from_arrays(columns, wanted)

    return whole.unionByName(with_ids.mapInArrow(sums, ", ".join(f"{c} long" for c in wanted)))
