"""MinHash near-dedup (op5): an inverted join over signature coordinates, confirmed on full shingle sets.

Texts with equal shingle sets are one class from the start, so copies never meet in pairs. Each class posts its first
POSTED coordinates as (coordinate, value). Two sets of the wanted similarity agree in at least t of them, but for a
chance of MISS; so they share one of the POSTED - t + 1 rarest of either (prefix), and a class with fewer than t values
that occur elsewhere has no partner. Only those prefix lists are merged; the other coordinates, frequent values above
all, are skipped and counted by lookup in the signatures, of which COORDINATES must give at least t' matches. Pairs
that pass are confirmed on the full sets. Before that, what a candidate has alone bounds its intersections.

A long list is a group of near copies, whose pairs would grow with its square. There, members are first compared with
one pivot of the list; those that turn out connected need no further comparison, and what remains are pairs between
different components. What a member of such a list has more or less than a pivot is a small set: two members of different components
can only be linked if they share enough of it, so the rarest differences, as a prefix again, make new and short lists, whose
pairs do not grow with the square of the group. Members too unlike the pivot stay in their list. Lists are compared in
blocks, so no task and no group grows with a list.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, runtime
from .words import SHINGLE, WordHashes, shingle_set, words_of

SIMILARITY = 85  # per cent
COORDINATES, POSTED = 128, 64
MISS = 1e-6
#: Lists longer than this go through pivots first; rounds of these; members of a list in one block.
LONG_LIST, PIVOT_ROUNDS, BLOCK = 64, 2, 256
#: Rounds of lists by differences from a pivot; a member less similar to it than so many per cent has none.
DIFFERENCE_ROUNDS, FAR = 2, 50
#: Rows with signatures that are broadcast at most.
WIDE_ROWS = 10_000
#: Rows with signatures, and with full sets, in one file.
WIDE_FILE, SET_FILE = 20_000, 4_000
_NO_ID = -(2**63)


def least_matches(similarity: float, coordinates: int, miss: float = MISS) -> int:
    """The most matches that a pair of that similarity falls short of with a chance of at most miss."""
    below, t = 0.0, 0
    while True:
        below += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            return t
        t += 1


class Sketcher:
    def __init__(self, width: int = SHINGLE) -> None:
        draw = np.random.default_rng(20240501)
        self.width = width
        self._xor = draw.integers(0, 2**64, COORDINATES, dtype=np.uint64)
        self._times = draw.integers(0, 2**64, COORDINATES, dtype=np.uint64) | np.uint64(1)
        self._hashes = WordHashes()

    def shingles(self, text: str) -> np.ndarray:
        return shingle_set(words_of(text), self._hashes, self.width)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The least hash under each coordinate's function; its high 32 bits."""
        out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 1024):
            np.minimum(out, ((shingles[i : i + 1024, None] ^ self._xor) * self._times).min(0), out=out)
        return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)

    @staticmethod
    def digest(shingles: np.ndarray) -> bytes:
        return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


_sketchers: dict[int, Sketcher] = {}


def _sketcher(width: int) -> Sketcher:
    return _sketchers.setdefault(width, Sketcher(width))


def _forget() -> None:
    _sketchers.clear()


def sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature (both NULL without words) for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = _sketcher(width)
        for batch in batches:
            sets = [sketcher.shingles(t) for t in batch.column(1).to_pylist()]
            digests = [sketcher.digest(s) if len(s) else None for s in sets]
            signatures = [sketcher.signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "digest", "signature"]
            )

    return runtime.docs_of(docs).mapInArrow(runtime.tidy(run, _forget), "doc_id long, n_shingles long, digest binary, signature array<int>")


def _full_sets(docs: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """c and the full set of the candidate classes: only the documents that stand for one are read again."""
    n = candidates.count()
    stand = F.coalesce(F.col("label"), F.lit(_NO_ID)).alias("stand")
    rows = runtime.docs_of(docs).withColumn("stand", F.coalesce(F.col("doc_id"), F.lit(_NO_ID)))
    rows = runtime.join_bounded(rows, candidates.select(stand).distinct(), ["stand"], "left_semi", n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = _sketcher(width)
        for batch in batches:
            sets = [sketcher.shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sketcher.digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["digest", "shingles"])

    sets = rows.select("text").mapInArrow(runtime.tidy(run, _forget), "digest binary, shingles array<long>")
    return runtime.stored(runtime.join_bounded(sets, candidates.select("digest", "c"), ["digest"], "inner", n).select("c", "shingles").dropDuplicates(["c"]), "sets", n, SET_FILE)


def _alone(sets: DataFrame) -> DataFrame:
    """c and how many of its shingles no other candidate has: these are in no intersection, which bounds any similarity."""
    owners = sets.select("c", F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"))
    return owners.where("n = 1").groupBy("c").agg(F.count(F.lit(1)).alias("n_alone"))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= similarity * union; pairs should be stored. A pivot's many pairs are split."""
    left = sets.select(F.col("c").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("c").alias("b"), F.col("shingles").alias("right_set"))
    rows = runtime.join_salted(pairs, left, "a", "b")
    hot = pairs.groupBy("b").count().where("count > 2000").take(1)
    rows = (runtime.join_salted(rows, right, "b", "a") if hot else rows.join(right, "b")).select("a", "b", "left_set", "right_set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (v.values.to_numpy() for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return rows.mapInArrow(runtime.tidy(run), "a long, b long")


def _block_pairs(lists: DataFrame, similarity: int, least_posted: int, least_all: int) -> DataFrame:
    """Pairs of different components in blocks of lists (token, x, y, c, comp, n_shingles, n_alone, mask, signature, first), each pair in one list of coordinates only.

    Tokens below 0 are lists by differences, in which a pair may come again.
    """

    def compare(token: int, g: dict[str, np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray] | None:
        if same:
            i, j = np.triu_indices(len(g["c"]), 1)
        else:
            left, right = np.flatnonzero(g["first"]), np.flatnonzero(~g["first"])
            i, j = (v.reshape(-1) for v in np.meshgrid(left, right, indexing="ij"))
        n, most = g["n_shingles"], g["n_shingles"] - g["n_alone"]
        common = np.minimum(most[i], most[j])  # at best
        ok = (g["comp"][i] != g["comp"][j]) & (100 * common >= similarity * (n[i] + n[j] - common))
        i, j = i[ok], j[ok]
        out = []
        for k in range(0, len(i), 8192):
            p, q = i[k : k + 8192], j[k : k + 8192]
            equal = g["signature"][p] == g["signature"][q]
            ok = (equal[:, :POSTED].sum(1) >= least_posted) & (equal.sum(1) >= least_all)
            p, q, equal = p[ok], q[ok], equal[ok, :POSTED]
            bits = ((g["mask"][p] & g["mask"][q])[:, None] >> np.arange(POSTED, dtype=np.uint64)) & np.uint64(1)
            mine = (equal & (bits > 0)).argmax(1) == token >> 32 if token >= 0 else slice(None)  # in the first list of those that both are in
            out.append((p[mine], q[mine]))
        if not out:
            return None
        p, q = (np.concatenate(x) for x in zip(*out, strict=True))
        return np.minimum(g["c"][p], g["c"][q]), np.maximum(g["c"][p], g["c"][q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(table: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
            token, x, y = (table.column(i).to_numpy() for i in range(3))
            edge = np.flatnonzero((token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            starts = [0, *edge.tolist()]
            ends = [*edge.tolist(), len(token)]
            rest = None
            if not last:
                rest = table.slice(starts[-1])
                starts, ends = starts[:-1], ends[:-1]
            if not starts:
                return [], rest
            flat = table.column("signature").combine_chunks()
            signatures = flat.flatten().to_numpy().reshape(-1, COORDINATES)
            columns = {k: table.column(k).to_numpy() for k in ("c", "comp", "n_shingles", "n_alone", "first")}
            columns["mask"] = table.column("mask").to_numpy().view(np.uint64)
            columns["signature"] = signatures
            found = []
            for s, e in zip(starts, ends, strict=True):
                if e - s > 1 and (pair := compare(int(token[s]), {k: v[s:e] for k, v in columns.items()}, x[s] == y[s])):
                    found.append(pair)
            return found, rest

        def out(found: list) -> Iterator[pa.RecordBatch]:
            if found:
                a, b = (np.concatenate(v) for v in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None and held.num_rows:
                table = pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            found, held = groups(table.combine_chunks(), False)
            yield from out(found)
        if held is not None and held.num_rows:
            yield from out(groups(held.combine_chunks(), True)[0])

    ordered = lists.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    return ordered.select("token", "x", "y", "c", "comp", "n_shingles", "n_alone", "mask", "signature", "first").mapInArrow(runtime.tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept, and n_copies, the rows with an equal set.

    A NULL text is empty; a text without words has no shingle, is linked with nothing and kept. component_id is the least
    doc_id reachable. Rows that repeat a doc_id are all kept or all not. A NULL doc_id is never the least; where nothing
    but NULL ids is reachable component_id is NULL and the rows are kept.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    t_posted, t_all = (least_matches(similarity / 100, k) for k in (POSTED, COORDINATES))
    base = runtime.stored(sketches(docs, width), "sketches")
    n_docs = base.count()
    grouped = base.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("label"), F.count(F.lit(1)).alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = runtime.stored(grouped.withColumn("c", F.monotonically_increasing_id()), "classes", n_docs, WIDE_FILE)
    n_classes = classes.count()

    # Values that more than one class has, and for each class the rarest of its own.
    tokens = classes.select("c", F.posexplode(F.slice("signature", 1, POSTED)).alias("k", "v"))
    tokens = tokens.select("c", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    shared = runtime.stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "shared-values", n_classes * POSTED // 2)
    mine = runtime.join_by_frequency(tokens, shared, "token", "n", n_classes * POSTED)
    mine = mine.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("values")).where(F.size("values") >= t_posted)
    prefix = F.transform(F.slice("values", F.lit(1), F.size("values") - t_posted + 1), lambda v: v["token"])
    mask = F.aggregate("prefix", F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(_bit(t)))
    posted = runtime.stored(mine.select("c", prefix.alias("prefix")).select("c", F.explode("prefix").alias("token"), mask.alias("mask")), "postings", n_classes * (POSTED - t_posted + 1))
    n_posted = posted.count()
    lengths = runtime.stored(posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "list-lengths", n_posted)
    if not n_posted:
        links = spark.createDataFrame([], "a long, b long")
    else:
        postings = runtime.stored(runtime.join_by_frequency(posted, lengths, "token", "n", n_posted), "lists", n_posted)
        wanted = postings.select("c").distinct()
        candidates = runtime.stored(runtime.join_bounded(classes, wanted, ["c"], "left_semi"), "candidates", min(n_posted, n_classes), WIDE_FILE)
        sets = _full_sets(docs, candidates, width)
        links = _links(postings, lengths, candidates, sets, similarity, t_posted, t_all)

    roots = graph.components(links)
    labels = runtime.join_bounded(classes.select(F.col("c").alias("node"), "label"), roots, ["node"], "inner")
    least = labels.groupBy("root").agg(F.min("label").alias("component"))
    linked = runtime.join_bounded(labels, least, ["root"], "inner").select(F.col("node").alias("c"), "component", F.lit(True).alias("linked"))
    known = classes.select("c", "digest", "label", "n_copies").join(linked, "c", "left")
    known = known.where((F.col("n_copies") > 1) | F.col("linked")).select("digest", "n_copies", F.coalesce("component", "label").alias("component"), F.lit(True).alias("grouped"))
    known = runtime.stored(known, "grouped-classes", n_classes)
    rows = runtime.join_by_frequency(base.select("doc_id", "n_shingles", "digest"), known, "digest", "n_copies", n_docs, "left")
    component = F.when(F.col("grouped"), F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))


def _block_units(members: DataFrame) -> DataFrame:
    """Lists (token, c, comp, mask, n_open) dealt into blocks, a row for each pair of blocks that a member meets in."""
    blocks = F.ceil(F.col("n_open") / BLOCK).cast("int")
    members = members.select("token", "c", "comp", "mask", F.pmod(F.xxhash64("c"), blocks).cast("int").alias("own"), blocks.alias("blocks"))
    units = members.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return units.select("token", "c", "comp", "mask", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("first"))


def _differences(meetings: DataFrame, sets: DataFrame) -> DataFrame:
    """For each (p, c): sizes of both sets, n_less (in p's set alone), n_more (in c's alone), and these differences unless c is far from p."""
    pivot, own = sets.select(F.col("c").alias("p"), F.col("shingles").alias("pivot_set")), sets.select("c", F.col("shingles").alias("own_set"))
    rows = runtime.join_salted(meetings, pivot, "p", "c").join(own, "c").select("p", "p_comp", "c", "comp", "n_alone", "pivot_set", "own_set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lists = [], []
            for x, y in zip(batch.column(5), batch.column(6), strict=True):
                x, y = (v.values.to_numpy() for v in (x, y))
                other = np.setxor1d(x, y, assume_unique=True)
                more = (len(other) + len(y) - len(x)) // 2
                sizes.append((len(x), len(other) - more, more))
                lists.append(other if 100 * (len(x) + more - len(other)) >= FAR * (len(x) + more) else other[:0])
            counts = np.array(sizes, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(counts[:, i]) for i in range(3)], pa.array(lists, pa.list_(pa.int64()))], ["p", "p_comp", "c", "comp", "n_alone", "n_pivot", "n_less", "n_more", "differences"])

    return rows.mapInArrow(runtime.tidy(run), "p long, p_comp long, c long, comp long, n_alone long, n_pivot long, n_less long, n_more long, differences array<long>")


def _difference_lists(members: DataFrame, facts: DataFrame, sets: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of long lists (token, c, comp, mask, n_open): links to pivots, shorter lists (token, c, comp, mask), and units of members that are linked with those that are not.

    With pivot P, X and Y share |P| - less(X) - less(Y) + o shingles, o being the differences from P that both have. So they are
    linked if 2 (100 + s) o >= A(X) + A(Y), A = 200 less + 2 s more - (100 - s) |P|, which is above 0 unless both are linked
    to P. Two that differ in less than 100 - s per cent can't have one below FAR and the other 100 - s above it; those that are
    not above it, the zone and all below, stay in their list, so in the zone only meetings with the core are left to see.
    """
    n = members.count()
    alone = facts.select("c", "n_alone", (F.col("n_alone") / F.col("n_shingles")).alias("alone"))
    members = runtime.stored(runtime.join_bounded(members, alone, ["c"], "inner"), "long-open-lists", n)
    pivots = members.groupBy("token").agg(F.min_by(F.struct("c", "comp"), F.struct("alone", F.xxhash64("c"))).alias("p"), F.count(F.lit(1)).alias("size"))
    members = runtime.join_by_frequency(members.drop("n_open", "alone"), runtime.stored(pivots, "pivots", n // LONG_LIST), "token", "size", n)
    members = runtime.stored(members.select("token", "c", "comp", "mask", "n_alone", F.col("p.c").alias("p"), F.col("p.comp").alias("p_comp")), "met-lists", n)
    meetings = runtime.stored(members.select("p", "p_comp", "c", "comp", "n_alone").distinct(), "pivot-meetings", n)
    n_met = meetings.count()
    met = runtime.stored(_differences(meetings, sets), "differences", n_met, SET_FILE)
    common, union, pn = F.col("n_pivot") - F.col("n_less"), F.col("n_pivot") + F.col("n_more"), F.col("n_pivot")
    near = met.where(common * 100 >= union * FAR).withColumns({"linked": common * 100 >= union * similarity, "a": F.col("n_less") * 200 + F.col("n_more") * (2 * similarity) - pn * (100 - similarity)})
    links = near.where(F.col("linked") & (F.col("comp") != F.col("p_comp"))).select(F.least("p", "c").alias("a"), F.greatest("p", "c").alias("b")).distinct()
    core = common * 100 >= union * (FAR + 100 - similarity)
    staying = met.where(~core).select("p", "c")
    rest = members.join(staying, ["p", "c"], "left_semi").select("token", "c", "comp", "mask")

    # With the most differences that each can share, a member that no partner's bounds allow is not cut into them.
    near = near.withColumn("slack", (F.col("n_less") + F.col("n_more") - F.col("n_alone")) * (2 * (100 + similarity)) - F.col("a")).withColumn("core", core)
    sides = {"linked": F.col("linked"), "other": ~F.col("linked"), "core": ~F.col("linked") & F.col("core")}
    ends = [agg(F.when(of, F.col(c))).alias(f"{name}_{side}") for side, of in sides.items() for name, agg, c in (("least", F.min, "a"), ("most", F.max, "slack"))]
    may = lambda side: (F.col("a") <= F.col(f"most_{side}")) & (F.col("slack") >= F.col(f"least_{side}"))
    for _ in range(2):  # again among those left
        bounds = near.groupBy("p").agg(*ends)
        bounds = runtime.stored(bounds.where(F.col("least_other").isNotNull()), "pivot-bounds", n_met)
        near = near.drop(*[f"{name}_{side}" for name in ("least", "most") for side in sides])
        near = runtime.join_bounded(near, bounds, ["p"], "inner")
        near = near.withColumns({"facing": F.when(F.col("linked"), may("other")).otherwise(may("linked") & (F.col("comp") != F.col("p_comp"))), "among": ~F.col("linked") & F.when(F.col("core"), may("other")).otherwise(may("core"))})
        near = near.where("facing OR among")
    key = F.struct("p", F.col("d")).alias("at")
    single = runtime.stored(near.select("p", "c", F.explode("differences").alias("d")).select("p", "c", key), "member-differences")
    counts = runtime.stored(single.groupBy("at").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "shared-differences")
    total = counts.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    shared = runtime.join_by_frequency(single, counts, "at", "f", max(1, total)).groupBy("p", "c").agg(F.array_sort(F.collect_list(F.struct("f", F.col("at.d").alias("d")))).alias("shared"))
    needed = lambda least: F.greatest(F.ceil((F.col("a") + F.col(least)) / (2 * (100 + similarity))), F.lit(1))
    prefix = lambda least: F.slice("shared", F.lit(1), F.greatest(F.size("shared") - needed(least) + 1, F.lit(0)).cast("int"))
    rows = runtime.stored(near.drop("differences").join(shared, ["p", "c"]).withColumn("comp", F.when(F.col("linked"), F.col("p_comp")).otherwise(F.col("comp"))), "shared-of-members", n_met, SET_FILE)
    token = lambda kind: (-1 - (F.pmod(F.xxhash64("p", "d.d"), F.lit(2**61)) * 2 + kind)).alias("token")
    mask = F.lit(0).cast("long").alias("mask")
    others = rows.where("among").select("p", "c", "comp", F.explode(F.when(F.col("core"), prefix("least_other")).otherwise(prefix("least_core"))).alias("d")).select(token(0), "c", "comp", mask)

    # Linked members with others: a block of one side meets each block of the other.
    facing = rows.where("facing").select("p", "c", "comp", F.col("linked").alias("first"), F.explode(F.when(F.col("linked"), prefix("least_other")).otherwise(prefix("least_linked"))).alias("d"))
    facing = runtime.stored(facing.select(token(1), "c", "comp", mask, "first"), "facing-lists")
    sizes = facing.groupBy("token").agg(F.count_if("first").alias("n_first"), F.count_if(~F.col("first")).alias("n_other"), F.count(F.lit(1)).alias("size")).where("n_first > 0 AND n_other > 0")
    sizes = runtime.stored(sizes, "facing-sizes")
    facing = runtime.join_by_frequency(facing, sizes, "token", "size", max(1, facing.count()))
    left, right = (F.ceil(F.col(k) / BLOCK).cast("int") for k in ("n_first", "n_other"))
    facing = facing.select("token", "c", "comp", "mask", "first", left.alias("left"), F.pmod(F.xxhash64("c"), F.when(F.col("first"), left).otherwise(right)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.when(F.col("first"), right).otherwise(left) - 1)).alias("other"))
    x, y = F.when(F.col("first"), F.col("own")).otherwise(F.col("other")), F.when(F.col("first"), F.col("other")).otherwise(F.col("own"))
    across = facing.select("token", "c", "comp", "mask", x.alias("x"), (F.col("left") + y).cast("int").alias("y"), "first")
    return links, runtime.stored(rest.unionByName(others), "shorter-lists"), across


def _bit(token):
    """The bit of a token's coordinate."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(token, 32).cast("int"))


def _links(postings: DataFrame, lengths: DataFrame, candidates: DataFrame, sets: DataFrame, similarity: int, t_posted: int, t_all: int) -> DataFrame:
    """Confirmed pairs that connect all that is connected."""
    facts = candidates.select("c", "n_shingles", "signature").join(_alone(sets), "c", "left").fillna(0, ["n_alone"])
    n_facts = candidates.count()
    n_rows = postings.count()
    facts = runtime.stored(facts, "facts", n_facts, WIDE_FILE)
    found = None
    parts = postings.select("c").distinct().select(F.col("c"), F.col("c").alias("comp"))
    if lengths.where(F.col("n") > LONG_LIST).take(1):
        alone = facts.select("c", (F.col("n_alone") / F.col("n_shingles")).alias("alone"))
        long_lists = runtime.join_bounded(postings.where(F.col("n") > LONG_LIST).select("token", "c", "n"), alone, ["c"], "inner", n_facts)
        long_lists = runtime.stored(long_lists, "long-lists", n_rows)
        total = long_lists.count()
        tested = None
        for r in range(PIVOT_ROUNDS):
            members = runtime.join_bounded(long_lists, parts, ["c"], "inner")
            # First the member with the least of its own, which is nearest to what the copies were made from; then any.
            order = F.col("alone") if r == 0 else F.lit(0.0)
            pivots = members.groupBy("token").agg(F.min_by(F.struct("c", "comp"), F.struct(order, F.xxhash64("c", F.lit(r)))).alias("p"), F.first("n").alias("size"))
            met = runtime.join_by_frequency(members.drop("n", "alone"), runtime.stored(pivots, "pivots", total // LONG_LIST), "token", "size", total)
            pairs = met.where(F.col("comp") != F.col("p.comp")).select(F.least("c", "p.c").alias("a"), F.greatest("c", "p.c").alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = runtime.stored(pairs, "pivot-meetings", total)
            for side in ("a", "b"):
                own = facts.select(F.col("c").alias(side), F.col("signature").alias(side + "_signature"), F.col("n_shingles").alias(side + "_n"), (F.col("n_shingles") - F.col("n_alone")).alias(side + "_most"))
                if n_facts <= WIDE_ROWS:
                    pairs = pairs.join(F.broadcast(own), side)
                else:
                    pairs = runtime.join_salted(pairs, own, side, "b" if side == "a" else "a")
            equal = F.size(F.filter(F.zip_with("a_signature", "b_signature", lambda x, y: x == y), lambda e: e))
            common = F.least("a_most", "b_most")  # at best
            near = (equal >= t_all) & (common * 100 >= (F.col("a_n") + F.col("b_n") - common) * similarity)
            pairs = runtime.stored(pairs.where(near).select("a", "b"), "pivot-pairs", total, WIDE_FILE)
            tested = pairs if tested is None else tested.unionByName(pairs)
            met = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
            near_sets = runtime.join_bounded(sets, met, ["c"], "left_semi")
            new = runtime.stored(confirmed(pairs, near_sets, similarity), "links", pairs.count() + n_facts, SET_FILE)
            found = new if found is None else found.unionByName(new)
            roots = graph.components(found)
            parts = runtime.stored(postings.select("c").distinct().join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("root", "c").alias("comp")), "parts", n_facts)
    members = runtime.join_bounded(postings.select("token", "c", "mask"), parts, ["c"], "inner")
    units = None
    for r in range(DIFFERENCE_ROUNDS + 1):
        sizes = members.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n_open")).where(F.col("lo") < F.col("hi")).select("token", "n_open")
        sizes = runtime.stored(sizes, "open-lists", n_rows)
        again = r < DIFFERENCE_ROUNDS and sizes.where(F.col("n_open") > LONG_LIST).take(1)
        members = runtime.join_by_frequency(members, sizes, "token", "n_open", max(1, n_rows))
        own = _block_units(members.where(F.col("n_open") <= LONG_LIST) if again else members)
        units = own if units is None else units.unionByName(own)
        if not again:
            break
        new, members, across = _difference_lists(members.where(F.col("n_open") > LONG_LIST), facts, sets, similarity)
        found, units = found.unionByName(new) if found is not None else new, units.unionByName(across)
    lists = runtime.join_bounded(units, facts, ["c"], "inner", n_facts, WIDE_ROWS)
    pairs = runtime.stored(_block_pairs(lists, similarity, t_posted, t_all).distinct(), "block-pairs")
    rest = runtime.stored(confirmed(pairs, sets, similarity), "links", pairs.count() + n_facts, SET_FILE)
    return rest if found is None else found.unionByName(rest)


def drop_near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """The rows, all columns, that stay: of each component the row with the least doc_id, a NULL one last.

    Rows are told apart by a 64-bit hash of doc_id and text, so rows with a NULL or a repeated doc_id go or stay by their
    own texts. Rows equal in both count once, if they have words; texts without words all stay.
    """
    name = "__loomline_key"
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    found = runtime.stored(near_duplicates(docs.select(key.alias("doc_id"), "text"), similarity, width).where("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id", "kept"), "dedup-decisions")
    sizes = found.where(~F.col("kept")).groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))  # components of more than one text or id
    many = runtime.stored(sizes, "dedup-components")
    n = many.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = runtime.join_by_frequency(found, many, "component_id", "n", max(1, n)).select("key", "component_id").distinct()
    members = runtime.stored(members, "dedup-members")
    ids = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id")).distinct()
    named = runtime.join_bounded(ids, members, ["key"], "inner")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("f")).select(F.col("f.key").alias("key"))
    gone = runtime.stored(members.join(first, "key", "left_anti").select(F.col("key").alias(name)), "dedup-gone")
    keyed = docs.withColumn(name, key)
    rest = runtime.join_bounded(keyed, gone, [name], "left_anti")
    again = runtime.stored(found.groupBy("key").count().where("count > 1").select(F.col("key").alias(name)), "repeated-rows")
    if not again.take(1):
        return rest.drop(name)
    once = runtime.join_bounded(rest, again, [name], "left_anti")
    twice = runtime.join_bounded(rest, again, [name], "left_semi").dropDuplicates([name])
    return once.unionByName(twice).drop(name)
