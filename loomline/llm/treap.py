"""Ranked lexical search (op13) over inverted treaps: the best documents of each item, by exact integer scores.

Documents are dealt into shards of bounded size. In a shard every term has a treap: a binary tree over the documents that
hold it, in search order by document and in heap order by impact, so a subtree's root has its largest impact. All items
are searched at once: a range of documents has one node per term, the highest of the term's treap in that range; if the
sum of their impacts can't enter the item's best k, the range is pruned, else the document of the largest impact is
scored and splits the range. Best values carry over from shard to shard of a task; the tasks' best are merged at the end.

An index serves the terms that it was built for, those of one block of items: it holds no posting of other words.
"""

from __future__ import annotations

import dataclasses
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime

TOP = 20
#: Documents and postings of a shard.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000
#: Shards that a task searches, one after the other, where there are more than shuffle partitions hold.
TASK_SHARDS = 8
#: Items, and signs of their texts, that are searched together; more are searched in several blocks.
BLOCK_ITEMS, BLOCK_SIGNS = 10_000, 16_000_000
#: Nodes that the ranges of the items searched at once may have in a shard, and ranges split at once.
HELD_NODES, SPLIT_RANGES = 8_000_000, 20_000
_NAMES = -1  # the "term" of a shard's doc_ids
_INDEX = "shard long, term int, keys binary, impacts binary, left binary, right binary"
_FOUND = "item int, doc_id long, score long"

_kept = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_SIGNS = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _kept else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters and digits and of other signs beyond ASCII, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SIGNS).split()


@dataclasses.dataclass
class Index:
    """shards: shard, term, keys, impacts, left, right; vocabulary: term -> number; weights: by number."""

    shards: DataFrame
    vocabulary: dict[bytes, int]
    weights: np.ndarray


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (of the vocabulary), for documents with any term; stored."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "doc_id long, n int, terms array<int>, tfs array<int>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = words.value.get
        for batch in batches:
            names, sizes, ends, terms, tfs = [], [], [0], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms_of(text)
                if not found:
                    continue
                known = Counter(map(number, found))
                known.pop(None, None)
                names.append(name)
                sizes.append(len(found))
                terms.extend(known)
                tfs.extend(known.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), *lists], ["doc_id", "n", "terms", "tfs"])

    return runtime.stored(runtime.docs_of(docs).mapInArrow(count, schema), "forward")


def heap_tree(order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right children (-1: none) of trees in heap order over runs of nodes that stay in place; and the runs' roots."""
    value = order.tolist()
    left, right, roots = [-1] * len(value), [-1] * len(value), []
    ends = [*starts[1:].tolist(), len(value)][: len(starts)]
    for begin, end in zip(starts.tolist(), ends, strict=True):
        stack: list[int] = []
        for i in range(begin, end):
            last, v = -1, value[i]
            while stack and value[stack[-1]] < v:
                last = stack.pop()
            left[i] = last
            if stack:
                right[stack[-1]] = i
            stack.append(i)
        roots.append(stack[0])
    return np.array(left, np.int32), np.array(right, np.int32), np.array(roots, np.int32)


def shard_rows(shard: int, names: list[int | None], sizes: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The treaps of a shard's documents, one row each, and a row with their doc_ids in order, NULL ones last."""
    null = np.array([n is None for n in names])
    ids = np.array([0 if n is None else n for n in names], np.int64)
    order = np.lexsort((ids, null))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    slow = 75 + (25 * sizes.astype(np.int64) * n_docs) // n_terms  # the contract's m
    doc = np.repeat(np.arange(len(order)), counts)
    tf = tfs.astype(np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * slow[doc])
    by_term = np.lexsort((place[doc], terms))
    keys, impact, terms = place[doc][by_term].astype("<i4"), impact[by_term].astype("<i4"), terms[by_term]
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.array([], np.int64)
    # Equal impacts are in the order of a hash, or equal ones would make chains of the trees.
    shuffled = ((keys.astype(np.int64) * 2654435761) >> 7) & 0xFFFFF
    left, right, roots = heap_tree((impact.astype(np.int64) << 20) | shuffled, starts)
    rows: list[tuple] = [(shard, _NAMES, ids[order].astype("<i8").tobytes(), null[order].astype("u1").tobytes(), b"", b"")]
    ends = np.r_[starts[1:], len(terms)] if len(terms) else starts
    for begin, end, root in zip(starts.tolist(), ends.tolist(), roots.tolist(), strict=True):
        # Children count from the first node of the term; the root's number stands before the left children.
        near = [np.where(x[begin:end] < 0, -1, x[begin:end] - begin).astype("<i4") for x in (left, right)]
        rows.append((shard, int(terms[begin]), keys[begin:end].tobytes(), impact[begin:end].tobytes(), np.r_[np.int32(root - begin), near[0]].astype("<i4").tobytes(), near[1].tobytes()))
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in _INDEX.split(", ")])


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> Index:
    """Treaps of the vocabulary's terms over all whole texts, as a stored table.

    A NULL text has no terms; documents without terms don't count. NULL and repeated doc_ids are documents like any other.
    """
    runtime.prepare(docs.sparkSession)
    rows = forward(docs, vocabulary)
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # at most a row per term of the vocabulary
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequence = TaskContext.get().partitionId(), 0
        names: list = []
        held: list[tuple[np.ndarray, ...]] = []
        postings = 0
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            counts = np.diff(ends)
            at = 0
            while at < len(counts):
                # So many documents as the shard has room for, one at least.
                room = np.searchsorted(np.cumsum(counts[at:]), shard_postings - postings, "right")
                take = max(int(min(room, shard_docs - len(names), len(counts) - at)), 0 if names else 1)
                if take:
                    begin, end = ends[at] - ends[0], ends[at + take] - ends[0]
                    names.extend(batch.column(0).slice(at, take).to_pylist())
                    held.append((batch.column(1).slice(at, take).to_numpy(), counts[at : at + take], batch.column(2).flatten().to_numpy()[begin:end], batch.column(3).flatten().to_numpy()[begin:end]))
                    postings += int(end - begin)
                    at += take
                if at < len(counts):
                    yield shard_rows(part << 32 | sequence, names, *map(np.concatenate, zip(*held, strict=True)), n_docs, n_terms)
                    sequence += 1
                    names, held, postings = [], [], 0
        if names:
            yield shard_rows(part << 32 | sequence, names, *map(np.concatenate, zip(*held, strict=True)), n_docs, n_terms)

    return Index(runtime.stored(rows.mapInArrow(build, _INDEX), "treaps"), vocabulary, weights)


class Best:
    """The best k documents of each item so far: by score, of equal ones the lower doc_id."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.scores = np.zeros((items, k), np.int64)
        self.ids = np.full((items, k), np.iinfo(np.int64).max)
        self.null = np.ones((items, k), bool)

    def may_enter(self, item: np.ndarray, score: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Whether a document with at most that score and at least that id could be among the best."""
        last = self.scores[item, -1]
        return (score > last) | ((score == last) & (score > 0) & (least_id < self.ids[item, -1]))

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        some = self.may_enter(item, score, ids)
        if not some.any():
            return
        touched = np.unique(item[some])
        items = np.r_[np.repeat(touched, self.k), item[some]]
        scores = np.r_[self.scores[touched].ravel(), score[some]]
        all_ids, nulls = np.r_[self.ids[touched].ravel(), ids[some]], np.r_[self.null[touched].ravel(), null[some]]
        order = np.lexsort((all_ids, -scores, items))
        items = items[order]
        first = np.searchsorted(items, touched)
        at = order[(first[:, None] + np.arange(self.k)).ravel()]
        for own, new in ((self.scores, scores), (self.ids, all_ids), (self.null, nulls)):
            own[touched] = new[at].reshape(-1, self.k)


class Shard:
    """A shard's treaps side by side: arrays over nodes, ordered by term and document."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes, bytes]]) -> None:
        rows = sorted(rows, key=lambda r: r[0])
        self.ids, self.null = np.frombuffer(rows[0][1], "<i8"), np.frombuffer(rows[0][2], "u1").astype(bool)
        self.order = np.where(self.null, np.iinfo(np.int64).max, self.ids)
        rows = rows[1:]
        size = np.array([len(r[1]) // 4 for r in rows], np.int64)
        begin = np.cumsum(size) - size
        whole = lambda k: np.frombuffer(b"".join(r[k] for r in rows), "<i4").astype(np.int64)
        # Node 0 stands for none, so that children of none are none.
        base = np.r_[0, np.repeat(begin, size) + 1]
        self.keys = np.r_[-1, whole(1)]
        self.impacts = np.r_[0, whole(2)]
        roots_left = whole(3)
        roots = np.array([int(np.frombuffer(r[3], "<i4", 1)[0]) for r in rows], np.int64)
        left = np.delete(roots_left, begin + np.arange(len(rows))) if rows else roots_left
        self.left = np.r_[0, np.where(left < 0, 0, left + base[1:])]
        right = whole(4)
        self.right = np.r_[0, np.where(right < 0, 0, right + base[1:])]
        self.term = np.r_[-1, np.repeat(np.arange(len(rows)), size)]
        self.sorted = (self.term << 32) | self.keys
        self.sorted[0] = -1
        self.roots = {r[0]: int(b + 1 + root) for r, b, root in zip(rows, begin, roots, strict=True)}

    def highest(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each node the highest one below it, itself included, with a document in [low, high); 0: none."""
        node = node.copy()
        at = np.arange(len(node))
        while len(at):
            here = node[at]
            key = self.keys[here]
            above, below = key >= high[at], (key < low[at]) & (here > 0)
            moved = above | below
            at, here, above = at[moved], here[moved], above[moved]
            node[at] = np.where(above, self.left[here], self.right[here])
        return node


def _first_of(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row


def search_shard(shard: Shard, items: list[tuple[int, np.ndarray, np.ndarray]], best: Best) -> None:
    """Adds the shard's documents to the best of the items: (item, terms, weights times repeats)."""
    found = [(i, [shard.roots.get(t, 0) for t in terms.tolist()], weights) for i, terms, weights in items]
    nodes = np.array([n for _, roots, _ in found for n in roots], np.int64)
    weight = np.concatenate([w for _, _, w in found]) if found else np.array([], np.int64)
    row = np.repeat(np.arange(len(found)), [len(roots) for _, roots, _ in found])
    there = (nodes > 0) & (weight > 0)
    nodes, weight, row = nodes[there], weight[there], row[there]
    item, low, high = np.array([i for i, _, _ in found], np.int64), np.zeros(len(found), np.int64), np.full(len(found), len(shard.ids), np.int64)

    def kept(item, low, high, row, nodes, weight):
        """Ranges whose bound can still enter, their entries renumbered."""
        if not len(row):
            return item[:0], low[:0], high[:0], item[:0], row, nodes, weight
        first = _first_of(row)
        at = row[first]
        bound = np.add.reduceat(weight * shard.impacts[nodes], first)
        ok = best.may_enter(item[at], bound, shard.order[low[at]])
        n = np.diff(np.r_[first, len(row)])
        entries = np.repeat(ok, n)
        return item[at][ok], low[at][ok], high[at][ok], bound[ok], np.repeat(np.arange(int(ok.sum())), n[ok]), nodes[entries], weight[entries]

    item, low, high, bound, row, nodes, weight = kept(item, low, high, row, nodes, weight)
    while len(item):
        # The better ranges of each item are split first, for they raise what the others have to reach.
        order = np.lexsort((-bound, item))
        first = _first_of(item[order])
        n = np.diff(np.r_[first, len(order)])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(first, n)
        share = np.zeros(int(item.max()) + 1, np.int64)
        share[item[order][first]] = np.maximum(16, n // 4)
        chosen = rank < np.minimum(share[item], max(1, SPLIT_RANGES // len(first)))
        entries = chosen[row]
        r = np.cumsum(chosen)[row[entries]] - 1
        e, w = nodes[entries], weight[entries]
        i, lo, hi = item[chosen], low[chosen], high[chosen]
        first = _first_of(r)
        value = w * shard.impacts[e]
        top = np.flatnonzero(value == np.maximum.reduceat(value, first)[r])
        pivot = shard.keys[e[top[_first_of(r[top])]]]
        # The score of the document that splits the range: where each term's treap has it, by its search order.
        wanted = (shard.term[e] << 32) | pivot[r]
        at = np.minimum(np.searchsorted(shard.sorted, wanted), len(shard.sorted) - 1)
        score = np.add.reduceat(np.where(shard.sorted[at] == wanted, w * shard.impacts[at], 0), first)
        best.add(i, score, shard.order[pivot], shard.null[pivot])
        below = shard.highest(e, lo[r], pivot[r])
        above = shard.highest(e, pivot[r] + 1, hi[r])
        rest = ~chosen
        stay = ~entries
        parts = [(item[rest], low[rest], high[rest], np.cumsum(rest)[row[stay]] - 1, nodes[stay], weight[stay])]
        for child, left_end, right_end in ((below, lo, pivot), (above, pivot + 1, hi)):
            there = child > 0
            parts.append((i, left_end, right_end, r[there], child[there], w[there]))
        shift = np.cumsum([0, *[len(p[0]) for p in parts[:-1]]])
        joined = [np.concatenate(c) for c in zip(*[(p[0], p[1], p[2], p[3] + s, p[4], p[5]) for p, s in zip(parts, shift, strict=True)], strict=True)]
        item, low, high, bound, row, nodes, weight = kept(*joined)


def search(index: Index, items: list[tuple[int, list[bytes]]], k: int = TOP) -> DataFrame:
    """item, doc_id, score: for each item (number, terms with repeats) its k best documents of every task, with score above 0."""
    spark = index.shards.sparkSession
    queries = []
    for number, terms in items:
        repeats = Counter(index.vocabulary[t] for t in terms if t in index.vocabulary)
        own = np.array(sorted(repeats), np.int64)
        weights = index.weights[own] * np.array([repeats[t] for t in own.tolist()], np.int64) if len(own) else own
        queries.append((number, own[weights > 0], weights[weights > 0]))
    queries = [q for q in queries if len(q[1])]
    wanted = spark.sparkContext.broadcast(queries)
    size = max((n for n, _ in items), default=-1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(size, k)

        def done(rows: list) -> None:
            shard = Shard(rows)
            room = max(1, 2 * HELD_NODES // max(1, len(shard.ids)))
            group: list = []
            held = 0
            for query in wanted.value:
                if group and held + len(query[1]) > room:
                    search_shard(shard, group, best)
                    group, held = [], 0
                group.append(query)
                held += len(query[1])
            if group:
                search_shard(shard, group, best)

        current, rows = None, []
        for batch in batches:
            for shard, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != current and rows:
                    done(rows)
                    rows = []
                current = shard
                rows.append(tuple(row))
        if rows:
            done(rows)
        item, at = np.nonzero(best.scores > 0)
        ids = pa.array(best.ids[item, at], pa.int64(), mask=best.null[item, at])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(best.scores[item, at], pa.int64())], ["item", "doc_id", "score"])

    terms = sorted({int(t) for _, own, _ in queries for t in own})
    chosen = index.shards if len(terms) * 2 > len(index.vocabulary) else index.shards.where(F.col("term").isin([_NAMES, *terms]))
    shards = index.shards.where(F.col("term") == _NAMES).count()
    tasks = -(-shards // TASK_SHARDS)
    # Shuffle partitions may be too few for a large index; where they aren't, adaptive execution may join small ones.
    dealt = chosen.repartition("shard") if tasks <= runtime.partitions(spark) else chosen.repartition(tasks, "shard")
    return dealt.sortWithinPartitions("shard", "term").mapInArrow(run, _FOUND)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items, in blocks of bounded size: (item_id, text)."""
    n, signs = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-signs // BLOCK_SIGNS))
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [(r[0], r[1]) for r in items.where(own == b).select("item_id", "text").collect()]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each item among those of the tasks, in two steps, so that no task sees all of one item."""
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item, all if fewer have a score above 0.

    Equal scores go by ascending doc_id, a NULL one last. A NULL text, of a document or an item, has no terms. Rows that
    repeat an item_id are items of their own, rows that repeat a doc_id documents. Without documents or items there are
    no rows.
    """
    spark = docs.sparkSession
    out = None
    for block in _blocks(items.select("item_id", "text")):
        texts = [terms_of(text) for _, text in block]
        vocabulary = {t: n for n, t in enumerate(sorted(set().union(*texts)))} if texts else {}
        index = build_index(docs, vocabulary)
        found = runtime.stored(_ranked(search(index, list(enumerate(texts)), k), k), "ranked")
        names = spark.createDataFrame([(n, name) for n, (name, _) in enumerate(block)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out
