"""LM scoring (op3): class-based bigrams with classes from exchange clustering.

P(w | previous) = P(class of w | class of previous) * P(w | class of w). The CORE most frequent words move between
classes one by one, all other words in UNITS groups that share an ending, so every word, seen or not, has a class. Then
each word seen LEARNED times or more goes, in ROUNDS of a distributed exchange, to the class that its own neighbours'
classes make most likely; only rarer and unseen words stay with their ending. The exchange maximises the likelihood of class bigrams, which are counted over all training texts. Transitions are
discounted and interpolated with class frequencies; within a class that holds word groups, a seen word has
(count - d) / N and all unseen ones together d * V / N, which is the probability of an unseen word, as one event.

The vocabulary grows with the corpus and stays distributed. The HEAD most frequent words go to every task; the rest of a
text's words are looked up by a join on the word, in which no key has more than 1/HEAD of all tokens. Classes of words
go to every task as a hash and a class, 9 bytes for each word seen LEARNED times.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .words import words_of

MOD, HELD_OUT = 7, 2
CORE, UNITS, CLASSES = 1024, 255, 64
HEAD = 65_536
SWEEPS = 6
LEARNED, ROUNDS = 20, 1
DISCOUNT = 0.5
_END = CORE + UNITS
_ITEMS = CORE + UNITS + 1
_KEEP = 300_000


def unit_of(word: bytes) -> int:
    """The group of a word outside the core, by its last three bytes."""
    return zlib.crc32(word[-3:]) % UNITS


class _Codes:
    """Words to codes: those given, then by hash those learned, and for others `first` plus their group; kept for a while."""

    def __init__(self, given: dict[bytes, int], first: int, hashes: np.ndarray, codes: np.ndarray) -> None:
        self._given, self._first, self._hashes, self._codes = given, first, hashes, codes
        self._kept = dict(given)

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self._kept.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(out < 0)
        if len(at):
            new = list({words[i] for i in at})
            code = np.fromiter((self._first + unit_of(w) for w in new), np.int64, len(new))
            if len(self._hashes):
                h = _hashes_of(new)
                place = np.minimum(np.searchsorted(self._hashes, h), len(self._hashes) - 1)
                code = np.where(self._hashes[place] == h, self._codes[place], code)
            if len(self._kept) > len(self._given) + _KEEP:
                self._kept = dict(self._given)
            self._kept.update(zip(new, code.tolist(), strict=True))
            out[at] = [self._kept[words[i]] for i in at]
        return out


def _hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all whole texts; each task adds up what it reads before it sends anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
            if len(counts) > 500_000:
                yield out()
                counts = Counter()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learned_words(vocabulary: DataFrame, core: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, rising, and groups of all words outside the core that were seen LEARNED times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if w not in core]
            yield pa.RecordBatch.from_arrays([pa.array(_hashes_of(words).view(np.int64)), pa.array(list(map(unit_of, words)), pa.int16())], ["h", "unit"])

    found = vocabulary.where(F.col("n") >= LEARNED).select("word").mapInArrow(run, "h long, unit short").toArrow()
    hashes, at = np.unique(found.column("h").to_numpy().view(np.uint64), return_index=True)
    return hashes, found.column("unit").to_numpy()[at].astype(np.int64)


def coded(docs: DataFrame, core: dict[bytes, int], hashes: np.ndarray) -> DataFrame:
    """The items of each whole text between two ends; from _ITEMS on, the place of a learned word."""
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(core, CORE, shared.value, np.arange(_ITEMS, _ITEMS + len(shared.value)))
        for batch in batches:
            rows = [np.concatenate([[_END], codes.of(words_of(t)), [_END]]) for t in batch.column(0).to_pylist()]
            if rows:
                ends = np.cumsum([0, *map(len, rows)])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows), pa.int32()))], ["codes"])

    return docs.select("text").mapInArrow(run, "codes array<int>")


def _neighbours(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Codes and the codes after them, within texts."""
    flat, ends = batch.column(0).flatten().to_numpy(), batch.column(0).offsets.to_numpy()
    keep = np.ones(max(0, len(flat) - 1), bool)
    keep[(ends - ends[0])[1:-1] - 1] = False
    return flat[:-1][keep], flat[1:][keep]


def pair_counts(texts: DataFrame, kinds: np.ndarray, size: int) -> np.ndarray:
    """How often each kind follows each, over all coded texts; kinds has that of each code, there are `size`."""
    shared = texts.sparkSession.sparkContext.broadcast(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(size * size, np.int64), [], 0
        for batch in batches:
            a, b = _neighbours(batch)
            held.append(shared.value[a] * size + shared.value[b])
            n += len(a)
            if n > 2_000_000:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 18):
            part = at[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["code", "n"])

    found = texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def likelihood(table: np.ndarray) -> float:
    """Of class bigrams, but for what no move of words changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def best_classes(before: np.ndarray, after: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word (a row of counts by classes before and after it) under a fixed table that has it in its own."""
    log = lambda x: np.log(np.maximum(x, 0.5))
    left, right = table.sum(1), table.sum(0)
    gain = before @ (log(table) - log(right)) + after @ (log(table).T - log(left))
    n_before, n_after = before.sum(1), after.sum(1)
    rows = np.arange(len(own))
    stay = (before * log(table[:, own].T - before)).sum(1) + (after * log(table[own] - after)).sum(1)
    gain[rows, own] = stay - n_before * log(right[own] - n_before) - n_after * log(left[own] - n_after)
    new = gain[:, : len(table) - 1].argmax(1)
    return np.where(gain[rows, new] > gain[rows, own] + 1e-9, new, own)


def exchange_learned(texts: DataFrame, kinds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A new class of each learned word; kinds has the class of each code and table the class bigrams."""
    shared, size = texts.sparkSession.sparkContext.broadcast(kinds), len(table)
    wide = 2 * size

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            word = keys // wide
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            ends = pa.array([*starts.tolist(), len(keys)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(word[starts], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(keys % wide, pa.int16())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))], ["i", "c", "n"])

        for batch in batches:
            a, b = (x.astype(np.int64) for x in _neighbours(batch))
            x, y = b >= _ITEMS, a >= _ITEMS
            held += [(b[x] - _ITEMS) * wide + shared.value[a[x]], (a[y] - _ITEMS) * wide + size + shared.value[b[y]]]
            n += int(x.sum() + y.sum())
            if n > 4_000_000:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            keys.append(np.repeat(batch.column(0).to_numpy().astype(np.int64), lengths) * wide + batch.column(1).flatten().to_numpy())
            counts.append(batch.column(2).flatten().to_numpy())
        if not keys:
            return
        key, count = np.concatenate(keys), np.concatenate(counts)
        words, place = np.unique(key // wide, return_inverse=True)
        for k in range(0, len(words), 4096):
            mine = (place >= k) & (place < k + 4096)
            some = words[k : k + 4096]
            rows = np.bincount((place[mine] - k) * wide + key[mine] % wide, count[mine], len(some) * wide).reshape(-1, wide)
            new = best_classes(rows[:, :size], rows[:, size:], shared.value[_ITEMS + some], table)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(new, pa.int16())], ["i", "class"])

    found = texts.mapInArrow(contexts, "i int, c array<short>, n array<int>").repartition("i").mapInArrow(choose, "i int, class short").toArrow()
    out = kinds.copy()
    out[_ITEMS + found.column("i").to_numpy()] = found.column("class").to_numpy()
    return out


def class_sums(vocabulary: DataFrame, core: dict[bytes, int], hashes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and words of each class over the whole vocabulary."""
    shared, size = vocabulary.sparkSession.sparkContext.broadcast((hashes, kinds)), CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(core, CORE, shared.value[0], np.arange(_ITEMS, _ITEMS + len(shared.value[0])))
        tokens, types = np.zeros(size), np.zeros(size)
        for batch in batches:
            own = shared.value[1][codes.of(batch.column(0).to_pylist())]
            tokens += np.bincount(own, batch.column(1).to_numpy(), size)
            types += np.bincount(own, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(tokens), pa.array(types)], ["class", "n", "types"])

    sums = vocabulary.select("word", "n").mapInArrow(run, "class int, n double, types double").groupBy("class").agg(F.sum("n"), F.sum("types")).collect()  # a row per class
    tokens, types = np.zeros(size), np.zeros(size)
    for c, n, distinct in sums:
        tokens[c], types[c] = n, distinct
    return tokens, types


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each item, so that class bigrams are as likely as moves of single items make them. The last item has a class of its own."""
    n = len(bigrams)
    order = np.argsort(-bigrams.sum(1), kind="stable")
    group = np.empty(n, int)
    group[order] = np.arange(n) % classes
    group[n - 1] = classes
    size = classes + 1
    member = np.zeros((n, size))
    member[np.arange(n), group] = 1
    table = member.T @ bigrams @ member
    out_sum, in_sum = bigrams.sum(1), bigrams.sum(0)
    left, right = table.sum(1), table.sum(0)
    inner = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if w == n - 1 or not (out_sum[w] or in_sum[w]):
                continue
            old, own = group[w], bigrams[w, w]
            after = np.bincount(group, bigrams[w], size)
            before = np.bincount(group, bigrams[:, w], size)
            after[old] -= own
            before[old] -= own
            table[old] -= after
            table[:, old] -= before
            table[old, old] -= own
            left[old] -= out_sum[w]
            right[old] -= in_sum[w]
            now = _xlogx(table)
            rows = _xlogx(table + after) - now
            columns = _xlogx(table + before[:, None]) - now
            d = np.arange(size)
            both = _xlogx(table[d, d] + after + before + own) - now[d, d]
            gain = rows.sum(1) - rows[d, d] + columns.sum(0) - columns[d, d] + both
            gain -= _xlogx(left + out_sum[w]) - _xlogx(left) + _xlogx(right + in_sum[w]) - _xlogx(right)
            new = int(inner[gain[:classes].argmax()])
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            group[w] = new
            table[new] += after
            table[:, new] += before
            table[new, new] += own
            left[new] += out_sum[w]
            right[new] += in_sum[w]
        if not moved:
            break
    return group


@dataclasses.dataclass
class Model:
    vocabulary: DataFrame  # word, n: distributed
    head: dict[bytes, int]  # place by frequency
    head_counts: np.ndarray
    train_tokens: int
    types: int
    train_docs: int
    group: np.ndarray  # class of each item
    transitions: np.ndarray  # log10
    class_tokens: np.ndarray
    class_discount: np.ndarray
    class_unseen: np.ndarray  # log10 probability of an unseen word in the class
    hashes: np.ndarray  # of learned words, rising
    learned: np.ndarray  # class of each

    def base(self, count):
        return np.log10((count + 1) / (self.train_tokens + self.types + 1))


def fit(train: DataFrame) -> Model:
    """Counts over all whole texts of train (doc_id, text); the driver's part of the clustering runs on at most _ITEMS squared of them."""
    train = runtime.docs_of(train)
    vocabulary = runtime.stored(word_counts(train), "vocabulary")
    train_docs = train.select("doc_id").count()
    tokens, types, once, twice = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    top = vocabulary.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    words, counts = [bytes(w) for w in top.column("word").to_pylist()], top.column("n").to_numpy().astype(float)
    core = {w: i for i, w in enumerate(words[:CORE])}
    hashes, units = learned_words(vocabulary, core)
    texts = runtime.stored(coded(train, core, hashes), "coded")
    items = np.concatenate([np.arange(_ITEMS), CORE + units])
    bigrams = pair_counts(texts, items, _ITEMS)
    group = exchange(bigrams, CLASSES)
    size = CLASSES + 1
    member = np.zeros((_ITEMS, size))
    member[np.arange(_ITEMS), group] = 1
    table, kinds = member.T @ bigrams @ member, group[items]
    for _ in range(ROUNDS if len(hashes) else 0):
        moved = exchange_learned(texts, kinds, table)
        new = pair_counts(texts, moved, size)
        if likelihood(new) <= likelihood(table):
            break
        table, kinds = new, moved
    class_tokens, class_types = class_sums(vocabulary, core, hashes, kinds)
    has_units = np.bincount(group[CORE:_END], minlength=size) > 0
    d = once / (once + 2 * twice) if once and twice else DISCOUNT
    discount = np.where(has_units, d, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        unseen = np.where(class_tokens > 0, np.log10(np.where(discount > 0, discount * class_types / class_tokens, 1)), 0.0)
    lower = (table.sum(0) + 1) / (table.sum() + size)
    rows = table.sum(1, keepdims=True)
    free = np.minimum(table, DISCOUNT).sum(1, keepdims=True)
    transitions = np.where(rows > 0, (np.maximum(table - DISCOUNT, 0) + free * lower) / np.maximum(rows, 1), lower)
    return Model(vocabulary, {w: i for i, w in enumerate(words)}, counts, int(tokens) + train_docs, int(types) + (train_docs > 0), train_docs, group, np.log10(transitions), class_tokens, discount, unseen, hashes, kinds[_ITEMS:].astype(np.int8))


def score(docs: DataFrame, model: Model, mod: int = MOD, held_out: int = HELD_OUT) -> DataFrame:
    """A row per row of docs. A NULL text is empty: its only token is the end. NULL and repeated doc_ids are rows like any other."""
    spark = docs.sparkSession
    n_head = len(model.head)
    # Codes of words outside the head: by ending, then by learned class.
    codes_class = np.concatenate([np.zeros(HEAD, np.int64), model.group[CORE:_END], np.arange(CLASSES)])
    core = {w: i for w, i in model.head.items() if i < CORE}
    head_class = np.concatenate([model.group, model.learned])[_Codes(core, CORE, model.hashes, np.arange(_ITEMS, _ITEMS + len(model.hashes))).of(list(model.head))]
    codes_class[:n_head] = head_class
    head_base = model.base(model.head_counts)
    head_model = np.log10((model.head_counts - model.class_discount[head_class]) / model.class_tokens[head_class]) if n_head else np.empty(0)
    end_base, end_known = float(model.base(model.train_docs)), int(model.train_docs > 0)
    shared = spark.sparkContext.broadcast((model.head, codes_class, head_base, head_model, model.transitions, model.hashes, model.learned))
    schema = "rid long, doc_id long, word binary, tf long, class int, base double, model double, n_tokens long, n_known long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, classes, base_of, model_of, transitions, hashes, learned = shared.value
        codes = _Codes(head, HEAD, hashes, learned.astype(np.int32) + HEAD + UNITS)
        end = CLASSES
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                code = codes.of(words)
                chain = np.concatenate([[end], classes[code], [end]])
                seen = code < HEAD
                known = code[seen]
                base = base_of[known].sum() + end_base
                value = model_of[known].sum() + transitions[chain[:-1], chain[1:]].sum()
                others = np.flatnonzero(~seen).tolist()
                rare = Counter([words[i] for i in others])
                class_of = {words[i]: int(classes[code[i]]) for i in others}
                # No word has a space, so this key meets nothing and each text has its own.
                keys = [b" " + rid.to_bytes(8, "little"), *rare]
                k = len(rare)
                out[0] += [rid] * (k + 1)
                out[1] += [name] + [None] * k
                out[2] += keys
                out[3] += [0, *rare.values()]
                out[4] += [0, *map(class_of.get, rare)]
                out[5] += [float(base)] + [0.0] * k
                out[6] += [float(value)] + [0.0] * k
                out[7] += [len(words) + 1] + [0] * k
                out[8] += [int(seen.sum()) + end_known] + [0] * k
                rid += 1
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["rid", "doc_id", "word", "tf", "class", "base", "model", "n_tokens", "n_known"])

    rows = runtime.docs_of(docs).mapInArrow(run, schema).join(model.vocabulary, "word", "left")
    per_class = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("class"))
    count = F.coalesce("n", F.lit(0)).cast("double")
    tokens, types = float(model.train_tokens), float(model.types)
    base = F.col("base") + F.col("tf") * F.log10((count + 1) / (tokens + types + 1))
    inside = F.when(F.col("n") > 0, F.log10((count - per_class(model.class_discount)) / per_class(model.class_tokens))).otherwise(per_class(model.class_unseen))
    value = F.col("model") + F.when(F.col("tf") > 0, F.col("tf") * inside).otherwise(0.0)
    known = F.col("n_known") + F.when(F.col("n") > 0, F.col("tf")).otherwise(0)
    out = rows.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(base).alias("base_score"), F.sum(value).alias("score"))
    return out.select(
        "doc_id",
        (runtime.fold_of(F.col("doc_id"), mod) == held_out).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def lm_scores(docs: DataFrame, mod: int = MOD, held_out: int = HELD_OUT) -> DataFrame:
    """Learns from the rows outside the held-out fold and scores all."""
    runtime.prepare(docs.sparkSession)
    train = docs.where(runtime.fold_of(F.col("doc_id").cast("long"), mod) != held_out)
    return score(docs, fit(train), mod, held_out)
