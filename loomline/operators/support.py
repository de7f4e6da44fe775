"""What speaks for merging two topics: nine signals per candidate pair, counted and ranked.

A signal's facts come from a table of its own, joined on the pair or on one of its sides, or go with the vectors to where
the pairs are made; a fact that is missing supports nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import join_bounded, stored
from .neighbours import Pack, ranked_pairs, round6

# From where on a fact is a signal.
LEAST_PROFILE, LEAST_NARRATIVE, LEAST_TERMS, LEAST_YEARS, LEAST_CORRELATION, LEAST_POINTS = 0.65, 0.60, 2, 4, 0.30, 4

#: Cells of similarity in which a group's pairs are ranked.
CELLS = 64
#: Pairs that a task packs at once, and that it unpacks at once.
PACKED, UNPACKED = 1 << 18, 1 << 20
#: What is known of a topic besides its vector.
FACTS = ["narrative", "terms", "years", "strict", "same", "docs", "chunks", "above", "above_at"]
#: What measured pairs have besides their similarity and ranks.
MEASURED = "narrative_similarity double, term_count int, year_count int, doc_correlation double, chunk_correlation double, strict_partner_count int, same_issue_partner_count int, ancestor_distance double"


def measured_candidates(topics: DataFrame, within: list[str], key: str, vector: str, k: int, least: float) -> DataFrame:
    """within, a, b, similarity, rank_from_a, rank_from_b (NULL where not selected from there) and MEASURED, for pairs among the k nearest of a side or at least so similar.

    topics have, NULL or empty where unknown: narrative (a vector), terms, years, strict, same (arrays of different whole
    numbers), docs and chunks (arrays of a value per year, NULL where the topic has none), and above and above_at, the
    merges that hold the topic and their distances.
    """
    return ranked_pairs(topics, within, key, vector, k, least, facts=FACTS, prepare=_prepare, measure=_measure, schema=MEASURED)


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _filled(lists: pa.ListArray, fill: float, kind: type) -> np.ndarray:
    """A row per list, as wide as the longest; fill for what is not there."""
    lengths = _lengths(lists)
    out = np.full((len(lists), max(1, lengths.max(initial=0))), fill, kind)
    flat = lists.flatten()
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat.to_numpy(zero_copy_only=False) if flat.null_count == 0 else pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    return out


def _correlation(x: np.ndarray, y: np.ndarray) -> pa.Array:
    """Pearson's r of columns over the years of either side, absent ones as 0; NULL as in series_correlation."""
    there = ~(np.isnan(x) & np.isnan(y))
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    n = there.sum(0)
    spread = lambda v: np.where(there, v, np.inf).min(0) < np.where(there, v, -np.inf).max(0)
    varied = (n >= LEAST_POINTS) & spread(x) & spread(y)
    dx, dy = (np.where(there, v - v.sum(0) / np.maximum(n, 1), 0.0) for v in (x, y))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (dx * dy).sum(0) / np.sqrt((dx * dx).sum(0) * (dy * dy).sum(0))
    return pa.array(round6(np.where(varied, r, 0.0)), mask=~varied)


def _prepare(facts: pa.StructArray) -> dict[str, np.ndarray]:
    """The narratives, a row per topic; other facts as matrices of a column per topic, and the lengths of its sets."""
    by_topic = lambda name, fill, kind: np.ascontiguousarray(_filled(facts.field(name), fill, kind).T)
    out = {"narrative": _filled(facts.field("narrative"), np.nan, float), "above_at": by_topic("above_at", np.inf, float)} | {c: by_topic(c, np.nan, float) for c in ("docs", "chunks")}
    for c in ("terms", "years", "strict", "same", "above"):
        out[c], out[f"{c}_n"] = by_topic(c, 0, np.int64), _lengths(facts.field(c))
    return out


def _measure(a: dict[str, np.ndarray], b: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
    def met(name: str) -> Iterator[tuple[int, int, np.ndarray]]:
        """For each place in a's list and in b's, where the two values are the same."""
        lengths = a[f"{name}_n"][i], b[f"{name}_n"][j]
        x, y = (s[name][: n.max(initial=0)].take(at, axis=1) for s, at, n in ((a, i, lengths[0]), (b, j, lengths[1])))
        there = [np.arange(len(v))[:, None] < n for v, n in zip((x, y), lengths, strict=True)]
        for c in range(len(x)):
            for d in range(len(y)):
                yield c, d, (x[c] == y[d]) & there[0][c] & there[1][d]

    def shared_count(name: str) -> np.ndarray:
        count = np.zeros(len(i), np.int32)
        for _, _, same in met(name):
            count += same
        return count

    told = [s["narrative"][at] for s, at in ((a, i), (b, j))]
    wide = max(t.shape[1] for t in told)
    told = [t if t.shape[1] == wide else np.full((len(t), wide), np.nan) for t in told]
    narrative = (told[0] * told[1]).sum(1)
    series = {name: _correlation(*_as_wide(a[name].take(i, axis=1), b[name].take(j, axis=1))) for name in ("docs", "chunks")}
    nearest = np.full(len(i), np.inf)
    for c, d, same in met("above"):
        own, far = a["above_at"][c][i], b["above_at"][d][j]
        nearest = np.where(same & np.isfinite(own) & np.isfinite(far) & (own < nearest), own, nearest)
    return {
        "narrative_similarity": pa.array(round6(np.nan_to_num(narrative)), mask=np.isnan(narrative)),
        "term_count": shared_count("terms"),
        "year_count": shared_count("years"),
        "doc_correlation": series["docs"],
        "chunk_correlation": series["chunks"],
        "strict_partner_count": shared_count("strict"),
        "same_issue_partner_count": shared_count("same"),
        "ancestor_distance": pa.array(np.where(np.isfinite(nearest), nearest, 0.0), mask=~np.isfinite(nearest)),
    }


def _as_wide(*series: np.ndarray) -> list[np.ndarray]:
    """Series of as many years as the longest has; none is known of the years that are added."""
    most = max(map(len, series))
    return [v if len(v) == most else np.concatenate([v, np.full((most - len(v), v.shape[1]), np.nan)]) for v in series]


#: A pair in whole numbers, those that order it first; what is in millionths; and what stands for NULL.
WORDS = ["similarity", "narrative_similarity", "a", "b", "rank_from_a", "rank_from_b", "term_count", "year_count", "doc_correlation", "chunk_correlation", "strict_partner_count", "same_issue_partner_count", "ancestor_distance"]
MILLIONTHS = {"similarity", "narrative_similarity", "doc_correlation", "chunk_correlation"}
NONE = np.iinfo(np.int64).min


def _signals(of: dict[str, np.ndarray]) -> np.ndarray:
    """How many of the nine signals a pair has, from columns in which NULL is NaN or 0."""
    least = {"similarity": LEAST_PROFILE, "narrative_similarity": LEAST_NARRATIVE, "term_count": LEAST_TERMS, "year_count": LEAST_YEARS, "doc_correlation": LEAST_CORRELATION, "chunk_correlation": LEAST_CORRELATION, "strict_partner_count": 1, "same_issue_partner_count": 1}
    return sum(((of[c] >= bar).astype(np.int64) for c, bar in least.items()), (~np.isnan(of["ancestor_distance"])).astype(np.int64))


def _cells(signals: np.ndarray, similarity: np.ndarray, narrative: np.ndarray, cells: int) -> np.ndarray:
    """Cells that rise with the order of a group's pairs: of fewer signals, then of less similarity; copies are parted by their narrative."""
    one = 1_000_000
    told = np.where(narrative == NONE, 64, 63 - np.clip(narrative * 64 // one, 0, 63))
    within = np.where(similarity > one, 0, np.where(similarity == one, 1 + told, 66 + cells - 1 - np.clip(similarity * cells // one, 0, cells - 1)))
    return (9 - signals) * (cells + 66) + within


def _packer(pairs_at_once: int) -> Pack:
    def pack(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
        """_code, _before, _pairs: a strip's pairs, a cell at a time, as compressed words, and how many of them are before each cell."""
        cells = max(1, min(CELLS, n * n >> 14), n * n >> 23)
        counts = np.zeros(10 * (cells + 66), np.int64)

        def flushed(held: list[np.ndarray]) -> pa.RecordBatch:
            words = np.concatenate(held, axis=1)
            words = words[:, np.lexsort((-words[0], words[-1]))]
            begins = np.flatnonzero(np.diff(words[-1], prepend=-1))
            planes, ends = _planes(words[:-1]), [*begins[1:], words.shape[1]]
            return batch_of(words[-1][begins], None, [_pressed(planes[:, :, b:e]) for b, e in zip(begins, ends, strict=True)])

        def batch_of(codes: np.ndarray, before: np.ndarray | None, blobs: list[bytes] | None) -> pa.RecordBatch:
            columns = [pa.array(codes, pa.int32()), pa.nulls(len(codes), pa.int64()) if before is None else pa.array(before), pa.nulls(len(codes), pa.binary()) if blobs is None else pa.array(blobs, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["_code", "_before", "_pairs"])

        held, size = [], 0
        for batch in batches:
            of, words = {}, []
            for c in WORDS:
                v = batch.column(c)
                whole = pa.types.is_integer(v.type)
                of[c] = x = pc.fill_null(v, 0 if whole else np.nan).to_numpy(zero_copy_only=False)
                if c in MILLIONTHS:
                    words.append(np.where(np.isnan(x), NONE, np.rint(np.nan_to_num(x) * 1e6).astype(np.int64)))
                else:
                    words.append(x.astype(np.int64) if whole else x.astype(float).view(np.int64))
            code = _cells(_signals(of), words[0], words[1], cells)
            np.add.at(counts, code, 1)
            held.append(np.stack([*words, code]))
            size += len(code)
            if size >= pairs_at_once:
                yield flushed(held)
                held, size = [], 0
        if size:
            yield flushed(held)
        before = np.cumsum(counts) - counts
        codes = np.flatnonzero(before)
        yield batch_of(codes, before[codes], None)

    return pack


def _planes(words: np.ndarray) -> np.ndarray:
    """The bytes of words, the lowest ones of a column first."""
    return np.stack([(words >> 8 * k).astype(np.uint8) for k in range(8)], axis=1)


def _pressed(planes: np.ndarray) -> bytes:
    """The bytes of pairs, compressed, after how many pairs they are."""
    return planes.shape[2].to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpressed(blob: pa.Buffer) -> np.ndarray:
    n = int.from_bytes(blob[:8].to_pybytes(), "little")
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=n * len(WORDS) * 8, codec="zstd"), np.uint8).reshape(len(WORDS), 8, n)
    words = planes[:, 7].astype(np.int64)
    for k in range(6, -1, -1):
        words <<= 8
        words |= planes[:, k]
    return words


def _order(words: np.ndarray) -> np.ndarray:
    similarity, narrative, a, b = words[:4]
    return np.lexsort((b, a, np.where(narrative == NONE, np.iinfo(np.int64).max, -narrative), -similarity))


def _in_order(blobs: list[pa.Buffer], most: int) -> Iterator[np.ndarray]:
    """The pairs of a cell in order, about so many at once; what is more is unpacked again for each part."""
    total = sum(int.from_bytes(b[:8].to_pybytes(), "little") for b in blobs)
    if total <= most:
        words = np.concatenate([_unpressed(b) for b in blobs], axis=1)
        yield words[:, _order(words)]
        return
    step = max(1, most // 64)
    parts = np.concatenate([w[:, _order(w)][:, ::step] for w in map(_unpressed, blobs)], axis=1)
    parts = parts[:, _order(parts)]
    parts = parts[:, max(1, -(-parts.shape[1] * most // (2 * total))) - 1 :: max(1, parts.shape[1] * most // (2 * total))]

    def part(words: np.ndarray) -> np.ndarray:
        """How many of the parts' ends are before each pair."""
        n = parts.shape[1]
        order = _order(np.concatenate([parts[:4], words[:4]], axis=1))  # equal ones: the end comes first
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(order < n)
        return out[n:]

    for p in range(parts.shape[1] + 1):
        words = np.concatenate([w[:, part(w) == p] for w in map(_unpressed, blobs)], axis=1)
        yield words[:, _order(words)]


def ranked_candidates(topics: DataFrame, within: list[str], key: str, vector: str, k: int, least: float, packed: int = PACKED, unpacked: int = UNPACKED, **strips: int) -> DataFrame:
    """measured_candidates with hierarchical_found, support_signal_count and support_rank, as with_support ranks them.

    A pair is shuffled once, as a few compressed bytes, to the task of its cell of signals and similarity, and nothing of
    it is written. Each strip tells each cell how many of its pairs are before it, so a cell's task knows where it begins.
    """
    groups = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in topics.select(*within).schema)
    kind = topics.schema[key].dataType.simpleString()
    cells = ranked_pairs(topics, within, key, vector, k, least, facts=FACTS, prepare=_prepare, measure=_measure, schema="_code int, _before long, _pairs binary", pack=_packer(packed), **strips)
    names = ["a", "b", "similarity", "rank_from_a", "rank_from_b", *(c.split()[0] for c in MEASURED.split(", "))]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: list[pa.Scalar], code: int, before: int, blobs: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
            for words in _in_order(blobs, unpacked) if blobs else ():
                for begin in range(0, words.shape[1], PACKED):
                    of = dict(zip(WORDS, words[:, begin : begin + PACKED], strict=True))
                    n = len(of["a"])
                    columns = {}
                    for c in names:
                        if c in MILLIONTHS:
                            columns[c] = pa.array(of[c] / 1e6, mask=of[c] == NONE)
                        elif c == "ancestor_distance":
                            far = np.ascontiguousarray(of[c]).view(float)
                            columns[c] = pa.array(far, mask=np.isnan(far))
                        elif c in ("a", "b"):
                            columns[c] = pa.array(of[c], pa.int64() if kind == "bigint" else pa.int32())
                        else:
                            columns[c] = pa.array(of[c].astype(np.int32), mask=(of[c] == 0) if c.startswith("rank") else None)
                    columns["hierarchical_found"] = columns["ancestor_distance"].is_valid()
                    numbers = {c: pc.fill_null(v, np.nan if pa.types.is_floating(v.type) else 0).to_numpy(zero_copy_only=False) for c, v in columns.items() if c in WORDS}
                    columns["support_signal_count"] = pa.array(_signals(numbers).astype(np.int32))
                    columns["support_rank"] = pa.array(np.arange(before + 1, before + n + 1, dtype=np.int32))
                    before += n
                    yield pa.RecordBatch.from_arrays([*(pa.repeat(g, n) for g in group), *columns.values()], [*within, *columns])

        unit = state = None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: c[r] for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                group = [row[w] for w in within]
                if (now := (*(g.as_py() for g in group), row["_code"].as_py())) != unit:
                    if state:
                        yield from out(*state)
                    unit, state = now, [group, now[-1], 0, []]
                state[2] += row["_before"].as_py() or 0
                if row["_pairs"].is_valid:
                    state[3].append(row["_pairs"].as_buffer())
        if state:
            yield from out(*state)

    schema = f"{groups}, a {kind}, b {kind}, similarity double, rank_from_a int, rank_from_b int, {MEASURED}, hierarchical_found boolean, support_signal_count int, support_rank int"
    return cells.repartition(*within, "_code").sortWithinPartitions(*within, "_code").mapInArrow(rank, schema)


def shared(pairs: DataFrame, sets: DataFrame, within: list[str], key: str, column: str, name: str) -> DataFrame:
    """Adds name_count and name_jaccard (NULL if both are empty) of a set-valued column of both sides; a missing set is empty."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(sets.select(*within, F.col(key).alias(side), F.array_distinct(column).alias(f"_{side}")), [*within, side], "left")
    empty = F.array().cast(sets.schema[column].dataType)
    a, b = F.coalesce("_a", empty), F.coalesce("_b", empty)
    count = F.size(F.array_intersect(a, b))
    whole = F.size(F.array_union(a, b))
    return out.withColumns({f"{name}_count": count, f"{name}_jaccard": F.round(F.try_divide(count.cast("double"), whole.cast("double")), 6)}).drop("_a", "_b")


def series_correlation(pairs: DataFrame, series: DataFrame, within: list[str], key: str, values: list[str], least: int = LEAST_POINTS) -> DataFrame:
    """within, a, b and value_correlation for each value: Pearson's r over the years of either side, absent ones as 0.

    NULL with fewer than `least` years or a side without variation.
    """
    ends = pairs.select(*within, "a", "b")
    long = None
    for side, other in (("a", "b"), ("b", "a")):
        own = series.select(*within, F.col(key).alias(side), "year", *[F.col(v).alias(f"{v}_{side}") for v in values])
        rows = ends.join(own, [*within, side]).select(*within, "a", "b", "year", *[F.col(f"{v}_{side}") for v in values], *[F.lit(0.0).alias(f"{v}_{other}") for v in values])
        long = rows if long is None else long.unionByName(rows)
    years = long.groupBy(*within, "a", "b", "year").agg(*[F.sum(f"{v}_{s}").alias(f"{v}_{s}") for v in values for s in ("a", "b")])

    def r(v: str) -> Column:
        x, y = F.col(f"{v}_a"), F.col(f"{v}_b")
        varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)) & (F.count(F.lit(1)) >= least)
        return F.when(varied, F.round(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), 6)).alias(f"{v}_correlation")

    return years.groupBy(*within, "a", "b").agg(*[r(v) for v in values])


def with_support(pairs: DataFrame, within: list[str]) -> DataFrame:
    """support_signal_count over the nine signals, and the pair's place in its group by it, then by both similarities.

    pairs have similarity, narrative_similarity, term_count, year_count, doc_correlation, chunk_correlation,
    strict_partner_count, same_issue_partner_count and hierarchical_found.
    """
    signals = [
        F.col("similarity") >= LEAST_PROFILE,
        F.col("narrative_similarity") >= LEAST_NARRATIVE,
        F.col("term_count") >= LEAST_TERMS,
        F.col("year_count") >= LEAST_YEARS,
        F.col("doc_correlation") >= LEAST_CORRELATION,
        F.col("chunk_correlation") >= LEAST_CORRELATION,
        F.col("strict_partner_count") > 0,
        F.col("same_issue_partner_count") > 0,
        F.col("hierarchical_found"),
    ]
    count = sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0))
    # A group is ranked by cells of the first two keys, which rise with the order; a cell's place comes from how many there are.
    cell = [*within, "support_signal_count", "_cell"]
    rows = stored(pairs.withColumn("support_signal_count", count).withColumn("_cell", F.floor(F.col("similarity") * CELLS).cast("int")))
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy(F.desc("support_signal_count"), F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    begin = stored(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    order = [F.desc("similarity"), F.desc_nulls_last("narrative_similarity"), F.col("a"), F.col("b")]
    placed = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    return join_bounded(placed, begin, cell).withColumn("support_rank", (F.col("_before") + F.col("_own")).cast("int")).drop("_cell", "_own", "_before")
