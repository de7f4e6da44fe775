import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomline.llm import packing

from tests.llm.conftest import ROWS

PATH = public_tokenizers.path("word_bpe_49k.json")


def held(kinds):
    out = Counter()
    for inside, count in kinds:
        for length in inside:
            out[length] += count
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_all_and_are_tight(seed):
    draw = random.Random(seed)
    lengths = Counter(min(2048, max(1, int(draw.lognormvariate(5.5 + seed / 3, 1)))) for _ in range(4000))
    kinds = packing.plan_bins(lengths)
    assert all(sum(i) <= 2048 for i, _ in kinds) and held(kinds) == lengths
    least = -(-sum(k * v for k, v in lengths.items()) // 2048)
    over_half = sum(v for k, v in lengths.items() if k > 1024)
    assert sum(c for _, c in kinds) <= max(least * 1.02 + 1, over_half * 1.02 + 1)


def best_fit_decreasing(lengths):
    bins = packing._Bins(2048)
    for k in sorted(lengths, reverse=True):
        bins.best_fit(k, lengths[k])
    return sum(c for _, c in bins.kinds())


@pytest.mark.parametrize("seed", range(6))
def test_bins_come_from_configurations(seed):
    """Nine of ten large pieces stand in bins of the programme, in no more bins than best fit decreasing makes, but for two."""
    draw = random.Random(100 + seed)
    lengths = Counter(min(2048, max(1, int(draw.lognormvariate(5.5 + seed / 4, 0.9)))) for _ in range(6000))
    large = {k: v for k, v in lengths.items() if 512 < k < 2048}
    total, bins = sum(large.values()), packing._Bins(2048)
    packing._configured_bins(large, 2048, 32, bins)
    assert sum(large.values()) <= total / 10
    assert sum(c for _, c in packing.plan_bins(lengths)) <= best_fit_decreasing(lengths) + 2


def test_groups_have_equal_cardinality():
    lengths = {k: 3 for k in range(600, 1000)}
    sizes, demand = packing.group_sizes(lengths, 16)
    assert sizes == sorted(sizes, reverse=True) and sizes[0] == 999 and sum(demand) == 1200
    assert all(abs(d - 75) <= 3 for d in demand)
    assert packing.group_sizes({700: 50, 600: 2}, 4) == ([700], [52])


def test_few_sizes_are_packed_best():
    """Against every way to fill the bins, by search over counts of patterns."""
    import functools

    for lengths in ({1100: 3, 900: 4, 600: 5}, {700: 7, 680: 2}, {1024: 5, 683: 3, 600: 3}):
        sizes = sorted(lengths, reverse=True)

        @functools.cache
        def least(left):
            if not any(left):
                return 0
            best = 99
            first = next(i for i, n in enumerate(left) if n)

            def fill(i, room, now, used):
                nonlocal best
                if i == len(sizes):
                    if used[first]:
                        best = min(best, 1 + least(tuple(now)))
                    return
                for n in range(min(now[i], room // sizes[i]) + 1):
                    fill(i + 1, room - n * sizes[i], [*now[:i], now[i] - n, *now[i + 1 :]], [*used, n])

            fill(0, 2048, list(left), [])
            return best

        assert sum(c for _, c in packing.plan_bins(lengths)) <= least(tuple(lengths[s] for s in sizes)) + 1


def test_small_plans():
    assert packing.plan_bins({}) == []
    assert packing.plan_bins({2048: 3}) == [((2048,), 3)]
    assert sum(c for _, c in packing.plan_bins({1025: 5})) == 5
    assert sum(c for _, c in packing.plan_bins({1200: 4, 848: 4})) == 4
    with pytest.raises(ValueError):
        packing.plan_bins({0: 1})


def check(rows, docs):
    plain = Tokenizer.from_file(PATH)
    want = []
    for d, t in docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.append((d, k, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_documents(odd):
    check(packing.pack(odd.repartition(3), PATH).collect(), [(d, t) for d, t, *_ in ROWS])


def test_empty(none):
    assert packing.pack(none, PATH).count() == 0


def test_few_sequences(spark):
    draw = random.Random(4)
    docs = [(i, " ".join("word" for _ in range(draw.randint(1, 900)))) for i in range(300)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), PATH).collect()
    assert check(rows, docs) <= -(-sum(r.length for r in rows) // 2048) + 2
