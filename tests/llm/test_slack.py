import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomline.llm import slack

from tests.llm.conftest import ROWS

PATH = public_tokenizers.path("word_bpe_49k.json")


def sequences_of(rows):
    """Filled places of each sequence, rows of equal lengths apart."""
    out = defaultdict(list)
    for origin, rank, count, start, length, sequence, offset in rows.tolist():
        for k in range(count):
            out[sequence + k].append((offset, length, origin, rank + k, start))
    return out


def check_plan(lengths, capacity):
    rows = slack.plan_windows(lengths, capacity)
    held = defaultdict(list)
    padding = 0
    for places in sequences_of(rows).values():
        at = 0
        for offset, length, origin, rank, start in sorted(places):
            assert offset == at and length > 0
            at += length
            held[origin, rank].append((start, length))
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert Counter(k[0] for k in held) == Counter({k: v for k, v in lengths.items() if v})
    for (origin, _), parts in held.items():
        assert [s for s, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]] and sum(n for _, n in parts) == origin
    return padding, sum(len(p) - 1 for p in held.values()), len(sequences_of(rows))


@pytest.mark.parametrize("seed", range(8))
def test_plans_have_no_padding_and_few_cuts(seed):
    draw = random.Random(seed)
    lengths = Counter(min(4096, max(1, int(draw.lognormvariate(5 + seed / 3, 1)))) for _ in range(3000))
    padding, cuts, n = check_plan(lengths, 4096)
    assert padding == 0 and cuts <= 12 + n * 0.1


@pytest.mark.parametrize("lengths", [{3000: 1000}, {4096: 7}, {1: 5}, {2049: 3, 2047: 3}, {4095: 4096}, {1500: 10**9, 7: 10**6}, {}])
def test_hard_stocks(lengths):
    if sum(lengths.values()) > 10**6:
        rows = slack.plan_windows(lengths)
        assert len(rows) < 20_000 and int((rows[:, 2] * rows[:, 4]).sum()) == sum(k * v for k, v in lengths.items())
        return
    assert check_plan(lengths, 4096)[0] == 0


def brute_closest(counts, target):
    sums = {0}
    for length, count in counts.items():
        for _ in range(count):
            sums |= {s + length for s in sums if s + length <= target}
    return max(sums)


@pytest.mark.parametrize("seed", range(40))
def test_closest_sum_equals_brute_force(seed):
    draw = random.Random(seed)
    counts = Counter(draw.choices(range(1, 64), k=draw.randrange(12)))
    target = draw.randrange(64)
    taken = slack.Stock(counts, 64).closest(target)
    assert all(0 < k <= counts[length] for length, k in taken.items())
    assert sum(length * k for length, k in taken.items()) == brute_closest(counts, target)


def test_too_long_pieces_are_refused():
    with pytest.raises(ValueError):
        slack.plan_windows({4097: 1})


@pytest.mark.parametrize("capacity", [4096, 256])
def test_pack_holds_every_id_once(spark, odd, capacity):
    """Odd rows: NULLs, empty, very long and repeated ones, and clashing names; each id in exactly one piece, without gaps."""
    found = slack.pack(odd, PATH, capacity).collect()
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for name, text, _ in ROWS:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want[name, len(ids)] += 1
        whole = {"<4": ids}["<4"]
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in found if r.doc_id == name and r.doc_tokens == len(ids))
        for start, length, crc in pieces:
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *whole[start : start + length]))
    tokens = Counter()
    for r in found:
        tokens[r.doc_id, r.doc_tokens] += r.length
    assert tokens == Counter({k: k[1] * v for k, v in want.items()})
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0


def test_empty_table(none):
    assert slack.pack(none, PATH).count() == 0
