import math
import random

import pyarrow as pa
import pytest

from loomline.llm import graph, neardup

from tests.llm.conftest import ROWS


def sets(text, width=5):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if len(w) >= width else frozenset([tuple(w)])


def brute(rows):
    """Components by comparing every pair of texts."""
    shingles = [sets(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    out = []
    for i, (d, *_) in enumerate(rows):
        c = least.get(root(i)) if shingles[i] else d
        out.append((d, len(shingles[i]), c, d == c))
    return sorted(out, key=str)


def run(df):
    return sorted(map(tuple, neardup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_odd_rows(odd):
    assert run(odd) == brute(ROWS)


def test_empty(none):
    assert run(none) == []


@pytest.fixture(scope="module")
def copies():
    """A large group of near copies of many degrees, small groups, exact copies, a shared passage, and texts apart."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3, 5, 9])):
            w[draw.randrange(150)] = word()
        rows.append((len(rows) * 3, " ".join(w)))
    for _ in range(40):
        w = [word() for _ in range(draw.randint(5, 60))]
        for _ in range(draw.randint(1, 4)):
            v = list(w)
            v[draw.randrange(len(v))] = word()
            rows.append((len(rows) * 3, " ".join(draw.choice([w, v]))))
    for _ in range(60):
        rows.append((len(rows) * 3, " ".join(passage + [word() for _ in range(draw.randint(20, 80))])))
    rows += [(len(rows) * 3 + i, " ".join(base).upper()) for i in range(20)]
    draw.shuffle(rows)
    return rows


def test_large_groups_are_exact(spark, copies, monkeypatch):
    monkeypatch.setattr(neardup, "LONG_LIST", 16)
    monkeypatch.setattr(neardup, "BLOCK", 32)
    assert run(spark.createDataFrame(copies, "doc_id long, text string").repartition(5)) == brute(copies)


def _around(n, near, seed=5):
    """A base text, copies with words changed in near or one fewer places, so that they are near the bar, and a copy of one of those."""
    pick = random.Random(seed)
    base = [f"w{i}" for i in range(140)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        text = list(base)
        for j, k in enumerate(sorted(pick.sample(range(28), near if i % 3 else near - 1))):
            text[5 * k + 2] = f"new{i}x{j}"
        rows.append((i, " ".join(text)))
    return [*rows, (n, rows[1][1] + " one more word")]


def test_a_ball_of_near_copies_has_no_square_of_pairs(spark, monkeypatch):
    seen = []
    confirmed = neardup.confirmed

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(neardup, "confirmed", counted)
    made = []
    for n in (150, 300):
        seen.clear()
        rows = _around(n, 4)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert run(df) == brute(rows)
        made.append(sum(seen))
    assert made[1] < 3 * made[0] and made[1] < 10 * 300, made


def test_pivots_of_many_are_split(spark, copies, monkeypatch):
    """The wide joins beyond the broadcast limit, with every list and every key taken for a long one."""
    from loomline.llm import runtime

    salted = runtime.join_salted
    monkeypatch.setattr(neardup, "LONG_LIST", 8)
    monkeypatch.setattr(neardup, "WIDE_ROWS", 0)
    monkeypatch.setattr(runtime, "join_salted", lambda *a: salted(*a, cut=3))
    assert run(spark.createDataFrame(copies, "doc_id long, text string").repartition(3)) == brute(copies)


def test_heavy_classes_are_joined_by_broadcast(spark, copies, monkeypatch):
    monkeypatch.setattr("loomline.llm.runtime.HEAVY_SHARE", 10**9)
    rows = copies + [(10_000 + i, "one two three four five six") for i in range(1200)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("doc_id >= 10000").select("component_id").distinct().collect()[0][0] == 10_000
    assert got.where("kept").count() == sum(r[3] for r in brute(copies)) + 1


def test_drop_keeps_one_of_each(spark, odd, copies):
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 1, None, 5, 8, 12, 13], key=str)
    df = spark.createDataFrame(copies, "doc_id long, text string")
    assert neardup.drop_near_duplicates(df).count() == sum(r[3] for r in brute(copies))


def test_unlike_rows_of_one_id_stay(spark):
    """NULL and repeated ids: rows go by their own texts, not by their id."""
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(30)) for w in ("ab", "cd", "ef", "gh"))
    rows = [(1, one), (None, one), (None, two), (None, three), (4, four), (4, one + " end"), (4, four), (9, None), (9, None), (None, " "), (None, two)]
    got = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, one), (None, two), (None, three), (4, four), (9, None), (9, None), (None, " ")], key=repr)


def test_planted_pairs_are_all_found(spark):
    """A thousand pairs of Jaccard similarity from 0.85 to 0.95, all of unlike texts, and as many just below."""
    rows, want = [], 0
    for i in range(1000):
        words = [f"w{i}x{k}" for k in range(204)]
        fresh = 5 + i % 12  # the shingles that hold a new word at the end: fresh of 200
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 204 - fresh] + [f"v{i}x{k}" for k in range(fresh)]))]
        want += 100 * (200 - fresh) >= 85 * (200 + fresh)
        words = [f"y{i}x{k}" for k in range(204)]
        rows += [(10_000 + 2 * i, " ".join(words)), (10_001 + 2 * i, " ".join(words[:186] + [f"z{i}x{k}" for k in range(18)]))]  # 182/218
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).where("doc_id <> component_id").collect()
    assert len(got) == want == 1000 and all(r.doc_id == r.component_id + 1 and r.doc_id < 10_000 for r in got)


def test_thresholds():
    """The most matches that a pair at the threshold misses with a chance of at most a millionth."""
    for n in (64, 128):
        t = neardup.least_matches(0.85, n)
        below = [sum(math.comb(n, i) * 0.85**i * 0.15 ** (n - i) for i in range(k)) for k in (t, t + 1)]
        assert below[0] <= 1e-6 < below[1]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 600)], "a long, b long")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert set(roots.values()) == {0, 500} and len(roots) == 103


def test_workers_keep_no_hashes(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    assert len(neardup.sketches(docs).collect()) == 40

    def held(batches):
        from loomline.llm import neardup

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(neardup._sketchers)] * batch.num_rows, pa.int64())], ["n"])

    assert {r.n for r in spark.range(32, numPartitions=8).mapInArrow(held, "n long").collect()} == {0}


def test_tidy_ends_with_its_task():
    from loomline.llm import runtime

    ended = []
    assert list(runtime.tidy(lambda batches: (2 * b for b in batches), lambda: ended.append(1))(iter([1, 2]))) == [2, 4]
    assert ended == [1]
