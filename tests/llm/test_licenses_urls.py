import math

import pytest

from loomline.llm import licenses, urls

FILES = [
    (1, "proj/LICENSE", "Released under the MIT License."),
    (2, "proj/src/a.py", "print(1)"),
    (3, "proj/src/deep/b.py", "Licensed under the Apache License, Version 2.0.\n" + "some code of this file\n" * 20),
    (4, "proj/vendor/COPYING", "some other words first\n" * 20 + "This work is licensed under the GNU General Public License, version 3."),
    (5, "proj/vendor/lib/c.c", None),
    (6, "other/readme", "no such thing, but a license is mentioned"),
    (7, None, "x"),
    (8, "top", ""),
    (8, "top", ""),
]


def test_licenses(spark):
    df = spark.createDataFrame(FILES, "file_id long, path string, text string").selectExpr("*", "'x' AS row", "'x' AS license")
    got = {r.file_id: (r.license, r.found_as, r.inherited_from) for r in licenses.license_scan(df).collect()}
    assert got == {
        1: ("MIT", "file", None),
        2: ("MIT", "inherited", "proj/LICENSE"),
        3: ("Apache-2.0", "notice", None),
        4: ("GPL-3.0", "notice", None),
        5: ("GPL-3.0", "inherited", "proj/vendor/COPYING"),
        6: (None, None, None),
        7: (None, None, None),
        8: (None, None, None),
    }
    assert licenses.license_scan(df).count() == len(FILES)
    assert licenses.license_scan(df.limit(0)).count() == 0


def wrapped(name, mark, longest=70):
    """The longest template of that name as a wrapped comment above code."""
    import textwrap

    text = max((t for n, t in licenses.TEMPLATES if n == name), key=len)
    return "\n".join([f"{mark} Copyright 2020 Some Author", mark, *(f"{mark} {x}" for x in textwrap.wrap(text, longest)), "", *(f"call_{i}(value_{i}, other_{i})" for i in range(300))])


def test_wrapped_headers_above_code(spark):
    names = ["MIT", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0"]
    files = [(k * 10 + j, f"d{k}{j}/f", wrapped(n, mark)) for k, n in enumerate(names) for j, mark in enumerate(["#", "//", " *"])]
    files += [(900 + k, f"e{k}/f", "\n".join(["first_call(x)"] * 200) + "\n" + wrapped(n, "#", 50)) for k, n in enumerate(names)]  # not at the head
    files += [(1000 + k, f"g{k}/f", "/*\n" + wrapped(n, "").replace("\n\ncall_0", "\n*/\ncall_0")) for k, n in enumerate(names)]
    files += [(2000, "z/f", "import licenses\n" * 100)]
    got = {r.file_id: r.license for r in licenses.license_scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    want = {k * 10 + j: n for k, n in enumerate(names) for j in range(3)} | {b + k: n for k, n in enumerate(names) for b in (900, 1000)}
    assert got == want | {2000: None}


def test_head_comment(spark):
    texts = ["# a\n# b\n\ncode # c", "/* a\n b */ code", "#!/bin/sh\n# a\nx", "code", "", '"""a\nb"""\ncode', "// a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    from pyspark.sql import functions as F

    got = [r.w for r in rows.orderBy("i").select(licenses.terms(licenses.head_comment(F.col("t"))).alias("w")).collect()]
    assert got == [["a", "b"], ["a", "b"], ["bin", "sh", "a"], [], [], ["a", "b"], ["a"]]


def test_similar_notices_are_told_apart(spark):
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, (_, t) in enumerate(licenses.TEMPLATES)], "file_id long, path string, text string")
    got = {r.file_id: (r.license, r.similarity) for r in licenses.license_scan(df).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: n for i, (n, _) in enumerate(licenses.TEMPLATES)}
    assert all(math.isclose(s, 1, abs_tol=1e-6) for _, s in got.values())


def test_needed_terms_lose_nothing():
    vector = {"a": 0.8, "b": 0.5, "c": 0.3, "d": math.sqrt(1 - 0.98)}
    needed = licenses.needed_terms([vector], 0.6)
    rest = math.sqrt(sum(w * w for t, w in vector.items() if t not in needed))
    assert rest < 0.6 and "a" in needed


def test_no_cosine_above_the_bar_is_missed(spark):
    """Every line against every template, by hand."""
    import itertools
    import re
    from collections import Counter

    pool = ["licensed under the apache", "mit license", "work", "version 3", "public", "released", "cc by nc 4 0", "words"]
    texts = [" ".join(p) for p in itertools.permutations(pool, 3)][:120]
    df = spark.createDataFrame([(i, f"f{i}", t) for i, t in enumerate(texts)], "file_id long, path string, text string")
    got = {r.file_id: r.similarity for r in licenses.license_scan(df, least_file=2.0).collect()}
    names = {t for _, x in licenses.TEMPLATES for t in re.findall("[a-z0-9]+", x.lower())}
    sets = [set(t.split()) for t in texts]
    idf = {t: math.log((len(texts) + 1) / (sum(t in s for s in sets) + 1)) + 1 for t in names.union(*sets)}

    def unit(t):
        w = {k: n * idf[k] for k, n in Counter(re.findall("[a-z0-9]+", t.lower())).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {k: v / norm for k, v in w.items()}

    templates = [(n, unit(x)) for n, x in licenses.TEMPLATES]
    for i, t in enumerate(texts):
        v, by_name = unit(t), {}
        for n, u in templates:
            by_name[n] = max(by_name.get(n, 0), round(sum(w * u.get(k, 0) for k, w in v.items()), 7))
        first, second = sorted(by_name.values(), reverse=True)[:2]
        wanted = first >= licenses.LEAST_LINE - 1e-9 and first > second
        assert (got[i] is not None) == wanted and (got[i] is None or math.isclose(got[i], first, abs_tol=1e-6))


GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_versions_identifiers_and_short_texts(spark):
    code = "\n".join(f"call_{i}(value_{i})" for i in range(200))
    isc = next(t for n, t in licenses.TEMPLATES if n == "ISC" and len(t) > 200)
    texts = {
        1: (GPL3, "GPL-3.0"),
        2: (GPL3.replace("version 3", "version 2"), "GPL-2.0"),
        3: ("/*\n" + GPL3 + "*/\n" + code, "GPL-3.0"),
        4: ("// SPDX-License-Identifier: Apache-2.0\n" + code, "Apache-2.0"),
        5: ("# SPDX-License-Identifier: GPL-3.0-or-later\n" + code, "GPL-3.0"),
        6: ("ISC License\n\nCopyright (c) 2020 Someone\n\n" + isc, "ISC"),
        7: (next(t for n, t in licenses.TEMPLATES if n == "BSD-2-Clause" and len(t) > 200), "BSD-2-Clause"),
        8: ("MIT License\n\nCopyright (c) 2020 Someone\n\n" + max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len), "MIT"),
        9: (code, None),
    }
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, (t, _) in texts.items()], "file_id long, path string, text string")
    assert {r.file_id: r.license for r in licenses.license_scan(df).collect()} == {i: n for i, (_, n) in texts.items()}


@pytest.mark.parametrize("noun", ["library", "program"])
def test_versions_decide_within_a_family(spark, noun):
    """The standard header of each GNU license under either noun, above code."""
    code = "\n".join(f"call_{i}(value_{i})" for i in range(60))
    rows, want = [], {}
    for i, (name, full) in enumerate([("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License")]):
        for version in {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}[name]:
            key = 10 * i + len(rows)
            header = GPL3.replace("GNU General Public License", full).replace("version 3", f"version {version}").replace("program", noun)
            rows.append((key, f"d{key}/f", f"/*\n{header}*/\n{code}"))
            want[key] = f"{name}-{version if '.' in version else version + '.0'}"
    got = {r.file_id: r.license for r in licenses.license_scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == want


def test_inheritance_equals_brute_force(spark):
    """The nearest directory above with a license file, by walking up."""
    import random

    draw = random.Random(9)
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    files = []
    for i in range(300):
        folder = "/".join(draw.choice("abc") for _ in range(draw.randint(0, 4)))
        kind = draw.choice([None, None, None, None, None, *notices])
        files.append((i, (folder + "/" if folder else "") + f"f{i}", notices[kind] if kind else "some code", kind))
    stands = {}
    for i, path, _, kind in sorted(files, key=lambda f: f[1]):
        if kind:
            stands.setdefault(path.rpartition("/")[0], (kind, path))
    want = {}
    for i, path, _, kind in files:
        folder, found = path.rpartition("/")[0], None
        while found is None:
            found = stands.get(folder)
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        want[i] = (kind, None) if kind else (found or (None, None))
    df = spark.createDataFrame([f[:3] for f in files], "file_id long, path string, text string").repartition(3)
    assert {r.file_id: (r.license, r.inherited_from) for r in licenses.license_scan(df).collect()} == want


def test_odd_files(spark, odd):
    files = odd.selectExpr("doc_id AS file_id", "source || '/' || doc_id AS path", "text", "row", "term", "key", "n", "c")
    got = licenses.license_scan(files).collect()
    assert len(got) == odd.count() and {r.license for r in got} == {None}


PAGES = [
    (1, "HTTP://A.Example.NET/en/x?q#f", "<p>free bets cheap pills</p>"),
    (2, "https://b.example.net/de", None),
    (3, "x://example.com/de/1", "spam farm"),
    (4, "https://cheappills.example.com/en/5", ""),
    (5, None, None),
    (6, "no scheme", "x"),
    (7, "https://org/fr/", "x"),
    (8, "https://notnet/", "x"),
    (8, "https://notnet/", "x"),
    (9, "https://h.net", "x"),
    (10, "a://b://c/d#e", "x"),
]


def test_urls(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS row", "'x' AS host")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(df).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("b.example.net", "/de", "net/", "block")
    assert got[3] == ("example.com", "/de/1", "example.com/de/", "block")
    assert got[4][:3] == ("cheappills.example.com", "/en/5", None)
    assert got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None)
    assert got[7] == ("org", "/fr/", "org/fr/", "allow")
    assert got[8][2] is None and got[9][:3] == ("h.net", "", None)
    assert got[10][:2] == ("b:", "//c/d")
    assert urls.url_filter(df).count() == len(PAGES) and urls.url_filter(df.limit(0)).count() == 0


def exhaustive(part, known, unknown):
    """The best score over all ways to split."""
    if not part:
        return 0.0
    return max(known.get(part[:k], unknown - k * math.log(10)) + exhaustive(part[k:], known, unknown) for k in range(1, len(part) + 1))


def test_splits_against_all_splits():
    import random

    draw = random.Random(2)
    for _ in range(60):
        known = {"".join(draw.choice("ab") for _ in range(draw.randint(1, 4))): math.log(draw.random() / 10) for _ in range(6)}
        part = "".join(draw.choice("abc") for _ in range(draw.randint(1, 10)))
        words = urls.best_split(part, known, math.log(1e-4))
        assert "".join(words) == part
        assert math.isclose(sum(known.get(w, math.log(1e-4) - len(w) * math.log(10)) for w in words), exhaustive(part, known, math.log(1e-4)))
    assert urls.best_split("a" * 64, {"a": -0.1}, -9.0) == ["a" * 64]


def bayes(rows, html):
    """Verdicts and scores by the definitions, page by page."""
    import re
    from collections import Counter

    words = Counter(w for h in html for w in re.split("[^a-z]+", re.sub("<[^>]*>", " ", h or "").lower()) if w)
    total = sum(words.values())
    known = {w: math.log(n / total) for w, n in words.items()}
    split = lambda host: [w for p in re.split("[^a-z]+", host) if p for w in urls.best_split(p, known, math.log(10 / total))]
    path_words = lambda path: [w for w in re.split("[^a-z0]+", re.sub("[0-9]+", " 0 ", path.lower())) if w]
    seen = []
    for url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path, host = re.match("[^?#]*", rest[len(host) :])[0], host.lower()
        fit = None
        for rule, verdict in sorted(urls.RULES, key=lambda r: -len(r[0])):
            name, _, prefix = rule.partition("/")
            if fit is None and (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
                fit = (name, "/" + prefix, verdict)
        own, own_path = ".".join(host.split(".")[:-2]), "/".join(path.split("/")[2:])
        seen.append((fit and fit[2], [*("h:" + w for w in split(own)), *("p:" + w for w in path_words(own_path))]))
    count = {v: Counter(t for f, ts in seen if f == v for t in ts) for v in ("block", "allow")}
    pages = Counter(f for f, _ in seen)
    kinds = len(set().union(*count.values()))
    p = lambda t, v: math.log((count[v][t] + 1) / (sum(count[v].values()) + kinds + 1))
    out = []
    for fit, tokens in seen:
        score = math.log((pages["block"] + 1) / (pages["allow"] + 1)) + sum(p(t, "block") - p(t, "allow") for t in tokens)
        out.append((fit or ("block" if score > 0 and pages["block"] and pages["allow"] else "allow"), round(score, 6)))
    return out


def test_verdicts_equal_brute_force(spark):
    """Words of blocked hosts block other hosts; nothing but naive Bayes says so."""
    import random

    draw = random.Random(6)
    bad, good, ends = ["bets", "pills", "casino"], ["news", "books", "garden"], ["free", "cheap", "my", "the"]
    rows, html = [], []
    for i in range(400):
        word, end = draw.choice(bad if i % 2 else good), draw.choice(ends)
        site = draw.choice(["{}.other.net/x/", "{}.example.com/de/"] if i % 2 else ["{}.example.net/en/", "{}.some.org/fr/"]) if i % 5 else "{}.else.com/it/"
        rows.append("https://" + site.format(end + word) + str(i))
        html.append(f"<p>{word} {end} and {word}</p>")
    rows += [None, "x", "https://" + "z" * 5000 + ".com/" + "y/" * 5000, "https://cheappills.com"] * 2
    html += [None, "", "w" * 100_000, "a"] * 2
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(rows, html, strict=True))], "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id, r.verdict, round(r.score, 6)) for r in urls.url_filter(df).collect())
    assert [g[1:] for g in got] == bayes(rows, html)
    open_pages = [(i, g[1]) for i, g in enumerate(got) if i < 400 and i % 5 == 0]
    assert all((v == "block") == bool(i % 2) for i, v in open_pages) and len({v for _, v in open_pages}) == 2


def test_no_host_suffix_decides(spark):
    """Pages of hosts with the same words in front and the same paths get the same verdicts, whatever their domain."""
    words = ["news", "bets", "garden", "casino", "books", "pills", "m"]
    labelled = [(f"https://{w}.example.net/{'en' if i % 2 == 0 else 'de'}/a{i}", "") for i, w in enumerate(words[:6] * 9)]
    open_pages = [(f"https://{w}.{d}/it/x", "") for w in words for d in ("example.org", "example.com", "some.org")]
    rows = labelled + open_pages
    got = {r.page_id: r for r in urls.url_filter(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id int, url string, html string")).collect()}
    by_word = {}
    for i in range(len(labelled), len(rows)):
        assert got[i].rule is None
        by_word.setdefault(rows[i][0].split("://")[1].split(".")[0], set()).add((got[i].verdict, got[i].score))
    assert all(len(v) == 1 for v in by_word.values()) and {next(iter(v))[0] for v in by_word.values()} == {"allow", "block"}


def test_cross_scores_leave_the_own_fold_out(spark):
    """With labels that no token tells, held-out scores tell nothing; with labels that one tells, they do."""
    def auc(rows):
        bad, good = [r.score for r in rows if r.bad], [r.score for r in rows if not r.bad]
        return sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))

    for told in (False, True):
        pages = [(i, f"https://{'free' if told and i % 2 else 'plain'}x{chr(97 + i % 23)}.a.example.net/{'de' if i % 2 else 'en'}/p", "free plain") for i in range(300)]
        found = urls.cross_scores(urls.labelled_urls(spark.createDataFrame(pages, "page_id int, url string, html string"))).collect()
        assert len(found) == 300 and (auc(found) > 0.95 if told else auc(found) < 0.65)


def test_odd_pages(spark, odd, none):
    pages = odd.selectExpr("doc_id AS page_id", "text AS url", "text AS html", "score", "label", "token", "row")
    got = urls.url_filter(pages).collect()
    assert len(got) == odd.count() and {r.host for r in got} == {""} and {r.verdict for r in got} == {"allow"}
    assert urls.url_filter(pages.limit(0)).count() == 0


def test_splits():
    known = {"free": math.log(0.1), "bets": math.log(0.1), "fre": math.log(0.01)}
    assert urls.best_split("freebets", known, math.log(1e-6)) == ["free", "bets"]
    assert urls.best_split("qqqq", known, math.log(1e-6)) == ["qqqq"]
    assert urls.best_split("", known, 0.0) == []
