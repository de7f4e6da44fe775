"""License scan (op9): sparse TF-IDF cosine to templates, then inheritance from the nearest directory; DataFrame functions only.

Notices (lines of a file, and runs of lines as long as a template), the comment at a file's head and whole files are
compared with templates. A text reaches a cosine of t only if it has one of a template's rarest terms, those without
which what is left of the template's vector is shorter than t (Cauchy-Schwarz); so only files with such a term are taken
apart, and into runs only where all their terms together are enough for the template. Document frequencies of all terms
are counted over all files. What is most similar decides, where a template of LONG_TEMPLATE terms counts a tenth more than a
short one, for it says more; a text just as near to templates of two licenses is no evidence of either. A file without a license of its own takes that of
the nearest directory above it that has a license file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Least cosine of a line or run of lines to a notice, and of a whole file or its head to a notice or a license text.
LEAST_LINE, LEAST_FILE = 0.75, 0.6
LONG_TEMPLATE = 200
# License notices and characteristic paragraphs of license texts, as their stewards publish them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "Copyright. All rights reserved. No part may be reproduced without permission."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License."),
    ("CC-BY-SA-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License."),
    ("CC-BY-NC-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License."),
    ("CC0-1.0", "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an owner) of an original work of authorship and/or a database (each, a Work)."),
]
# Fixed values, continued: the notices of the GNU licenses, which differ by name and version; lines of identifiers; short texts.
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the {name} for more details.
You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_GNU_NAMES = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_GNU_IDS = ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
# Every notice, whole and its first sentence, with either noun, so that among the licenses name and version alone decide.
TEMPLATES += [
    (i, text.replace("program", noun).format(name=_GNU_NAMES[i.partition("-")[0]], version=i.partition("-")[2].removesuffix(".0")))
    for i in _GNU_IDS
    for noun in ("program", "library")
    for text in (_GNU, _GNU.partition("\n")[0])
]
TEMPLATES += [("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1.")]
_SPDX = ["Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
TEMPLATES += [(i, f"SPDX-License-Identifier: {i}") for i in _SPDX]
TEMPLATES += [(i, f"SPDX-License-Identifier: {i}-{which}") for i in _GNU_IDS for which in ("only", "or-later")]
TEMPLATES += [
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
]
_GAP = r"[^a-z0-9]+"
_LINE_END = r"\r\n|\r|\n"
#: What a line of comment begins with, and a comment between marks, at the head of a file.
_COMMENT_LINE = r"^\s*(?:#|//|--|;|%|\*|/\*|rem\b|dnl\b|$)"
_COMMENT_BLOCK = r"\A\s*(?:#![^\r\n]*\s+)?(/\*[\s\S]*?\*/|<!--[\s\S]*?-->|\(\*[\s\S]*?\*\)|\{-[\s\S]*?-\}|\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})"


def terms(text: Column) -> Column:
    """Runs of a-z and 0-9 after lowering; signs between digits and letters part them."""
    inner = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[^a-z0-9]+|[^a-z0-9]+$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _GAP))


def _template_vectors(templates: list[tuple[str, str]], idf: dict[str, float]) -> list[dict[str, float]]:
    out = []
    for _, text in templates:
        tf = Counter(re.findall(r"[a-z0-9]+", text.lower()))
        weights = {t: n * idf[t] for t, n in tf.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        out.append({t: w / norm for t, w in weights.items()})
    return out


def needed_terms(vectors: list[dict[str, float]], least: float, idf: dict[str, float] | None = None) -> set[str]:
    """Terms one of which any text must have to reach the least cosine with a template; with idf the rarest, which the fewest texts have."""
    out: set[str] = set()
    for vector in vectors:
        rest = 1.0
        for term, weight in sorted(vector.items(), key=lambda x: (-idf[x[0]] if idf else 0, -x[1], x[0])):
            if rest < least * least - 1e-9:
                break
            out.add(term)
            rest -= weight * weight
    return out


def _best_template(units: DataFrame, keys: list[str], idf: DataFrame, weights: DataFrame, least: float) -> DataFrame:
    """keys, template, similarity of the nearest template of each unit (keys, words), where it is at least `least` and no other license's is as near."""
    tf = units.select(*keys, F.explode("words").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = runtime.join_bounded(tf, idf, ["term"], "inner").withColumn("w", F.col("tf") * F.col("idf"))
    norms = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(weights), "term").groupBy(*keys, "template").agg(F.first("name").alias("name"), F.sum(F.col("w") * F.col("weight")).alias("dot"))
    sims = dots.join(norms, keys).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("similarity") >= least)
    by_name = sims.groupBy(*keys, "name").agg(F.max(F.struct("similarity", (-F.col("template")).alias("t"))).alias("b"))
    best = by_name.groupBy(*keys).agg(F.sort_array(F.collect_list("b"), asc=False).alias("b"))  # a struct per license
    clear = (F.size("b") < 2) | (F.get("b", F.lit(0))["similarity"] > F.get("b", F.lit(1))["similarity"])
    return best.where(clear).select(*keys, (-F.get("b", F.lit(0))["t"]).alias("template"), F.get("b", F.lit(0))["similarity"].alias("similarity"))


def _any_of(words: set[str]) -> str:
    """A pattern of any of the words as a whole term, by first letters."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(words):
        by_first.setdefault(w[0], []).append(w[1:])
    return r"(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + r")(?![a-z0-9])"


def head_comment(text: Column) -> Column:
    """The comment that a file begins with: between marks, or else its first lines that are comments."""
    lines = F.split(text, _LINE_END)
    code = F.array_position(F.transform(lines, lambda x: F.lower(x).rlike(_COMMENT_LINE)), False).cast("int")
    block = F.regexp_extract(text, _COMMENT_BLOCK, 1)
    return F.when(block != "", block).otherwise(F.array_join(F.slice(lines, F.lit(1), F.when(code > 0, code - 1).otherwise(F.size(lines))), "\n"))


def _line_runs(some: DataFrame, weights: DataFrame, shapes: DataFrame, least: float) -> DataFrame:
    """row, line, last, words of runs of lines about as long as a template that the file has enough terms of.

    From every line: up to the line with the template's last word, one less and one more.
    """
    has = some.select("row", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(F.broadcast(weights), "term")
    near = has.groupBy("row", "template").agg(F.sum(F.col("weight") * F.col("weight")).alias("mass")).where(F.col("mass") >= least * least - 1e-9).select("row", "template")
    near = runtime.stored(near, "license-near")
    lines = F.filter(F.transform(F.split("text", _LINE_END), terms), lambda w: F.size(w) > 0)
    cut = runtime.join_bounded(some, near.select("row").distinct(), ["row"], "left_semi").select("row", lines.alias("lines")).where(F.size("lines") > 1)
    cut = cut.select("row", F.flatten("lines").alias("words"), F.flatten(F.transform("lines", lambda w, k: F.array_repeat(k, F.size(w)))).alias("line"))
    # Stored between the steps, for an expression inside a function of elements is evaluated for each element.
    cut = runtime.stored(cut, "license-words")
    n = F.size("words")
    ends = F.filter(F.sequence(F.lit(1), n), lambda p: (p == n) | (F.get("line", p) != F.get("line", p - 1)))
    cut = runtime.stored(cut.select("*", ends.alias("ends")), "license-lines")

    def from_line(k: Column) -> Column:
        start = F.coalesce(F.get("ends", k - 1), F.lit(0))
        last = F.get("line", F.least(start + F.col("length"), n) - 1)
        lasts = F.filter(F.sequence(last - 1, last + 1), lambda j: (j > k) & (j < F.size("ends")))
        return F.transform(lasts, lambda j: F.struct(k.alias("line"), j.alias("last"), F.slice("words", start + 1, F.get("ends", j) - start).alias("words")))

    runs = F.flatten(F.transform("ends", lambda _, k: F.filter(from_line(k), lambda r: F.arrays_overlap(r["words"], F.col("needed")))))
    units = runtime.join_bounded(near.join(F.broadcast(shapes), "template"), cut, ["row"], "inner", limit=0).select("row", F.explode(runs).alias("r"))
    return units.groupBy("row", "r.line", "r.last").agg(F.first("r.words").alias("words"))


def license_scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, least_line: float = LEAST_LINE, least_file: float = LEAST_FILE) -> DataFrame:
    """files (file_id, path, text) to file_id, path, license, similarity, found_as, inherited_from.

    found_as: file (the whole text is a license or notice), notice (a line, run of lines or its head is) or inherited. A file named like
    a license or whose whole text is one stands for its directory; of several the most similar does, then the least
    path. A NULL text is empty, a NULL path has no directory; rows that repeat a file_id or path are files of their own.
    """
    templates = TEMPLATES if templates is None else templates
    spark = files.sparkSession
    words = sorted({t for _, text in templates for t in re.findall(r"[a-z0-9]+", text.lower())})
    rows = files.select(F.col("file_id"), F.col("path").cast("string").alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # Document frequencies over all files: each file sends its distinct terms, which tasks add up before they shuffle.
    present = rows.select(F.explode(F.array_append(F.array_distinct(terms(F.col("text"))), F.lit(""))).alias("term"))
    frequencies = runtime.stored(present.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "license-frequencies")
    df = {r[0]: r[1] for r in frequencies.where(F.col("term").isin(["", *words])).collect()}  # a row per term of the templates
    n = df.pop("", 0)
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in words}
    vectors = _template_vectors(templates, idf)
    weights = spark.createDataFrame([(t, i, templates[i][0], w) for i, v in enumerate(vectors) for t, w in sorted(v.items())], "term string, template int, name string, weight double")
    needed = needed_terms(vectors, min(least_line, least_file), idf)
    pattern = _any_of(needed)
    # Without a needed term there is no license to find, so only these few files keep their text.
    some = rows.where(F.lower("text").rlike(pattern)).select("file_id", "path", "text")
    some = runtime.stored(some.withColumn("row", F.monotonically_increasing_id()), "license-candidates")
    # Inverse document frequencies of the terms that the candidates have.
    theirs = some.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
    log = F.log(F.lit(float(n + 1)) / (F.col("df") + 1)) + 1
    vocabulary = runtime.stored(frequencies.join(theirs, "term", "left_semi").select("term", log.alias("idf")), "license-idf")
    lines = some.select("row", F.posexplode(F.split("text", _LINE_END)).alias("line", "content"))
    lines = lines.where(F.lower("content").rlike(pattern)).select("row", "line", terms(F.col("content")).alias("words"))
    notices = _best_template(lines, ["row", "line"], vocabulary, weights, least_line)
    shapes = [(i, sum(1 for _ in re.finditer(r"[a-z0-9]+", text.lower())), sorted(needed_terms([v], least_line, idf))) for i, ((_, text), v) in enumerate(zip(templates, vectors, strict=True))]
    runs = _line_runs(some, weights, spark.createDataFrame(shapes, "template int, length int, needed array<string>"), least_line)
    runs = _best_template(runtime.stored(runs, "license-runs"), ["row", "line", "last"], vocabulary, weights, least_line)
    heads = _best_template(some.select("row", terms(head_comment(F.col("text"))).alias("words")), ["row"], vocabulary, weights, least_file)
    whole = _best_template(some.select("row", terms(F.col("text")).alias("words")), ["row"], vocabulary, weights, least_file)
    every = notices.unionByName(runs.drop("last")).unionByName(heads.withColumn("line", F.lit(0))).withColumn("whole", F.lit(False))
    every = every.unionByName(whole.select("row", F.lit(0).alias("line"), "template", "similarity", F.lit(True).alias("whole")))
    size_of = F.get(F.array(*[F.lit(length) for _, length, _ in shapes]), F.col("template"))
    name_of = F.get(F.array(*[F.lit(n) for n, _ in templates]), F.col("b.template"))
    order = F.struct((F.col("similarity") + 0.1 * F.least(F.lit(1.0), size_of / LONG_TEMPLATE)).alias("strength"), "similarity", "whole", (-F.col("line")).alias("l"), (-F.col("template")).alias("t"), "template")
    best = every.groupBy("row").agg(F.max(order).alias("b"), F.bool_or("whole").alias("is_file"))
    found = some.select("row", "file_id", "path").join(best, "row")
    found = runtime.stored(
        found.select("file_id", "path", name_of.alias("license"), F.col("b.similarity").alias("similarity"), F.when(F.col("is_file"), "file").otherwise("notice").alias("found_as")).distinct(),
        "licenses-found",
    )
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    stands = (F.col("found_as") == "file") | F.upper(base).rlike(r"^(LICEN[CS]E|COPYING|NOTICE|UNLICENSE)")
    by_folder = found.where(stands & F.col("path").isNotNull()).withColumn("folder", folder_of(F.col("path")))
    first = F.min_by(F.struct("license", "path"), F.struct(-F.col("similarity"), "path", "license")).alias("b")
    by_folder = by_folder.groupBy("folder").agg(first).select("folder", F.col("b.license").alias("folder_license"), F.col("b.path").alias("inherited_from"))
    by_folder = runtime.stored(by_folder, "license-folders")
    # Nearest above, per directory and not per file.
    folders = runtime.stored(rows.where(F.col("path").isNotNull()).groupBy(folder_of(F.col("path")).alias("own")).agg(F.count(F.lit(1)).alias("n_files")), "folders")
    above = folders.select("own", F.explode(ancestors(F.col("own"))).alias("folder"))
    near = runtime.join_bounded(above, by_folder, ["folder"], "inner").groupBy("own").agg(F.max_by(F.struct("folder_license", "inherited_from"), F.length("folder")).alias("b"))
    near = runtime.stored(folders.join(near, "own", "left").select("own", "n_files", F.col("b.folder_license").alias("folder_license"), F.col("b.inherited_from").alias("inherited_from")), "folder-licenses")
    slim = rows.select("file_id", "path").withColumn("own", folder_of(F.col("path")))
    out = runtime.join_by_frequency(slim, near, "own", "n_files", max(1, n), "left")
    own = found.groupBy(F.col("file_id").alias("f"), F.col("path").alias("p")).agg(F.max(F.struct("similarity", "license", "found_as")).alias("o"))
    out = runtime.join_bounded(out.withColumn("f", F.col("file_id")).withColumn("p", F.coalesce("path", F.lit(""))), own.withColumn("p", F.coalesce("p", F.lit(""))), ["f", "p"], "left")
    inherited = F.col("o").isNull() & F.col("folder_license").isNotNull()
    return out.select(
        "file_id",
        "path",
        F.coalesce(F.col("o.license"), F.col("folder_license")).alias("license"),
        F.col("o.similarity").alias("similarity"),
        F.when(inherited, "inherited").otherwise(F.col("o.found_as")).alias("found_as"),
        F.when(inherited, F.col("inherited_from")).alias("inherited_from"),
    )


def folder_of(path: Column) -> Column:
    """The directory of a path, '' at the top."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), r"/$", "")


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, '' last."""
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.array_distinct(F.concat(above, F.array(F.lit(""))))
