"""Licence scans: Dice coefficients over word bigrams against licence templates, in DataFrame functions."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence notices, by SPDX identifier and form.
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT/line": "Released under the MIT License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0/line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Proprietary/line": "All rights reserved.",
    "Apache-2.0/notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MIT/text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC/text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause/text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause/text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL-3.0/notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/.",
    "AGPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "Unlicense/text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org',
}
#: Least Dice coefficient, in hundredths.
PERCENT = 80


def normal_words(text: str) -> list[str]:
    """Lower-cased runs of ASCII letters and digits; any other character separates."""
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def size_bounds(n: int, percent: int) -> tuple[int, int]:
    """The least and most bigrams of a text that can reach the coefficient against n: 2 min(a, n) >= percent (a + n)."""
    return -(-percent * n // (200 - percent)), (200 - percent) * n // percent


def anchors(templates: dict[str, set[str]], percent: int) -> list[str]:
    """Words of which any text that reaches the coefficient has one: with a template of n bigrams it shares at
    least percent * n / (200 - percent), so words that touch all but fewer than that suffice. Rare words first."""
    out: set[str] = set()
    commonness = Counter(w for b in templates.values() for w in {x for g in b for x in g.split()})
    for b in templates.values():
        need = size_bounds(len(b), percent)[0]
        left = {g for g in b if not out & set(g.split())}
        while len(left) >= need:
            words = Counter(w for g in left for w in set(g.split()))
            w = max(words, key=lambda w: (len(w) > 3, words[w] / commonness[w], len(w), w))
            out.add(w)
            left = {g for g in left if w not in g.split()}
    return sorted(out)


def _words(text: Column) -> Column:
    """Normal words of a text: other characters go first, so that lower-casing meets ASCII only. (One predefined class
    and a replaced underscore: Java matches a class of several ranges ten times slower.)"""
    return F.array_remove(F.split(F.lower(F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), r"\W+", " ")), " "), "")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(doc_id, segment, license_id, bigrams, template_bigrams, shared, dice) of each line (segment from 1) and
    each whole text of more than one line (segment 0) that reaches the coefficient against a template.

    Texts without one of the anchor words cannot reach it and are left out before they are cut; lines then go by
    size bounds, on words first, and bigram sets are compared with the templates in bounds. Distinct bigrams count once. Null or
    empty texts and lines of fewer than two words match nothing; equal lines and repeated rows match each for
    itself; a line that reaches several templates gives a row for each. The templates are a literal table.
    """
    spark: SparkSession = docs.sparkSession
    sets = {k: bigrams(normal_words(v)) for k, v in templates.items()}
    sets = {k: b for k, b in sets.items() if b}
    if not sets:
        return spark.createDataFrame([], "doc_id bigint, segment int, license_id string, bigrams bigint, template_bigrams bigint, shared bigint, dice double")
    marks = anchors(sets, percent)
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(0).alias("segment"), _words(text).alias("w")))).otherwise(F.array().cast("array<struct<segment: int, w: array<string>>>"))
    each = F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("segment"), _words(x).alias("w")))
    low, high = zip(*(size_bounds(len(b), percent) for b in sets.values()), strict=True)
    found = lambda w: F.arrays_overlap(w, F.lit(marks))
    parts = docs.where(found(_words(F.col("text")))).select("doc_id", F.explode(F.concat(whole, each)).alias("s")).select("doc_id", "s.segment", "s.w")
    # A segment of w words has at most w - 1 bigrams, and shared ones need min(low) of them; d distinct words make d - 1 distinct bigrams at least.
    parts = parts.where((F.size("w") > min(low)) & found(F.col("w")) & (F.size(F.array_distinct("w")) <= max(high) + 1))
    more = F.greatest(F.size("w") - 1, F.lit(0))  # a filter above may run after this
    pairs = F.array_distinct(F.zip_with(F.slice("w", F.lit(1), more), F.slice("w", F.lit(2), more), lambda a, b: F.concat(a, F.lit(" "), b)))
    parts = parts.select("doc_id", "segment", pairs.alias("b")).where(F.size("b").between(min(low), max(high)))
    table = F.array(*(F.struct(F.lit(k).alias("id"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.lit(sorted(sets[k])).alias("b")) for k, lo, hi in zip(sets, low, high, strict=True)))
    fits = F.filter(table, lambda t: F.size("b").between(t["low"], t["high"]))
    got = F.transform(fits, lambda t: F.struct(t["id"].alias("license_id"), F.size(t["b"]).alias("n"), F.size(F.array_intersect("b", t["b"])).alias("shared")))
    parts = parts.select("doc_id", "segment", F.size("b").cast("long").alias("bigrams"), F.explode(got).alias("m"))
    parts = parts.select("doc_id", "segment", "m.license_id", "bigrams", F.col("m.n").cast("long").alias("template_bigrams"), F.col("m.shared").cast("long").alias("shared"))
    parts = parts.where(200 * F.col("shared") >= percent * (F.col("bigrams") + F.col("template_bigrams")))
    return parts.withColumn("dice", 2.0 * F.col("shared") / (F.col("bigrams") + F.col("template_bigrams")))


def runs(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(doc_id, start, words, license_id, bigrams, template_bigrams, shared, dice) of runs of consecutive words that
    reach the coefficient against a template, anywhere in a text: wrapped over lines or inside a line of prose.

    `start` is the run's first word, from 1. Candidates begin and end with a bigram of the template, since other ends
    only lower the coefficient, and have at most (200 - percent) / percent times its bigrams, repeats counted. Of
    candidates of one template that share a bigram's place the best stays, then the earliest, then the shortest.
    A text is judged against a template only if all of it has as many of the template's bigrams as a match needs.
    """
    spark: SparkSession = docs.sparkSession
    words = {k: normal_words(v) for k, v in templates.items()}
    sets = {k: bigrams(w) for k, w in words.items() if len(w) > 1}
    if not sets:
        return spark.createDataFrame([], "doc_id bigint, start int, words int, license_id string, bigrams bigint, template_bigrams bigint, shared bigint, dice double")
    one = lambda c, name: F.explode(F.array(c)).alias(name)  # noqa: E731  what it makes is made once
    d = docs.select("doc_id", one(_words(F.col("text")), "w")).where((F.size("w") > 1) & F.arrays_overlap("w", F.lit(anchors(sets, percent))))
    more = F.size("w") - 1
    d = d.select("doc_id", one(F.zip_with(F.slice("w", F.lit(1), F.greatest(more, F.lit(0))), F.slice("w", F.lit(2), F.greatest(more, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)), "g"))
    places = F.filter(F.transform("g", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].isin(sorted(set().union(*sets.values()))))
    d = d.select("doc_id", "g", one(places, "at")).where(F.size("at") >= min(size_bounds(len(b), percent)[0] for b in sets.values()))
    d = d.select("doc_id", "g", "at", one(F.array_distinct(F.transform("at", lambda p: p["x"])), "seen"))
    rows = [(k, sorted(b), len(b), size_bounds(len(b), percent)[0], size_bounds(len(words[k]) - 1, percent)[1]) for k, b in sets.items()]
    table = F.array(*(F.struct(F.lit(k).alias("id"), F.lit(b).alias("b"), F.lit(n).alias("n"), F.lit(need).alias("need"), F.lit(most).alias("most")) for k, b, n, need, most in rows))
    d = d.select("doc_id", "g", "at", F.explode(F.filter(table, lambda t: F.size(F.array_intersect("seen", t["b"])) >= t["need"])).alias("t"))
    d = d.select("doc_id", "g", "at", *(F.col(f"t.{c}").alias(c) for c in ("id", "b", "n", "need", "most")))
    d = d.select("doc_id", "g", "id", "b", "n", "need", "most", one(F.filter("at", lambda p: F.array_contains("b", p["x"])), "at"))
    ends = lambda p, j: F.filter(F.slice("at", j + F.col("need"), F.col("most")), lambda q: q["i"] - p["i"] < F.col("most"))
    pairs = F.flatten(F.transform("at", lambda p, j: F.transform(ends(p, j), lambda q: F.struct(p["i"].alias("a"), q["i"].alias("z")))))
    d = d.select("doc_id", "g", "id", "b", "n", one(pairs, "c"))
    run = lambda c: F.slice("g", c["a"] + 1, c["z"] - c["a"] + 1)
    sized = F.transform("c", lambda c: F.struct(c["a"].alias("a"), c["z"].alias("z"), F.size(F.array_distinct(run(c))).alias("bigrams"), F.size(F.array_intersect(run(c), F.col("b"))).alias("shared")))
    d = d.select("doc_id", "id", "n", one(sized, "c"))
    reach = F.filter("c", lambda c: 200 * c["shared"] >= percent * (c["bigrams"] + F.col("n")))
    keyed = F.transform(reach, lambda c: F.struct((-2.0 * c["shared"] / (c["bigrams"] + F.col("n"))).alias("rank"), c["a"].alias("a"), c["z"].alias("z"), c["bigrams"].alias("bigrams"), c["shared"].alias("shared")))
    d = d.select("doc_id", "id", "n", one(F.array_sort(keyed), "c"))
    best = F.aggregate("c", F.array().cast("array<struct<rank: double, a: int, z: int, bigrams: int, shared: int>>"), lambda kept, c: F.when(F.exists(kept, lambda k: (k["a"] <= c["z"]) & (c["a"] <= k["z"])), kept).otherwise(F.concat(kept, F.array(c))))
    d = d.select("doc_id", "id", "n", F.explode(best).alias("c"))
    return d.select("doc_id", (F.col("c.a") + 1).alias("start"), (F.col("c.z") - F.col("c.a") + 2).alias("words"), F.col("id").alias("license_id"), F.col("c.bigrams").cast("long").alias("bigrams"), F.col("n").cast("long").alias("template_bigrams"), F.col("c.shared").cast("long").alias("shared"), (-F.col("c.rank")).alias("dice"))
