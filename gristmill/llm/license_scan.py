"""License scans: MinHash bands over overlapping windows [native].

Texts are words (A-Z lower-cased, runs of letters, digits and non-ASCII) and shingles of five words;
a template of fewer words is one shingle of its own length. A template of m distinct shingles is looked for in runs of up
to L = m + m div 4 shingles. Windows of W = L + S - 1 shingles start at every S-th one, S = max(1, L div 8), so that each such run lies whole in
one of them.

Retrieval: a window's sketch has ``BANDS`` bands of ``ROWS`` MinHash values over all its own shingles. A window that holds need = ceil(0.75 m)
of a template's shingles has a Jaccard similarity of at least j = need / (m + W - need) with it, so that at least one band is equal with a probability
of at least 1 - (1 - j ** ROWS) ** BANDS: j is 0.45 at least, which makes that 1 - 5e-7 (``collision_bound``). Band by band this would cost a
hash for each value, shingle and window; but a band can only be equal where the shingle that gives the
template its first value lies in the window. So texts are probed for these shingles (``BANDS`` at most a template), and only the windows around
a probe's hit compute their bands. The result is that of sketching every window and joining the bands, which a test checks.

Verification: a retrieved window matches if it holds at least ``CONTAINMENT`` of the template's distinct shingles, compared as words.

Templates are a parameter; they are broadcast in groups of at most ``GROUP_BYTES`` of text, one scan a group. Nulls: a null or
wordless text has no match. Rows are judged each, also where a doc_id repeats or is null; equal templates under
two names both match, and of equally good windows the first is reported. Texts are scanned whole; a hit carries its window's words, never its text. Empty tables and templates
without words give empty results. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialize
from gristmill.llm.decontam import words

K, CONTAINMENT, BANDS, ROWS = 5, 0.75, 64, 2
#: Bytes of template texts that are broadcast at once.
GROUP_BYTES = 4 << 20

#: Texts to find, as their licences have them: usual notices, and whole short licences.
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_TWO = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
BSD_THIRD = '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'
BSD_REST = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
UNLICENSE = 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": f"{BSD_TWO} {BSD_REST}",
    "bsd-3-clause": f"{BSD_TWO} {BSD_THIRD} {BSD_REST}",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": ISC,
    "mit": f"{MIT_GRANT} {MIT_REST}",
    "mit-grant": MIT_GRANT,
    "mit-line": "Released under the MIT license.",
    "unlicense-notice": UNLICENSE,
}


def geometry(m: int) -> tuple[int, int, int]:
    """need, step and width of windows for a template of m shingles."""
    run = m + m // 4
    step = max(1, run // 8)
    return math.ceil(CONTAINMENT * m), step, run + step - 1


def collision_bound(m: int, bands: int = BANDS, rows: int = ROWS) -> float:
    """The least probability that a window with need of m shingles shares a band with the template."""
    need, _, width = geometry(m)
    return 1 - (1 - (need / (m + width - need)) ** rows) ** bands


def value(band: Column | int, row: int, shingle: Column) -> Column:
    """What the row-th hash function of a band makes of a shingle's hash."""
    return F.xxhash64(band * F.lit(ROWS) + row, shingle)


def shingles_of(w: Column, k: Column | int) -> Column:
    """All shingles of an array of words, in order, as strings; words have no blanks."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))


def sketched(spark, templates: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(license, k, m, need, step, width, ts: distinct shingles, sketch: ROWS values a band) and the probes (h, k, license, bands)."""
    base = spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    base = base.withColumn("k", F.least(F.lit(K), F.size("w")))
    base = base.select("license", "k", F.array_distinct(shingles_of(F.col("w"), F.col("k"))).alias("ts"))
    hs = F.transform("ts", lambda s: hash_of_shingle(s))
    each = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array(*[F.array_min(F.transform("hs", lambda h: F.struct(value(b, r, h).alias("v"), h.alias("h")))) for r in range(ROWS)]))
    m = F.size("ts")
    run = (m + F.floor(m / 4)).cast("int")
    step = F.greatest(F.lit(1), F.floor(run / 8).cast("int"))
    base = base.withColumn("hs", hs).withColumn("e", each).select("license", "k", m.alias("m"), F.ceil(m * CONTAINMENT).cast("int").alias("need"), step.alias("step"), (run + step - 1).alias("width"), "ts", "e")
    base = materialize(base.withColumn("sketch", F.transform("e", lambda b: F.transform(b, lambda x: x["v"]))), "license-templates")
    probes = base.select("license", "k", F.posexplode("e").alias("band", "x")).groupBy(F.element_at("x", 1)["h"].alias("h"), "k", "license").agg(F.sort_array(F.collect_set("band")).alias("bands"))
    return base.drop("e"), materialize(probes, "license-probes")


def hash_of_shingle(s: Column) -> Column:
    """A shingle's hash from its words, as the scan makes it."""
    w = F.split(s, " ")
    return F.coalesce(*[F.when(F.size(w) == n, F.xxhash64(*[F.get(w, F.lit(i)) for i in range(n)])) for n in range(1, K + 1)])


def probed(documents: DataFrame, lengths: list[int], probes: DataFrame, base: DataFrame) -> DataFrame:
    """A row (row, doc_id, n, license, win, bands, ctx) for each window that holds a probe's shingle: bands that it may share, and its words."""
    docs = documents.select("doc_id", words(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    # explode_outer: explode would add a filter that splits the text a second time
    at = docs.select("row", "doc_id", "w", F.explode_outer(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))).alias("at"))
    each = [F.when(F.col("at") + n <= F.size("w"), F.struct(F.lit(n).alias("k"), F.xxhash64(*[F.get("w", F.col("at") + j) for j in range(n)]).alias("h"))) for n in lengths]
    grams = at.select("row", "doc_id", "at", "w", *([each[0].alias("g")] if len(each) == 1 else [F.explode(F.array(*each)).alias("g")])).select("row", "doc_id", "at", "w", "g.k", "g.h")
    met = grams.join(F.broadcast(probes), ["h", "k"]).join(F.broadcast(base.select("license", "step", "width")), "license")
    wins = F.expr("sequence(int(greatest(0, (at - width + step) div step)), int(at div step))")
    met = met.select("row", "doc_id", F.size("w").alias("n"), "license", "k", "step", "width", "bands", "w", F.explode(wins).alias("win"))
    met = met.select("row", "doc_id", "n", "license", "win", "bands", F.slice("w", (F.col("win") * F.col("step") + 1).cast("int"), F.col("width") + F.col("k") - 1).alias("ctx"))
    return met.groupBy("row", "license", "win").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("bands"))).alias("bands"), F.first("ctx").alias("ctx"))


def retrieved(windows: DataFrame, base: DataFrame) -> DataFrame:
    """Of the probed windows those with an equal band; with cs, their shingles, and the template's columns."""
    rows = windows.join(F.broadcast(base), "license").withColumn("cs", shingles_of(F.col("ctx"), F.col("k")))
    rows = rows.withColumn("ch", F.transform("cs", hash_of_shingle))

    def equal(b: Column) -> Column:
        want, out = F.element_at("sketch", b + 1), F.lit(True)
        for r in range(ROWS):
            out = out & (F.array_min(F.transform("ch", lambda h: value(b, r, h))) == F.element_at(want, r + 1))
        return out

    return rows.where(F.exists("bands", equal))


def scan_group(documents: DataFrame, templates: dict[str, str]) -> DataFrame:
    base, probes = sketched(documents.sparkSession, templates)
    lengths = sorted(r["k"] for r in base.select("k").distinct().collect()) or [K]  # five at most
    found = retrieved(probed(documents, lengths, probes, base), base).withColumn("matched", F.size(F.array_intersect("cs", "ts"))).where("matched >= need")
    # the best window is the one with the most shingles, the first of those
    best = F.min(F.struct((-F.col("matched")).alias("x"), (F.col("win") * F.col("step")).alias("lo"), F.least(F.col("win") * F.col("step") + F.col("width") + F.col("k") - 1, F.col("n")).alias("hi"), "m"))
    per = found.groupBy("row", "license").agg(F.max("doc_id").alias("doc_id"), best.alias("b"))
    return per.select("doc_id", "license", (-F.col("b.x")).cast("long").alias("matched"), F.col("b.m").cast("long").alias("total"), F.col("b.lo").cast("long").alias("word_from"), F.col("b.hi").cast("long").alias("word_to"))


def scan(documents: DataFrame, templates: dict[str, str] | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, license, matched and total (distinct shingles of the template, found and in all), word_from and word_to of the first best window."""
    templates = TEMPLATES if templates is None else templates
    groups: list[dict[str, str]] = [{}]
    for name, text in sorted(templates.items()):
        if groups[-1] and sum(map(len, groups[-1].values())) + len(text) > group_bytes:
            groups.append({})
        groups[-1][name] = text
    out = scan_group(documents, groups[0])
    for more in groups[1:]:
        out = out.unionByName(scan_group(documents, more))
    return out
