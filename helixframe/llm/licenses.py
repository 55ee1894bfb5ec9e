"""License notices and license texts in documents, by MinHash bands over overlapping windows; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and usual wording of license notices, and the texts of short licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("BSD-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-later-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("MIT-license-notice", "Licensed under the MIT License."),
    ("BSD-license-notice", "Licensed under the BSD 3-Clause License."),
    ("LGPL-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("AGPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    ("EPL-2.0-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("CC0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-NC-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following.",
    ),
    (
        "Apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
)


@dataclass(frozen=True)
class LicenseOptions:
    """Windows are as long as the template, a quarter of it apart, so some window is within an eighth of any occurrence.

    Such a window and an unchanged template are at least 7/9 alike, and share one of 16
    bands of 2 hashes with probability 1 - 3e-7; at 0.6, which edits of a fifth leave, with
    1 - 8e-4.  ``containment`` is the share of a template's shingles to be found.  Texts are cut into
    segments of ``segment`` shingles with an overlap, which bounds what a row makes at once; ``library`` is the number
    of templates that one scan looks for.
    """

    shingle: int = 5
    bands: int = 16
    rows: int = 2
    containment: float = 0.8
    segment: int = 4096
    library: int = 2000


def _shingles(text: str, k: int) -> F.Column:
    """Hashes of the runs of k words in text order; words are runs of letters and digits in lower case."""
    clean = f"trim(regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"
    words = f"split({clean}, ' ')"
    run = ", ' ', ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return F.expr(f"aggregate(array({words}), cast(array() AS array<bigint>), (acc, w) -> if(size(w) < {k}, acc, transform(sequence(0, size(w) - {k}), i -> xxhash64(concat({run})))))")


def _least(window: str, o: LicenseOptions) -> str:
    """For each hash function the (hash, shingle) that is smallest in a window."""
    return f"transform(sequence(1, {o.bands * o.rows}), f -> array_min(transform({window}, h -> struct(xxhash64(h, f) AS x, h AS h))))"


def _signature(window: str, o: LicenseOptions) -> str:
    """Band keys of an array of shingle hashes."""
    least = f"transform(sequence(1, {o.bands * o.rows}), f -> array_min(transform({window}, h -> xxhash64(h, f))))"
    parts = ", ".join(f"m[b * {o.rows} + {r}]" for r in range(o.rows))
    return f"flatten(transform(array({least}), m -> transform(sequence(0, {o.bands - 1}), b -> xxhash64(b, {parts}))))"


def _templates(spark: SparkSession, templates: Sequence[tuple[str, str]], o: LicenseOptions) -> DataFrame:
    rows = spark.createDataFrame(list(templates), "license string, wording string")
    rows = rows.select("license", F.array_distinct(_shingles("wording", o.shingle)).alias("t")).where("size(t) > 0")
    return rows.select("license", "t", F.size("t").alias("n"), F.expr(_signature("t", o)).alias("bands"), F.expr(f"array_distinct(transform({_least('t', o)}, m -> m.h))").alias("sketch"))


def _scan(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, o: LicenseOptions) -> DataFrame:
    """(id, license, at, containment) of the windows whose bands meet those of a template of ``known`` and that confirm it."""
    listed = known.select("n", "sketch").collect()  # one row per template in the call
    # A window can share a band with a template only if it holds the smallest shingle of the template under the band's
    # hashes, so windows are made only where one of these (at most bands * rows a template, whatever its length) stands.
    marks = ", ".join(f"{h}L" for h in sorted({h for r in listed for h in r["sketch"]}))
    lengths = sorted({r["n"] for r in listed})
    reach = max(n + n // 4 + 1 for n in lengths)
    before = max(n // 4 + 1 for n in lengths)
    # One row each, behind a generator, so that the shingles are made once.
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.array(_shingles(f"cast(`{text_col}` AS string)", o.shingle))).alias("sh"))
    segments = f"transform(sequence(0, size(sh) - 1, {o.segment}), s -> struct(s AS from, greatest(s - {before}, 0) AS begin, size(sh) AS of, slice(sh, greatest(s - {before}, 0) + 1, least(s, {before}) + {o.segment} + {reach}) AS sh))"
    rows = rows.where("size(sh) > 0").select("id", F.explode(F.expr(segments)).alias("g")).select("id", "g.from", "g.begin", "g.of", F.col("g.sh").alias("sh"))
    hits = F.expr(f"filter(transform(sh, (h, i) -> if(h IN ({marks}), i + begin, -1)), i -> i >= 0)")
    rows = rows.select("*", F.explode(F.array(hits)).alias("hits")).where("size(hits) > 0")
    windows = []
    for n in lengths:
        step, last = max(1, n // 4), f"greatest(of - {n}, 0)"
        # Starts at multiples of the step, and at the end of the text, of windows that hold a hit and begin in this segment.
        first, final = f"cast(greatest(p - {n} + {step}, 0) div {step} AS int)", f"cast(p div {step} AS int)"
        starts = f"array_distinct(flatten(transform(hits, p -> transform(sequence({first}, {final}), k -> least(k * {step}, {last})))))"
        starts = f"array_union(filter({starts}, s -> s >= from AND s < from + {o.segment}), if({last} >= from AND {last} < from + {o.segment} AND exists(hits, p -> p >= {last}), array({last}), cast(array() AS array<int>)))"
        windows.append(f"transform({starts}, s -> struct({n} AS n, s AS at, slice(sh, s - begin + 1, {n}) AS win, slice(sh, greatest(s - {step}, begin) - begin + 1, least(s - begin, {step}) + {n} + {step}) AS wide))")
    windows = rows.select("id", F.explode(F.expr(f"flatten(array({', '.join(windows)}))")).alias("x")).select("id", "x.n", "x.at", "x.win", "x.wide")
    banded = windows.select("id", "n", "at", "wide", F.explode(F.expr(_signature("win", o))).alias("key"))
    keys = known.select("license", "n", "t", F.explode("bands").alias("key"))
    met = banded.join(F.broadcast(keys), ["n", "key"]).select("id", "license", "at", (F.size(F.array_intersect("t", "wide")) / F.col("n")).alias("containment"))
    return met.where(F.col("containment") >= o.containment)


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", options: LicenseOptions | None = None) -> DataFrame:
    """One row per document and template found: ``doc_id, license, containment, first_word, windows``.

    ``containment`` is the largest share of the template's shingles in one place,
    ``first_word`` the word at which the first such window starts (from 0), ``windows`` how
    many windows confirmed it.  Only templates are broadcast, and they are a list in
    the call, of which one scan takes ``library`` at a time.

    Defined cases: a null or empty text, or one of fewer words than a shingle, has
    no notice; a template of fewer words is never found; repeated rows count as one
    document, with the windows of all of them; null ids are one document; texts
    are read whole, in segments; other columns are not read; an empty table gives an empty one.
    """
    o = options or LicenseOptions()
    out = docs.select(F.col(id_col).alias("id"), F.lit("").alias("license"), F.lit(0).alias("at"), F.lit(0.0).alias("containment")).where(F.lit(False))
    for begin in range(0, len(templates), o.library):
        known = _templates(docs.sparkSession, templates[begin : begin + o.library], o)
        if known.limit(1).count():
            out = out.unionByName(_scan(docs, known, id_col, text_col, o))
    # Bands of one window that agree are one window.
    out = out.groupBy("id", "license", "at").agg(F.max("containment").alias("containment"))
    out = out.groupBy("id", "license").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word"), F.count("*").alias("windows"))
    return out.withColumnRenamed("id", id_col)
