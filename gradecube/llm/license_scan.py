"""Operator 1: licence templates found by Dice coefficient over word bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices and headers by licence, then whole texts of short licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]
THRESHOLD = 0.8
#: Sizes just at a bound stay in despite rounding.
EDGE = 1e-9
#: The scan takes at most this many templates, as they are sent to every executor.
MOST_TEMPLATES = 5000


def normal_words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; all else parts words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(ws: Column) -> Column:
    """The distinct word bigrams of a word array; a single word stands for itself."""
    n = F.size(ws)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(F.get(ws, i), F.lit(" "), F.get(ws, i + 1)))
    return F.when(n >= 2, F.array_distinct(pairs)).when(n == 1, ws).otherwise(F.array().cast("array<string>"))


def size_bounds(size: int, threshold: float) -> tuple[float, float]:
    """Bigram set sizes that can reach the threshold against a template of this size: Dice is at most 2 min / (sum)."""
    return size * threshold / (2 - threshold) - EDGE, size * (2 - threshold) / threshold + EDGE


def template_sizes(templates: list[tuple[str, str]]) -> list[int]:
    import re

    out = []
    for _, text in templates:
        ws = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
        out.append(max(len({*zip(ws, ws[1:], strict=False)}), min(len(ws), 1)))
    return out


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every segment of a document that a licence template matches with a Dice coefficient of at least threshold.

    Segments are the lines, the paragraphs of several lines and the whole text, so that a notice is found on its
    own line, wrapped, or as a whole file. Input: doc_id, text; other columns are not read. Null and empty texts
    match nothing; empty tables give no rows; repeated rows each match. A segment that fits several templates of
    a licence has one row, with the best coefficient. Segments whose size rules out every template are dropped
    before their bigrams are made. Returns doc_id, license, segment (line number, from 0; the whole text is -1,
    paragraphs of several lines count down from -2), dice. A notice within a longer line or paragraph of other text is
    no segment of its own.
    """
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    spark = docs.sparkSession
    sizes = template_sizes(templates)
    bounds = [size_bounds(n, threshold) for n in sizes if n]
    low, high = min((b[0] for b in bounds), default=1), max((b[1] for b in bounds), default=0)
    t = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)] or [(0, "", "")], "template int, license string, ttext string")
    t = t.withColumn("_b", bigrams(normal_words(F.col("ttext")))).select("template", "license", F.size("_b").alias("tsize"), F.explode("_b").alias("gram"))

    text = F.coalesce(F.col("text"), F.lit(""))
    rid = F.monotonically_increasing_id()
    segment = lambda place, ws: F.struct(place.cast("int").alias("segment"), ws.alias("ws"))
    d = docs.select("doc_id", rid.alias("rid"), text.alias("text"))
    d = d.withColumn("_lines", F.transform(F.split("text", "\n"), normal_words))
    blocks = F.when(F.col("text").rlike("\n[ \t\r]*\n"), F.split("text", "\n[ \t\r]*\n"))
    d = d.withColumn("_blocks", F.coalesce(F.transform(F.filter(blocks, lambda b: F.trim(b).contains("\n")), normal_words), F.array().cast("array<array<string>>")))
    whole = F.when(F.size("_lines") > 1, F.array(segment(F.lit(-1), F.flatten("_lines")))).otherwise(F.array().cast("array<struct<segment:int,ws:array<string>>>"))
    segments = F.concat(F.transform("_lines", lambda ws, i: segment(i, ws)), F.transform("_blocks", lambda ws, i: segment(-2 - i, ws)), whole)
    # there are at least as many distinct bigrams as distinct words, less one
    fits = lambda x: (F.size(x["ws"]) > low) & (F.size(F.array_distinct(x["ws"])) <= high + 1)
    s = d.select("doc_id", "rid", F.inline(F.filter(segments, fits)))
    s = s.select("doc_id", "rid", "segment", bigrams(F.col("ws")).alias("_b")).where(F.size("_b").between(low, high))
    s = s.select("doc_id", "rid", "segment", F.size("_b").alias("size"), F.explode("_b").alias("gram"))
    hits = s.join(F.broadcast(t), "gram")  # at most MOST_TEMPLATES short texts
    hits = hits.where((F.col("size") * (2 - threshold) + EDGE >= F.col("tsize") * threshold) & (F.col("tsize") * (2 - threshold) + EDGE >= F.col("size") * threshold))
    shared = hits.groupBy("doc_id", "rid", "segment", "template", "license", "size", "tsize").agg(F.count("*").alias("both"))
    dice = 2.0 * F.col("both") / (F.col("size") + F.col("tsize"))
    return shared.select("doc_id", "rid", "segment", "license", dice.alias("dice")).where(F.col("dice") >= threshold).groupBy("doc_id", "rid", "segment", "license").agg(F.max("dice").alias("dice")).drop("rid")


def _oracle() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    ws = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')".format
    grams = "CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END"
    low = min(size_bounds(n, THRESHOLD)[0] for n in template_sizes(TEMPLATES))
    high = max(size_bounds(n, THRESHOLD)[1] for n in template_sizes(TEMPLATES))
    return rf"""
WITH t0 AS (SELECT * FROM (VALUES {rows}) AS v(template, license, ttext)),
t1 AS (SELECT template, license, {ws("ttext")} AS ws FROM t0),
t AS (SELECT template, license, {grams} AS b FROM t1),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS seg, unnest(range(0, len(string_split(text, chr(10))))) AS segment FROM d),
p0 AS (SELECT rid, doc_id, list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda x: contains(trim(x), chr(10))) AS bs FROM d WHERE regexp_matches(text, '\n[ \t\r]*\n')),
p AS (SELECT rid, doc_id, unnest(bs) AS seg, -2 - unnest(range(0, len(bs))) AS segment FROM p0),
s0 AS (SELECT rid, doc_id, segment, {ws("seg")} AS ws FROM (SELECT * FROM l UNION ALL SELECT * FROM p UNION ALL SELECT rid, doc_id, text, -1 FROM d WHERE contains(text, chr(10)))),
s AS (SELECT rid, doc_id, segment, {grams} AS b FROM s0),
s2 AS (SELECT * FROM s WHERE len(b) BETWEEN {low} AND {high}),
h AS (SELECT rid, doc_id, segment, license, 2.0 * len(list_intersect(s2.b, t.b)) / (len(s2.b) + len(t.b)) AS dice FROM s2, t WHERE list_has_any(s2.b, t.b))
SELECT doc_id, segment::INT AS segment, license, max(dice)::DOUBLE AS dice FROM h WHERE dice >= {THRESHOLD} GROUP BY rid, doc_id, segment, license
"""


ORACLE = _oracle()
