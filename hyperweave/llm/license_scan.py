"""Licence notices by the Dice coefficient over word bigrams, in DataFrame functions only.

Words are runs of letters and digits in lower case. A text falls into segments, which end at line ends and at ``.``, ``!``, ``?`` or
``;`` before a space; a unit is any run of successive segments: a line, a sentence in a longer line, a notice wrapped over
several lines, a whole licence text. With n and m bigrams (repeats count), a Dice coefficient of t needs
t/(2-t) <= n/m <= (2-t)/t, so each template meets units of sizes within its own bounds only.

The same bound says how many of its m bigrams a unit must hold, t*m/(2-t), hence at least one of any few more than the rest.
Of these the ones with the longest words are taken, and a text that has none of those words is dropped before anything
else is done with it. A text that has too few bigrams of a template in all does not meet that template.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

THRESHOLD = 0.8
#: Up to so many templates are broadcast; more meet the texts in a shuffled join, with the same result.
MAX_TEMPLATES = 5_000
#: Up to so many words are looked for in each text before its bigrams are made; with more every text goes on.
MAX_ANCHORS = 2_000
_BREAK, _NOT_WORD = r"[.!?;] +", r"[^\p{L}\p{N}]+"

#: Short notices by which works name their licence.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Licence texts and file headers as they stand in works, without titles and copyright lines.
FULL_TEXTS = [
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-2.0-or-later",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    (
        "GPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    (
        "LGPL-3.0-or-later",
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    ),
    (
        "AGPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
]
TEMPLATES = NOTICES + FULL_TEXTS


def _words(text):
    return F.array_remove(F.split(F.lower(text), _NOT_WORD), "")


def template_bigrams(templates: DataFrame) -> DataFrame:
    """(license, text) -> template long, license, m, gram, k: the m bigrams of each template, each with its count k."""
    words = templates.where("license IS NOT NULL AND text IS NOT NULL").select("license", _words("text").alias("w")).distinct()
    words = words.where("size(w) > 1").withColumn("template", F.xxhash64("license", "w"))
    grams = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    return words.select("template", "license", (F.size("w") - 1).alias("m"), F.explode(grams).alias("gram")).groupBy("template", "license", "m", "gram").agg(F.count("*").cast("int").alias("k"))


def anchors(known: list, threshold: float) -> list[str]:
    """Words of which every text has at least one that holds a unit similar to one of the templates (rows of template_bigrams)."""
    of: dict[int, list] = {}
    for r in known:
        of.setdefault(r["template"], []).append(r)
    out = set()
    for rows in of.values():
        m = rows[0]["m"]
        spare = m - math.ceil(threshold * m / (2 - threshold) - 1e-9)
        for word, k in sorted(((max(r["gram"].split(" "), key=lambda w: (len(w), w)), r["k"]) for r in rows), key=lambda x: (-len(x[0]), x[0])):
            out.add(word)
            spare -= k
            if spare < 0:
                break
    return sorted(out)


def _text_bigrams(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text) -> doc_id, tag, i, gram, lo, hi, line, last: bigram i lies in the segments that take the words from lo up to hi."""
    segments = F.flatten(F.transform(F.split("text", "\n"), lambda l, n: F.transform(F.split(l, _BREAK), lambda s: F.struct(n.alias("line"), _words(s).alias("w")))))
    tokens = F.flatten(F.transform("segments", lambda g: F.transform(g["w"], lambda w, j: F.struct(w.alias("w"), g["line"].alias("line"), j.alias("j"), F.size(g["w"]).alias("n")))))
    t = docs.select("doc_id", "tag", segments.alias("segments")).select("doc_id", "tag", tokens.alias("t")).where("size(t) > 1")
    pair = lambda i, a, b: F.struct(i.alias("i"), F.concat_ws(" ", a["w"], b["w"]).alias("gram"), (i - a["j"]).alias("lo"), (i + 1 - b["j"] + b["n"]).alias("hi"), a["line"].alias("line"), b["line"].alias("last"))
    return t.select("doc_id", "tag", F.inline(F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda i: pair(i, F.col("t")[i], F.col("t")[i + 1]))))


def scan(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) and (license, text) -> doc_id, license, line, last_line, n_words, dice: units that reach ``threshold``.

    Units begin and end with a segment that holds a bigram of the template. Lines count from 0. Of units of one text that
    overlap and name the same licence, or take the same words, only the best is returned: the greatest dice, then the
    most words, then the first, then the least name. A licence may have several templates. Texts may be of any length.

    Null texts and units of fewer than two words match nothing; rows that repeat a doc_id (null, too) are judged on their
    own, but equal rows give their result only once. Null licence names or texts are ignored, templates of one word match
    nothing. Other columns of ``docs`` are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold lies in (0, 1]")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    eps = 1e-9
    t = template_bigrams(templates)
    texts = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tag"), "text")
    if t.select("template").distinct().limit(MAX_TEMPLATES + 1).count() <= MAX_TEMPLATES:
        known = t.collect()
        t = F.broadcast(docs.sparkSession.createDataFrame(known, t.schema))
        words = anchors(known, threshold)
        if len(words) <= MAX_ANCHORS:
            texts = texts.where(F.arrays_overlap(F.split(F.lower("text"), _NOT_WORD), F.array(*map(F.lit, words)).cast("array<string>")))
    hits = stored(_text_bigrams(texts).join(t, "gram").distinct(), "license-bigrams")
    key = ["doc_id", "tag", "template", "license", "m"]
    same = ["doc_id", "tag", "template"]

    # What a text holds of a template in all bounds what a unit of it can hold.
    held = hits.groupBy(*key, "gram", "k").agg(F.least("k", F.count("*")).alias("c")).groupBy(*key).agg(F.sum("c").alias("c"))
    able = held.where(F.col("c") + eps >= F.col("m") * low).select(*same)
    hits = hits.join(able, [hits[c].eqNullSafe(able[c]) for c in same], "left_semi")

    # A unit has at most m * high + 1 words, so it lies in one bucket of that width and the next.
    width = F.floor(F.col("m") * high).cast("int") + 2
    both = lambda at: F.explode(F.array(F.floor(at / width), F.floor(at / width) - 1)).alias("bucket")
    starts = hits.select(*key, "lo", "line", F.floor(F.col("lo") / width).alias("bucket")).distinct()
    ends = hits.select(*key, "hi", "last", both(F.col("hi") - 1)).distinct()
    near = lambda a, b, *more: [*(a[c].eqNullSafe(b[c]) for c in (*same, "bucket")), *more]
    n = F.col("hi") - F.col("lo") - 1
    units = starts.join(ends, near(starts, ends)).select(*(starts[c] for c in (*key, "lo", "line", "bucket")), "hi", "last")
    units = units.where((n + eps >= F.col("m") * low) & (n - eps <= F.col("m") * high))
    inside = hits.select(*same, "i", "gram", "k", both(F.col("i")))
    met = units.join(inside, near(units, inside, units["lo"] <= inside["i"], inside["i"] + 1 < units["hi"])).select(*(units[c] for c in (*key, "lo", "hi", "line", "last")), "gram", "k")
    common = met.groupBy(*key, "lo", "hi", "line", "last", "gram", "k").agg(F.least("k", F.count("*")).alias("c"))
    dice = common.groupBy(*key, "lo", "hi", "line", "last").agg(F.sum("c").alias("c")).withColumn("dice", 2.0 * F.col("c") / (n + F.col("m")))
    found = dice.where(F.col("dice") + eps >= threshold).groupBy("doc_id", "tag", "license", "lo", "hi", "line", "last").agg(F.max("dice").alias("dice"))
    found = stored(found, "license-units")

    widest = found.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 1
    rank = F.struct(-F.col("dice"), F.col("lo") - F.col("hi"), "lo", "license")
    ranked = found.select("*", rank.alias("rank"), F.explode(F.array_distinct(F.array(F.floor(F.col("lo") / widest), F.floor((F.col("hi") - 1) / widest)))).alias("bucket"))
    a, b = ranked.alias("a"), ranked.alias("b")
    clash = (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))) & (F.col("a.tag") == F.col("b.tag")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.lo") < F.col("b.hi")) & (F.col("b.lo") < F.col("a.hi"))
    alike = (F.col("a.license") == F.col("b.license")) | ((F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi")))
    beaten = a.join(b, clash & alike & (F.col("b.rank") < F.col("a.rank"))).select(*(F.col(f"a.{c}") for c in ("doc_id", "tag", "license", "lo", "hi"))).distinct()
    whole = ["doc_id", "tag", "license", "lo", "hi"]
    best = found.join(beaten, [found[c].eqNullSafe(beaten[c]) for c in whole], "left_anti")
    return best.select("doc_id", "license", "line", F.col("last").alias("last_line"), (F.col("hi") - F.col("lo")).alias("n_words"), "dice")


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"), default_templates(spark))


def _sql() -> str:
    """The same by all pairs of segments of one text that hold a bigram of a template, within the size bounds."""
    rows = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("'", "''") for x in t)) for i, t in enumerate(TEMPLATES))
    words = lambda x: rf"[w FOR w IN string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+') IF w <> '']"
    return rf"""
WITH tw AS (SELECT t, license, {words("text")} AS w FROM (VALUES {rows}) AS v(t, license, text)),
tg AS (
  SELECT t, license, m, gram, count(*) AS k FROM (SELECT t, license, len(w) - 1 AS m, unnest([w[i] || ' ' || w[i+1] FOR i IN range(1, len(w))]) AS gram FROM tw)
  GROUP BY ALL),
lines AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
parts AS (SELECT doc_id, line, unnest(range(0, len(ss))) AS s, unnest(ss) AS x FROM (SELECT doc_id, line, string_split_regex(l, '[.!?;] +') AS ss FROM lines)),
segs AS (SELECT doc_id, line, s, {words("x")} AS w FROM parts),
placed AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM segs WHERE len(w) > 0),
toks AS (SELECT doc_id, line, lo, lo + len(w) AS hi, lo + unnest(range(0, len(w))) AS i, unnest(w) AS w FROM placed),
grams AS (SELECT a.doc_id, a.i, a.w || ' ' || b.w AS gram, a.lo, b.hi, a.line, b.line AS last FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
hits AS (SELECT doc_id, i, t, license, m, k, gram, lo, hi, line, last FROM grams JOIN tg USING (gram)),
units AS (
  SELECT DISTINCT a.doc_id, a.t, a.license, a.m, a.lo, b.hi, a.line, b.last FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.t = b.t
  AND 3 * (b.hi - a.lo - 1) >= 2 * a.m AND 2 * (b.hi - a.lo - 1) <= 3 * a.m),
common AS (
  SELECT u.doc_id, u.t, u.license, u.m, u.lo, u.hi, u.line, u.last, h.gram, least(h.k, count(*)) AS c
  FROM units u JOIN hits h ON u.doc_id = h.doc_id AND u.t = h.t AND h.i >= u.lo AND h.i + 1 < u.hi
  GROUP BY u.doc_id, u.t, u.license, u.m, u.lo, u.hi, u.line, u.last, h.gram, h.k),
scored AS (SELECT doc_id, license, lo, hi, line, last, 2.0::DOUBLE * sum(c) / (hi - lo - 1 + m) AS dice FROM common GROUP BY doc_id, t, license, m, lo, hi, line, last),
found AS (SELECT doc_id, license, lo, hi, line, last, max(dice) AS dice FROM scored WHERE dice >= {THRESHOLD} GROUP BY ALL)
SELECT doc_id, license, CAST(line AS INTEGER) AS line, CAST(last AS INTEGER) AS last_line, CAST(hi - lo AS INTEGER) AS n_words, dice FROM found a
WHERE NOT EXISTS (
  SELECT 1 FROM found b WHERE a.doc_id = b.doc_id AND a.lo < b.hi AND b.lo < a.hi AND (a.license = b.license OR (a.lo = b.lo AND a.hi = b.hi))
  AND (-b.dice, b.lo - b.hi, b.lo, b.license) < (-a.dice, a.lo - a.hi, a.lo, a.license))
"""


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE_SQL = {"op5_license_scan": _sql()}
