"""Licence notices and texts by Dice coefficient of word bigrams, in DataFrame expressions alone.

A text is normalised to words, and its runs of words are compared with the templates as sets of word
bigrams. With sets of a and b bigrams, a coefficient of t needs a between b t / (2 - t) and b (2 - t) / t,
and as many of the template's: so the number of a template's bigrams that a text has at all rules most
templates out, and a run's size most runs, before sets are compared.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import keyed_text, read

LEAST = 0.8

#: Notices by which works name their licence. A name may have several.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
)


#: Whole licences that are short enough to be copied into works.
_PERMISSION = NOTICES[18][1]
_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
TEXTS: tuple[tuple[str, str], ...] = (
    ("BSD-2-Clause", f"{_CLAUSES[0]} {_CLAUSES[2]}"),
    ("BSD-3-Clause", " ".join(_CLAUSES)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", f"{_PERMISSION} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)
TEMPLATES = NOTICES + TEXTS


def template_bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def words(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " ")), " ")


def pairs(w: Column) -> Column:
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words, license, dice): runs of consecutive words, anywhere in a text and over its lines, that
    reach `least` with a template; of runs that overlap the likest, then the one with more of its template, then by name and place.

    No run is left out by its length. One that reaches `least` still does without a first or last bigram that is not the
    template's or that recurs in it, so those from a bigram of the template, before it recurs, to the first of another
    are all there are to try; of those that start alike the likest counts. Words count from 0 after normalisation. Null
    and empty texts match nothing. Repeated rows stay repeated, a null id stays null. templates is a fixed list, part of
    the plan. Empty in, empty out.
    """
    known = [(name, template_bigrams(text)) for name, text in templates]
    shape = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(len(b)).alias("n")) for name, b in known if b])
    every = F.array(*map(F.lit, sorted({x for _, b in known for x in b})))
    share = least / (2 - least)
    rows = keyed_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    # explode of one element: a generator's output is not evaluated again by what stands on it
    got = rows.select("row", "doc_id", F.explode(F.array(words(F.col("text")))).alias("w")).select("row", "doc_id", F.explode(F.array(pairs(F.col("w")))).alias("b"))
    got = got.select("row", "doc_id", "b", F.explode(F.array(F.array_intersect("b", every))).alias("present")).where(F.size("present") > 0)
    near = F.filter(shape, lambda t: F.size(F.array_intersect("present", t["bigrams"])) >= t["n"] * share - 1e-9)
    got = got.select("row", "doc_id", "b", F.explode(near).alias("t"))
    hits = F.filter(F.transform("b", lambda x, i: F.struct((i + 1).alias("at"), F.array_position("t.bigrams", x).alias("code"))), lambda h: h["code"] > 0)
    got = got.select("row", "doc_id", "b", "t", F.explode(F.array(hits)).alias("hits"))
    got = got.select("row", "doc_id", "b", "t", "hits", F.posexplode("hits").alias("k", "from"))
    again = F.array_position(F.transform(F.slice("hits", F.col("k") + 2, F.size("hits")), lambda h: h["code"]), F.col("from.code"))
    reach = F.slice("hits", F.col("k") + 1, F.when(again > 0, again.cast("int")).otherwise(F.size("hits")))
    got = got.select("row", "doc_id", "b", "t", "from", F.explode(F.array(reach)).alias("reach"))
    codes = F.transform("reach", lambda h: h["code"])
    ends = F.transform(F.filter(F.transform("reach", lambda h, i: F.struct(h["at"].alias("at"), (F.array_position(codes, h["code"]) == i + 1).alias("new"))), lambda h: h["new"]), lambda h: h["at"])
    got = got.select("row", "doc_id", "b", "t", "from", F.explode(F.array(ends)).alias("ends"))
    size = lambda end: F.size(F.array_distinct(F.slice("b", F.col("from.at"), end - F.col("from.at") + 1)))
    fewest = F.ceil(F.col("t.n") * share - 1e-9).cast("int")
    got = got.where(F.size("ends") >= fewest)
    # sets only grow with the end: one that is too large at the first end that can do rules its start out
    got = got.where(size(F.element_at("ends", fewest)) <= F.col("t.n") / share + 1e-9)
    runs = F.transform("ends", lambda end, i: F.when(i + 1 >= fewest, F.struct((-2.0 * (i + 1) / (size(end) + F.col("t.n"))).alias("minus"), (-(i + 1)).alias("fewer"), F.col("t.license").alias("license"), F.col("from.at").alias("lo"), end.alias("hi"))))
    got = got.select("row", "doc_id", F.explode(F.array(F.array_min(runs))).alias("run")).where(F.col("run.minus") <= F.lit(-least))
    ranked = got.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    # words lo to hi + 1 of each
    apart = lambda kept, x: ~F.exists(kept, lambda y: (y["lo"] <= x["hi"] + 1) & (x["lo"] <= y["hi"] + 1))
    kept = F.aggregate("runs", F.slice("runs", 1, 0), lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return ranked.select("doc_id", F.explode(kept).alias("r")).select("doc_id", (F.col("r.lo") - 1).alias("start_word"), (F.col("r.hi") - F.col("r.lo") + 2).cast("int").alias("n_words"), "r.license", (-F.col("r.minus")).alias("dice"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    values = ",\n".join("('{}', [{}])".format(name, ", ".join(f"'{x}'" for x in template_bigrams(text))) for name, text in TEMPLATES)
    share = LEAST / (2 - LEAST)
    return f"""
WITH RECURSIVE t(license, tb) AS (VALUES {values}),
g AS (SELECT row_number() OVER () AS tid, license, len(tb) AS n, unnest(tb) AS g FROM t),
b AS (
  SELECT r, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM (
    SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents)),
p AS (SELECT r, unnest(b) AS g, generate_subscripts(b, 1) AS pos FROM b),
h AS (  -- bigrams of a template, and where each stands before and again
  SELECT r, tid, license, n, g, pos, lag(pos) OVER (PARTITION BY r, tid, g ORDER BY pos) AS before, lead(pos) OVER (PARTITION BY r, tid, g ORDER BY pos) AS again
  FROM p JOIN g USING (g)),
few AS (SELECT r, tid FROM h GROUP BY r, tid, n HAVING count(DISTINCT g) >= n * {share} - 1e-9),
e AS (
  SELECT a.r, a.tid, a.license, a.n, a.pos AS lo, z.pos AS hi, row_number() OVER (PARTITION BY a.r, a.tid, a.pos ORDER BY z.pos) AS k
  FROM h a SEMI JOIN few ON a.r = few.r AND a.tid = few.tid
  JOIN h z ON a.r = z.r AND a.tid = z.tid AND z.pos >= a.pos AND z.pos < coalesce(a.again, z.pos + 1) AND coalesce(z.before, 0) < a.pos),
s AS (
  SELECT e.*, doc_id, 2.0 * k / (len(list_distinct(b[lo:hi])) + n) AS dice FROM e JOIN b USING (r) WHERE k >= n * {share} - 1e-9),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, k DESC, license, lo, hi) AS rk FROM s WHERE dice >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY r, tid, lo ORDER BY dice DESC, k DESC, hi) = 1),
kept AS (  -- in each round the likest of each text, and what does not overlap it goes on
  SELECT r, doc_id, rk, lo, hi, license, dice, first_value(rk) OVER w AS top, first_value(lo) OVER w AS a, first_value(hi) OVER w AS z
  FROM runs WINDOW w AS (PARTITION BY r ORDER BY rk)
  UNION ALL
  SELECT r, doc_id, rk, lo, hi, license, dice, first_value(rk) OVER w, first_value(lo) OVER w, first_value(hi) OVER w
  FROM kept WHERE lo > z + 1 OR a > hi + 1 WINDOW w AS (PARTITION BY r ORDER BY rk))
SELECT doc_id, CAST(lo - 1 AS INTEGER) AS start_word, CAST(hi - lo + 2 AS INTEGER) AS n_words, license, CAST(dice AS DOUBLE) AS dice FROM kept WHERE rk = top
"""


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE = {"op10_license_scan": _oracle()}
