"""Licence scan: texts against licence templates by the Dice coefficient of their word bigrams.

A text is lower-cased, and every run of other characters than letters, digits and line breaks
becomes one blank. Its lines, its paragraphs (between blank lines), runs of its lines and the whole of
it are held against the templates. With a least coefficient t, a template of b distinct bigrams can only
match a unit of a distinct bigrams if b t / (2 - t) <= a <= b (2 - t) / t; this bound is an equi-join on
the unit's size against a table that lists each template under all sizes it may match (a few
hundred rows, fixed by the templates and not by the data). The same bound says that a match holds
more than b t / (2 - t) of the template's bigrams; so some words can be named for each template
of which a match must hold one, and texts and units with none of them end at a substring search.

Runs of lines (that aren't blank) are looked for with long templates, LONG bigrams or more, so a licence of
several paragraphs is found inside a longer text, and a header with code directly below it. A text
whose bigrams hold too few of a template's has no run that matches it. In others one fold over the lines
keeps, for each of the template's bigrams, the run's start that its last occurrence allows. The best
run that ends at a line starts at one of those, as any line before it without a new bigram of the
template only adds others; so a line has few runs to be tried, and none whose shared bigrams alone
can't beat the best one so far. Work grows with lines times the template's size, whatever the lines repeat.
All of it is DataFrame functions.

Null, empty and one-word texts match nothing. Rows that share a doc_id are reported together, equal
units of one row once. Long texts and runs are read whole. Of a template's units the greatest coefficient is
given, ties are one. n_units counts lines, paragraphs and whole texts that match: 0 where only a run
of lines does. Only doc_id and text are read, so other columns may have any names. An empty table
gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

#: Short notices, headers and licences in full.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public "
        "domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
        "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
}

_OTHER = r"[^\p{L}\p{N}\n]+"


def _template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(b: int, least: float = LEAST) -> tuple[int, int]:
    """Sizes that a unit may have to reach `least` against b bigrams."""
    return max(1, math.ceil(b * least / (2 - least) - 1e-9)), math.floor(b * (2 - least) / least + 1e-9)


#: Letters of a word that is rare enough to search for; shorter ones serve only where a template has no other.
RARE = 7


def telling_words(templates: list[list[str]], least: float = LEAST) -> list[str]:
    """Words, few and long ones, of which every text that reaches `least` against some template holds one: the template's bigrams without them are too few."""
    out: list[str] = []
    for grams in templates:
        shared = math.ceil(len(grams) * least / (2 - least) - 1e-9)  # bigrams that a match has in common at least
        left = {g for g in grams if not set(g.split()) & set(out)}
        while len(left) >= max(1, shared):
            words = sorted({w for g in left for w in g.split()})
            best = max(words, key=lambda w: (min(len(w), RARE), sum(w in g.split() for g in left), w))
            out.append(best)
            left = {g for g in left if best not in g.split()}
    return out


def _words(unit: Column) -> Column:
    return F.filter(F.split(unit, " "), lambda w: w != "")


#: Bigrams from which a template is long: only long ones are looked for in runs of lines.
LONG = 40


def _known(templates: dict[str, str] | None) -> dict[str, list[str]]:
    return {k: g for k, v in (TEMPLATES if templates is None else templates).items() if (g := _template_bigrams(v))}


def run_words(known: dict[str, list[str]], least: float = LEAST) -> tuple[int, int]:
    """Fewest words of a run of lines that may match a long template, and half as many again as the most distinct bigrams: what the SQL form tries."""
    sizes = [bounds(len(g), least) for g in known.values() if len(g) >= LONG]
    return (min(lo for lo, _ in sizes) + 1, max(hi for _, hi in sizes) * 3 // 2) if sizes else (1, 0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: inside lambdas nothing else keeps it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bigrams(w: Column) -> Column:
    """The bigrams of an array of words, in order, repeats included."""
    return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def _best_run(lines: Column, grams: Column, all_bigrams: Column, least: float) -> Column:
    """The greatest coefficient of a run of `lines` (arrays of words) against `grams`, or 0; all_bigrams: those of all lines' words in order.

    The fold's state: words before this line, and before the line above; that line's last word; for each
    of grams the words before the latest line at which a run may start and still hold it, -1 for none.
    """
    b = F.size(grams)
    need = F.ceil(b * F.lit(least / (2 - least)) - 1e-9)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("above"), F.lit("").alias("word"), F.transform(grams, lambda g: F.lit(-1)).alias("last"), F.lit(0.0).cast("double").alias("best"))

    def step(state: Column, words: Column) -> Column:
        at, over = state["at"], F.concat(state["word"], F.lit(" "), F.element_at(words, 1))
        end = at + F.size(words)

        def moved(own: Column, crossed: Column) -> Column:
            return F.transform(F.arrays_zip(grams.alias("g"), state["last"].alias("x")), lambda z: F.when(F.array_contains(own, z["g"]), at).when(crossed & (z["g"] == over), F.greatest(z["x"], state["above"])).otherwise(z["x"]))

        def tried(last: Column) -> Column:
            def coefficient(best: Column, start: Column) -> Column:
                """The better of best and the run of the words from start to end."""

                def better(shared: Column) -> Column:
                    unit = F.size(F.array_distinct(F.slice(all_bigrams, start + 1, end - start - 1)))
                    return F.when((shared >= need) & (2.0 * shared / (b + shared) > best), F.greatest(best, 2.0 * shared / (b + unit))).otherwise(best)

                return _let(F.size(F.filter(last, lambda x: x >= start)), better)

            held = F.filter(last, lambda x: x >= 0)
            return F.when(F.size(held) >= need, F.aggregate(F.array_distinct(held), state["best"], coefficient)).otherwise(state["best"])

        def after(last: Column, best: Column) -> Column:
            return F.struct(end.alias("at"), at.alias("above"), F.element_at(words, -1).alias("word"), last.alias("last"), best.alias("best"))

        def with_own(own: Column) -> Column:
            def with_crossed(crossed: Column) -> Column:
                return F.when((F.size(own) > 0) | crossed, _let(moved(own, crossed), lambda last: after(last, tried(last)))).otherwise(after(state["last"], state["best"]))

            return _let(F.array_contains(grams, over), with_crossed)

        return _let(F.array_intersect(_bigrams(words), grams), with_own)

    return F.aggregate(lines, zero, step, lambda state: state["best"])


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """df with further columns: a generator of one row keeps what it makes from being worked out again inside each later lambda."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def run_matches(cut: DataFrame, known: dict[str, list[str]], least: float = LEAST) -> DataFrame:
    """doc_id, license, dice of the best run of lines for each long template; cut: doc_id and the cleaned text `plain`."""
    long = {k: g for k, g in known.items() if len(g) >= LONG}
    if not long:
        return cut.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("dice")).where("false")
    words = F.filter(F.transform(F.split("plain", "\n"), lambda x: F.filter(F.split(x, " "), lambda w: w != "")), lambda x: F.size(x) > 0)
    lines = _once(cut, lines=words)
    lines = _once(lines, bigrams=_bigrams(F.flatten("lines")))
    lines = _once(lines, different=F.array_distinct("bigrams"))
    table = F.from_json(F.lit(json.dumps([{"license": k, "grams": g} for k, g in long.items()])), "array<struct<license:string,grams:array<string>>>")
    held = F.filter(table, lambda t: F.size(F.array_intersect("different", t["grams"])) >= F.ceil(F.size(t["grams"]) * F.lit(least / (2 - least)) - 1e-9))
    each = lines.select("doc_id", "lines", "bigrams", F.explode(held).alias("t")).select("doc_id", "lines", "bigrams", "t.license", "t.grams")
    return _once(each, dice=_best_run(F.col("lines"), F.col("grams"), F.col("bigrams"), least)).select("doc_id", "license", "dice").where(F.col("dice") >= least)


def licences(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """One row per (document, template found): doc_id, license, dice (of its best unit), n_units (lines, paragraphs and whole texts that matched)."""
    spark = docs.sparkSession
    known = _known(templates)
    sized = [(n, k, g) for k, g in known.items() for n in range(bounds(len(g), least)[0], bounds(len(g), least)[1] + 1)]
    sizes = spark.createDataFrame(sized, "a int, license string, grams array<string>")
    words = telling_words(list(known.values()), least)
    long_words = telling_words([g for g in known.values() if len(g) >= LONG], least)
    any_of = lambda parts, text: reduce(or_, [F.contains(text, F.lit(w)) for w in parts], F.lit(False))
    spaced = lambda ws: [f" {w} " for w in ws]
    clean = lambda u: F.trim(F.regexp_replace(u, "[\n ]+", " "))
    low = _once(docs.select("doc_id", F.lower("text").alias("low")), text=F.col("low")).drop("low")
    cut = _once(low.where(any_of(words, F.col("text"))), plain=F.regexp_replace("text", _OTHER, " ")).drop("text")
    cut = _once(cut, flat=F.concat(F.lit(" "), F.translate("plain", "\n", " "), F.lit(" "))).where(any_of(spaced(words), F.col("flat")))
    units = F.concat(F.split("plain", "\n"), F.split("plain", r"\n *\n"), F.array("plain"))
    each = cut.select("doc_id", F.explode(F.array_distinct(F.transform(units, clean))).alias("unit")).where(any_of(spaced(words), F.concat(F.lit(" "), "unit", F.lit(" "))))
    grams = each.select("doc_id", F.array_distinct(_bigrams(_words(F.col("unit")))).alias("g")).where("size(g) > 0")
    near = grams.select("doc_id", "g", F.size("g").alias("a")).join(F.broadcast(sizes), "a")
    dice = F.lit(2.0) * F.size(F.array_intersect("g", "grams")) / (F.size("g") + F.size("grams"))
    found = near.select("doc_id", "license", dice.alias("dice"), F.lit(1).alias("unit")).where(F.col("dice") >= least)
    runs = run_matches(cut.where(any_of(spaced(long_words), F.col("flat"))), known, least).withColumn("unit", F.lit(0))
    return found.unionByName(runs).groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.sum("unit").alias("n_units"))


def licences_sql(least: float = LEAST) -> str:
    """The same in DuckDB's SQL, over documents; every run of lines is made there, of texts without a long template's word too."""
    known = _known(None)
    fewest, most = run_words(known, least)
    values = ", ".join(f"('{k}', [{', '.join(repr(x) for x in g)}], {bounds(len(g), least)[0]}, {bounds(len(g), least)[1]})" for k, g in known.items())
    telling = " OR ".join(f"contains(x, '{w}')" for w in telling_words([g for g in known.values() if len(g) >= LONG], least))
    return f"""
    WITH t(license, grams, lo, hi) AS (VALUES {values}),
    p AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS plain FROM documents),
    l AS (SELECT doc_id, list_filter(list_transform(string_split(plain, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM p),
    n AS (SELECT doc_id, lines, list_transform(lines, lambda x: len(string_split(x, ' '))) AS n, list_transform(lines, lambda x: {telling}) AS told FROM l),
    i AS (SELECT doc_id, lines, n, told, unnest(range(1, len(lines) + 1)) AS i FROM n WHERE list_bool_or(told)),
    j AS (SELECT doc_id, lines, n, told, i, unnest(range(i + 1, len(lines) + 1)) AS j FROM i),
    r AS (SELECT doc_id, array_to_string(lines[i:j], ' ') AS unit FROM j WHERE list_sum(n[i:j]) BETWEEN {fewest} AND {most} AND list_bool_or(told[i:j])),
    s AS (SELECT doc_id, unnest(list_transform(list_concat(list_concat(string_split(plain, chr(10)), regexp_split_to_array(plain, '\\n *\\n')), [plain]),
          lambda x: trim(regexp_replace(x, '[\\n ]+', ' ', 'g')))) AS unit FROM p WHERE plain <> ''),
    u AS (SELECT doc_id, unit, max(n) AS n FROM (SELECT doc_id, unit, 0 AS n FROM r UNION ALL SELECT doc_id, unit, 1 AS n FROM s) GROUP BY doc_id, unit),
    w AS (SELECT doc_id, n, string_split(unit, ' ') AS w FROM u WHERE unit LIKE '% %'),
    g AS (SELECT doc_id, n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
    d AS (SELECT doc_id, n, license, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM g JOIN t ON len(g) BETWEEN lo AND hi)
    SELECT doc_id, license, max(dice) AS dice, sum(n)::BIGINT AS n_units FROM d WHERE dice >= {least} GROUP BY doc_id, license"""
