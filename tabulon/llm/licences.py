"""License scans: units of normalised text against license templates, by Dice coefficient over word bigrams.

Units are the lines, sentences and paragraphs of a text, the text itself, and windows as long as a template over the
words of the whole text, wherever a line breaks, each against the templates of that length. A unit of a bigrams can reach the least
score with a template of b only if b * t / (2 - t) <= a <= b * (2 - t) / t, so sizes prune most templates. Texts are
pruned first, and exactly: a unit that reaches the score holds so many of a template's bigrams that it must hold one
out of any b - ceil(b * t / (2 - t)) + 1 of them; a text with none of those phrases has no such unit. The longest words
of the phrases are looked for first, among the words of the text. Bigrams are compared as 64-bit hashes of their words, so that arrays of
numbers meet and not of strings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.arrays import let
from tabulon.llm.common import table
from tabulon.llm.legalcodes import SECTIONS

LEAST = 0.8
# Short notices by SPDX identifier, as authors put them into documents.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "proprietary": ("All rights reserved.",),
}
# Full texts of short licences and file headers, a template a paragraph; the SQL knows the notices only.
PARAGRAPHS: Mapping[str, Sequence[str]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL-3.0": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
}
_KINDS = (TEMPLATES, SECTIONS, PARAGRAPHS)
ALL_TEMPLATES: Mapping[str, Sequence[str]] = {name: tuple(t for kind in _KINDS for t in kind.get(name, ())) for name in sorted({name for kind in _KINDS for name in kind})}
_BREAK = r"([.!?])\x20+"


def bigrams(text: str) -> list[str]:
    """Distinct bigrams of normalised words, in order."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:], strict=False)))


def normalised(text: Column) -> Column:
    """Letters and digits, lower-cased, with single spaces for everything else."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


#: Words too common to look for.
_COMMON = set("a an and any are as at be by can for in is it may no not of on or such that the this to under with you".split())


def _rarest(phrase: str) -> str:
    words = phrase.split()
    return max([w for w in words if w not in _COMMON] or words, key=len)


def _phrases(templates: Mapping[str, Sequence[str]], least: float) -> list[str]:
    """Bigrams of which a text with a hit has one: for each template, those with the longest uncommon words."""
    return list(dict.fromkeys(p for texts in templates.values() for t in texts for p in _anchors(bigrams(t), least)))


def _anchors(grams: Sequence[str], least: float) -> list[str]:
    needed = math.ceil(round(len(grams) * least / (2 - least), 9))
    return sorted(grams, key=lambda g: (-len(_rarest(g)), g))[: len(grams) - needed + 1]


def _units(text: Column) -> Column:
    lines = F.split(text, "\n", -1)
    sentences = F.split(F.regexp_replace(text, _BREAK, "$1\n"), "\n", -1)
    return F.array_distinct(F.concat(lines, sentences, F.split(text, r"\n[\x20\x09]*\n", -1), F.array(text)))


def _hashed(gram: str) -> int:
    """The number that stands for a bigram, the same as Spark's hash of its two words."""
    h = 42
    for word in gram.split(" "):
        h = xxhash.xxh64_intdigest(word.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def _numbers(grams: Sequence[str]) -> Column:
    return F.expr("array(" + ", ".join(f"{_hashed(g)}L" for g in grams) + ")")  # one call for thousands of literals


def _grams(units: Column) -> Column:
    """The distinct bigrams of each unit, as numbers; words are bound once for each, so the work is linear in the text."""
    words = F.transform(units, _words)
    some = F.filter(words, lambda w: F.size(w) > 1)
    return F.transform(some, lambda w: F.array_distinct(_pairs(w)))


def _words(text: Column) -> Column:
    return F.split(F.trim(normalised(text)), " ", -1)


def _pairs(words: Column) -> Column:
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1)))


def _window_hits(pairs: Column, templates: Sequence[tuple[str, str]], least: float) -> Column:
    """For each template, the best score of a window with its number of words, where that reaches the least score.

    ``pairs`` are the bigrams of a text in order. A window that reaches the score has so many places whose bigrams are the
    template's, so only starts around as many such places close together are scored. The ranges of starts that follow from
    each run of places are taken without what the one before had, so that no start is scored twice.
    """
    rows = [(name, grams, len(re.findall(r"[^\W_]+", t.lower())) - 1) for name, t in templates if (grams := bigrams(t))]
    every = list(dict.fromkeys(_hashed(g) for _, grams, _ in rows for g in grams))
    known = F.array(*(
        F.struct(F.lit(name).alias("license"), _numbers(grams).alias("grams"), F.lit(n).alias("n"), F.lit(math.ceil(round(len(grams) * least / (2 - least), 9))).alias("needed")) for name, grams, n in rows
    ))

    def best(placed: Column, t: Column) -> Column:
        def score(s: Column) -> Column:
            return let(F.array_distinct(F.slice(pairs, s + 1, t["n"])), lambda w: F.lit(2.0) * F.size(F.array_intersect(w, t["grams"])) / (F.size(w) + F.size(t["grams"])))

        def starts(at: Column) -> Column:
            def run(first: Column, j: Column) -> Column:
                last = F.get(at, j + t["needed"] - 1)
                low = F.greatest(last - t["n"] + 1, F.coalesce(F.get(at, j - 1) + 1, F.lit(0)), F.lit(0))
                high = F.least(first, F.size(pairs) - t["n"])
                return F.when((last - first < t["n"]) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

            return F.flatten(F.transform(F.slice(at, 1, F.greatest(F.size(at) - t["needed"] + 1, F.lit(0))), run))

        mine = F.transform(F.filter(placed, lambda x: F.array_contains(t["grams"], x["p"])), lambda x: x["i"])
        return let(mine, lambda at: F.when(F.size(at) >= t["needed"], F.array_max(F.transform(starts(at), score))))

    def found(placed: Column) -> Column:
        each = F.transform(known, lambda t: F.struct(t["license"].alias("license"), best(placed, t).alias("score")))
        return F.filter(each, lambda x: x["score"] >= least)

    return let(F.filter(F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: x["p"].isin(*every)), found)


def scan(docs: DataFrame, text: str = "text", templates: Mapping[str, Sequence[str]] = ALL_TEMPLATES, least: float = LEAST) -> DataFrame:
    """``docs`` with ``licences``: (license, score) of every license that some unit reaches ``least`` for, by license.

    The score is the best over units and templates. Null and empty texts have none. Rows are independent of each other,
    so repeated rows repeat their result; a column of the name ``licences`` is replaced. Templates of fewer than two
    words have no bigrams and never match.
    """
    rows = [(name, g) for name, texts in templates.items() for t in texts if (g := bigrams(t))]
    whole = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    phrases = _phrases(templates, least)
    rare = list(dict.fromkeys(map(_rarest, phrases)))
    # a word of ASCII letters that is one by itself in the normalised text is one here, and this is split faster
    parts = F.split(F.lower(whole), "[^a-z0-9]+", -1) if all(w.isascii() for w in rare) else _words(whole)
    word = F.arrays_overlap(parts, F.array(*map(F.lit, rare))) if rare else F.lit(False)
    hint = word & F.arrays_overlap(let(_words(whole), _pairs), _numbers(phrases)) if rare else word
    none = F.array().cast("array<struct<license:string,score:double>>")
    low, high = least / (2 - least), (2 - least) / least
    sizes = [len(g) for _, g in rows] or [0]

    known = F.array(*(
        F.struct(
            F.lit(name).alias("license"), _numbers(g).alias("grams"), F.lit(math.ceil(round(low * len(g), 9))).alias("low"), F.lit(math.floor(round(high * len(g), 9))).alias("high"),
        )
        for name, g in rows
    ))

    def scores(unit: Column) -> Column:
        fitting = F.filter(known, lambda t: F.size(unit).between(t["low"], t["high"]))
        scored = F.transform(fitting, lambda t: F.struct(t["license"].alias("license"), (F.lit(2.0) * F.size(F.array_intersect(unit, t["grams"])) / (F.size(unit) + F.size(t["grams"]))).alias("score")))
        return F.filter(scored, lambda s: s["score"] >= least)

    def best(hits: Column) -> Column:
        top = F.array_sort(F.transform(hits, lambda h: F.struct(h["license"].alias("license"), (-h["score"]).alias("minus"))))
        first = F.filter(top, lambda h, i: (i == 0) | (F.element_at(top, F.greatest(i, F.lit(1)))["license"] != h["license"]))
        return F.transform(first, lambda h: F.struct(h["license"].alias("license"), (-h["minus"]).alias("score")))

    grams = F.filter(F.array_distinct(_grams(_units(whole))), lambda g: F.size(g).between(math.ceil(low * min(sizes)), math.floor(high * max(sizes))))
    windows = let(let(_words(whole), _pairs), lambda p: _window_hits(p, [(name, t) for name, texts in templates.items() for t in texts], least))
    out = docs.withColumn("__grams", F.when(hint, grams))
    hits = F.concat(F.flatten(F.transform("__grams", scores)), windows)
    out = out.withColumn("__hits", F.when(F.col("__grams").isNotNull(), hits).otherwise(none))
    return out.withColumn("licences", F.when(F.size("__hits") > 0, best(F.col("__hits"))).otherwise(none)).drop("__grams", "__hits")


def report(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """For every row: the number of licenses found, the best of them (of equal scores the first by name), and all."""
    found = F.col("licences")
    top = F.element_at(F.array_sort(F.transform(found, lambda s: F.struct((-s["score"]).alias("m"), s["license"].alias("license")))), 1)
    shown = F.transform(found, lambda s: F.concat_ws(":", s["license"], F.format_number(s["score"], 4)))
    some = F.size(found) > 0
    return scanned.select(key, F.size(found).cast("long").alias("n_licences"), F.when(some, top["license"]).alias("license"), F.when(some, F.round(-top["m"], 6)).alias("score"), F.array_join(shown, ",").alias("licences"))


def op10_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def oracle() -> str:
    """The scan in SQL for DuckDB: every unit of every document against every template, with no pruning."""
    values = ", ".join(f"('{name}', ['{"', '".join(bigrams(t))}'])" for name, texts in TEMPLATES.items() for t in texts)
    return rf"""
WITH templates(license, grams) AS (VALUES {values}),
units AS (
  SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split(regexp_replace(text, '([.!?])\x20+', '\1' || chr(10), 'g'), chr(10)), string_split_regex(text, '\n[\x20\x09]*\n'), [text])) AS unit
  FROM documents),
words AS (SELECT doc_id, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
grams AS (SELECT DISTINCT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
scores AS (
  SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS score FROM grams JOIN templates ON len(g) BETWEEN len(grams) * 0.6 AND len(grams) * 1.6),
best AS (SELECT doc_id, license, max(score) AS score FROM scores WHERE score >= {LEAST} GROUP BY ALL),
found AS (SELECT doc_id, count(*) AS n, arg_min(license, (-score, license)) AS license, max(score) AS score, string_agg(license || ':' || format('{{:.4f}}', score), ',' ORDER BY license) AS licences FROM best GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_licences, license, round(score, 6) AS score, coalesce(licences, '') AS licences FROM documents LEFT JOIN found USING (doc_id)
"""
