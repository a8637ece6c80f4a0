"""Licence scans: lines, whole texts and windows of words against licence templates, by Dice
coefficient over word bigrams; DataFrame functions only.

Text is normalised: A-Z lowered, everything but a-z and 0-9 a space.  With A and B the sets of
a unit's and a template's word bigrams, a match has 2|A & B| / (|A| + |B|) >= ``threshold``; so
|A| lies between |B| t/(2-t) and |B| (2-t)/t, which rules out most templates by size alone.  As
a match shares more than t/(2-t) of the template's bigrams, texts and units that hold none of
a few rare ones are dropped first.  Notices that are wrapped over lines or stand among other
words are found in windows: a template's anchors are the bigram of its longest words in each
third of it, and wherever the text holds an anchor, the words around it, as many as the
template has and with the anchor at the template's place, are one window.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm.common import isolate

#: Public licence notices, by SPDX-like name.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(text: str) -> list[str]:
    """The words of a normalised text; the same rule as on the executors."""
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a normalised text, sorted."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def windows_of(text: str) -> list[tuple[str, int, int]]:
    """A template's anchors: (bigram, its place, words of the template)."""
    words = words_of(text)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    out = {}
    for third in range(3):
        part = range(len(pairs) * third // 3, len(pairs) * (third + 1) // 3)
        if part:
            at = max(part, key=lambda i: (sum(len(w) for w in pairs[i].split() if w not in COMMON), -i))
            out.setdefault(pairs[at], at)
    return [(gram, at, len(words)) for gram, at in out.items()]


#: Words too common to look a template up by.
COMMON = {"a", "all", "and", "any", "as", "be", "by", "except", "for", "following", "free", "in", "is", "it", "may", "not", "of", "or",
          "published", "terms", "that", "the", "this", "to", "under", "use", "with", "without", "work", "you"}


def anchors(grams: list[list[str]], threshold: float) -> tuple[str, list[str]]:
    """A pattern that every match contains, and words of which any such text holds one.

    A match shares t/(2-t) of a template's bigrams at least, so one of any more than the rest:
    of those that hold its longest words, as many words as it takes.
    """
    asked: set[str] = set()
    rare: set[str] = set()
    for b in grams:
        spare = len(b) - max(1, math.ceil(threshold / (2 - threshold) * len(b) - 1e-9))
        touched: set[str] = set()
        for word in sorted({w for x in b for w in x.split()}, key=lambda w: (w in COMMON, -len(w), w)):
            if len(touched) > spare:
                break
            rare.add(word)
            touched.update(x for x in b if word in x.split())
        asked |= touched
    least = sorted(w for w in rare if not any(v != w and v in w for v in rare))
    pattern = "(?i)(?:" + "|".join(sorted(x.replace(" ", "[^A-Za-z0-9]+") for x in asked)) + ")"
    return (pattern if asked else r"\z\A."), least


def _words(unit: Column) -> Column:
    low = F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Word bigrams in order."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


def license_scans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    threshold: float = 0.8,
) -> DataFrame:
    r"""Licences of each document: the id, n_units, n_matches, n_windows, licenses, best_license, best_dice, found.

    Units are the lines (ended by ``\n``) and, for texts of two lines or more, the whole text
    (line 0).  A unit's licence is the template of the largest coefficient, ties to the first
    name.  ``n_windows`` counts the windows that match the template whose anchor they hold.
    ``licenses`` lists distinct names in order, comma-joined ('' for none); ``best_license``
    is the one of the largest coefficient (null for none, with best_dice 0); ``found`` is an
    array of (line, license, dice), windows with the line -1.

    Null and empty texts have no unit.  Rows are scanned one by one, so repeated rows and null
    ids are kept as they are.  Templates of one word or none cannot match.  An empty table
    gives no row.  Extra columns are ignored.  The templates are a parameter, held as
    literals: keep them to some hundreds.
    """
    frame, (doc, text), _ = isolate(docs, id_col, text_col)
    known = [(n, b, t) for n, t in sorted(templates if templates is not None else TEMPLATES) if (b := bigrams_of(t))]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [(math.ceil(low * len(b) - 1e-9), math.floor(high * len(b) + 1e-9)) for _, b, _ in known]
    least, most = min((a for a, _ in sizes), default=1), max((b for _, b in sizes), default=0)

    some, words = anchors([b for _, b, _ in known], threshold)
    kind = "array<struct<line:int,license:string,dice:double>>"
    unit_kind = "array<struct<line:int,unit:string>>"
    grams = [F.array(*[F.lit(x) for x in b]) for _, b, _ in known]

    def dice(pairs: Column, at: int) -> Column:
        size = F.size(pairs)
        return F.when(size.between(*sizes[at]), 2.0 * F.size(F.array_intersect(pairs, grams[at])) / (size + len(known[at][1]))).otherwise(0.0)

    def judged(pairs: Column) -> Column:
        options = [F.struct((-dice(pairs, i)).alias("less"), F.lit(n).alias("license")) for i, (n, _, _) in enumerate(known)]
        return F.when(F.size(pairs).between(least, most), F.array_min(F.array(*options)))

    body = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("unit")))
    whole = F.when(F.contains(body, F.lit("\n")), F.array(F.struct(F.lit(0).alias("line"), body.alias("unit")))).otherwise(F.array().cast(unit_kind))
    hopeful = F.filter(F.concat(whole, lines), lambda u: u["unit"].rlike(some))
    n_lines = F.size(F.split(body, "\n"))
    gate = reduce(or_, (F.contains("low", F.lit(w)) for w in words), F.lit(False)) & body.rlike(some)
    out = frame.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.lower(F.col(text)).alias("low")).select(
        "doc",
        F.when(body == "", 0).otherwise(n_lines + (n_lines > 1).cast("int")).cast("long").alias("n_units"),
        F.when(gate, F.struct(hopeful.alias("units"), _words(body).alias("words"))).alias("t"),
    )
    if known:
        paired = F.transform("t.units", lambda u: F.struct(u["line"].alias("line"), F.array_distinct(_pairs(_words(u["unit"]))).alias("pairs")))
        tested = F.transform(paired, lambda u: F.struct(u["line"].alias("line"), judged(u["pairs"]).alias("m")))
        found = F.transform(
            F.filter(tested, lambda t: F.coalesce(-t["m"]["less"] >= threshold, F.lit(False))),
            lambda t: F.struct(t["line"].alias("line"), t["m"]["license"].alias("license"), (-t["m"]["less"]).alias("dice")),
        )
        # windows: where an anchor stands, the template's length of words around it
        by_gram: dict[str, list[tuple[int, int, int]]] = {}
        for i, (_, _, t) in enumerate(known):
            for gram, at, n in windows_of(t):
                by_gram.setdefault(gram, []).append((i, at, n))
        rows = [F.struct(F.lit(g).alias("gram"), F.lit(i).alias("at"), F.lit(a).alias("off"), F.lit(n).alias("n")) for g, some_of in sorted(by_gram.items()) for i, a, n in some_of]
        table, every = F.array(*rows), F.array(*grams)
        low_high = F.array(*[F.struct(F.lit(a).alias("least"), F.lit(b).alias("most"), F.lit(n).alias("license"), F.lit(len(g)).alias("size")) for (a, b), (n, g, _) in zip(sizes, known, strict=True)])
        hits = F.filter(
            F.transform(_pairs(F.col("t.words")), lambda g, i: F.struct(g.alias("gram"), (i + 1).alias("place"))), lambda h: h["gram"].isin(*sorted(by_gram))
        )
        out = out.select("doc", "n_units", "t", found.alias("found"), hits.alias("hits"))

        def window(h: Column, t: Column) -> Column:
            from_ = F.greatest(h["place"] - t["off"], F.lit(1))
            pairs = F.array_distinct(_pairs(F.slice(F.col("t.words"), from_, t["n"])))
            own = F.get(low_high, t["at"])
            return F.transform(F.array(F.struct(pairs.alias("pairs"), own.alias("own"), F.get(every, t["at"]).alias("grams"))), _coefficient)[0]

        seen = F.flatten(F.transform("hits", lambda h: F.transform(F.filter(table, lambda t: t["gram"] == h["gram"]), lambda t: window(h, t))))
        close = F.filter(seen, lambda w: w["dice"] >= threshold)
        windows = F.when(F.size("hits") > 0, close).otherwise(F.array().cast(kind)).cast(kind)
        out = out.select("doc", "n_units", F.coalesce(F.col("found").cast(kind), F.array().cast(kind)).alias("found"), F.coalesce(windows, F.array().cast(kind)).alias("windows"))
    else:
        out = out.select("doc", "n_units", F.array().cast(kind).alias("found"), F.array().cast(kind).alias("windows"))
    out = out.withColumn("all", F.concat("found", "windows"))
    best = F.array_min(F.transform("all", lambda f: F.struct((-f["dice"]).alias("less"), f["license"].alias("license"))))
    return out.select(
        F.col("doc").alias(id_col), "n_units", F.size("found").cast("long").alias("n_matches"), F.size("windows").cast("long").alias("n_windows"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("all", lambda f: f["license"]))), ",").alias("licenses"),
        best["license"].alias("best_license"), F.coalesce(-best["less"], F.lit(0.0)).alias("best_dice"), F.col("all").alias("found"),
    )


def _coefficient(w: Column) -> Column:
    """(line, license, dice) of a window (pairs, own, grams); 0 outside the template's size bounds."""
    size = F.size(w["pairs"])
    share = 2.0 * F.size(F.array_intersect(w["pairs"], w["grams"])) / (size + w["own"]["size"])
    fits = size.between(w["own"]["least"], w["own"]["most"])
    return F.struct(F.lit(-1).alias("line"), w["own"]["license"].alias("license"), F.when(fits, share).otherwise(0.0).alias("dice"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_units", "n_matches", "n_windows", "licenses", "best_license", F.round("best_dice", 9).alias("best_dice"))
