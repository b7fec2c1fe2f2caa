"""Licences: headers and licence files against templates by sparse TF-IDF cosine, then inheritance from the nearest directory.

Every line, sentence and paragraph of a text that holds an anchor word is a segment, and so is, for each length of a template in words, the
window of so many words from a segment's first anchor on; each is compared with each template as a sparse TF-IDF vector. So words
around a notice don't dilute it. Templates are notices, headers and whole short licences. Document frequencies of the templates' words
are counted over all texts; words that no template holds weigh as the rarest and so lower the cosine. A text's licence is the template
with the largest cosine of at least ``THRESHOLD``. A text that is a licence as a whole, or whose name says so, is a licence file and gives its
directory a licence, the best-scoring one if there are several. Texts without a licence of their own inherit that of the nearest directory
above them, found by joining directories to their ancestors.

Null texts count as empty, null paths as "", the root. Ties go to the template first by name and the file with the smaller id. Rows
are answered one by one, repeated rows and null ids as they come; an empty table gives an empty result; further columns are left
alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, materialise, text_of

THRESHOLD = 0.6

# Templates by SPDX name, words that a segment must hold one of, names of licence files.
WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
TEMPLATES = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + ISC_WARRANTY],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", GNU.format("Affero General Public License", "3", "Affero General Public License")],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", BSD, BSD + " " + BSD_WARRANTY],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + BSD_WARRANTY],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", GNU.format("General Public License", "2", "General Public License")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", GNU.format("General Public License", "3", "General Public License")],
    "ISC": ["Released under the ISC License.", ISC, ISC + " " + ISC_WARRANTY],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", GNU.format("Lesser General Public License", "3", "Lesser General Public License")],
    "MIT": ["Released under the MIT License.", MIT, MIT + " " + WARRANTY],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."],
}
ANCHORS = ("licen", "copyright", "spdx", "permission", "redistribut", "public domain", "creative commons", "cc by", "cc0", "all rights")
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.-][A-Za-z0-9.-]*)?$"
TERM = re.compile(r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> Counter:
    return Counter(TERM.findall(text.lower()))


def templates() -> list[tuple[str, str]]:
    """All templates with their names, by name; each licence also as its SPDX line."""
    return [(name, x) for name, texts in sorted(TEMPLATES.items()) for x in [*texts, f"SPDX-License-Identifier: {name}"]]


VOCABULARY = sorted({t for _, x in templates() for t in terms(x)})


class Matcher:
    """Cosines of segments with the templates under given document frequencies."""

    def __init__(self, documents: int, frequency: dict[str, int]):
        self.rarest = math.log(documents + 1) + 1
        self.idf = {t: math.log((documents + 1) / (frequency.get(t, 0) + 1)) + 1 for t in VOCABULARY}
        self.templates = []
        for name, x in templates():
            vector = {t: n * self.idf[t] for t, n in terms(x).items()}
            length = math.sqrt(sum(w * w for w in vector.values()))
            self.templates.append((name, {t: w / length for t, w in vector.items()}))

    def best(self, segment: str) -> tuple[float, str]:
        vector = {t: n * self.idf.get(t, self.rarest) for t, n in terms(segment).items()}
        length = math.sqrt(sum(w * w for w in vector.values()))
        if not length:
            return 0.0, ""
        found = [(sum(w * template[t] for t, w in vector.items() if t in template) / length, name) for name, template in self.templates]
        return max(found, key=lambda x: x[0])


def anchored(text: str) -> bool:
    low = text.lower()
    return any(a in low for a in ANCHORS)


#: Words of templates, each length once: the lengths of windows.
LENGTHS = sorted({len(x.split()) for _, x in templates()})
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def segments(text: str) -> list[str]:
    """Lines, sentences and paragraphs with an anchor, and the windows of the templates' lengths from their first anchors on."""
    if not anchored(text):
        return []
    parts = [x for x in text.split("\n") if anchored(x)]
    parts += [x for x in re.split(r"\n\s*\n", text) if "\n" in x and anchored(x)]
    found = dict.fromkeys(parts)
    for part in parts:
        found.update(dict.fromkeys(x for x in SENTENCE.split(part) if anchored(x)))
        words = part.split()
        if len(words) > LENGTHS[0]:
            first = next((k for k, w in enumerate(words) if anchored(w)), 0)
            found.update(dict.fromkeys(" ".join(words[first : first + n]) for n in LENGTHS if n < len(words) - first))
    return list(found)


def term_frequencies(docs: DataFrame, text_col: str) -> tuple[int, dict[str, int]]:
    """The number of texts, and of those that hold each word of the templates."""

    def count(batches):
        words, n, held = set(VOCABULARY), 0, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                held.update(words.intersection(TERM.findall(text.lower())))
        if n:
            yield {"term": [*held, ""], "n": [*held.values(), n]}

    rows = map_arrow(docs.select(text_of(text_col).alias("text")), count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r[0]: r[1] for r in rows}  # one row a word of the templates
    return found.pop("", 0), found


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """A directory and all above it, "" last."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit(""))))


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, path, license, score, origin (file, header or inherited; null without a licence), from_dir; one row a row of docs."""
    id_type = docs.schema[id_col].dataType.simpleString()
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(*term_frequencies(docs, text_col)))

    def run(batches):
        for batch in batches:
            out = {"license": [], "score": [], "whole": []}
            for text in batch.column("text").to_pylist():
                best, whole = (0.0, ""), False
                found = segments(text)
                if found:
                    best = max((matcher.value.best(x) for x in found), key=lambda x: x[0])
                    whole = matcher.value.best(text)[0] >= threshold
                hit = best[0] >= threshold
                out["license"].append(best[1] if hit else None)
                out["score"].append(round(best[0], 9) if hit else None)
                out["whole"].append(whole)
            yield {"id": batch.column("id"), "path": batch.column("path")} | out

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(path, F.lit("")).alias("path"), text_of(text_col).alias("text"))
    own = materialise(map_arrow(rows, run, f"id {id_type}, path string, license string, score double, whole boolean"), "licenses")
    own = own.withColumn("is_file", F.col("license").isNotNull() & (F.col("whole") | F.col("path").rlike(FILE_NAME))).withColumn("dir", directory(F.col("path")))
    given = own.filter("is_file").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("o"), F.col("license"), F.col("id"))).alias("f")).select(F.col("dir").alias("up"), F.col("f.license").alias("up_license"), (-F.col("f.o")).alias("up_score"))
    # directories are few and some hold very many texts; what each inherits is written before it is joined, so that the join can split a directory
    above = own.select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("up"))
    near = above.join(given, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("o"), "up", "up_license", "up_score")).alias("n")).select("dir", "n.up", "n.up_license", "n.up_score")
    joined = own.join(materialise(near, "inherited"), "dir", "left")
    has = F.col("license").isNotNull()
    origin = F.when(F.col("is_file"), "file").when(has, "header").when(F.col("up").isNotNull(), "inherited")
    return joined.select(F.col("id").alias(id_col), "path", F.coalesce("license", "up_license").alias("license"), F.coalesce("score", "up_score").alias("score"), origin.alias("origin"), F.when(~has, F.col("up")).alias("from_dir"))
