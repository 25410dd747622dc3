"""License scans by a positional index of rare tokens.

Templates are whole licence texts, notices and phrases, as words with mandatory key phrases. Over the whole corpus the
document frequency of every template word is counted; a template is indexed by its words of highest IDF, each with its
position. A file's occurrences of such words are looked up; each posting (template, position) names the word at which the
template would start, and places where several postings agree are kept. There, the key phrases have to stand in full, and
the words found at their relative positions give the score, of which a find needs a least part: naming a licence isn't
granting it. Words that were put in, left out or changed between key
phrases shift or lose a few postings, no more.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import letters_lower, map_texts, small_batches, table

_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else (c + 32 if 0x41 <= c <= 0x5A else 0x20) for c in range(256))


def split(data: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of UTF-8 text, after A-Z is lower-cased."""
    return data.translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    """words: the text's words. keys: runs (from, to) of words that have to stand in full, about where they belong."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]
    base: bool = False


def template(label: str, text: str, *keys: str, base: bool = False) -> Template:
    words = tuple(w.decode() for w in split(letters_lower(text)))
    at = []
    for key in keys:
        k = tuple(w.decode() for w in split(letters_lower(key)))
        i = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        at.append((i, i + len(k)))
    return Template(label, words, tuple(at), base)


#: The phrases whose every place counts.
BASE = tuple(template(label, text, text, base=True) for label, text in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")))

# Public licence texts and notices.

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
) + _WARRANTY
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "{0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
    "for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
) + _WARRANTY.replace(" OR COPYRIGHT HOLDERS", "")
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {0} which accompanies this distribution"
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."

TEMPLATES = (
    *BASE,
    template("mit", _MIT, "permission is hereby granted free of charge to any person", "without restriction including without limitation the rights to use"),
    template("bsd", _BSD.format(""), "redistribution and use in source and binary forms", "this list of conditions and the following disclaimer"),
    template("bsd", _BSD.format(_ENDORSE), "redistribution and use in source and binary forms", "endorse or promote products derived from this software"),
    template("isc", _ISC, "permission to use copy modify and or distribute this software"),
    template("apache-2", _APACHE, "apache license version 2", "apache org licenses license 2"),
    template("gpl-3", _GNU.format("", 3), "gnu general public license as published", "version 3 of the license"),
    template("gpl-2", _GNU.format("", 2), "gnu general public license as published", "version 2 of the license"),
    template("lgpl", _GNU.format("Lesser ", 3), "gnu lesser general public license as published", "version 3 of the license"),
    template("agpl-3", _GNU.format("Affero ", 3), "gnu affero general public license"),
    template("unlicense", _UNLICENSE, "free and unencumbered software released into the public domain"),
    template("mpl-2", _MPL, "mozilla public license v 2 0"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person"),
    template("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2"),
    template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    template("lgpl", "under the terms of the gnu lesser general public license", "under the terms of the gnu lesser general public license"),
    template("lgpl", "gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    template("lgpl", "gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1"),
    template("lgpl", _GNU.format("Lesser ", "2 1"), "gnu lesser general public license as published", "version 2 1 of the license"),
    template("agpl-3", "under the terms of the gnu affero general public license version 3", "gnu affero general public license"),
    template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    template("mpl-2", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy modify and or distribute this software"),
    template("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike"),
    template("cc-by", "licensed under cc by 4 0", "under cc by 4 0"),
    template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    template("zlib", _ZLIB, "alter it and redistribute it freely", "must not be misrepresented"),
    template("boost-1", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    template("epl-2", _EPL.format("2.0"), "eclipse public license 2 0"),
    template("epl-1", _EPL.format("v1.0"), "eclipse public license v1 0"),
    template("eupl", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", "under the eupl version 1"),
    template("ofl-1", "this font software is licensed under the sil open font license version 1 1", "sil open font license version 1 1"),
    template("artistic-2", "it is free software licensed under the artistic license 2 0", "artistic license 2 0"),
    template("cc0", "released under cc0 1 0 universal", "cc0 1 0"),
)

#: Words by which a template is indexed, and how many of them have to agree on a start (all of them, where it has fewer).
ANCHORS, AGREE = 8, 2
#: The score that a find needs, its share of the template's IDF weight: an opening has about as much, a name less.
LEAST = 0.4
#: Words by which the start may drift within one copy of a template, as words are put in or left out.
DRIFT = 16


def document_frequency(docs: DataFrame, vocabulary: set[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Rows of docs, and how many hold each word of a (fixed, small) vocabulary. Each task sends its sums only."""
    wanted = frozenset(w.encode() for w in vocabulary)
    small_batches(docs.sparkSession)

    def count(batches):
        rows, df = 0, dict.fromkeys(wanted, 0)
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                for w in wanted.intersection(split(letters_lower(text or ""))):
                    df[w] += 1
        found = [(w.decode(), n) for w, n in df.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([None, *(w for w, _ in found)], pa.string()), pa.array([rows, *(n for _, n in found)], pa.int64())], ["word", "n"])

    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r["word"]: r["n"] for r in sums.collect()}  # a row for each word of the vocabulary at most
    return got.pop(None, 0) or 0, got


class Index:
    """Postings of each template's words of highest IDF, and the IDF of all template words."""

    def __init__(self, templates: tuple[Template, ...], rows: int, df: dict[str, int], least: float = LEAST):
        self.least = least
        self.idf = {w: math.log((rows + 1) / (df.get(w, 0) + 1)) + 1 for t in templates for w in t.words}
        self.templates = templates
        self.words = [[w.encode() for w in t.words] for t in templates]
        self.total = [sum(self.idf[w] for w in t.words) for t in templates]
        self.need, self.postings = [], {}
        for k, t in enumerate(templates):
            first = {w: i for i, w in reversed(list(enumerate(t.words)))}
            rank = lambda i: (-self.idf[t.words[i]], i)  # noqa: B023, E731
            # Of a base phrase one word will do: every place of it counts, and each is checked. Of other templates some
            # words of the first key phrase are indexed in any case, as a corpus may hold little more than that.
            rarest = sorted(first.values(), key=rank)[: 1 if t.base else ANCHORS]
            if not t.base:
                rarest = sorted({*rarest, *sorted(range(*t.keys[0]), key=rank)[:AGREE]})
            self.need.append(min(1 if t.base else AGREE, len(rarest)))
            for i in rarest:
                w = t.words[i]
                self.postings.setdefault(w.encode(), []).append((k, i))
        self.anchors = frozenset(self.postings)

    def starts(self, words: list[bytes]) -> dict[int, list[int]]:
        """For each template, the starts on which enough of its postings agree, in order."""
        votes: dict[tuple[int, int], int] = {}
        for anchor in self.anchors.intersection(words):
            at = -1
            for _ in range(words.count(anchor)):
                at = words.index(anchor, at + 1)
                for k, i in self.postings[anchor]:
                    votes[k, at - i] = votes.get((k, at - i), 0) + 1
        out: dict[int, list[int]] = {}
        for (k, start), n in sorted(votes.items()):
            if n >= self.need[k]:
                out.setdefault(k, []).append(start)
        return out

    def scan(self, words: list[bytes]) -> list[tuple[Template, int, float]]:
        """(template, place of its first key phrase, share of its IDF weight found) for all places with a share of `least`."""
        found = []
        for k, starts in self.starts(words).items():
            drift = 0 if self.templates[k].base else DRIFT
            group: list[int] = []
            for s in [*starts, None]:
                if group and (s is None or s - group[-1] > drift):
                    found += self._verified(k, group, words, drift)
                    group = []
                if s is not None:
                    group.append(s)
        return found

    def _verified(self, k: int, starts: list[int], words: list[bytes], drift: int) -> list[tuple[Template, int, float]]:
        """A group of starts that drift apart: a find if every key phrase stands where some start, or its drift, puts it."""
        t, ws, places = self.templates[k], self.words[k], []
        for a, b in t.keys:
            near = range(max(0, starts[0] + a - drift), min(len(words) - (b - a), starts[-1] + a + drift) + 1)
            place = next((i for i in near if words[i : i + b - a] == ws[a:b]), None)
            if place is None:
                return []
            places.append(place)
        aligned = {s for s in starts} | {p - a for p, (a, _) in zip(places, t.keys, strict=True)}
        got = sum(self.idf[t.words[i]] for i, w in enumerate(ws) if any(0 <= s + i < len(words) and words[s + i] == w for s in aligned))
        score = min(1.0, got / self.total[k])
        return [(t, places[0], score)] if score >= self.least else []


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """For each row: n_words, matches (label, base, place of the mandatory phrase in words, score), in order of place.

    Finds of which less than `least` of the template's weight stands there (a bare mention of a name) are none; base
    phrases stand in full, so all of theirs count.

    Null and empty texts have no words and no matches. Repeated rows stay repeated; equal texts have equal results.
    Of words of equal IDF those that come first in the template are indexed. Copies of a template closer than DRIFT words
    to one another (a text given over and over) count as one find, base phrases always by place. An empty table gives an
    empty result.
    """
    rows, df = document_frequency(docs, {w for t in templates for w in t.words}, text_col)
    index = Index(templates, rows, df, least)

    def make() -> Callable[[list[str]], dict]:
        def run(texts: list[str]) -> dict:
            n, matches = [], []
            for text in texts:
                words = split(letters_lower(text))
                n.append(len(words))
                matches.append([{"label": t.label, "base": t.base, "word": at, "score": s} for t, at, s in sorted(index.scan(words), key=lambda x: (x[1], x[0].label, x[0].words))])
            return {"n_words": n, "matches": pa.array(matches, pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("score", pa.float64())])))}

        return run

    return map_texts(docs, make, "n_words long, matches array<struct<label:string,base:boolean,word:long,score:double>>", id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    return (
        scan_licenses(table(spark, sf_dir, "documents"))
        .withColumn("base", F.filter("matches", lambda x: x["base"]))
        .select(
            "doc_id",
            "n_words",
            F.size("base").cast("long").alias("n_base"),
            F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"),
            F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
            labels(F.col("base")).alias("base_labels"),
            labels(F.col("matches")).alias("labels"),
            F.coalesce(F.array_max(F.transform("matches", lambda x: x["score"])), F.lit(0.0)).alias("score"),
        )
    )
