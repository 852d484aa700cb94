"""Licence texts found through a positional index of rare words.

A task turns each text into the places of the words that licence templates use: the index.
Document frequencies over all documents order these words by rarity. Of each template whose
mandatory key phrase a file has all words of, the rarest one is looked up in the file; each
of its places, moved back by the word's place in the template, is where the template would
begin, and the places of the phrase's other words, moved back likewise, are intersected with
that. Where a key phrase stands, the template's postings vote: every licence word of the
file, moved back by each of its places in the template, is a vote for a beginning, and the
score is the share of the template's words that agree on it. A label is given where that
share is LEAST_SHARE or more, so a key phrase by itself gives none unless it is the whole
template. All of it is DataFrame code.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import cut

#: What parts words: every ASCII character but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The share of a template's words that must agree for its label.
LEAST_SHARE = 0.4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Notice:
    """A label, the words of a template, and the part of them, the key phrase, that must stand in a text."""

    label: str
    words: tuple[str, ...]
    key_from: int
    key_to: int
    base: bool = False

    @property
    def key(self) -> tuple[str, ...]:
        return self.words[self.key_from : self.key_to]


def notice(label: str, text: str, key: str | None = None, base: bool = False) -> Notice:
    """A template from its text, cut into words as documents are."""
    words, part = (tuple(re.findall(r"[a-z0-9]+", t.lower())) for t in (text, key or text))
    at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
    return Notice(label, words, at, at + len(part), base)


#: Texts of public licences, or the notices by which works are put under them.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. {_AS_IS}"""
_BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must
not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
law. {_AS_IS.replace(" OR COPYRIGHT HOLDERS", "")} For more information, please refer to
<https://unlicense.org>"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""
_APACHE_GRANT = """Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a
perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly
display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."""


def _gnu(name: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free
    Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that
    it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
    GNU {name} for more details."""


_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""

#: The contract's base phrases, then short notices and whole texts with their mandatory key phrases.
NOTICES = (
    notice("mit", "mit license", base=True),
    notice("apache", "apache license", base=True),
    notice("gpl", "general public license", base=True),
    notice("mit-notice", "released under the MIT license", "under the mit license"),
    notice("mit-text", _MIT, "permission is hereby granted free of charge to any person"),
    notice("bsd-2-clause", f"{_BSD_TOP} {_BSD_END}", "redistribution and use in source and binary forms"),
    notice("bsd-3-clause", f"{_BSD_TOP} {_BSD_NAMES} {_BSD_END}", "may be used to endorse or promote products"),
    notice("isc", _ISC, "permission to use copy modify and or distribute this software"),
    notice("zlib", _ZLIB, "permission is granted to anyone to use this software"),
    notice("unlicense", _UNLICENSE, "free and unencumbered software released into the public domain"),
    notice("apache-2.0", _APACHE, "apache license version 2 0"),
    notice("apache-2.0", "Apache License, Version 2.0"),
    notice("apache-2.0-text", _APACHE_GRANT, "each contributor hereby grants to you a perpetual"),
    notice("gpl-2.0", "GNU General Public License, version 2", "general public license version 2"),
    notice("gpl-3.0", "GNU General Public License, version 3", "general public license version 3"),
    notice("gpl-header", _gnu("General Public License", "3"), "under the terms of the gnu general public license"),
    notice("lgpl", _gnu("Lesser General Public License", "3"), "gnu lesser general public license"),
    notice("lgpl", "GNU Lesser General Public License"),
    notice("agpl", _gnu("Affero General Public License", "3"), "gnu affero general public license"),
    notice("agpl", "GNU Affero General Public License"),
    notice("mpl-2.0", _MPL, "mozilla public license"),
    notice("mpl-2.0", "Mozilla Public License, version 2.0"),
    notice("cc-by", "licensed under CC BY 4.0", "cc by 4 0"),
    notice("cc-by-sa", "licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    notice("cc-by-nc", "licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    notice("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    notice("all-rights-reserved", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    """The lower-cased words of a text; only A-Z are lowered, null is empty."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def positional_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n_words, hits): the places of the vocabulary's words in each text, as array<struct<w, p>>; w counts the vocabulary."""
    split = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words_of(F.col("text")).alias("words"))
    known = F.array(*map(F.lit, vocabulary))
    at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("p"))), lambda x: x["word"].isin(vocabulary))
    return split.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.transform(at, lambda x: F.struct((F.array_position(known, x["word"]) - 1).cast("int").alias("w"), x["p"].alias("p"))).alias("hits"),
    )


def document_frequencies(index: DataFrame, vocabulary: list[str]) -> list[int]:
    """In how many documents each word of the vocabulary stands: one row per word, whatever the corpus."""
    seen = index.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").count()
    found = dict(map(tuple, seen.collect()))
    return [found.get(i, 0) for i in range(len(vocabulary))]


def starts(n: Notice, ids: list[int], idf: list[float]) -> Column:
    """The places where the template would begin by its key phrase: all its words agree on them. The rarest is looked up first."""
    rarest = sorted(range(n.key_from, n.key_to), key=lambda o: (-idf[ids[o]], o))

    def moved(o: int) -> Column:
        return F.transform(F.filter("hits", lambda h: h["w"] == ids[o]), lambda h: h["p"] - o)

    found = moved(rarest[0])
    for o in rarest[1:]:
        found = F.array_intersect(found, moved(o))
    # a file that lacks a word of the phrase isn't looked at
    return F.when(F.size(F.array_except(F.array(*map(F.lit, sorted({ids[o] for o in rarest}))), "have")) == 0, found).otherwise(F.array().cast("array<int>"))


def agreement(n: Notice, ids: list[int], found: Column, vocabulary: int) -> Column:
    """The share of the template's words that agree on one of the beginnings ``found``: the postings (places in the template, by word) vote."""
    postings = [[o for o, w in enumerate(ids) if w == v] for v in range(vocabulary)]
    table = F.from_json(F.lit(json.dumps(postings)), "array<array<int>>")
    votes = F.flatten(F.transform(F.filter("hits", lambda h: F.size(F.get(table, h["w"])) > 0), lambda h: F.transform(F.get(table, h["w"]), lambda o: h["p"] - o)))
    counted = F.sort_array(F.filter(votes, lambda s: F.array_contains(found, s)))
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, s: Column) -> Column:
        run = F.when(a["last"] == s, a["run"] + 1).otherwise(1)
        return F.struct(s.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return F.aggregate(counted, zero, step)["most"] / len(ids)


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases; first_word and last_word are the least and
    the largest of them (null: none), words counted from 0. base_labels and labels are
    distinct, sorted and comma-joined, empty where nothing stands; where a label is given
    its key phrase stands in the text, and LEAST_SHARE of its template's words agree there
    (of a base phrase all do). score is the largest share of a template's words that agree with
    the text where its key phrase stands, else 0: 1 for a whole template. A null text is
    empty; repeated rows stay; very long texts are scanned whole; other columns are ignored;
    an empty table gives an empty result.
    """
    vocabulary = sorted({w for n in notices for w in n.words})
    index = cut(positional_index(docs, vocabulary), "licence_index")
    frequencies = document_frequencies(index, vocabulary)
    idf = [-math.log((f + 1) / (max(frequencies) + 2)) for f in frequencies]
    place = {w: i for i, w in enumerate(vocabulary)}
    ids = [[place[w] for w in n.words] for n in notices]
    looked = index.withColumn("have", F.array_distinct("hits.w"))
    found = looked.select("doc_id", "n_words", "hits", *(starts(n, i, idf).alias(f"at_{k}") for k, (n, i) in enumerate(zip(notices, ids, strict=True))))
    base = [k for k, n in enumerate(notices) if n.base]
    places = F.concat(*(F.col(f"at_{k}") for k in base))
    label = lambda some: F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.col(f"share_{k}") >= LEAST_SHARE, F.lit(notices[k].label)) for k in some))))))
    shares = [
        F.when(F.size(f"at_{k}") > 0, F.lit(1.0) if n.key == n.words else agreement(n, i, F.col(f"at_{k}"), len(vocabulary))).otherwise(0.0)
        for k, (n, i) in enumerate(zip(notices, ids, strict=True))
    ]
    agreed = found.select(
        "doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"), F.array_max(places).cast("bigint").alias("last_word"), *(s.alias(f"share_{k}") for k, s in enumerate(shares)),
    )
    return agreed.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", label(base).alias("base_labels"), label(range(len(notices))).alias("labels"),
        F.greatest(*(F.col(f"share_{k}") for k in range(len(notices)))).alias("score"),
    )


def oracle(notices: tuple[Notice, ...] = NOTICES) -> str:
    """The same rows in DuckDB SQL: every key phrase is looked for at every word, where it stands every word of its template is compared, and enough of them give the label."""

    def at(n: Notice) -> str:
        same = " AND ".join(f"w[i + {1 + j}] = '{x}'" for j, x in enumerate(n.key))
        return f"[i - {n.key_from} for i in range(len(w)) if {same}]"

    def share(k: int, n: Notice) -> str:
        if n.key == n.words:
            return f"CASE WHEN len(at_{k}) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END"
        # a place before the text has no word
        words = "[" + ", ".join(f"'{x}'" for x in n.words) + "]"
        agreed = f"list_max([len([j for j in range({len(n.words)}) if s + j >= 0 AND w[s + j + 1] = {words}[j + 1]]) for s in at_{k}])"
        return f"CASE WHEN len(at_{k}) = 0 THEN 0.0::DOUBLE ELSE {agreed}::DOUBLE / {len(n.words)} END"

    base = [k for k, n in enumerate(notices) if n.base]
    label = lambda some: "array_to_string(list_sort(list_distinct(list_concat(" + ", ".join(f"CASE WHEN share_{k} >= {LEAST_SHARE} THEN ['{notices[k].label}'] ELSE []::VARCHAR[] END" for k in some) + "))), ',')"
    return f"""
    WITH words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
    found AS (SELECT doc_id, w, len(w) AS n_words, {', '.join(f"{at(n)} AS at_{k}" for k, n in enumerate(notices))} FROM words),
    based AS (SELECT *, list_concat({', '.join(f'at_{k}' for k in base)}) AS places, {', '.join(f"{share(k, n)} AS share_{k}" for k, n in enumerate(notices))} FROM found)
    SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
      {label(base)} AS base_labels, {label(range(len(notices)))} AS labels, greatest({', '.join(f'share_{k}' for k in range(len(notices)))}) AS score
    FROM based"""
