"""Licence scan by canonical digests.

A text is brought to a canonical form: lower case, equivalent spellings made one, lines that name a
holder of rights and markup dropped, everything but letters and digits turned into single blanks. The SHA-256 of
that form is joined to the digests of known texts. Whole documents are looked up, and every line
of a document, so that notices inside other text are found as well.

All of it is DataFrame functions. Texts are read once and only digests are written and joined; the
table of known texts is aggregated to one row per digest and left to Spark's size checks.

Defined cases: null counts as empty; a text or line that is empty in canonical form matches nothing;
repeated rows get a result each; of several licences with one canonical text the first by name is
reported; empty tables give no rows or no matches; further columns are left out.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.session import cut_lineage

#: Spellings held to be equal, as (pattern, replacement) on lower-case words.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("authorise", "authorize"), ("authorised", "authorized"), ("favour", "favor"), ("organisation", "organization"),
    ("noninfringement", "non infringement"), ("copyright holders", "copyright owners"), ("copyright holder", "copyright owner"),
    ("cancelled", "canceled"), ("whilst", "while"), ("per cent", "percent"), ("wilful", "willful"), ("fulfilment", "fulfillment"),
    ("programme", "program"), ("https", "http"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
#: Licence texts and one-line notices, by SPDX name and form.
KNOWN = (
    ("MIT", "text", "MIT License\n" + _MIT),
    ("MIT", "text", _MIT),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("ISC", "text", "ISC License\n" + _ISC),
    ("ISC", "text", _ISC),
    ("ISC", "notice", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "text", _APACHE),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-or-later", "text", _GPL3),
    ("GPL-3.0-only", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "notice", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "notice", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "notice", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


#: Whole texts, one file per licence with its SPDX name.
TEXTS = Path(__file__).with_name("license_texts")
#: Headings that copies of a text carry or lack.
HEADINGS = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "ISC": ("", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", "The 2-Clause BSD License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("", "BSD 3-Clause License", "The 3-Clause BSD License", "The BSD 3-Clause License", "New BSD License", "BSD License"),
}
_CLAUSE_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
#: Where the advice on use begins that many copies leave out.
ADVICE = re.compile(r"\n[ \t]*(APPENDIX: How to apply|(Appendix: )?How to Apply These Terms)")


def whole_texts() -> list[tuple[str, str, str]]:
    """The texts of TEXTS and HEADINGS as (license, form, text), in the variants that copies have."""
    files = {f.stem: f.read_text(encoding="utf-8") for f in sorted(TEXTS.glob("*.txt"))}
    out = [(name, "text", text) for name, text in files.items()]
    out += [(name, "text", text[:found.start()]) for name, text in files.items() if (found := ADVICE.search(text))]
    two = files["BSD-2-Clause"]
    cut = two.index("THIS SOFTWARE IS PROVIDED")
    short = {"MIT": [_MIT], "ISC": [_ISC], "BSD-2-Clause": [two], "BSD-3-Clause": [two[:cut] + _CLAUSE_3 + two[cut:]]}
    for name, texts in short.items():
        reserved = ("", "All rights reserved.\n") if name.startswith("BSD") else ("",)
        bare = [re.sub(r"(?m)^[0-9]\. ", "* ", t) for t in texts]
        out += [(name, "text", f"{h}\n{r}{t}") for h in HEADINGS[name] for r in reserved for t in dict.fromkeys(texts + bare)]
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    """The built-in texts as (license, form, text); a larger table of the same shape may be used instead."""
    return spark.createDataFrame([*KNOWN, *whole_texts()], "license string, form string, text string")


#: Words that follow `copyright` or `(c)` in the clauses of a licence, where a line was wrapped before it or as an
#: item of a list; and what may follow `the`, `our` or `your` there.
CLAUSE_WORDS = (
    r"notices?|holders?|owners?|licen[sc]e[sd]?|licensors?|laws?|statements?|interests?|disclaimers?|permissions?|rights?|treat(?:y|ies)|protection|"
    r"infringement|status|terms?|control|information|ownership|claims?|doctrines?|patents?|trademarks?|conditions?|and|or|in|on|of|to|for|from|is|are|"
    r"as|at|that|which|with|under|it|you|your|may|must|shall|will|can|if|any|all|each|such|this|a|an|no|not|neither|where|when|use|resulting|including|representations?"
)
ARTICLES = r"(?:the|our|your)"
CLAUSE_NOUNS = r"(?:licen[sc]es?|software|library|program|work|above|following|material|original|initial|contributor|licensed)"
#: What stands ahead of a notice in its line, the words and signs of one, and what ends a word that is no notice.
AHEAD, SIGN, NO_NOTICE = r"[ \t*#/;-]*", r"copyright|\(c\)|©", r"""-|[ \t]*[.,;)'"”’/]"""
#: Lines that name a holder of rights differ from copy to copy. A sign or word alone, or before a clause, is no such line.
#: Repetitions are possessive: they go through a line of any length in a loop and never come back.
HOLDER_LINE = (
    rf"(?:^|\n){AHEAD}+(?:©|(?:copyright|\(c\))(?![a-z])(?:[ \t:-]*+(?:{SIGN})(?![a-z]))*+"
    rf"(?!{NO_NOTICE}|[ \t]*(?:\n|\z))(?![ \t:-]*(?:{CLAUSE_WORDS}|{ARTICLES}(?:(?= *(?:\n|\z))| {CLAUSE_NOUNS}))(?![a-z0-9])))[^\n]*+"
)
#: ASCII other than letters, digits and the line feed.
BETWEEN_WORDS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def spelled(form: Column) -> Column:
    """Equivalent spellings made one. Words stand between two blanks each, so neighbours share none."""
    for old, new in SPELLINGS:
        form = F.replace(form, F.lit(f" {old} ".replace(" ", "  ")[1:-1]), F.lit(f" {new} ".replace(" ", "  ")[1:-1]))
    return form


def canonical_lines(text: Column) -> Column:
    """The text with each line in canonical form, words between blanks, line feeds kept; null is empty.

    All ASCII but letters and digits separates words.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_replace(F.regexp_replace(lowered, HOLDER_LINE, "\n"), BETWEEN_WORDS, "  ")
    return spelled(F.concat(F.lit(" "), F.replace(words, F.lit("\n"), F.lit(" \n ")), F.lit(" ")))


def plain(form: Column) -> Column:
    return F.trim(F.replace(form, F.lit("  "), F.lit(" ")))


def whole_form(lines: Column) -> Column:
    """Canonical form of a whole text from `canonical_lines`: its words in one line."""
    return plain(spelled(F.regexp_replace(lines, r"[ \n]+", "  ")))


def digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form, 256))


def known_digests(known: DataFrame) -> DataFrame:
    """One row per canonical text: (_digest, _license)."""
    forms = known.select("license", whole_form(canonical_lines(F.col("text"))).alias("_form"))
    listed = forms.select(digest(F.col("_form")).alias("_digest"), "license").where("_digest is not null")
    return listed.groupBy("_digest").agg(F.min("license").alias("_license"))


def text_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license_digest, line_digests): of the whole text, and of each of its lines as 32 bytes.

    The texts are read and brought to their form once; what is written are digests.
    """
    lined = docs.select(F.col(key).alias("_key"), canonical_lines(F.col(text)).alias("_lines"))
    formed = lined.select(
        "_key", whole_form(F.col("_lines")).alias("_whole"),
        F.array_distinct(F.filter(F.transform(F.split("_lines", "\n", -1), plain), lambda x: x != "")).alias("_each"),
    )
    return cut_lineage(formed.select(
        F.col("_key").alias(key), digest(F.col("_whole")).alias("license_digest"),
        F.transform("_each", lambda x: F.unhex(F.sha2(x, 256))).alias("line_digests"),
    ))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, license_digest, license (that the entire text is, or null), notices.

    `notices` names the licences that single lines announce, sorted and comma-joined. Rows that
    share a key share their notices.
    """
    looked, listed = text_digests(docs, key, text), known_digests(known)
    lines = looked.select(F.col(key).alias("_of"), F.explode("line_digests").alias("_line"))
    announced = lines.join(listed, lines["_line"] == F.unhex(listed["_digest"])).select("_of", "_license").distinct()
    by_key = announced.groupBy("_of").agg(F.array_join(F.array_sort(F.collect_set("_license")), ",").alias("notices"))
    whole = looked.drop("line_digests").join(listed, looked["license_digest"] == listed["_digest"], "left")
    joined = whole.join(by_key, whole[key].eqNullSafe(by_key["_of"]), "left")
    return joined.select(key, "license_digest", F.col("_license").alias("license"), F.coalesce("notices", F.lit("")).alias("notices"))
