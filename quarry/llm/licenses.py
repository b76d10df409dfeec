"""License scans by canonical digests, in DataFrame functions only.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, white space), digested, and looked up by a
hash join in a table of digests of known licence texts. The same lookup over the lines of a row, in the row, finds
one-line notices.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import pick

#: (pattern, replacement), applied in this order to lower-case text. Java and RE2 both read them.
COPYRIGHT_LINE = (r"(^|\n)[ \t/*#;.-]*(copyright|copyleft|\(c\)|©)[^\n]*", "\n")
#: Words after "copyright" that go on with a sentence, where a notice would name a year or a holder. Fixed values.
_PROSE = "the (?:library|software|program|work)|notices?|holders?|owners?|ownership|laws?|licen[cs]\\w*|statements?|interests?|rights?|and|or|in|on|of|to|for|from|is|are|as|with|that|which|under|disclaimers?|treat(?:y|ies)|acts?|protection|permissions?|lines?|headers?|status|materials?|terms?|doctrines?|attributions?|claims?|assignments?|infringements?|works?|registrations?|office"
#: Notices alone, by what COPYRIGHT_LINE deletes: not a line of a sentence that is wrapped before the word, nor an item (c).
NOTICE = (
    r"(^|\n)[ \t/*#;.-]*(copyright[ \t:,]*(\(c\)|©|[0-9])|(copyright|copyleft)[ \t:]+(?!(?:" + _PROSE + r")\b)[^\s,;.)]|©|\(c\)[ \t]*([0-9]{4}|copyright|by\b))[^\n]*",
    "\n",
)
#: What COPYRIGHT_LINE may delete of a sentence: only such texts need a second digest.
STARTS = r"(^|\n)[ \t/*#;.-]*(copyright|copyleft|\(c\))"
SPELLINGS = [
    (r"\b(sub|un)?licence(s|d|e|es)?\b", "${1}license${2}"),
    (r"\b(sub|un)?licen[cs]ing\b", "${1}licensing"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bwilfull?\b", "willful"),
    (r"\bhttps?://", "http://"),
    (r"\band/or\b", "and or"),
    (r"\bversion\s+|\bv\s*\.?\s*([0-9])", "v${1}"),
]
PUNCTUATION = (r"[^\p{L}\p{N}]+", " ")

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_0 = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: (licence, whole text). Public licence texts and the usual one-line notices.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("0BSD", _BSD_0),
    ("0BSD", "Zero-Clause BSD\n\n" + _BSD_0),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("MIT", "Apache-2.0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib", "GPL-2.0-only", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0")),
]
#: Longer licences, from files beside this one; not in the SQL. A text of the GPL or LGPL says nothing of later versions.
_FILES = {
    "Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only",
    "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
WHOLE = [(name, pkgutil.get_data("quarry.llm", f"license_texts/{file}.txt").decode()) for file, name in _FILES.items()]
_END = "END OF TERMS AND CONDITIONS"
#: The same without the appendix on how to apply them.
WHOLE += [(name, text[: text.index(_END) + len(_END)]) for name, text in WHOLE if _END in text]
#: Known texts that a table of digests may hold; more are refused. Their digests also travel with the plan, for lines.
MAX_KNOWN = 4_000


def canonical(text: Column, notice: tuple[str, str] = COPYRIGHT_LINE) -> Column:
    """Normalised text; null as empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), *notice)
    for pattern, by in SPELLINGS:
        out = F.regexp_replace(out, pattern, by.replace("${1}", "$1").replace("${2}", "$2"))
    return F.trim(F.regexp_replace(out, *PUNCTUATION))


def anchor(text: str) -> str:
    """Letters that a text must hold, whatever its case, spelling and punctuation, to have the canonical form of `text`.

    A long word that no spelling rule makes or changes; or the stem that all spellings of "license" share.
    """
    lower = "\n".join(x for x in text.lower().split("\n") if not re.match(r"[ \t/*#;.-]*(copyright|copyleft|\(c\)|©)", x))
    if re.search(r"licen[cs]", lower):
        return "licen"
    made = ("merchantab", "merchantib", "wil", "version")
    words = [w for w in re.findall(r"[a-z]{4,}", lower) if not w.startswith(made)]
    return max(words, key=len, default="")


def digests(spark, known: list[tuple[str, str]]) -> DataFrame:
    """(digest, license_id): one row for each different canonical text (by lines and by notices), the smallest licence where two share one."""
    if len(known) > MAX_KNOWN:
        raise ValueError(f"{len(known)} known texts; at most {MAX_KNOWN}")
    table = spark.createDataFrame(list(known), "license_id string, text string")
    both = F.array(*(F.sha2(canonical(F.col("text"), notice), 256) for notice in (COPYRIGHT_LINE, NOTICE)))
    return table.select(F.explode(both).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN + WHOLE) -> DataFrame:
    """docs (doc_id, text, further columns) -> doc_id, digest, license_id, line_licenses: one row for each row, in one scan.

    `digest` is the SHA-256 of the canonical whole text and license_id the known licence with that digest, or with that of
    the text less true notices only (a sentence may be wrapped before "copyright"), else null. Null
    and empty texts have the digest of the empty text, which no licence has. line_licenses: sorted licences of the lines
    of this very row that are a known text by themselves (empty if none; a line without the letters that some known text
    needs is not digested), whatever its id is. Further columns are left out. An empty table gives an empty one.
    """
    table = digests(docs.sparkSession, known)
    found = {r["digest"]: r["license_id"] for r in table.collect()}  # MAX_KNOWN texts at most, by lines and by notices
    licence_of = F.create_map(*(F.lit(x) for pair in sorted(found.items()) for x in pair)) if found else F.lit(None).cast("map<string, string>")
    needed = "|".join(sorted({anchor(text) for _, text in known}))
    lines = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(needed))  # no other line can match
    hits = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: F.try_element_at(licence_of, F.sha2(canonical(x), 256))), F.isnotnull)))
    some = F.lower("text").rlike(needed) if found else F.lit(False)
    rows = docs.select(
        "doc_id",
        F.sha2(canonical(F.col("text")), 256).alias("digest"),
        F.when(F.lower("text").rlike(STARTS), F.sha2(canonical(F.col("text"), NOTICE), 256)).alias("wrapped"),
        F.coalesce(F.when(some, hits), F.array().cast("array<string>")).alias("line_licenses"),
    )
    # MAX_KNOWN rows at most, twice
    out = rows.join(F.broadcast(table), "digest", "left").join(F.broadcast(table.toDF("wrapped", "again")), "wrapped", "left")
    return out.select("doc_id", "digest", F.coalesce("license_id", "again").alias("license_id"), "line_licenses")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text"))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


def _sql(text: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"lower(coalesce({text}, ''))"
    for pattern, by in [COPYRIGHT_LINE, *SPELLINGS, PUNCTUATION]:
        by = by.replace("${1}", "\\1").replace("${2}", "\\2")
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return f"sha256(trim({out}))"


OP6_SQL = (
    "WITH known(license_id, text) AS (VALUES " + ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN) + "), "
    f"d AS (SELECT {_sql('text')} AS digest, min(license_id) AS license_id FROM known GROUP BY 1), "
    f"l AS (SELECT doc_id, {_sql('line')} AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')), "
    "h AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses FROM l JOIN d USING (digest) GROUP BY doc_id), "
    f"w AS (SELECT doc_id, {_sql('text')} AS digest FROM documents) "
    "SELECT w.doc_id, w.digest, d.license_id, coalesce(h.line_licenses, '') AS line_licenses FROM w LEFT JOIN d USING (digest) LEFT JOIN h ON h.doc_id = w.doc_id"
)
