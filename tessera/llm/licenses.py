"""Licence scans by canonical digests of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spellings that count as the same word, as (pattern, replacement) on lower-case text without punctuation.
EQUIVALENT = (
    (r"\b(sub ?)?licenc", "$1licens"), (r"\bnon commercial\b", "noncommercial"), (r"\bsub licens", "sublicens"),
    (r"\bcopyright (owner|holder)s?\b", "copyright holder"), (r"\bsoft ware\b", "software"), (r"\bwhils?t\b", "while"), (r"\bhttps?\b", "http"),
)
#: Notices and short licences known from the start: (id, text). Public texts.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2, BSD_3 = _BSD + _BSD_END, _BSD + _BSD_THIRD + _BSD_END
BSD_0 = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN = (
    ("BSD-2-Clause", BSD_2), ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_2), ("BSD-3-Clause", BSD_3), ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_3),
    ("0BSD", BSD_0), ("0BSD", "BSD Zero Clause License\n" + BSD_0), ("Unlicense", UNLICENSE), ("BSL-1.0", BOOST),
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License\n" + MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC), ("ISC", "ISC License\n" + ISC), ("Zlib", ZLIB), ("Zlib", "zlib License\n" + ZLIB),
    ("Apache-2.0", APACHE_HEADER), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: Catalogues up to this many texts are sent to every task; larger ones are joined by exchange.
MOST_SENT = 10_000
#: Keys over which the copies of one text with notices are dealt.
SALTS = 16
#: Lines without this word, in lower case with c for s, cannot be a notice; catalogue texts of one line must have it.
MARK = "licen"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, one space between words, one spelling.

    Only A to Z change case, and letters outside ASCII stay. A copyright line begins, after white space and comment
    marks, with "copyright", "(c)" or the sign and has a year or a sign on it.
    """
    out = F.translate(text, UPPER, LOWER)
    out = F.regexp_replace(out, r"(^|\n)[ \t/*#;]*(copyright|\(c\)|©)[^\n]*([0-9][0-9][0-9][0-9]|\(c\)|©)[^\n]*", "$1")
    out = F.trim(F.regexp_replace(out, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " "))
    for pattern, new in EQUIVALENT:
        out = F.regexp_replace(out, pattern, new)
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def catalogue(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license_id) of known licence texts: those of KNOWN, or a table (license_id, text); of equal texts the first id stays."""
    if known is None:
        rows = ", ".join("('" + i + "', '" + t.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "')" for i, t in KNOWN)
        known = spark.sql(f"SELECT * FROM VALUES {rows} AS t(license_id, text)")
    return known.where(canonical(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def read_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(license_id, text) from a folder of licence texts, a file each, named by its id with or without an ending .txt: for
    the long licences, whose texts are not in this module."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.txt)?$", 1)
    return spark.read.text(folder, wholetext=True).select(name.alias("license_id"), F.col("value").alias("text"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """For each row of docs: doc_id, digest of the canonical text, license_id of a whole-text match, and notice_ids.

    notice_ids are the sorted licences whose notice is one whole line of the text, found by the same digests. Null,
    empty and blank texts have the digest of nothing and match nothing. Repeated rows each get their result, and other
    columns are not read. The catalogue is sent to all tasks if it is small, so whole texts are matched where they are; the
    notices of texts with such lines come back by a salted exchange of digests.
    """
    spark = docs.sparkSession
    table = catalogue(spark, known)
    small = table.limit(MOST_SENT + 1).count() <= MOST_SENT
    sent = F.broadcast(table) if small else table
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(F.translate(x, UPPER, LOWER), F.lit(MARK)))
    rows = docs.select("doc_id", digest(text).alias("digest"), F.array_distinct(F.transform(lines, digest)).alias("lines"))
    whole = rows.join(sent, "digest", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    some = whole.where(F.size("lines") > 0).select("digest", F.explode(F.array_distinct("lines")).alias("line")).distinct()
    other = table.select(F.col("digest").alias("line"), F.col("license_id").alias("notice"))
    found = some.join(F.broadcast(other) if small else other, "line").groupBy("digest").agg(F.array_sort(F.collect_set("notice")).alias("notice_ids"))
    # only texts with lines have a key that others have, dealt over SALTS keys where a text has very many copies
    at = lambda n: F.concat_ws(":", "digest", n.cast("string"))
    found = found.select(F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("n"), "digest", "notice_ids").select(at(F.col("n")).alias("key"), "notice_ids")
    keyed = whole.withColumn("key", F.when(F.size("lines") > 0, at(F.col("salt"))).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    none = F.array().cast("array<string>")
    return keyed.join(found, "key", "left").select("doc_id", "digest", "license_id", F.coalesce("notice_ids", none).alias("notice_ids"))


def oracle_sql() -> str:
    """The same query in DuckDB's SQL."""
    def canon(x: str) -> str:
        x = f"translate({x}, '{UPPER}', '{LOWER}')"
        x = f"regexp_replace({x}, '(^|\\n)[ \\t/*#;]*(copyright|\\(c\\)|©)[^\\n]*([0-9][0-9][0-9][0-9]|\\(c\\)|©)[^\\n]*', '\\1', 'g')"
        x = f"trim(regexp_replace({x}, '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'))"
        for pattern, new in EQUIVALENT:
            x = f"regexp_replace({x}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
        return f"sha256({x})"

    rows = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in KNOWN)
    return f"""WITH k AS (SELECT {canon('text')} AS digest, min(license_id) AS license_id FROM (VALUES {rows}) t(license_id, text) GROUP BY 1),
d AS (SELECT doc_id, {canon("coalesce(text, '')")} AS digest, coalesce(text, '') AS text FROM documents),
l AS (SELECT DISTINCT doc_id, digest, unnest(string_split(text, chr(10))) AS line FROM d WHERE lower(text) LIKE '%{MARK}%'),
n AS (SELECT l.digest, list_sort(list(DISTINCT k.license_id)) AS ids FROM l JOIN k ON {canon('l.line')} = k.digest WHERE lower(line) LIKE '%{MARK}%' GROUP BY l.digest)
SELECT d.doc_id, d.digest, k.license_id, array_to_string(coalesce(n.ids, []), ',') AS notice_ids, k.license_id IS NOT NULL AS is_license
FROM d LEFT JOIN k ON d.digest = k.digest LEFT JOIN n ON d.digest = n.digest"""
