"""Licence scan by canonical digest lookup, with built-in functions only.

A text is normalised (case, copyright lines, headings, list marks, punctuation, white space, equivalent spellings), digested, and the digest is
hash-joined with those of known licences. Besides the entire text, each line that names a licence is digested by the same rules, so
that one-line notices at the foot of a document are found. What lines say depends on the text alone, so it is found once for each
distinct text and joined back.

Defined cases: a null text is the empty text; an empty (or all-punctuation) text has the digest of '' and no licence; equal texts have
equal results; each row gives one row, repeated rows and null ids too; very long texts are read whole; extra columns are ignored,
whatever their names. Known texts with equal canonical forms give the smallest id. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame, functions as F

from tidepool.llm.common import hot_keys, materialize, salted_join

# Public licence texts and notices, by SPDX identifier.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
}



def known_licenses() -> dict[str, str]:
    """The texts and notices above and the files of the folder ``licenses``, one to a long licence, named by SPDX identifier."""
    texts = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in files("tidepool.llm").joinpath("licenses").iterdir() if f.name.endswith(".txt")}
    if not texts:
        raise FileNotFoundError("the licence texts of tidepool.llm are missing from this installation")
    return KNOWN | dict(sorted(texts.items()))


# Spellings taken as equal, after punctuation has become spaces; applied in this order.
EQUIVALENT = [
    ("licence", "license"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("organisation", "organization"),
    ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("copyright holder s", "copyright holders"), ("per cent", "percent"),
    ("favour", "favor"), ("https", "http"),
]

# Headings that licence files stand under, before the words they begin with; marks of list items, before the words items
# begin with; and the addresses of the Free Software Foundation. All in canonical form; (pattern, what stays: a group's number or words).
FORMS = [
    (r"^((the )?(mit|isc|zlib|x11|expat|unlicense|boost software|(simplified |new |modified |revised |original )?bsd( [0234] clause)?|[0234] clause bsd) license( (mit|isc|x11|expat|zlib))?|license|bsd [0234] clause|zlib libpng license) (permission (is|to) |redistribution and |this software is |this is free )", 8),
    (r" ([0-9]|[a-e]) (redistributions (of|in) |neither the name |the origin of |altered source |this notice may )", 2),
    (r" (51 franklin st(reet)?( fifth floor)?|59 temple place( suite 330)?|675 mass ave) (boston|cambridge) ma [0-9]{5}( [0-9]{4})?( usa)? ", " fsf address "),
]

#: A line that says who holds the copyright, as opposed to one that merely uses the word.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|\(c\)[ \t]|©|all rights reserved)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Lines worth a lookup of their own.
NAMES_LICENSE = "licen[cs]"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, letters and digits only, one space between words, equivalent spellings made equal."""
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(COPYRIGHT_LINE), F.lit(" "))
    c = F.concat(F.lit(" "), F.regexp_replace(c, F.lit(NOT_WORD), F.lit(" ")), F.lit(" "))
    c = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), EQUIVALENT, c)
    c = F.trim(F.regexp_replace(c, F.lit(" +"), F.lit(" ")))
    for pattern, kept in FORMS:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(kept if isinstance(kept, str) else f"{' ' * pattern.startswith(' ')}${kept}"))
    return c


def known_digests(spark, known: dict[str, str] | None = None) -> DataFrame:
    """(license_id, license_digest), one row per canonical form."""
    rows = list((known_licenses() if known is None else known).items())
    texts = spark.createDataFrame(rows, "license_id string, body string")
    return texts.groupBy(F.md5(canonical(F.col("body"))).alias("license_digest")).agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None) -> DataFrame:
    """Per row: id, text_digest, license_id of the entire text (or null), notices: sorted ids found on its lines, joined by commas.

    The documents are read once. Entire digests meet the known ones in a hash join, so do the digests of lines, of which those of equal
    texts are one; texts with notices, hot ones dealt over many tasks, meet their rows by the text's own digest. ``known`` maps licence
    ids to texts.
    """
    digests = known_digests(docs.sparkSession, known)
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.lower(x).rlike(NAMES_LICENSE))
    units = text.select("_id", F.md5("_text").alias("_raw"), F.md5(canonical(F.col("_text"))).alias("text_digest"), F.array_distinct(F.transform(lines, lambda x: F.md5(canonical(x)))).alias("_lines"))
    units = materialize(units, "licenses")
    said = units.select("_raw", F.explode("_lines").alias("license_digest")).join(digests, "license_digest").groupBy("_raw", "license_id").agg(F.count("*").alias("n"))
    said = materialize(said.groupBy("_raw").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("notices"), F.max("n").alias("n")), "notices")
    entire = units.join(digests.withColumnRenamed("license_digest", "text_digest"), "text_digest", "left")
    rows = salted_join(entire.select("_id", "_raw", "text_digest", "license_id"), said.drop("n"), ["_raw"], F.col("_id"), "left", hot=hot_keys(said, ["_raw"]))
    return rows.select(F.col("_id").alias(id_col), "text_digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def oracle(table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def canon(x: str) -> str:
        c = f"' ' || regexp_replace(regexp_replace(lower({x}), {quote(COPYRIGHT_LINE)}, ' ', 'g'), {quote(NOT_WORD)}, ' ', 'g') || ' '"
        for a, b in EQUIVALENT:
            c = f"replace({c}, {quote(a)}, {quote(b)})"
        c = f"trim(regexp_replace({c}, ' +', ' ', 'g'))"
        for pattern, kept in FORMS:
            stays = kept if isinstance(kept, str) else " " * pattern.startswith(" ") + "\\" + str(kept)
            c = f"regexp_replace({c}, {quote(pattern)}, {quote(stays)}, 'g')"
        return c

    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known_licenses().items())
    return f"""
with known as (select min(license_id) license_id, d from (select license_id, md5({canon('body')}) d from (values {values}) t(license_id, body)) group by d),
units as (select doc_id, coalesce(text, '') t, md5({canon("coalesce(text, '')")}) text_digest from {table}),
texts as (select distinct t from units), lines as (select distinct t, md5({canon('line')}) d from (select t, unnest(string_split(t, chr(10))) line from texts) where regexp_matches(lower(line), '{NAMES_LICENSE}')),
notices as (select t, string_agg(license_id, ',' order by license_id) n from (select distinct l.t, k.license_id from lines l join known k using (d)) group by 1)
select u.doc_id, u.text_digest, k.license_id, coalesce(n.n, '') as notices
from units u left join known k on k.d = u.text_digest left join notices n on n.t = u.t"""
