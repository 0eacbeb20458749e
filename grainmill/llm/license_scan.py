"""Licence scan by canonical digests; DataFrame functions only.

A text and each of its lines are brought to a canonical form (lower case, copyright notices dropped,
equivalent spellings unified, everything but letters and digits folded to single spaces) and
looked up by the SHA-256 of that form: the whole text among known licence texts, single lines among
known licence notices. The table of digests is made from `KNOWN_TEXTS` and the notices that `NAMES` and `FRAMES`
give, from texts and notices of the caller's (`known_table`), or from a folder of files (`texts_in`). It is broadcast
while it has at most `max_broadcast` entries, and joined by shuffle beyond that. Every line is brought to its
canonical form; only those as long as some known notice are digested.

`KNOWN_TEXTS` has the short licences whole, and of Apache-2.0 its notice; long ones (the GPL family, MPL,
Creative Commons) are known by their notice lines until a caller gives their texts.

Documents are told apart by (id, text hash): rows equal in both are one result row with `n_rows`. Defined results:
null, empty and symbol-only texts have an empty canonical form, which matches nothing; whole texts are
normalised, however long; null ids are kept; an empty table gives none; columns other than id and text are
not looked at and not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grainmill.llm._common import Placed
from grainmill.llm._text import settled

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Whole texts of common licences, by SPDX identifier, without titles and copyright lines.
KNOWN_TEXTS = {"MIT": _MIT, "ISC": _ISC, "0BSD": _ZERO_BSD, "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL, "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "Apache-2.0": _APACHE_HEADER, "Zlib": _ZLIB}
TITLES = {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Apache-2.0": None, "Zlib": "zlib License"}
#: Names in notices, by SPDX identifier.
NAMES = {
    "MIT": ["MIT License", "the MIT License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "GPL-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "GPL-3.0"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD-3-Clause"],
    **{f"CC-{k.upper().replace(' ', '-')}-4.0": [f"CC {k} 4.0", f"a Creative Commons {long} 4.0 International License", f"CC-{k.upper().replace(' ', '-')}-4.0"] for k, long in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items()},
    "CC0-1.0": ["CC0 1.0", "CC0-1.0", "the CC0 1.0 Universal Public Domain Dedication"],
}
#: Notice lines.
FRAMES = ["Licensed under {}.", "This work is licensed under {}.", "This file is licensed under {}.", "This software is licensed under {}.", "Released under {}.", "Distributed under {}.", "Available under {}.", "SPDX-License-Identifier: {}"]

#: Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = {"licence": "license", "sub-license": "sublicense", "non-infringement": "noninfringement", "acknowledgement": "acknowledgment", "https:": "http:", "&": " and "}
#: A line that states a copyright: with a sign, a year, a placeholder or a holder behind the word; not one that goes on about copyright.
COPYRIGHT_LINE = r"(?m)^[ \t/*#;>-]*(copyright[ \t:]*(\(c\)|©|[0-9]{4}|<|\[|by )|\(c\)[ \t]|©|all rights reserved)[^\n]*$"


def canonical(c: Column) -> Column:
    """The canonical form; '' if no letter or digit is left."""
    t = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    t = F.when(F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("(c)")) | F.contains(t, F.lit("©")) | F.contains(t, F.lit("all rights reserved")), F.regexp_replace(t, COPYRIGHT_LINE, "")).otherwise(t)
    for a, b in SPELLINGS.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.btrim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def known_table(spark: SparkSession, texts: dict[str, list[str]] | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """(unit, digest, n, license_id): the digests and lengths of the given texts' (unit 'text') and lines' (unit 'line') canonical forms."""
    if texts is None:
        texts = {k: [v] + ([f"{TITLES[k]}\n{v}"] if TITLES[k] else []) for k, v in KNOWN_TEXTS.items()}
    if notices is None:
        notices = {k: [f.format(n) for n in names for f in FRAMES] for k, names in NAMES.items()}
    rows = [(unit, k, v) for unit, table in (("text", texts), ("line", notices)) for k, vs in table.items() for v in vs]
    df = spark.createDataFrame(rows, "unit string, license_id string, t string").withColumn("c", canonical(F.col("t")))
    return df.where("c != ''").groupBy("unit", F.sha2("c", 256).alias("digest"), F.length("c").alias("n")).agg(F.min("license_id").alias("license_id"))


def texts_in(spark: SparkSession, path: str) -> DataFrame:
    """(unit, digest, n, license_id) of the whole licence texts in a folder: files named by identifier, with or without a suffix such as .txt."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.(txt|md)$", "")
    read = spark.read.format("binaryFile").load(path).select(name.alias("license_id"), canonical(F.col("content").cast("string")).alias("c"))
    return read.where("c != ''").groupBy(F.lit("text").alias("unit"), F.sha2("c", 256).alias("digest"), F.length("c").alias("n")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", max_broadcast: int = 100_000, max_lengths: int = 5000) -> DataFrame:
    """(id, key, n_rows, canonical_sha256, license_id, notices): per document the digest of its canonical text, the licence it is, or null, and the sorted licences that lines of it name.

    Lines are picked by their length while the known notices have at most max_lengths different ones; else each is digested.
    """
    known = known_table(docs.sparkSession) if known is None else known
    lengths = [r["n"] for r in known.where("unit = 'line'").select("n").distinct().limit(max_lengths + 1).collect()]
    known = known.select(F.col("unit").alias("ku"), F.col("digest").alias("kd"), "license_id")
    known = F.broadcast(known) if known.count() <= max_broadcast else known
    placed = Placed(docs)
    t = placed(text).cast("string")
    d = placed.df.select(placed(id_col).alias("id"), F.xxhash64(t).alias("key"), F.coalesce(t, F.lit("")).alias("t"))
    whole = F.struct(F.lit("text").alias("unit"), F.sha2(canonical(F.col("t")), 256).alias("digest"))
    d = d.withColumn("lines", settled(F.transform(F.array_distinct(F.split("t", "\n")), canonical)))
    fits = lambda x: F.length(x).isin(lengths) if lengths and len(lengths) <= max_lengths else F.lit(bool(lengths)) & (x != "")
    lines = F.transform(F.filter("lines", fits), lambda x: F.struct(F.lit("line").alias("unit"), F.sha2(x, 256).alias("digest")))
    u = d.select("id", "key", settled(F.concat(F.array(whole), lines)).alias("u")).select("id", "key", F.explode_outer("u").alias("u")).select("id", "key", "u.*")
    met = u.join(known, (F.col("digest") == F.col("kd")) & (F.col("unit") == F.col("ku")), "left").where("unit = 'text' or license_id is not null")
    is_text = F.col("unit") == "text"
    return met.groupBy("id", "key").agg(
        F.count_if(is_text).alias("n_rows"),
        F.max(F.when(is_text, F.col("digest"))).alias("canonical_sha256"),
        F.max(F.when(is_text, F.col("license_id"))).alias("license_id"),
        F.sort_array(F.collect_set(F.when(~is_text, F.col("license_id")))).alias("notices"),
    )
