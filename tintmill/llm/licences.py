"""Licence scans by canonical digest.

A text becomes canonical when case, punctuation, white space, copyright lines and equivalent
spellings no longer tell it from another copy. Digests of entire canonical texts are hash-joined to
those of the known licences; so are the digests of a text's single lines, which find notices. A
spelling is replaced word for word, so the number of words alone rules most texts out beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small

# Spellings that count as equivalent, the second standing for both.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Notices and the texts of short public licences.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
]

# The third clause stands between the conditions and the disclaimer of the shorter licence.
KNOWN += [
    (
        "BSD-3-Clause",
        dict(KNOWN)["BSD-2-Clause"].replace(
            "THIS SOFTWARE IS",
            "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS",
            1,
        ),
    )
]

# Usual title lines, with which a licence's text is the same licence.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
}
KNOWN += [(name, f"{title}\n\n{text}") for name, text in KNOWN if "\n" in text for title in TITLES[name]]

#: A copyright line names a year, or where it goes; a line of prose that happens to begin with the word doesn't.
_COPYRIGHT = r"^[ \t]*((copyright|\(c\)|©).*([0-9]{4}|\(c\)|©|yyyy|<year>)|©|all rights reserved)"

# Licences whose texts are too long to stand here, by the digest of their canonical form, and its words.
DIGESTS = [
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2", 1602),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", 983),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 1088),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71", 3315),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6", 3732),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", 2067),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", 2975),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", 5684),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", 4200),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", 4401),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 1231),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1", 3789),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", 2426),
]


def _plain(lines: Column) -> Column:
    """Words of lower-case lines that aren't copyright lines, without punctuation, joined by spaces."""
    own = F.filter(lines, lambda x: ~x.rlike(_COPYRIGHT))
    return F.trim(F.regexp_replace(F.array_join(own, " "), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")


def _spelt(plain: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in EQUIVALENT.items() for x in pair))
    return F.array_join(F.transform(F.split(plain, " "), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for a null one."""
    return _spelt(_plain(_lines(text)))


def digests(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN, longer: Sequence[tuple[str, str, int]] = DIGESTS) -> DataFrame:
    """(digest, license_id, n_words) of known licence texts and digests, a digest once."""
    rows = spark.createDataFrame(list(known), "license_id string, text string").select("license_id", canonical(F.col("text")).alias("c"))
    own = rows.filter("c <> ''").select("license_id", F.sha2(F.col("c").cast("binary"), 256).alias("digest"), F.size(F.split("c", " ")).alias("n_words"))
    if longer:
        own = own.unionByName(spark.createDataFrame(list(longer), "license_id string, digest string, n_words int"))
    return own.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.first("n_words").alias("n_words"))


def read_known(folder: str) -> list[tuple[str, str]]:
    """(license_id, text) of a folder's text files, to be scanned for beside the list here; files are named for their licence."""
    return [(p.name.removesuffix(".txt"), p.read_text(encoding="utf-8", errors="replace")) for p in sorted(Path(folder).iterdir()) if p.is_file()]


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] = KNOWN, longer: Sequence[tuple[str, str, int]] = DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per id ``doc_id, license_id, notices``.

    ``license_id`` is the known licence that the entire text is, ``notices`` those that single lines
    of it are: ascending, distinct, joined by spaces (empty: none). Either is found whatever its
    case, punctuation, copyright lines or equivalent spelling.

    A null or empty text, or one of copyright lines alone, is no licence. Rows that share an id give
    one row, with the least ``license_id`` and the notices of all. A null id is an id. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    listed = digests(spark, known, longer).collect()
    counts = sorted({r["n_words"] for r in listed}) or [0]
    table = small(spark.createDataFrame([(r["digest"], r["license_id"]) for r in listed], "digest string, license_id string"), len(listed))

    own = docs.select(F.col(f"`{id_col}`").alias("_id"), _lines(F.col(f"`{text_col}`")).alias("_lines"))
    # The whole text first, then its lines where there are several; what has another number of words than any licence goes.
    units = F.concat(F.array(_plain(F.col("_lines"))), F.when(F.size("_lines") > 1, F.transform("_lines", lambda x: _plain(F.array(x)))).otherwise(F.array().cast("array<string>")))
    units = F.transform(units, lambda x, i: F.struct((i == 0).alias("whole"), x.alias("text")))
    found = own.select("_id", F.explode_outer(F.filter(units, lambda u: (u["text"] != "") & F.size(F.split(u["text"], " ")).isin(counts))).alias("u"))
    found = found.select("_id", "u.whole", F.when(F.col("u.text").isNotNull(), F.sha2(_spelt(F.col("u.text")).cast("binary"), 256)).alias("digest")).distinct()
    # A text of one line is a notice too.
    named = found.join(table, "digest", "left")
    return named.groupBy(F.col("_id").alias("doc_id")).agg(F.min(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"), F.array_join(F.array_sort(F.collect_set("license_id")), " ").alias("notices"))


def oracle() -> str:
    """The scan in DuckDB's SQL, comparing digests of canonical texts; from ``documents``."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    spelt = "MAP {" + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in EQUIVALENT.items()) + "}"
    plain = lambda lines: f"trim(regexp_replace(array_to_string(list_filter({lines}, lambda x: NOT regexp_matches(x, '{_COPYRIGHT}')), ' '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    words = lambda c: f"array_to_string(list_transform(string_split({c}, ' '), lambda w: coalesce({spelt}[w], w)), ' ')"
    longer = ", ".join(f"({quote(a)}, {quote(b)}, {n})" for a, b, n in DIGESTS)
    return f"""
WITH texts AS (SELECT license_id, {words(plain("string_split(lower(text), chr(10))"))} AS c FROM (VALUES {known}) k(license_id, text)),
listed AS (SELECT license_id, sha256(c) AS digest, len(string_split(c, ' ')) AS n FROM texts UNION ALL SELECT * FROM (VALUES {longer}) l(license_id, digest, n)),
known AS (SELECT min(license_id) AS license_id, digest FROM listed GROUP BY digest),
lined AS (SELECT doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS lines FROM documents),
counts AS (SELECT DISTINCT n FROM listed),
units AS (
  SELECT doc_id, true AS whole, {plain("lines")} AS t FROM lined
  UNION ALL SELECT doc_id, false, {plain("[line]")} FROM (SELECT doc_id, unnest(lines) AS line FROM lined WHERE len(lines) > 1)),
spelt AS (SELECT doc_id, whole, {words("t")} AS c FROM units WHERE t <> '' AND len(string_split(t, ' ')) IN (SELECT n FROM counts)),
named AS (SELECT doc_id, whole, license_id FROM spelt JOIN known ON sha256(c) = digest)
SELECT d.doc_id, min(CASE WHEN whole THEN license_id END) AS license_id, coalesce(array_to_string(list_sort(list_distinct(list(license_id))), ' '), '') AS notices
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN named n ON d.doc_id IS NOT DISTINCT FROM n.doc_id GROUP BY d.doc_id
"""
