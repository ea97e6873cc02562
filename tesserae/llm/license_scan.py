"""Licence scans by Dice coefficient over word bigrams.

A document is normalised (lower case; anything but letters and digits becomes one space) and its units are compared, as sets of
word bigrams, with licence templates: 2 * common / (size + size). Units are the lines, the whole text and, for each template, the
windows of the template's own number of words that start at one of its bigrams; so a licence is also found in the middle of other words, or wrapped
over several lines. A coefficient of at least t asks for sizes within a factor of t / (2 - t) and
(2 - t) / t, and for t / (2 - t) of the template's bigrams in the document: both prune the candidate templates before any
comparison. Everything happens inside a row; nothing is shuffled.

Null and empty texts match nothing. Units of fewer than two words have no bigrams and match nothing. Ties go to the
longer template, then to the one listed first. Repeated rows are scanned each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licences by SPDX name, with the notices that announce them and, where short, their whole texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare "
        "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)


def pairs(unit: Column) -> Column:
    """64-bit hashes of the word bigrams of normalised text, in order."""
    words = F.array(F.filter(F.split(unit, " "), lambda w: w != ""))
    n = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    return F.transform(words, lambda w: F.zip_with(F.slice(w, F.lit(1), n(w)), F.slice(w, F.lit(2), n(w)), lambda a, b: F.xxhash64(a, b)))[0]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\n]+", " ")


def scan_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, dice: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, license, score, matches) for each row: the best template's licence and coefficient, or null and 0, and the number
    of templates that match a unit."""
    spark = docs.sparkSession
    listed = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(templates)], "k int, t string")
    sets = {r[0]: r[1] for r in listed.select("k", pairs(normalised(F.col("t")))).collect()}  # one row for each template
    lengths = {k: len(s) for k, s in sets.items()}
    sets = {k: sorted(set(s)) for k, s in sorted(sets.items()) if s}
    if not sets:
        return docs.select(F.col(id_col), F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("score"), F.lit(0).alias("matches"))
    literal = lambda s: f"array({','.join(f'{h}L' if h != -(1 << 63) else 'cast(-9223372036854775808 as bigint)' for h in s)})"
    among = lambda s: ",".join(map(str, s))
    needed = {k: len(s) * dice / (2 - dice) for k, s in sets.items()}
    # candidates: templates of whose bigrams the document has enough
    likely = [f"CASE WHEN size(known) >= {needed[k]!r}D AND size(filter(known, x -> x IN ({among(s)}))) >= {needed[k]!r}D THEN {k} END" for k, s in sets.items()]
    names = F.array(*[F.lit(name) for name, _ in templates])
    norm = normalised(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col), norm.alias("norm"))
    rows = rows.withColumn("grams", pairs(F.translate("norm", "\n", " ")))
    every = sorted({h for s in sets.values() for h in s})
    rows = rows.withColumn("known", F.expr(f"array_distinct(filter(grams, x -> x IN ({among(every)})))"))
    rows = rows.withColumn("likely", F.expr(f"CASE WHEN size(known) >= {min(needed.values())!r}D THEN array_compact(array({','.join(likely)})) ELSE array() END"))
    # the rest concerns few documents: units are made only for those
    lines = F.when(F.size("likely") > 0, F.filter(F.transform(F.split("norm", "\\n"), lambda u: F.array_distinct(pairs(u))), lambda s: F.size(s) > 0))
    rows = rows.withColumn("units", F.when(F.size("likely") > 0, F.concat(lines, F.array(F.array_distinct("grams")))))
    score = "2D * size(array_intersect({0}, u)) / (size({0}) + size(u))"
    bests = []
    for k, s in sets.items():
        windows = f"transform(filter(sequence(1, size(grams)), i -> grams[i - 1] IN ({among(s)})), i -> array_distinct(slice(grams, i, {lengths[k]})))"
        best = f"array_max(transform(filter(concat(units, {windows}), u -> size(u) >= {needed[k]!r}D AND size(u) <= {len(s) * (2 - dice) / dice!r}D), u -> {score.format(literal(s))}))"
        bests.append(f"CASE WHEN array_contains(likely, {k}) THEN struct({best} AS score, {len(s)} AS size, {-k} AS k) END")
    rows = rows.withColumn("hits", F.expr(f"CASE WHEN size(likely) > 0 THEN filter(array({','.join(bests)}), b -> b.score >= {dice!r}D) END"))
    rows = rows.withColumn("top", F.array_max("hits")).withColumn("n", F.coalesce(F.size("hits"), F.lit(0)))
    found = F.col("n") > 0
    return rows.select(
        F.col(id_col),
        F.when(found, F.element_at(names, 1 - F.col("top.k"))).alias("license"),
        F.when(found, F.col("top.score")).otherwise(F.lit(0.0)).alias("score"),
        F.greatest("n", F.lit(0)).alias("matches"),
    )


def oracle_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, dice: float = 0.8) -> str:
    """The same scan of table `documents` in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({k}, {quote(name)}, {quote(text)})" for k, (name, text) in enumerate(templates))
    norm = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    grams = "list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    words = "list_filter(string_split({}, ' '), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT k, name, {words.format(norm.format('body'))} AS w FROM (VALUES {listed}) v(k, name, body)),
tb AS (SELECT k, name, len(w) - 1 AS wide, list_distinct({grams.format(w='w')}) AS g FROM t),
tg AS (SELECT k, unnest(g) AS gram FROM tb),
n AS (SELECT row_number() OVER () AS row_id, doc_id, {norm.format("coalesce(text, '')")} AS n FROM documents),
w AS (SELECT row_id, {words.format("replace(n, chr(10), ' ')")} AS w FROM n),
dg AS (SELECT row_id, {grams.format(w='w')} AS g FROM w),
lw AS (SELECT row_id, {words.format('line')} AS w FROM (SELECT row_id, unnest(string_split(n, chr(10))) AS line FROM n)),
u AS (SELECT row_id, NULL AS k, list_distinct(g) AS g FROM dg
      UNION ALL SELECT row_id, NULL, list_distinct({grams.format(w='w')}) FROM lw WHERE len(w) > 1),
starts AS (SELECT DISTINCT row_id, i, k FROM (SELECT row_id, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS gram FROM dg) JOIN tg USING (gram)),
x AS (SELECT starts.row_id, starts.k, list_distinct(dg.g[i:i + wide - 1]) AS g FROM starts JOIN dg USING (row_id) JOIN tb ON starts.k = tb.k
      UNION ALL SELECT row_id, tb.k, u.g FROM u, tb WHERE len(list_intersect(u.g, tb.g)) > 0),
d AS (SELECT row_id, x.k, any_value(len(tb.g)) AS size, max(2e0 * len(list_intersect(x.g, tb.g)) / (len(x.g) + len(tb.g))) AS score FROM x JOIN tb ON x.k = tb.k GROUP BY row_id, x.k),
h AS (SELECT * FROM d WHERE score >= {dice}),
b AS (SELECT row_id, max(score) AS score, arg_min(k, (-score, -size, k)) AS k, count(*) AS matches FROM h GROUP BY row_id)
SELECT n.doc_id, t.name AS license, coalesce(b.score, 0e0) AS score, CAST(coalesce(b.matches, 0) AS INTEGER) AS matches
FROM n LEFT JOIN b ON n.row_id = b.row_id LEFT JOIN t ON b.k = t.k"""
