"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Units are each whole text (a licence file), each line, and each block of several lines (a header: a notice wrapped over
lines, up to a line that is blank or has comment marks alone). Templates are short notices, file headers and whole texts
of short licences; long licences are known by the notice that they end with, which is a block. Inverse document
frequencies of all terms are counted over all texts. For each template its rarest terms are anchors, so many that the others'
weight alone stays under the threshold: a unit without any anchor can't reach it. Nor can one with fewer of the template's
terms than the heaviest that reach the threshold's square together. Only units that pass both are scored. A file's own licence is its best unit's. A licence file (by name, or by the cosine of
its whole text) licenses its directory; a file without an own licence takes that of the nearest ancestor directory that
has one, by an equi-join of the distinct directories' ancestors.

Only DataFrame operations run. Defined results: a null or empty text has no own licence; a null path has no directory
and inherits nothing. Ties go to the licence whose name sorts first. Repeated rows are each judged. Columns beside id,
path and text are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import materialise, table

#: Least cosine of a line or block, and of a whole text, to a template.
LINE_COSINE, FILE_COSINE = 0.7, 0.6
#: Terms of most texts whose inverse frequencies are broadcast; units' other terms meet theirs by a shuffle.
COMMON = 50_000
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: A licence file by its name.
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying)([.-][^/]*)?$"
#: Lines that end a block: blank ones and those of comment marks alone.
_BETWEEN = r"\n(?:[ \t]*(?:#+|//+|/?\*+/?|;+|--+|%+|<!--|-->|\"\"\")?[ \t]*\r?\n)+"
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin
of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be
plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def _gnu(licence: str, version: str) -> list[str]:
    """The blocks of the notice that a licence of this family ends with; its first one also stands alone."""
    first = f"""This program is free software: you can redistribute it and/or modify it under the terms of the {licence} as published
by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
    rest = f"""This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {licence} for more details. You should have received a copy
of the {licence} along with this program. If not, see <https://www.gnu.org/licenses/>."""
    return [first, f"{first} {rest}"]


#: Notices, headers and whole texts by which licences are known.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_AS_IS}"),
    ("ISC", _ISC),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_AS_IS}"),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    *[("AGPL-3.0", x) for x in _gnu("GNU Affero General Public License", "3")],
    *[("GPL-2.0", x) for x in _gnu("GNU General Public License", "2")],
    *[("GPL-3.0", x) for x in _gnu("GNU General Public License", "3")],
    *[("LGPL-2.1", x) for x in _gnu("GNU Lesser General Public License", "2.1")],
    *[("LGPL-3.0", x) for x in _gnu("GNU Lesser General Public License", "3")],
]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TERM), F.lit(0))


def units(text: Column) -> Column:
    """The whole text, its lines, and its blocks of several lines where there are several blocks."""
    blocks = F.split(text, _BETWEEN)
    several = F.filter(blocks, lambda b: F.contains(b, F.lit("\n")) & (F.size(blocks) > 1))
    return F.concat(F.array(text), F.split(text, "\n"), several)


def template_terms(spark: SparkSession, templates: list[tuple[str, str]]) -> list[tuple[int, str, str, int]]:
    """(template, licence, term, count): as many rows as the templates have distinct terms."""
    made = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, licence string, text string")
    made = made.select("template", "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "licence", "term").count()
    return [tuple(r) for r in made.orderBy("template", "term").collect()]


def weigh(rows: list[tuple[int, str, str, int]], frequency: dict[str, int], total: int) -> tuple[list[tuple], set[str], list[tuple[list[str], int]]]:
    """(template rows with unit weights, anchors, each template's terms and how many of them a unit needs)."""
    idf = {term: math.log((total + 1) / (frequency.get(term, 0) + 1)) + 1 for _, _, term, _ in rows}
    weighted, anchors, needs, least = [], set(), [], 0.98 * min(LINE_COSINE, FILE_COSINE) ** 2
    for template in sorted({r[0] for r in rows}):
        own = [(licence, term, n * idf[term]) for t, licence, term, n in rows if t == template]
        norm = math.sqrt(sum(w * w for *_, w in own))
        weighted += [(template, licence, term, w / norm) for licence, term, w in own]
        left, most = 1.0, 0.0
        for _, term, w in sorted(own, key=lambda x: (frequency.get(x[1], 0), -x[2], x[1])):
            if left > least:
                anchors.add(term)
                left -= (w / norm) ** 2
        for n, w in enumerate(sorted((w for *_, w in own), reverse=True), 1):
            most += (w / norm) ** 2
            if most >= least:
                needs.append((sorted(term for _, term, _ in own), n))
                break
    return weighted, anchors, needs


def scan(files: DataFrame, doc_id: str = "doc_id", path: str = "path", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, path, licence, score, origin, directory): origin is header, file, inherited or none."""
    spark = files.sparkSession
    files = files.selectExpr(f"`{doc_id}` as doc_id", f"`{path}` as path", f"`{text}` as text")
    rows = template_terms(spark, templates)
    frequency = files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").count()
    frequency, total = materialise(frequency, "frequency"), files.count()
    known = frequency.filter(F.col("term").isin(sorted({r[2] for r in rows})))
    weighted, anchors, needs = weigh(rows, {r["term"]: r["count"] for r in known.collect()}, total)
    weights = F.broadcast(spark.createDataFrame(weighted, "template int, licence string, term string, weight double"))
    inverse = frequency.select("term", (F.log(F.lit(total + 1.0) / (F.col("count") + 1)) + 1).alias("idf"))
    common = F.broadcast(inverse.orderBy("idf", "term").limit(COMMON))
    anchor = F.array(*[F.lit(a) for a in sorted(anchors)])

    keyed = files.withColumn("row_key", F.xxhash64("doc_id", "path", "text"))
    lines = keyed.filter(F.arrays_overlap(terms(F.col("text")), anchor)).select("row_key", F.posexplode(F.transform(units(F.col("text")), terms)).alias("unit", "terms"))
    enough = [F.size(F.array_intersect("terms", F.array(*[F.lit(t) for t in own]))) >= n for own, n in needs]
    scored = lines.filter(F.arrays_overlap("terms", anchor)).filter(reduce(lambda a, b: a | b, enough))
    counted = scored.select("row_key", "unit", F.explode("terms").alias("term")).groupBy("row_key", "unit", "term").agg(F.count("*").alias("n"))
    counted = materialise(counted.join(common, "term", "left"), "terms")
    rare = counted.filter("idf is null").drop("idf").join(inverse, "term")
    counted = counted.filter("idf is not null").unionByName(rare).withColumn("w", F.col("n") * F.col("idf"))
    counted = materialise(counted, "units")
    norms = counted.groupBy("row_key", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = counted.join(weights, "term").groupBy("row_key", "unit", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["row_key", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    least = F.when(F.col("unit") == 0, F.lit(FILE_COSINE)).otherwise(F.lit(LINE_COSINE))
    scored = scored.filter(F.col("score") >= least)
    best = F.min_by(F.struct("licence", "score", "unit"), F.struct(-F.col("score"), F.col("licence"), F.col("unit")))
    own = scored.groupBy("row_key").agg(best.alias("own"), F.max(F.col("unit") == 0).alias("whole"))
    judged = keyed.select("row_key", "doc_id", "path").join(own, "row_key", "left")
    judged = judged.withColumn("folder", F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"^([\s\S]*)/", 1)).when(F.col("path").isNotNull(), F.lit("")))
    judged = materialise(judged, "judged")

    makes = judged.filter(F.col("own").isNotNull() & F.col("folder").isNotNull() & (F.col("whole") | F.col("path").rlike(FILE_NAME)))
    licensed = makes.groupBy("folder").agg(F.min_by(F.col("own.licence"), F.struct(-F.col("own.score"), F.col("own.licence"))).alias("inherited"))
    seeking = judged.filter(F.col("own").isNull() & F.col("folder").isNotNull()).select("folder").distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    climbed = seeking.select("folder", F.posexplode(above).alias("depth", "directory"))
    climbed = climbed.join(licensed.withColumnRenamed("folder", "directory"), "directory")
    nearest = climbed.groupBy("folder").agg(F.max_by(F.struct("directory", "inherited"), "depth").alias("near"))
    out = judged.join(nearest, "folder", "left")
    taken = F.col("own").isNull()
    return out.select(
        "doc_id",
        "path",
        F.when(taken, F.col("near.inherited")).otherwise(F.col("own.licence")).alias("licence"),
        F.when(taken, F.lit(0.0)).otherwise(F.col("own.score")).alias("score"),
        F.when(~taken & F.col("own.unit").eqNullSafe(0), "file").when(~taken, "header").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(taken, F.col("near.directory")).otherwise(F.col("folder")).alias("directory"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """``documents`` have no path; their source, thousand and id are taken as one."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.select("doc_id", path.alias("path"), "text"))
