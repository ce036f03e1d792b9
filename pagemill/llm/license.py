"""Licence scans: sparse TF-IDF cosine of notices to templates, and inheritance from the nearest ancestor directory.

A file's notice is its lines that mention a licence; a licence file (by name) is also compared as a whole. Weights are
tf * idf with idf = ln((1 + n) / (1 + df)) + 1 over all these texts. The template of greatest cosine (rounded to six
places, then by name) is the file's own licence if that is at least LEAST. Headers, from the first to the last line of a
block and from the first to the last block that mentions a licence, and licence files are also compared to the standard
headers and to the full texts in `licenses`, with at least LEAST_WHOLE. An SPDX tag names its licence. A licence file's licence holds in its directory;
a file without one of its own inherits from the nearest directory above it that has one. Inheritance is resolved for each
directory once, by joins of directories with their ancestors, and then joined with the files.

Defined cases: a null text or one without words has no licence of its own; a null path is a file in the root directory; of
several licence files in a directory the one of greater cosine counts, then by name; repeated rows are treated alike; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import materialise

#: Wordings of public licence notices.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause New or Revised License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Licensed under the ISC License."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain, the Unlicense."),
)
MENTION = r"(?i)licen[sc]e|spdx|copyright|public domain|permission is hereby"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)(\.[a-z]+)?$"
#: Standard headers, compared as the full texts are.
HEADERS = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
#: An SPDX tag and its expression, which ends with the line or the comment.
SPDX = r"(?i:SPDX-License-Identifier):[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+()-]+)*)"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LEAST = 0.5
#: Whole texts share their common words with any prose, and copies of them reach more.
LEAST_WHOLE = 0.7
#: Terms with a weight (some 20 bytes each) up to which they are broadcast.
BROADCAST_TERMS = 500_000
#: Directories with a licence (path and name) up to which they are broadcast.
BROADCAST_ROWS = 100_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0))


def weighted(units: DataFrame, idf: DataFrame, unseen: float, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Weights of units' terms (keys, term, w), and the norm of each unit. unseen: the idf of terms without one."""
    tf = units.repartition(*keys).select(*keys, F.explode(terms(F.col("unit"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    w = tf.join(idf, "term", "left").select(*keys, "term", (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("w"))
    return w, w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def whole_templates() -> list[tuple[str, str]]:
    """Standard headers and the full texts that lie in `licenses`, by name."""
    return [*HEADERS, *((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt")))]


def headers(text: Column) -> Column:
    """The first block (lines up to a blank one) that mentions a licence, and all from it to the last such block."""
    blocks = F.split(text, r"\n[ \t\r]*(?:\n[ \t\r]*)*\n")
    flags = F.transform(blocks, lambda b: b.rlike(MENTION))
    first = F.array_position(flags, True).cast("int")
    last = F.size(flags) + 1 - F.array_position(F.reverse(flags), True).cast("int")
    both = F.array(F.get(blocks, first - 1), F.array_join(F.slice(blocks, first, last - first + 1), "\n"))
    return F.when(text.rlike(MENTION) & (first > 0), F.when(last > first, both).otherwise(F.slice(both, 1, 1)))


def tagged(files: DataFrame) -> DataFrame:
    """key, license and score of keys whose text has an SPDX tag: the expression, a simple one without -only, -or-later and +."""
    tag = F.regexp_extract(F.coalesce("text", F.lit("")), SPDX, 1)
    name = F.when(tag.rlike(r"^[A-Za-z0-9.+-]+$"), F.regexp_replace(tag, r"(?i)(?:-only|-or-later|\+)$", "")).otherwise(tag)
    return files.select("key", name.alias("license"), F.lit(1.0).alias("score")).where("license <> ''")


def owned(files: DataFrame, least: float = LEAST) -> DataFrame:
    """key, license and score of each key of files (key, path, text) whose notice matches a template."""
    text = F.coalesce("text", F.lit(""))
    lines = F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(MENTION)), "\n")
    whole = F.when(F.coalesce("path", F.lit("")).rlike(LICENCE_FILE), text)
    units = files.select("key", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("part"), F.when(text.rlike(MENTION), lines).alias("unit")), F.struct(F.lit(1).alias("part"), whole.alias("unit"))), lambda u: u["unit"].isNotNull() & (u["unit"] != ""))).alias("u"))
    units = materialise(units.select("key", "u.part", "u.unit").distinct(), "units")
    blocks = files.select("key", F.posexplode(headers(text)).alias("part", "unit")).select("key", (F.col("part") + 2).alias("part"), "unit").distinct()
    blocks = materialise(blocks, "blocks")
    spark = files.sparkSession
    every = [*((name, text, False) for name, text in TEMPLATES), *((name, text, True) for name, text in whole_templates())]
    templates = spark.createDataFrame([(i, *t) for i, t in enumerate(every)], "template int, license string, unit string, whole boolean")
    n = units.count()
    df = units.select("key", "part", F.explode(F.array_distinct(terms(F.col("unit")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known = templates.select(F.explode(terms(F.col("unit"))).alias("term")).distinct()
    # Terms of no template only count in norms; terms of templates that no text has keep their greatest idf.
    idf = df.join(known, "term", "full").select("term", (F.log((1 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    idf = materialise(idf, "idf")
    idf = F.broadcast(idf) if idf.count() <= BROADCAST_TERMS else idf  # units stay where they are
    w, norms = weighted(units.unionByName(blocks), idf, float(math.log(1 + n)) + 1, "key", "part")
    v, sizes = weighted(templates, idf.join(F.broadcast(known), "term"), 0.0, "template", "license", "whole")
    pattern = v.join(sizes, ["template", "license", "whole"]).select("template", "license", "whole", "term", (F.col("w") / F.col("norm")).alias("v"))
    # The templates bound the pattern. Notices go with the short ones, header blocks with the whole ones, licence files with both.
    pairs = w.join(F.broadcast(pattern), "term").where(F.when(F.col("whole"), F.col("part") >= 1).otherwise(F.col("part") <= 1))
    dots = pairs.groupBy("key", "part", "template", "license", "whole").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dots.join(norms, ["key", "part"]).select("key", "license", "whole", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    cosine = cosine.where(F.col("score") >= F.when(F.col("whole"), F.lit(max(least, LEAST_WHOLE))).otherwise(F.lit(least))).drop("whole").unionByName(tagged(files))
    best = F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b")
    return cosine.groupBy("key").agg(best).select("key", "b.license", (-F.col("b.minus")).alias("score"))


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(path: Column) -> Column:
    """The directory itself and all above it, the root as ''."""
    parts = F.split(path, "/")
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """For each row of files (key, path, text): key, path, own_license, own_score, license and inherited_from."""
    own = materialise(owned(files, least), "owned")
    places = files.select("key", F.coalesce("path", F.lit("")).alias("path")).withColumn("dir", directory(F.col("path")))
    licensed = places.where(F.col("path").rlike(LICENCE_FILE)).distinct().join(own, "key")
    licensed = licensed.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b")).select(F.col("dir").alias("from"), F.col("b.license").alias("given"))
    licensed = materialise(licensed, "licensed")
    small = licensed.count() <= BROADCAST_ROWS
    above = places.select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("from"))
    nearest = above.join(F.broadcast(licensed) if small else licensed, "from").groupBy("dir").agg(F.max(F.struct(F.length("from").alias("depth"), "from", "given")).alias("b")).select("dir", "b.from", "b.given")
    out = places.join(own, "key", "left").join(nearest, "dir", "left")
    inherits = F.col("license").isNull() & F.col("given").isNotNull()
    return out.select("key", "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"), F.coalesce("license", "given").alias("license"), F.when(inherits, F.col("from")).alias("inherited_from"))
