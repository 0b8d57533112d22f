"""Licence scans: TF-IDF cosine to templates, and inheritance from directories above.

DataFrame operations only.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written

# Short notices, standard headers and whole short licences as they are worded.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

# Short identifiers as they follow a tag, with the licence they stand for.
IDENTIFIERS = {
    "Apache-2.0": "Apache-2.0", "MIT": "MIT", "ISC": "ISC", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause",
    "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0",
    "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0",
    "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "MPL-2.0": "MPL-2.0", "CC-BY-4.0": "CC-BY-4.0",
    "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "CC0-1.0": "CC0-1.0", "Unlicense": "Unlicense",
}
TEMPLATES = [*NOTICES, *[(name, f"SPDX-License-Identifier: {tag}") for tag, name in IDENTIFIERS.items()]]

# A term is a word or a number with its points.
TERM = r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*"
# Every template holds one of these, and what holds none is no notice.
CUE = r"(?i)licen[sc]|permission|public\x20domain|redistribution"
LICENCE_NAME = r"(?i)^(?:un)?(?:licen[sc]e|copying)(?:[.-][^/]*)?$"
# What opens or closes a line of a comment.
COMMENT = r"(?m)^[\x20\t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|<!--|%+)|(?:\*+/|-->)[\x20\t]*\r?$"


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def weights() -> tuple[dict[str, float], float]:
    """Inverse document frequencies over the templates, and that of any other term."""
    n = len(TEMPLATES)
    held = Counter(t for _, text in TEMPLATES for t in set(terms_of(text)))
    return {t: math.log((1 + n) / (1 + d)) + 1 for t, d in held.items()}, math.log(1 + n) + 1


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def best_templates(units: DataFrame, least: float) -> DataFrame:
    """``unit, license, score, held`` for the distinct texts ``unit`` near enough to a
    template; ``held`` is the number of terms.

    Terms travel with a number in place of their text, which may be long.
    """
    spark = units.sparkSession
    idf, other = weights()
    rows = []
    for number, (name, text) in enumerate(TEMPLATES):
        vector = {t: k * idf[t] for t, k in Counter(terms_of(text)).items()}
        norm = math.sqrt(sum(w * w for w in vector.values()))
        rows += [(t, number, name, w / norm, idf[t]) for t, w in vector.items()]
    # A few hundred rows, fixed in number by the templates above.
    table = F.broadcast(spark.createDataFrame(rows, "term string, number int, license string, w double, idf double"))
    units = written(units.withColumn("no", F.monotonically_increasing_id()), "texts")
    split = units.select("no", F.explode(_terms(F.col("unit"))).alias("term"))
    counted = split.groupBy("no", "term").agg(F.count("*").alias("tf"))
    known = table.select("term", "idf").distinct()
    weighed = counted.join(F.broadcast(known), "term", "left").select(
        "no", "term", "tf", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("weight")
    )
    norms = weighed.groupBy("no").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"), F.sum("tf").alias("held"))
    dots = weighed.join(table, "term").groupBy("no", "number", "license").agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    scored = dots.join(norms, "no").withColumn("score", cosine).where(F.col("score") >= least)
    best = F.max_by(F.struct("license", "score", "held"), F.struct("score", -F.col("number")))
    found = scored.groupBy("no").agg(best.alias("best"))
    return units.join(found, "no").select("unit", "best.license", "best.score", "best.held")


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", least: float = 0.7, file_share: float = 0.8) -> DataFrame:
    """``doc_id, license, score, origin, from_dir`` for every row of ``docs``.

    A file's own licence is the template nearest to one of its lines, sentences or blocks
    of lines or to all of it, comment marks aside, if their cosine is ``least`` or more
    (equal: the longer of these, then the first template; ``origin`` is ``own``). A file is a licence file if its name says so or the matched words are
    ``file_share`` of its words. A file without a licence gets that of the licence file
    in the nearest directory above it (``inherited``; of several there the best score,
    then the first by name), else nulls. Null and empty texts have no licence of their
    own; a null path has no directories above; repeated rows are answered one by one.
    ``docs`` has to be read the same way twice, as files are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       path.cast("string").alias("path")).withColumn("row", F.monotonically_increasing_id())
    folder = F.regexp_extract(F.col("path"), "^(.*)/[^/]*$", 1)
    named = F.regexp_extract(F.col("path"), "([^/]*)$", 1).rlike(LICENCE_NAME)
    cued = rows.where(F.col("text").rlike(CUE)).withColumn("plain", F.regexp_replace("text", COMMENT, ""))
    blocks = F.split("plain", r"\n[\x20\t\r]*\n")
    sentences = F.flatten(F.transform(blocks, lambda x: F.split(x, r"(?<=[.!?])\s+(?=[A-Z])")))
    pieces = F.array_distinct(F.concat(F.split("plain", "\n"), blocks, sentences, F.array("plain")))
    pieces = F.filter(pieces, lambda u: u.rlike(CUE))
    units = written(
        cued.select("row", folder.alias("dir"), F.coalesce(named, F.lit(False)).alias("named"),
                    F.size(_terms(F.col("text"))).alias("words"), F.explode(pieces).alias("unit")),
        "units",
    )
    best = best_templates(units.select("unit").distinct(), least)
    hits = units.join(best.withColumnRenamed("unit", "_u"), F.col("unit") == F.col("_u"))
    top = F.max_by(F.struct("license", "score"), F.struct("score", "held", "license"))
    own = written(
        hits.groupBy("row", "dir").agg(
            top.alias("best"), F.max(F.col("named") | (F.col("held") >= F.col("words") * file_share)).alias("file")
        ).select("row", "dir", "best.license", "best.score", "file"),
        "own-licences",
    )
    first = F.max_by(F.struct("license", "score"), F.struct("score", "license"))
    files = own.where("file AND dir IS NOT NULL").groupBy(F.col("dir").alias("above")).agg(first.alias("best"))
    listed = rows.select("row", "doc_id", F.when(F.col("path").isNotNull(), folder).alias("dir"))
    # Directories are looked up once each, however many files they hold.
    steps = F.split("dir", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")
    )
    nearest = (
        listed.where("dir IS NOT NULL").select("dir").distinct()
        .select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "above"))
        .join(files, "above")
        .groupBy("dir").agg(F.max_by(F.struct("best", "above"), "depth").alias("from"))
    )
    mine = own.select(F.col("row").alias("_r"), F.col("license").alias("_license"), F.col("score").alias("_score"))
    out = listed.join(mine, F.col("row") == F.col("_r"), "left").join(
        nearest.withColumnRenamed("dir", "_d"), F.col("dir") == F.col("_d"), "left"
    )
    has = F.col("_license").isNotNull()
    return out.select(
        "doc_id",
        F.coalesce("_license", "from.best.license").alias("license"),
        F.coalesce("_score", "from.best.score").alias("score"),
        F.when(has, "own").when(F.col("from").isNotNull(), "inherited").alias("origin"),
        F.when(~has, F.col("from.above")).alias("from_dir"),
    )
