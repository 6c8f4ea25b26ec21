"""License scans: sparse TF-IDF cosine to license templates, then inheritance from the nearest directory (DataFrame functions only).

Units are the lines of a file, its paragraphs (lines without letters and digits, such as empty comment lines, end one) and its
whole text. So one-line notices, headers wrapped over several lines and license files are all met. Templates are notices,
standard headers, titles of license files and whole short licenses; a long license is known by its title and its header.

Document frequencies of the templates' words are counted over all files; a word outside the templates is a dimension of its own with the
greatest weight. A unit can only reach the threshold if it has one of a template's heaviest words (those whose absence leaves
less than threshold of the template's norm), so all other units are passed over without loss.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.plans.staging import materialize

#: The permission and warranty paragraphs of short licenses.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: License and template text, several templates for one license.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT),
    ("MIT", f"MIT License {_MIT} {_MIT_REST}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD} {_BSD_THIRD} {_BSD_REST}"),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD} {_BSD_REST}"),
    ("ISC", _ISC),
    ("ISC", f"ISC License {_ISC} {_ISC_REST}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: What ends a paragraph: line breaks with no letter or digit between them.
PARAGRAPH = r"\n(?:[^A-Za-z0-9\n]*\n)+"
#: Names of license files.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|copyright|notice)([-_.].*)?$"


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _idf(files: int, having: int) -> float:
    return math.log((files + 1) / (having + 1)) + 1


def _vectors(templates: list[tuple[str, str]], idf: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    return [(name, {w: n * idf[w] for w, n in Counter(words(text)).items()}) for name, text in templates if words(text)]


def heaviest(vector: dict[str, float], threshold: float) -> list[str]:
    """The heaviest words of a template, without all of which a unit's cosine stays below ``threshold``."""
    rest, kept = sum(x * x for x in vector.values()), []
    least = threshold**2 * rest
    for w in sorted(vector, key=lambda w: (-vector[w], w)):
        if rest < least * (1 - 1e-9):
            break
        kept.append(w)
        rest -= vector[w] ** 2
    return kept


def detect_licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.7, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, license, score): the best template of each path whose text has a unit with a cosine of ``threshold`` at least.

    Ties go to the name that sorts first. Of rows with the same path the best counts. Null paths and null or empty texts
    give nothing, and neither do templates without words. Very long texts are read whole.
    """
    slim = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).where("path is not null and text is not null")
    vocabulary = sorted({w for _, t in templates for w in words(t)})
    if not vocabulary:
        return slim.select("path", F.lit("").alias("license"), F.lit(0.0).alias("score")).where(F.lit(False))
    known = F.array(*[F.lit(w) for w in vocabulary])
    present = F.array_intersect(F.split(F.lower("text"), "[^a-z0-9]+", -1), known)
    having = slim.select(F.explode(F.concat(F.array(F.lit("")), present)).alias("word")).groupBy("word").count().collect()
    counts = {r[0]: r[1] for r in having}
    total = counts.pop("", 0)
    idf = {w: _idf(total, counts.get(w, 0)) for w in vocabulary}
    other = _idf(total, 0)
    vectors = _vectors(templates, idf)
    # A little less, as scores are rounded to six digits.
    heavy = [heaviest(v, threshold - 1e-6) for _, v in vectors]
    keys = "(?<![a-z0-9])(?:" + "|".join(sorted({w for h in heavy for w in h})) + ")(?![a-z0-9])"
    has_key = lambda c: F.lower(c).rlike(keys)
    table = lambda rows: F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in r) + ")" for r in rows) + ")")
    # Constants of the templates: their words' weights by template and word, and by word the templates that have it among their heaviest.
    idfs = F.element_at(table([[idf[w] for w in vocabulary]]), 1)
    products = table([[idf[w] * v.get(w, 0.0) for w in vocabulary] for _, v in vectors])
    norms = F.element_at(table([[math.sqrt(sum(x * x for x in v.values())) for _, v in vectors]]), 1)
    names = F.array(*[F.lit(n) for n, _ in vectors])
    able = F.expr("array(" + ", ".join("cast(array(" + ", ".join(str(i) for i, h in enumerate(heavy) if w in h) + ") as array<int>)" for w in vocabulary) + ")")
    units = F.array_distinct(F.concat(F.array("text"), F.split("text", PARAGRAPH, -1), F.split("text", "\n", -1)))
    tokens = F.transform(F.filter(units, has_key), lambda u: F.regexp_extract_all(F.lower(u), F.lit("[a-z0-9]+"), 0))
    # A unit is scored in its own row: what moves between tasks is the best of each path, whatever the words of a unit share with templates.
    hit = slim.where(has_key("text")).select("path", F.explode(tokens).alias("words")).withColumn("own", F.array_intersect("words", known))
    times = lambda w: F.size("words") - F.size(F.array_remove("words", w))
    tf = hit.withColumn("tf", F.transform("own", lambda w: F.struct((F.array_position(known, w) - 1).cast("int").alias("at"), times(w).alias("n"))))
    # Words outside the templates only count, whatever they are.
    rest = F.size("words") - F.aggregate("tf", F.lit(0), lambda s, t: s + t["n"])
    square = F.aggregate("tf", F.lit(0.0), lambda s, t: s + F.pow(t["n"] * F.get(idfs, t["at"]), F.lit(2.0)))
    met = F.array_distinct(F.flatten(F.transform("tf", lambda t: F.get(able, t["at"]))))
    tf = tf.select("path", "tf", F.sqrt(square + rest * other**2).alias("length"), met.alias("met"))
    dot = lambda i: F.aggregate("tf", F.lit(0.0), lambda s, t: s + t["n"] * F.get(F.get(products, i), t["at"]))
    scored = tf.select("path", F.explode(F.transform("met", lambda i: F.struct(F.get(names, i).alias("license"), F.round(dot(i) / F.col("length") / F.get(norms, i), 6).alias("score")))).alias("s")).select("path", "s.*")
    best = scored.where(F.col("score") >= threshold).groupBy("path").agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license"))).alias("best"))
    return best.select("path", "best.license", "best.score")


def directory(path: Column) -> Column:
    """What precedes the last ``/``; empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan_licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.7, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``files`` with ``license``, ``license_score``, ``license_from`` (own, inherited, none) and ``license_dir``.

    A file's own license is the template that a line or paragraph of it, or its whole text, comes closest to, from ``threshold`` on.
    Others inherit from the nearest directory at or above theirs in which a license file (by its name) has a license; of
    several there, the one with the highest score, then the smallest path.

    Each row stays, repeated ones too; rows with the same path are one file. Null paths, and null or empty texts without an
    ancestor, get no license. Very long texts are read whole. An empty table gives an empty result. Columns named like an
    output are replaced, others may have any name.
    """
    made = ["license", "license_score", "license_from", "license_dir"]
    names = [c for c in files.columns if c not in made]
    # A row for each file with a license of its own; it is read three times below.
    own = materialize(detect_licenses(files, templates, threshold, path_col, text_col))
    named = own.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENSE_FILE)).withColumn("dir", directory(F.col("path")))
    by_dir = named.groupBy("dir").agg(F.min_by("license", F.struct(-F.col("score"), F.col("path"))).alias("dir_license"))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/", -1)))
    by_dir = by_dir.withColumn("depth", depth)
    # No more numbers than the deepest license file has directories.
    depths = by_dir.agg(F.collect_set("depth")).first()[0] or []
    places = files.select(directory(F.col(path_col)).alias("dir")).where("dir is not null").distinct()
    parts = F.split("dir", "/", -1)
    above = F.filter(F.array(*[F.lit(d) for d in sorted(depths)]).cast("array<int>"), lambda d: d <= depth)
    ancestors = places.select(F.col("dir").alias("place"), F.explode(F.transform(above, lambda d: F.when(d == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), d), "/")))).alias("dir"))
    nearest = ancestors.join(by_dir, "dir").groupBy("place").agg(F.max_by(F.struct("dir", "dir_license"), "depth").alias("near"))
    # Written before the join, so that the files of one directory, however many, are split over tasks.
    nearest = materialize(nearest.select(F.col("place").alias("_place"), F.col("near.dir").alias("_dir"), F.col("near.dir_license").alias("_dir_license")))
    own = own.select(F.col("path").alias("_path"), F.col("license").alias("_license"), F.col("score").alias("_score"))
    rows = files.select(F.struct(*names).alias("_row"), F.col(path_col).alias("_key"))
    joined = rows.join(own, F.col("_key") == F.col("_path"), "left").join(nearest, directory(F.col("_key")) == F.col("_place"), "left")
    where = F.when(F.col("_license").isNotNull(), "own").when(F.col("_dir_license").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        "_row.*",
        F.coalesce("_license", "_dir_license").alias("license"),
        F.col("_score").alias("license_score"),
        where.alias("license_from"),
        F.when(where == "inherited", F.col("_dir")).alias("license_dir"),
    )
