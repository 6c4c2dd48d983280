"""License scans [native]: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line of every whole text is a candidate header and is compared with the header templates; a licence file (by its
name) is also compared as a whole, with these and with whole licence texts. The vector space has the templates' words,
weighted by document frequencies over all files, and one more dimension that pools a unit's other words. A unit has a
template's licence only if it also has all version numbers of that template. Words that a line must have some of to
reach the threshold are found from the templates' weights (what the other words of a template can add is too little),
so lines without any of them are left out exactly. A file without a licence of its own gets that of the nearest ancestor
directory with a licence file.

Everything is DataFrame functions. What is broadcast are the templates' words; their number is checked against
``MAX_TERMS``. Only licences that have a template are told apart: the twenty-odd of ``HEADERS`` and ``TEXTS``.

Defined results: a row is known by its id, path and text, so rows that repeat all three are scanned once and keep their
multiplicity, and rows that share an id or a path only are scanned each on its own; a null or empty text has no
licence of its own and may inherit one; a null path is a file "" in the root directory; ties go to the smaller licence
name, then the earlier line; of a directory's licence files the most similar one, then the smallest path, then the
smaller name counts; columns other than id, text and path are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.6
MAX_TERMS = 20_000
#: Java and RE2 read this alike.
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([-._].*)?$"

#: Header sentences of common licences, by SPDX identifier.
HEADERS = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Released under the zlib License."),
]

_DISCLAIMER = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness"
    " for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but"
    " not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability"
    " or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above"
    " copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
    " disclaimer in the documentation and or other materials provided with the distribution"
)

#: Whole licence texts, without the names of holders and the numbers of clauses.
TEXTS = [
    ("BSD-2-Clause", f"{_BSD} {_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_DISCLAIMER}"),
    ("BSL-1.0", "boost software license version 1.0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("Unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("Zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
]
#: Version numbers among a template's words.
VERSION = r"[0-9]+(?:\.[0-9]+)*"


@dataclass(frozen=True)
class Templates:
    headers: Sequence[tuple[str, str]] = tuple(HEADERS)
    texts: Sequence[tuple[str, str]] = tuple(TEXTS)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _counts(templates: Sequence[tuple[str, str]]) -> list[tuple[str, Counter]]:
    return [(name, Counter(re.findall(TERM, text.lower()))) for name, text in templates]


def weights(files: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Smoothed idf of the templates' words over all files."""
    own = F.array_intersect(terms(F.col("text")), F.array(*[F.lit(t) for t in vocabulary]))
    counts = files.select(F.explode(F.array_append(own, F.lit("")))).groupBy("col").agg(F.count("*").alias("n")).collect()  # a row a word
    df = {r.col: r.n for r in counts}
    n = df.pop("", 0)
    return {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}


def _vectors(counts: list[tuple[str, Counter]], idf: dict[str, float]) -> list[dict[str, float]]:
    out = []
    for _, c in counts:
        v = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out


def anchors(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Words of which any unit at the threshold has one: the lightest words of a template that together cannot reach it go."""
    kept = set()
    for v in vectors:
        room = (threshold - 1e-9) ** 2
        for t, x in sorted(v.items(), key=lambda i: (i[1], i[0])):
            room -= x * x
            if room < 0:
                kept.add(t)
    return sorted(kept)


def own_licenses(files: DataFrame, templates: Templates, threshold: float) -> DataFrame:
    """id, path, h (a hash of the text), license, similarity, line_no of files (id, path, text, h) with a licence of their
    own. Line -1: the whole file."""
    spark = files.sparkSession
    headers, texts = _counts(templates.headers), _counts(templates.texts)
    vocabulary = sorted({t for _, c in headers + texts for t in c})
    if len(vocabulary) > MAX_TERMS:
        raise ValueError(f"the templates have {len(vocabulary)} words; at most {MAX_TERMS} are broadcast")
    idf = weights(files, vocabulary)
    of_headers = _vectors(headers, idf)
    wanted = "(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in anchors(of_headers, threshold)) + ")(?![a-z0-9])"
    numbered = []
    for k, ((name, counts), v) in enumerate(zip(headers + texts, of_headers + _vectors(texts, idf), strict=True)):
        versions = sum(bool(re.fullmatch(VERSION, t)) for t in counts)
        numbered += [(f"{k:05d} {name}", int(k >= len(headers)), t, x, int(bool(re.fullmatch(VERSION, t))), versions) for t, x in v.items()]
    of_terms = F.broadcast(common.inline(spark, sorted(idf.items()), ["term", "idf"]))
    of_templates = F.broadcast(common.inline(spark, numbered, ["template", "whole_only", "term", "part", "version", "versions"]))

    row = ["id", "path", "h"]
    lines = files.filter(F.col("text").rlike(wanted)).select(*row, F.posexplode(F.split("text", "\n")).alias("line_no", "unit")).filter(F.col("unit").rlike(wanted))
    whole = files.filter(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE)).select(*row, F.lit(-1).alias("line_no"), F.col("text").alias("unit"))
    unit = [*row, "line_no"]
    tf = lines.union(whole).dropDuplicates(unit).select(*unit, F.explode(terms(F.col("unit"))).alias("term")).groupBy(*unit, "term").agg(F.count("*").alias("tf"))
    known = tf.join(of_terms, "term", "left")
    own = F.when(F.col("idf").isNotNull(), (1 + F.log("tf")) * F.col("idf"))
    scaled = known.select(*unit, "term", "tf", own.alias("own"))
    fits = scaled.filter("own IS NOT NULL").join(of_templates, "term").filter("whole_only = 0 OR line_no = -1")
    dots = fits.groupBy(*unit, "template", "versions").agg(F.sum(F.col("own") * F.col("part")).alias("dot"), F.sum("version").alias("has"))
    dots = dots.filter("has = versions").drop("has", "versions")
    others = F.sum(F.when(F.col("own").isNull(), F.col("tf")).otherwise(0))
    norms = scaled.groupBy(*unit).agg(F.sum(F.coalesce(F.col("own") * F.col("own"), F.lit(0.0))).alias("known"), others.alias("others"))
    pooled = F.when(F.col("others") > 0, (1 + F.log("others")) * (1 + F.log("others"))).otherwise(0.0)
    norms = norms.select(F.col("id").alias("n_id"), F.col("path").alias("n_path"), F.col("h").alias("n_h"), F.col("line_no").alias("n_line"), F.sqrt(F.col("known") + pooled).alias("norm"))
    same = F.col("id").eqNullSafe(F.col("n_id")) & (F.col("path") == F.col("n_path")) & (F.col("h") == F.col("n_h")) & (F.col("line_no") == F.col("n_line"))
    near = dots.join(norms, same).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("similarity") >= threshold)
    best = F.min(F.struct((-F.col("similarity")).alias("minus"), F.substring("template", 7, 1000).alias("license"), "line_no")).alias("best")
    found = near.groupBy(*row).agg(best)
    return found.select(*row, "best.license", (-F.col("best.minus")).alias("similarity"), "best.line_no")


def scan(files: DataFrame, templates: Templates = Templates(), threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """Per row: id, path, license, similarity, line_no, inherited_from (the directory whose licence file counts, if not its own)."""
    spark = files.sparkSession
    folder = common.shared_dir(spark, "license-scan")
    rows = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    own = common.cut(own_licenses(rows, templates, threshold), folder, "own")
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))

    holders = own.filter(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE)).withColumn("dir", directory)
    first = F.min(F.struct((-F.col("similarity")).alias("minus"), "path", "license")).alias("first")
    holders = common.cut(holders.groupBy("dir").agg(first).select(F.col("dir").alias("above"), F.col("first.license").alias("license")), folder, "holders")
    # ``holders`` has one row a directory, so the join can split the many rows that ask for one directory, such as the root.
    depths = F.expr("transform(sequence(0, IF(dir = '', 0, size(split(dir, '/')))), n -> struct(n AS depth, array_join(slice(split(dir, '/'), 1, n), '/') AS above))")
    asked = rows.select(directory.alias("dir")).distinct().select("dir", F.inline(depths))
    nearest = F.max(F.struct("depth", "above", "license")).alias("nearest")
    resolved = asked.join(holders, "above").groupBy("dir").agg(nearest)
    resolved = common.cut(resolved.select(F.col("dir").alias("of_dir"), F.col("nearest.license").alias("given"), F.col("nearest.above").alias("giver")), folder, "resolved")
    common.remove(spark, f"{folder}/holders")

    mine = own.select(F.col("id").alias("o_id"), F.col("path").alias("o_path"), F.col("h").alias("o_h"), "license", "similarity", "line_no")
    each = rows.select("id", "path", "h", directory.alias("dir"))
    joined = each.join(mine, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("path") == F.col("o_path")) & (F.col("h") == F.col("o_h")), "left")
    joined = joined.join(resolved, F.col("dir") == F.col("of_dir"), "left")
    return joined.select(
        F.col("id").alias(id_col), "path", F.coalesce("license", "given").alias("license"), "similarity", "line_no",
        F.when(F.col("license").isNull(), F.col("giver")).alias("inherited_from"),
    )
