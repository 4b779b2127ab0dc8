"""License scans: TF-IDF cosine of licence statements to templates, then inheritance from the nearest directory above.

Statements are of two kinds: the pieces of a text, cut at line ends and after full stops, for licences
named in passing, and its paragraphs, lines joined without their comment marks and cut at blank lines, for
headers and the wording of licence files. Only those count that hold a word by which licences speak.
Equal statements are one from then on, so a header in a third of all files costs no
more than a rare one. Terms are runs of ASCII letters and digits, lower-cased; a term's weight is
its count times ln((1 + n) / (1 + df)) + 1 over all distinct statements and templates. Of the templates
whose least cosine is reached and whose telling terms agree the best names a statement's licence: what its licence's name and version say (``TELLING``)
must be there if the template says it, and what only its relatives say must not. The best statement names a file's licence; a reserved
copyright yields to any licence, an opening that licences share to a clause that only one has, ties go to the later name.

SPDX identifiers are read, not compared: a statement that has one is the expression of known identifiers (``MIT OR Apache-2.0``) at score 1, or none.

A licence file is one that is so called, or of whose words ``FILE_SHARE`` at least are in statements that
matched, so that it says nothing else. A file without a licence of its own takes that of the nearest directory above with a
licence file; directories, once each, meet their ancestors in joins on whole paths.

Built-in functions only. Defined cases: null and empty texts have no statements; a null path
lies in the root and has no licence file's name; rows of equal id are one file; empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shipping import bounded, settle

LEAST, FILE_SHARE = 0.5, 0.9
MENTION = r"(?i)licen[sc]|copyright|public domain|\bCC[ -]BY|\bCC0|SPDX|rights reserved|redistribution and use|permission is hereby granted|permission to use|free software|endorse or promote products|advertising materials|freely, subject to the following|redistributions (?:of|in)|warranties or conditions|public license"
#: What stands before the words of a commented line.
MARKS = r"^[ \t\r]*(//+|#+|/\*+|\*+/?|--+|;+|%+|<!--+)?[ \t]*"
FILE_NAME = r"(?i)^(un)?licen[sc]es?([.-].*)?$|^copying([.-].*)?$"
#: Statements by which licences are named in headers and licence files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Distributed under the BSD 3 Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under this BSD style license"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("Proprietary", "Copyright All rights reserved"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Distributed under the BSD 2 Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University of California and its contributors."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD style license that can be found in the LICENSE file"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third parties to whom the Software is furnished to do so, all subject to the following:"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY NC ND 4.0"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY NC SA 4.0"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY ND 4.0"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
#: Terms that tell a licence from its relatives: those that must be there if the template has them, and those that must not.
TELLING = {
    "AGPL-3.0": ("affero 3", "lesser"), "LGPL-2.1": ("lesser 2 1", "affero 3"), "LGPL-3.0": ("lesser 3", "affero"), "GPL-2.0": ("2", "lesser library affero 3"), "GPL-3.0": ("3", "lesser library affero"),
    "Apache-1.1": ("apache 1", "2"), "Apache-2.0": ("apache 2", ""), "BSL-1.0": ("boost", ""), "EPL-2.0": ("eclipse 2", ""), "MPL-2.0": ("mozilla 2", ""), "Unlicense": ("unencumbered", ""), "CC0-1.0": ("cc0", "unencumbered"),
    "BSD-2-Clause": ("bsd 2", "endorse advertising style 3"), "BSD-3-Clause": ("endorse bsd", "advertising 2clause"), "BSD-4-Clause": ("advertising", ""),
    "CC-BY-4.0": ("4", "nc sa nd noncommercial commercial sharealike noderivatives noderivs"), "CC-BY-NC-4.0": ("4 nc noncommercial", "sa nd sharealike noderivatives noderivs"),
    "CC-BY-SA-4.0": ("4 sa sharealike", "nc nd noncommercial commercial noderivatives noderivs"), "CC-BY-ND-4.0": ("4 nd noderivatives", "nc sa noncommercial commercial sharealike"),
    "CC-BY-NC-SA-4.0": ("4 nc sa noncommercial sharealike", "nd noderivatives noderivs"), "CC-BY-NC-ND-4.0": ("4 nc nd noncommercial noderivatives", "sa sharealike"),
}
#: SPDX identifiers, and whose licence they are where that is another name; "-only" and "-or-later" are versions of what stands before.
SPDX = """AGPL-3.0 Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0
    EPL-2.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense Zlib""".split()
EXPRESSION = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+(?:[ \t]+(?:OR|AND)[ \t]+[A-Za-z0-9.+-]+)*)"


def identifiers() -> dict[str, str]:
    """What may stand in an expression, and what it is called here."""
    return {"OR": "OR", "AND": "AND"} | {x + end: x for x in SPDX for end in ("", "-only", "-or-later", "+")}


def templates() -> list[tuple[str, str, float, int, list[str], list[str]]]:
    """licence, statement, the least cosine at which it counts, its rank (of clauses that only one of the licences of an opening has), terms that must and that must not be there."""
    out = []
    for name, text in TEMPLATES:
        must, never = (x.split() for x in TELLING.get(name, ("", "")))
        has = set(re.findall("[a-z0-9]+", text.lower()))
        rank = {"BSD-3-Clause": 1, "BSD-4-Clause": 2}.get(name, 0) if has & {"endorse", "advertising"} else 0
        out.append((name, text, LEAST, rank, [m for m in must if m in has], [x for x in never if x not in has]))
    return out


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def _pieces(text: Column) -> Column:
    return F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(". ")), r"\. "), lambda s: F.trim(s))


def _paragraphs(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, MARKS, ""))
    return F.transform(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda s: F.trim(F.replace(s, F.lit("\n"), F.lit(" "))))


def statements(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``kind`` (0 piece, 1 paragraph), ``statement`` and ``n`` (its repeats) for each file and distinct statement."""
    speaking = files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.rlike("text", F.lit(MENTION)))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.filter(cut(F.col("text")), lambda s: F.rlike(s, F.lit(MENTION))).alias("of")) for k, cut in enumerate((_pieces, _paragraphs))])
    return speaking.select("id", F.inline(kinds)).select("id", "kind", F.explode("of").alias("statement")).groupBy("id", "kind", "statement").agg(F.count(F.lit(1)).alias("n"))


def _order() -> list[Column]:
    return [(F.col("license") != "Proprietary").alias("named"), F.col("rank"), F.col("score"), F.col("license")]


def expression(statement: Column) -> tuple[Column, Column]:
    """Whether a statement has an SPDX identifier, and its expression, null if one of them is not known."""
    found = F.regexp_extract(statement, EXPRESSION, 1)
    known = F.create_map(*[F.lit(x) for pair in identifiers().items() for x in pair])
    named = F.transform(F.split(found, r"[ \t]+"), lambda x: F.try_element_at(known, x))
    return found != "", F.when((found != "") & ~F.exists(named, lambda x: x.isNull()), F.array_join(named, " "))


def match(distinct: DataFrame) -> DataFrame:
    """``statement``, ``license``, ``score`` and ``rank`` of those that a template matches or that have an SPDX expression."""
    spark = distinct.sparkSession
    known = spark.createDataFrame([(i, *t) for i, t in enumerate(templates())], "template int, license string, statement string, least double, rank int, must array<string>, never array<string>")
    has, said = expression(F.col("statement"))
    written = distinct.select("statement", said.alias("license"), F.lit(1.0).alias("score"), F.lit(0).alias("rank")).filter("license is not null")
    named = distinct.filter(~has).select("statement", F.md5("statement").alias("key"))  # a paragraph may be long: its digest goes with its terms
    every = named.select("key", "statement", F.lit(None).cast("int").alias("template"), F.lit(None).cast("string").alias("license")).unionByName(known.select(F.md5("statement").alias("key"), "statement", "template", "license"))
    counted = settle(every.select("key", "template", "license", F.explode(_terms(F.col("statement"))).alias("term")).groupBy("key", "template", "license", "term").agg(F.count(F.lit(1)).alias("tf")))
    n = every.agg(F.count(F.lit(1)).alias("all"))
    frequency = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("term", (F.ln((1 + F.col("all")) / (1 + F.col("df"))) + 1).alias("idf"))  # n is one row
    weighed = settle(counted.join(bounded(settle(frequency)), "term").select("key", "template", "license", "term", (F.col("tf") * F.col("idf")).alias("w")))
    norms = weighed.groupBy("key", "template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    ours = weighed.filter("template is null").select("key", "term", "w")
    theirs = weighed.filter("template is not null").select("template", "license", "term", F.col("w").alias("v"))  # a few hundred rows, fixed
    dots = ours.join(F.broadcast(theirs), "term").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    own = norms.filter("template is null").select("key", F.col("norm").alias("a"))
    fixed = norms.filter("template is not null").select("template", F.col("norm").alias("b"))
    scored = dots.join(own, "key").join(F.broadcast(fixed), "template").select("key", "template", "license", F.round(F.col("dot") / (F.col("a") * F.col("b")), 6).alias("score"))
    enough = scored.join(F.broadcast(known.select("template", "least", "rank", "must", "never")), "template").filter("score >= least")  # some tens of rows, fixed
    terms = _terms(F.col("statement"))
    agree = named.withColumn("terms", terms).join(enough, "key").filter((F.size(F.array_except("must", "terms")) == 0) & ~F.arrays_overlap("never", "terms"))
    best = agree.groupBy("key").agg(F.max(F.struct(*_order())).alias("best"))
    return named.join(best, "key").select("statement", "best.license", "best.score", "best.rank").unionByName(written)


def scan(files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``id_col``, ``license``, ``score`` (of the file's own), ``effective_license`` and ``inherited_from`` (a directory) per row."""
    said = settle(statements(files, id_col, text_col))
    known = bounded(settle(match(said.select("statement").distinct())))
    words = F.col("n") * F.size(_terms(F.col("statement")))
    own = settle(said.join(known, "statement").groupBy("id").agg(
        F.max(F.struct(*_order())).alias("best"), *[F.coalesce(F.sum(F.when(F.col("kind") == k, words)), F.lit(0)).alias(f"stated{k}") for k in (0, 1)],
    ).select("id", "best.score", "best.license", F.greatest("stated0", "stated1").alias("stated")))
    path = F.coalesce(F.col(f"`{path_col}`"), F.lit(""))
    listed = files.select(
        F.col(f"`{id_col}`").alias("id"), F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"),
        F.size(_terms(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("n_terms"))
    small = bounded(own.withColumnRenamed("id", "_id"))
    marked = settle(listed.join(small, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "dir", "name", "n_terms", "score", "license", "stated"))
    whole = F.rlike("name", F.lit(FILE_NAME)) | (F.col("stated") >= FILE_SHARE * F.col("n_terms"))
    given = settle(marked.filter(F.col("license").isNotNull() & whole).groupBy("dir").agg(F.max(F.struct("score", "license"))["license"].alias("given")))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))
    orphans = marked.filter(F.col("license").isNull()).select("dir").distinct()
    nearest = (
        orphans.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.up").join(bounded(given.withColumnRenamed("dir", "up")), "up")
        .groupBy("dir").agg(F.max(F.struct("depth", "up", "given")).alias("near")).select("dir", F.col("near.up").alias("up"), F.col("near.given").alias("given")))
    out = marked.join(bounded(settle(nearest)), "dir", "left")
    inherits = F.col("license").isNull() & F.col("given").isNotNull()
    return out.select(F.col("id").alias(id_col), "license", "score", F.coalesce("license", "given").alias("effective_license"), F.when(inherits, F.col("up")).alias("inherited_from"))
