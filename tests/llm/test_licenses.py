import math
import re
from collections import Counter

from veilframe.llm import licenses as L

FILES = [
    ("a/LICENSE", "Released under the MIT License."),
    ("a/b/x.py", "code\nmore code here"),
    ("a/b/c/y.py", "print()"),
    ("q/whole.txt", "// Released under the MIT License."),
    ("q/talk.md", "Released under the Apache License, Version 2.0. The rest of this text speaks of something else, and at greater length."),
    ("q/code.c", "int x;"),
    ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3.\nlong text follows " + "word " * 50),
    ("z/own.py", "# Licensed under the Apache License, Version 2.0.\n" + "x = 1\n" * 30),
    ("z/other.py", "no statement"),
    ("z/talk.md", "The licence of a driver was lost on the road to the sea in a storm of words and rain."),
    ("top.py", None),
    ("a/ab/q.py", ""),
]


def test_own_and_inherited(spark):
    df = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(FILES)], "id long, path string, text string, license string")
    got = {FILES[r.id][0]: (r.license, r.effective_license, r.inherited_from) for r in L.scan(df).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "MIT", None),
        "a/b/x.py": (None, "GPL-3.0", "a/b"),
        "a/b/c/y.py": (None, "GPL-3.0", "a/b"),
        "a/b/COPYING.txt": ("GPL-3.0", "GPL-3.0", None),
        "z/own.py": ("Apache-2.0", "Apache-2.0", None),
        "z/other.py": (None, None, None),
        "z/talk.md": (None, None, None),
        "q/whole.txt": ("MIT", "MIT", None),
        "q/talk.md": ("Apache-2.0", "Apache-2.0", None),
        "q/code.c": (None, "MIT", "q"),
        "top.py": (None, None, None),
        "a/ab/q.py": (None, "MIT", "a"),
    }


def test_cosines_against_plain_arithmetic(spark):
    said = ["Released under the MIT License", "licensed, licensed and licensed again under CC BY-NC 4.0", "all rights reserved by copyright"]
    terms = lambda s: Counter(re.findall("[a-z0-9]+", s.lower()))
    every = [terms(s) for s in said] + [terms(t) for _, t, *_ in L.templates()]
    df = Counter(t for d in every for t in d)
    weigh = lambda d: {t: n * (math.log((1 + len(every)) / (1 + df[t])) + 1) for t, n in d.items()}

    def cosine(a, b):
        return sum(a[t] * b.get(t, 0) for t in a) / math.hypot(*a.values()) / math.hypot(*b.values())

    agrees = lambda s, must, never: set(must) <= set(terms(s)) and not set(never) & set(terms(s))
    scored = {s: [(name != "Proprietary", rank, x, name) for name, t, least, rank, must, never in L.templates() if (x := round(cosine(weigh(terms(s)), weigh(terms(t))), 6)) >= least and agrees(s, must, never)] for s in said}
    got = {r.statement: (r.rank, r.score, r.license) for r in L.match(spark.createDataFrame([(s,) for s in said], "statement string")).collect()}
    assert got == {s: max(b)[1:] for s, b in scored.items() if b}


def test_repeats_nulls_and_empty(spark):
    rows = [(1, None, "Released under the MIT License."), (1, None, "Released under the MIT License."), (None, "x/y", "Released under the MIT License."), (2, "/", None)]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    got = sorted(((r.id, r.license) for r in L.scan(df).collect()), key=repr)
    assert got == sorted([(1, "MIT"), (1, "MIT"), (None, "MIT"), (2, None)], key=repr)
    assert L.scan(df.limit(0)).collect() == []


REAL = {
    "MIT": """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "ISC": """Copyright (c) 2020, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "BSD-3-Clause": """# Copyright (c) 2020, Some One
# All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice.
#
# 3. Neither the name of Some One nor the names of its contributors may be
#    used to endorse or promote products derived from this software without
#    specific prior written permission.""",
    "GPL-2.0": """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 */
int main() {}""",
    "Apache-2.0": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
package x""",
    "GPL-3.0": "# SPDX-License-Identifier: GPL-3.0-or-later\nx = 1",
    "LGPL-3.0": "// SPDX-License-Identifier: LGPL-3.0-only",
    "Proprietary": "Copyright 2020 Some One. All rights reserved.",
    None: "// SPDX-License-Identifier: Foo-1.0\nThe driver of the lorry had permission to use the yard.",
}


def test_licences_as_they_are_written(spark):
    df = spark.createDataFrame([(i, f"d{i}/x", t) for i, t in enumerate(REAL.values())], "id long, path string, text string")
    names = list(REAL)
    assert {names[r.id]: r.license for r in L.scan(df).collect()} == {n: n for n in names}


OPENING = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
CLAUSES = ("1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n"
           "   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n")
NAMES = "Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
ADVERTS = "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by the organization.\n\n"
GNU = "This {what} is free software{mark} you can redistribute it and/or\nmodify it under the terms of the GNU {kind} Public\nLicense as published by the Free Software Foundation{mark2} either\nversion {version} of the License, or (at your option) any later version.\n"
RELATIVES = [
    ("AGPL-3.0", GNU.format(what="program", mark=":", kind="Affero General", mark2=",", version=3)), ("LGPL-2.1", GNU.format(what="library", mark=";", kind="Lesser General", mark2=";", version="2.1")),
    ("LGPL-3.0", GNU.format(what="library", mark=";", kind="Lesser General", mark2=";", version=3)), ("GPL-2.0", GNU.format(what="program", mark=";", kind="General", mark2=";", version=2)),
    ("GPL-3.0", GNU.format(what="program", mark=":", kind="General", mark2=",", version=3)),
    ("BSD-2-Clause", OPENING + CLAUSES), ("BSD-3-Clause", OPENING + CLAUSES + "3. " + NAMES), ("BSD-4-Clause", OPENING + CLAUSES + ADVERTS + "4. " + NAMES),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."), ("Apache-1.1", "The Apache Software License, Version 1.1\n\nCopyright (c) 2000 The Apache Software Foundation."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT OR Apache-2.0", "// SPDX-License-Identifier: MIT OR Apache-2.0"), ("GPL-2.0 AND MIT", "# SPDX-License-Identifier: GPL-2.0-only AND MIT\nx = 1"), (None, "# SPDX-License-Identifier: MIT OR Foo-1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "//          Copyright Joe Coder 2004 - 2006.\n// Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt)"), ("Zlib", "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"),
    ("Zlib", "/* SPDX-License-Identifier: Zlib */"), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."),
]


def test_relatives_are_told_apart(spark):
    """What the texts say, not what the rule gives."""
    df = spark.createDataFrame([(i, f"d{i}/x.c", t) for i, (_, t) in enumerate(RELATIVES)], "id long, path string, text string")
    got = {r.id: r.license for r in L.scan(df).collect()}
    assert {i: (RELATIVES[i][1][:60], g) for i, g in got.items()} == {i: (t[:60], name) for i, (name, t) in enumerate(RELATIVES)}


def test_every_template_names_its_own_licence(spark):
    every = L.templates()
    assert all(re.search(L.MENTION, t) for _, t, *_ in every)
    got = {r.statement: r.license for r in L.match(spark.createDataFrame([(t,) for _, t, *_ in every], "statement string")).collect()}
    assert got == {t: name for name, t, *_ in every}


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "a/x", "word and word again, " * 100_000 + "\nReleased under the MIT License.\n" + "more\n" * 50_000)], "id long, path string, text string")
    assert L.scan(df).first().license == "MIT"
