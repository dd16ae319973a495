"""Licence rules."""

import re

import pytest

from recordflow.llm import licenses as L, queries

SF = "/root/testdata/sf0.001"
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS.
// See the License for the specific language governing permissions and
// limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to use, copy, modify, merge. The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
CASES = [
    ("Some words | more\nThis work is licensed under the GNU General Public License, version 3.\nx", ["GPL-3.0-only"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Released under the MIT License.", ["MIT"]),
    ("a b\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"]), (APACHE, ["Apache-2.0"]), (MIT, ["MIT"]), (BSD, ["BSD-2-Clause"]), (BSD3, ["BSD-3-Clause"]), (LGPL, ["LGPL-2.1-or-later"]),
    ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */", ["MIT OR Apache-2.0"]), (f"{MIT}\n\nFoo.\n\n{APACHE}", ["MIT", "Apache-2.0"]), ("Distributed under the 3-Clause BSD license.", ["BSD-3-Clause"]),
    ("Licensed under the Creative Commons Attribution-ShareAlike 4.0 International licence.", ["CC-BY-SA-4.0"]), ("Available under the GNU GPL version 2 or later.", ["GPL-2.0-or-later"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("", []), ("The driver had a license and permission to enter.", []), ("Software and warranties", []), ("The MIT campus and the Apache tribe.", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_text(text, want):
    assert [n for _, n in L.licences(L.identifiers(text))] == want
    assert [n for _, n in L.licences(L.identifiers(("Words before. " * 50) + "\n" + text + "\n" + "Words after. " * 50))] == want


PLAIN = {"GPL-3.0-only": "licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()}
    got = queries.QUERIES["op10_licenses"](spark, SF.replace("0.001", "0.01")).collect()
    assert len(got) == len(docs)
    for r in got:
        want = sorted((docs[r["doc_id"]].find(s), n) for n, s in PLAIN.items() if s in docs[r["doc_id"]])
        assert r["licences"] == ",".join(n for _, n in want) and r["n_licences"] == len(want)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, PLAIN["MIT"]), (3, PLAIN["MIT"]), (None, "x y. " * 60_000 + APACHE)]
    docs = spark.createDataFrame([(*r, "a", 3) for r in rows], "doc_id long, text string, licences string, s int")
    got = sorted(map(tuple, L.licence_scan(docs).collect()), key=str)
    assert [r[1] for r in got] == ["", "", "MIT", "MIT", "Apache-2.0"] and got[0][4] is None and got[2][4] == 0
    assert L.licence_scan(docs.limit(0)).collect() == []


def test_rules_name_known_sentences():
    named = {s for _, must, may in L.RULES for s in must + may}
    assert named <= set(L.SENTENCES) | {"spdx"} and set(L.NEEDS) == set(L.SENTENCES)
    assert all(re.search(r"[a-z]", w) for w in L.NEEDS.values())


def alternatives(node):
    """Every choice of alternatives of a parsed pattern, as texts that it matches; optional parts are taken and left."""
    from itertools import product
    out = [""]
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "BRANCH":
            more = [t for branch in arg[1] for t in alternatives(branch)]
        elif name == "SUBPATTERN":
            more = alternatives(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            one = ["any words"] if str(arg[2][0][0]) == "ANY" else alternatives(arg[2])
            more = ([""] if arg[0] == 0 else []) + (one if arg[1] else [])
        elif name == "IN":
            more = ["2" if str(arg[0][0]) == "RANGE" else chr(arg[0][1])]
        elif name in ("ASSERT", "ASSERT_NOT", "AT"):
            more = [""]
        else:
            raise AssertionError(name)
        out = list(dict.fromkeys(a + b for a, b in product(out, more)))
        if len(out) > 400:  # enough of each kind: the first ones and an even share of the others
            out = out[:100] + out[100::len(out) // 300]
    return out


@pytest.mark.parametrize("name", L.SENTENCES)
def test_every_alternative_is_scanned(name):
    """What a pattern can match passes the words looked for first, on one line and wrapped in a comment."""
    texts = [t for t in alternatives(re._parser.parse(L.PATTERNS[name].pattern)) if L.PATTERNS[name].fullmatch(t)]
    assert texts
    for t in texts:
        for lines in (t, t.replace(" ", "\n"), "// " + t.replace(" ", "\n// ")):
            plain = L.normalise(lines)
            assert plain == " ".join(t.split()) and L.hinted(plain)
            if L.PATTERNS[name].search(plain):
                assert name in [i for _, i, _ in L.identifiers(lines)] or L.known(plain)
            assert any(w in f" {plain} " for w in L._NEEDED[name])


HINTLESS = [("Released under MIT.", "MIT"), ("Distributed under ISC.", "ISC"), ("Available under the Expat", "MIT"), ("Published under Creative Commons Attribution 4.0.", "CC-BY-4.0"), ("CC0 1.0 Universal", "CC0-1.0"),
            ("Released under\nCC BY 4.0.", "CC-BY-4.0"), ("// This is free and unencumbered software released into the public\n// domain.", "Unlicense"), ("Creative Commons Zero 1.0", "CC0-1.0")]


def test_names_without_the_word_licence(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HINTLESS)], "doc_id long, text string")
    assert [r["licences"] for r in L.licence_scan(docs).orderBy("doc_id").collect()] == [n for _, n in HINTLESS]


MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version."""
HEADERS = [
    (MPL, "MPL-2.0"), (MPL.replace("/*", "#").replace(" * ", "# ").replace("*/", ""), "MPL-2.0"), (MPL.replace(", v. 2.0", ",\n * v.\n * 2.0"), "MPL-2.0"), (MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"),
    (BSD + "\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\nThis product includes software developed by the organization.", "BSD-4-Clause"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    (APACHE, "Apache-2.0"), (GNU.format("", 3), "GPL-3.0-or-later"), (GNU.format("Affero ", 3), "AGPL-3.0-or-later"), (GNU.format("Lesser ", 2.1), "LGPL-2.1-or-later"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"), ("CC0 1.0 Universal", "CC0-1.0"),
    ("This program and the accompanying materials\nare made available under the terms of the Eclipse Public License v1.0\nwhich accompanies this distribution, and is available at x", "EPL-1.0"),
    ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("// Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt or copy at\n//          https://www.boost.org/LICENSE_1_0.txt)", "BSL-1.0"),
    ("it under the terms of the Do What The Fuck You Want\nTo Public License, Version 2, as published by Sam Hocevar.", "WTFPL"),
    ("Released under the Mozilla Public License, v. 2.0.", "MPL-2.0"), ("Made available under the terms of the Eclipse Public License, v. 1.0.", "EPL-1.0"), ("Licensed under the Apache License, v. 2.0.", "Apache-2.0"),
    ("Licensed under the Apache License, ver. 2.0.", "Apache-2.0"), ("Released under the GPL v. 3.", "GPL-3.0-only"), ("Released under the GPL v.3.", "GPL-3.0-only"), ("Distributed under the LGPL v. 2.1 or later.", "LGPL-2.1-or-later"),
    ("Licensed under CC BY v. 4.0.", "CC-BY-4.0"),
]


@pytest.mark.parametrize("text,want", HEADERS)
def test_official_headers_and_short_versions(text, want):
    assert [n for _, n in L.licences(L.identifiers(text))] == [want]
    assert [n for _, n in L.licences(L.identifiers(f"Words before.\n\n{text}\n\nWords after."))] == [want]


def test_sentences_end_behind_other_words():
    assert [s for _, s in L.sentences("It is rev. 2 of it. See no. 3 there. No. It ended in v. The end.")] == ["It is rev.", "2 of it.", "See no. 3 there.", "No.", "It ended in v.", "The end."]


@pytest.mark.parametrize("part", ["in no event shall ", "this software is provided as is and ", "this is under ", "neither the names of ", "released under ", "word "])
def test_long_sentences_take_linear_time(part):
    """A text without sentence ends is scanned in time that grows with its length."""
    import time
    took = []
    for n in (20_000, 80_000):
        text = "in no event shall x " + part * (n // len(part))
        start = time.perf_counter()
        L.identifiers(text)
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 0.5 and took[1] < 20
