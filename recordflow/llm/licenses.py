"""Licence recognition by sentences and rules.

A text is cut into sentences, each is normalised (case, comment marks, punctuation, white
space, spelling) and looked up among known licence sentences; the identifiers found, in
their order, are then matched against rules. Rules are tried in their order at each place,
the longer and more special before the shorter; a rule names the identifiers that must
follow one another, other known sentences in between being allowed where it says so.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordflow.llm.common import text_bytes

# --- Fixed values: known licence sentences, normalised, as patterns; {v} is a version, {x} any few words, 300 characters at most. ---
SENTENCES = {
    "mit-named": r"(?:released|licensed|distributed|available|provided|published) under (?:the )?(?:terms of the )?(?:mit|expat|x11)(?: license)?",
    "mit-title": r"(?:the )?mit license",
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction {x}",
    "mit-notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": r"(?:the|this) software is provided as is (?:and {x} disclaims all warranties|without warranty of any kind) {x}",
    "no-liability": r"in no event shall {x} liable {x}",
    "isc-grant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?P<notice> provided that the above copyright notice and this permission notice appear in all copies)?",
    "isc-named": r"(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of the )?isc(?: license)?",
    "bsd-grant": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": r"(?:1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": r"(?:2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": r"(?:3 )?neither the names? of {x} may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advert": r"(?:3 )?all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-named": r"(?:released|licensed|distributed|available|provided) under (?:the |a )?(?:terms of the )?(?:(?P<n>[234]|two|three|four) clause )?(?:modified |simplified |new )?bsd(?: (?P<m>[234]) clause)?(?: style)?(?: license)?",
    "apache-named": r"licensed under (?:the )?(?:terms of the )?apache license(?: version)? {v}(?: the license)?",
    "apache-other": r"(?:released|distributed|available|provided|published) under (?:the )?(?:terms of the )?apache(?: license)?(?: version)? {v}(?: license)?",
    "apache-comply": r"you may not use this file except in compliance with the license",
    "apache-copy": r"you may obtain a copy of the license at {x}",
    "apache-asis": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis {x}",
    "apache-see": r"see the license for the specific language governing permissions and limitations under the license",
    "gpl-named": r"(?:this {x} is |is )?(?:released|licensed|distributed|available|provided|published) under (?:the )?(?:terms of the )?(?:gnu )?(?P<kind>lesser |library |affero )?(?:gnu )?(?:general public license|gpl)(?: gpl)?(?: version)? {v}(?P<later> or (?:any )?later(?: version)?| or at your option any later version)?",
    "gpl-short": r"(?:released|licensed|distributed|available|provided|published) under (?:the )?(?P<kind>l|a)?gpl ?{v}(?P<later> or (?:any )?later(?: version)?)?",
    "gpl-grant": r"is free software you can redistribute it and or modify it under the terms of the (?:gnu )?(?P<kind>lesser |library |affero )?general public license as published by the free software foundation (?:either )?version {v}(?: of the license)?(?P<later> or at your option any later version)?",
    "gpl-hope": r"is distributed in the hope that it will be useful but without any warranty {x}",
    "gpl-see": r"see the gnu (?:lesser |library |affero )?general public license for more details",
    "gpl-copy": r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with {x}",
    "mpl-grant": r"this source code form is subject to the terms of the mozilla public license(?: version)? {v}",
    "mpl-copy": r"if a copy of the mpl was not distributed with this file you can obtain one at {x}",
    "mpl-named": r"(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of the )?mozilla public license(?: version| v)? {v}",
    "cc-named": r"(?:released|licensed|distributed|available|provided|published) under (?:a |the )?(?:terms of the )?(?:creative commons|cc) (?P<kind>by(?: nc)?(?: sa| nd)?|attribution(?: ?non ?commercial)?(?: ?share ?alike| ?no ?deriv(?:ative)?s)?)(?: {v})?(?: (?:international|unported|generic|deed))?(?: license)?",
    "cc0-named": r"(?:cc0|creative commons zero|cc zero)(?: {v})?(?: universal)?(?: license| public domain dedication)?",
    "public-domain": r"this is free and unencumbered software released into the public domain",
    "unlicense-named": r"(?:released|licensed) under the unlicense",
    "epl-named": r"under the terms of the eclipse public license(?: version| v)? {v} {x}",
    "epl-short": r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?eclipse public license(?: version| v)? {v}",
    "boost": r"distributed under the boost software license version {v}",
    "zlib-grant": r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-named": r"(?:released|licensed|distributed|available) under (?:the )?zlib(?: libpng)? license",
    "wtfpl": r"do what the fuck you want to public license",
    "proprietary": r"all rights reserved",
}

# Ordered rules: licence, the sentences that must follow one another, those that may stand between or behind.
# A name with {..} takes parts of the first sentence's match.
RULES = [
    ("{spdx}", ["spdx"], []),
    ("MIT", ["mit-grant", "mit-notice", "as-is"], ["no-liability"]),
    ("MIT", ["mit-title", "mit-grant"], ["mit-notice", "as-is", "no-liability"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"], ["bsd-endorse", "as-is", "no-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"], ["as-is", "no-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"], ["as-is", "no-liability"]),
    ("ISC", ["isc-grant"], ["as-is", "no-liability"]),
    ("{apache}", ["apache-named", "apache-comply"], ["apache-copy", "apache-asis", "apache-see"]),
    ("{gpl}", ["gpl-grant"], ["gpl-hope", "gpl-see", "gpl-copy"]),
    ("{mpl}", ["mpl-grant"], ["mpl-copy"]),
    ("Unlicense", ["public-domain"], ["as-is", "no-liability"]),
    ("Zlib", ["zlib-grant"], ["as-is", "no-liability"]),
    ("MIT", ["mit-grant"], ["mit-notice", "as-is", "no-liability"]),
    ("MIT", ["mit-named"], ["as-is"]),
    ("ISC", ["isc-named"], []),
    ("{bsd}", ["bsd-named"], []),
    ("{apache}", ["apache-named"], ["apache-copy", "apache-asis", "apache-see"]),
    ("{apache}", ["apache-other"], []),
    ("{gpl}", ["gpl-named"], ["gpl-hope", "gpl-see", "gpl-copy"]),
    ("{gpl}", ["gpl-short"], []),
    ("{mpl}", ["mpl-named"], []),
    ("{cc}", ["cc-named"], []),
    ("CC0-1.0", ["cc0-named"], []),
    ("Unlicense", ["unlicense-named"], []),
    ("{epl}", ["epl-named"], []),
    ("{epl}", ["epl-short"], []),
    ("BSL-1.0", ["boost"], []),
    ("Zlib", ["zlib-named"], []),
    ("WTFPL", ["wtfpl"], []),
    ("MIT", ["mit-title"], []),
]
# --- End of fixed values. ---

_FILL = {"{v}": r"(?:(?:v|vers?|version|no)[. ]?)?(?P<v>[0-9]+(?:\.[0-9]+)*)", "{x}": r"(?:.{0,300}?)"}


def _compiled(pattern: str) -> re.Pattern:
    for name, value in _FILL.items():
        pattern = pattern.replace(name, value)
    return re.compile(rf"(?<!\S)(?:{pattern})(?!\S)", re.A)


PATTERNS = {k: _compiled(p) for k, p in SENTENCES.items()}
# Words one of which stands, in the normalised form, in whatever a sentence can match, to skip most patterns (fixed values).
NEEDS = {
    "mit-named": " under ", "mit-title": "mit license", "mit-grant": "free of charge", "mit-notice": "permission notice", "as-is": " as is ", "no-liability": "in no event",
    "isc-grant": "permission to use", "isc-named": " isc", "bsd-grant": "binary forms", "bsd-source": "source code must", "bsd-binary": "binary form must", "bsd-endorse": "endorse or promote",
    "bsd-advert": "advertising materials", "bsd-named": "bsd", "apache-named": "apache", "apache-other": "apache", "apache-comply": "in compliance", "apache-copy": "you may obtain",
    "apache-asis": "unless required", "apache-see": "specific language", "gpl-named": " under ", "gpl-short": "gpl", "gpl-grant": "free software", "gpl-hope": "in the hope",
    "gpl-see": "see the gnu", "gpl-copy": "should have received", "mpl-grant": "mozilla", "mpl-copy": "mpl was", "mpl-named": "mozilla", "cc-named": " under ", "cc0-named": "cc0|cc zero|creative commons zero",
    "public-domain": "unencumbered", "unlicense-named": "unlicense", "epl-named": "eclipse", "epl-short": "eclipse", "boost": "boost", "zlib-grant": "permission is granted",
    "zlib-named": "zlib", "wtfpl": "what the fuck", "proprietary": "all rights reserved",
}
_NEEDED = {k: words.split("|") for k, words in NEEDS.items()}
_ANY = re.compile("|".join(re.escape(w) for w in sorted({w for words in _NEEDED.values() for w in words})))
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9.+-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+-]+)*\)?)")
# A full stop ends no sentence behind v., ver., vers. or no. before a number, wherever the line is cut.
_BREAK = re.compile(r"(?<=[.!?])(?!(?:(?<=\b[vV]\.)|(?<=\b[nN][oO]\.)|(?<=\b[vV][eE][rR]\.)|(?<=\b[vV][eE][rR][sS]\.))\s[\s*/#;%-]*[0-9])[\"')\]]*\s+|(?<=:)\s*\n|\n\s*\n|[  ]")
_MARKS = re.compile(r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|<!--|rem\b|dnl\b)[ \t]?|-->|\*/")
_DROP = re.compile(r"[^a-z0-9.+\n]+")


def normalise(sentence: str) -> str:
    """Lower case, comment marks and punctuation dropped, white space single, one spelling."""
    s = _DROP.sub(" ", _MARKS.sub("", sentence).lower().replace("licence", "license").replace("c++", "cpp"))
    s = re.sub(r"\.(?=\s|\Z)|(?<![0-9a-z])\.|\n", " ", s)
    return " ".join(s.split())


def hinted(sentence: str) -> bool:
    """Whether a normalised sentence holds a word without which no pattern can match."""
    return _ANY.search(f" {sentence} ") is not None


def known(sentence: str) -> list[tuple[str, dict]]:
    """Identifiers of the known sentences in a normalised one, in order, with the parts of their match."""
    hits, padded = [], f" {sentence} "
    for name, pattern in PATTERNS.items():
        if any(w in padded for w in _NEEDED[name]):
            hits += [(m.start(), -m.end(), name, {k: v for k, v in m.groupdict().items() if v}) for m in pattern.finditer(sentence)]
    out, until = [], 0
    for start, end, name, parts in sorted(hits, key=lambda h: h[:3]):
        if start >= until:  # what lies in a longer match is part of it
            out.append((name, parts))
            until = -end
    return out


def sentences(text: str) -> list[tuple[int, str]]:
    """(offset, sentence) of a text."""
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            out.append((at, text[at:end]))
        at = m.end() if m else at
    return out


def identifiers(text: str) -> list[tuple[int, str, dict]]:
    """(offset, identifier, parts) of the known sentences of a text, in order."""
    found = [(m.start(), "spdx", {"id": m[1].strip("()")}) for m in SPDX.finditer(text)]
    for at, sentence in sentences(text):
        if hinted(plain := normalise(sentence)):
            found += [(at, *hit) for hit in known(plain)]
    return sorted(found, key=lambda f: f[0])


def _name(template: str, parts: dict) -> str:
    v = parts.get("v", "")
    if template == "{spdx}":
        return " ".join(parts["id"].split())
    if template == "{apache}":
        return f"Apache-{v if '.' in v else v + '.0'}"
    if template == "{mpl}":
        return f"MPL-{v if '.' in v else v + '.0'}"
    if template == "{epl}":
        return f"EPL-{v if '.' in v else v + '.0'}"
    if template == "{bsd}":
        n = {"two": "2", "three": "3", "four": "4"}.get(parts.get("n", ""), parts.get("n") or parts.get("m"))
        return f"BSD-{n}-Clause" if n else "BSD"
    if template == "{gpl}":
        kind = {"lesser": "LGPL", "library": "LGPL", "l": "LGPL", "affero": "AGPL", "a": "AGPL"}.get(parts.get("kind", "").strip(), "GPL")
        return f"{kind}-{v if '.' in v else v + '.0'}-{'or-later' if parts.get('later') else 'only'}"
    if template == "{cc}":
        k = parts["kind"].replace(" ", "")
        k = re.sub("attribution", "by", re.sub("noncommercial", "nc", re.sub("sharealike", "sa", re.sub("noderiv(?:ative)?s", "nd", k))))
        return f"CC-{'-'.join(re.findall('by|nc|sa|nd', k)).upper()}-{v}" if v else f"CC-{'-'.join(re.findall('by|nc|sa|nd', k)).upper()}"
    return template


def licences(found: list[tuple[int, str, dict]]) -> list[tuple[int, str]]:
    """(offset, licence) by the ordered rules. A rule's sentences may have its optional ones in between; what it takes is spent."""
    out, i = [], 0
    while i < len(found):
        for name, must, may in RULES:
            j, k = i, 0
            while j < len(found) and (k < len(must) or found[j][1] in may):
                if k < len(must) and found[j][1] == must[k]:
                    k += 1
                elif not (k and found[j][1] in may):
                    break
                j += 1
            if k == len(must):
                out.append((found[i][0], _name(name, found[i][2])))
                i = j
                break
        else:
            i += 1
    return out


def scan(text: Column) -> Column:
    """Struct of the licences of a column of UTF-8 bytes, in the order of their first place, and the identifiers that led to them."""

    @F.arrow_udf("struct<licences: array<string>, sentences: array<string>, first_at: bigint>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for raw in texts.to_pylist():
            found = identifiers(raw.decode("utf-8", "replace"))
            got = licences(found)
            rows.append({"licences": list(dict.fromkeys(n for _, n in got)), "sentences": [n for _, n, _ in found], "first_at": got[0][0] if got else None})
        return pa.array(rows, pa.struct([("licences", pa.list_(pa.string())), ("sentences", pa.list_(pa.string())), ("first_at", pa.int64())]))

    return run.asNondeterministic()(text)


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, licences, sentences, n_licences, first_at) of every document.

    Texts are read whole. ``licences`` and ``sentences`` are joined by commas, empty where
    nothing is found, as for null and empty texts; ``first_at`` (code points from 0) is then
    null. Repeated rows give repeated rows, an empty table none; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), scan(text_bytes(text_col)).alias("s"))
    return rows.select(F.col("id").alias(id_col), F.array_join("s.licences", ",").alias("licences"), F.array_join("s.sentences", ",").alias("sentences"),
                       F.size("s.licences").cast("long").alias("n_licences"), F.col("s.first_at").alias("first_at"))
