"""Licences in texts, by rules over known sentences.

A text is cut into sentences twice, by lines and by paragraphs (licence texts are often
wrapped). A sentence is brought to a normal form; forms of known licence sentences have
identifiers, a few of them with gaps for names and years. The identifiers found, in text
order, are matched against ordered rules: a rule names the identifiers that must follow
each other with few other licence sentences between them. A sentence that a rule has used
is not used again, so full texts win over short notices.

Null text counts as empty and has no licences; repeated rows and null identifiers are kept.
Scanning is narrow, over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.bpe import small_batches

#: Sentences of public licences in normal form. ``<x>`` stands for one to eight words.
SENTENCES = {
    "mit_title": "mit license",
    "mit_grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions"
    ),
    "mit_keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
        "purpose and noninfringement"
    ),
    "no_event": (
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
        "out of or in connection with the software or the use or other dealings in the software"
    ),
    "apache_title": "apache license version 2 0",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache_basis": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any "
        "kind either express or implied"
    ),
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution"
    ),
    "bsd_names": "neither the name of <x> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies"
    ),
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <x> of the license or at your option any later version",
    "lgpl_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version <x> of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_see": "see the gnu general public license for more details",
    "mpl_notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
    "copyright": "copyright <x>",
}
#: Names of licences as notices write them, in normal form, by identifier of the licence.
NAMES = {
    "MIT": ["mit license", "mit"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0", "apache 2 0 license"],
    "GPL-3.0": ["gnu general public license version 3", "gnu gpl version 3", "gpl version 3", "gpl v3", "gplv3", "gpl 3 0", "gnu general public license v3 0"],
    "GPL-2.0": ["gnu general public license version 2", "gpl version 2", "gpl v2", "gplv2", "gpl 2 0"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl version 3", "lgpl v3", "lgpl 3 0"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl version 3", "agpl v3", "agpl 3 0"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "bsd 3 clause", "new bsd license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "bsd 2 clause", "simplified bsd license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "ISC": ["isc license"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "CC0-1.0": ["cc0 1 0", "cc0", "cc0 1 0 universal"],
}
#: Ordered rules: licence and the sentences that follow each other.
RULES = [
    ("MIT", ["mit_grant", "mit_keep", "as_is", "no_event"]),
    ("MIT", ["mit_grant", "mit_keep"]),
    ("MIT", ["mit_grant"]),
    ("Apache-2.0", ["name:Apache-2.0", "apache_use", "apache_copy", "apache_basis", "apache_see"]),
    ("Apache-2.0", ["name:Apache-2.0", "apache_use"]),
    ("Apache-2.0", ["apache_use", "apache_copy"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("ISC", ["isc_grant"]),
    ("LGPL", ["lgpl_free"]),
    ("GPL", ["gpl_free", "gpl_hope", "gpl_see"]),
    ("GPL", ["gpl_free"]),
    ("MPL-2.0", ["mpl_notice"]),
    ("Unlicense", ["unlicense"]),
    *((licence, [f"name:{licence}"]) for licence in NAMES),
    ("MIT", ["mit_title"]),
    ("Apache-2.0", ["apache_title"]),
    ("All rights reserved", ["copyright", "reserved"]),
    ("All rights reserved", ["reserved"]),
]
#: Other licence sentences that may stand between two of a rule.
BETWEEN = 3

#: Verbs of notices, before "under" and a name.
VERBS = ("licensed", "released", "distributed", "available", "published", "provided")
#: Every known sentence and notice has one of these parts, so a text without any has no licence.
CUES = ("licen", "permission", "redistribut", "warrant", "copyright", "spdx")
PHRASES = ("rights reserved", "in no event", "free software", "free and unencumbered", "this program is", *(f"{v} under" for v in VERBS))
#: Phrases with anything between their words that a normal form drops, and a word of each, which is quick to look for.
_PHRASE = re.compile("|".join(p.replace(" ", r"[\W_]+") for p in PHRASES))
_WORDS = ("reserved", "event", "free", "program", "under")
#: Ends of sentences: a single mark before white space.
END = re.compile(r"(?<![.!?;])[.!?;](?=\s)")
VERB = rf"(?:this (?:work|file|program|project|software|document|code|text|library) is |it is |are |is )?(?:{'|'.join(VERBS)}|made available) under (?:the terms of )?(?:the |an |a )?"


def normal(sentence: str) -> str:
    """Lower case, words and digits only, one spelling."""
    words = re.sub(r"[\W_]+", " ", sentence.lower()).split()
    return " ".join("license" if w == "licence" else "licenses" if w == "licences" else w for w in words)


def cued(text: str) -> bool:
    low = text.lower()
    return any(c in low for c in CUES) or any(w in low for w in _WORDS) and bool(_PHRASE.search(low))


@cache
def _known() -> tuple[dict[str, str], list[tuple[re.Pattern, str]], re.Pattern]:
    exact = {s: i for i, s in SENTENCES.items() if "<x>" not in s}
    gaps = [(re.compile(re.escape(s).replace("<x>", r"(?:\S+ ?){1,8}?").replace("\\ ", " ") + "$"), i) for i, s in SENTENCES.items() if "<x>" in s]
    names = sorted(((n, k) for k, ns in NAMES.items() for n in ns), key=lambda x: -len(x[0]))
    notice = re.compile(rf"\b(?:{VERB}|spdx license identifier )(?P<name>{'|'.join(re.escape(n) for n, _ in names)})(?: license)?\b")
    return exact, gaps, notice


@cache
def _inside() -> re.Pattern:
    """Known sentences without gaps, longest first, inside a longer normal form."""
    exact = [s for s in _known()[0] if len(s.split()) > 2]
    return re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(exact, key=len, reverse=True))) + r")\b")


@cache
def _licence_of() -> dict[str, str]:
    return {n: k for k, ns in NAMES.items() for n in ns}


def identifiers(form: str) -> list[str]:
    """Identifiers of the known sentences that a normal form is or holds."""
    exact, gaps, notice = _known()
    if form in exact:
        return [exact[form]]
    found = [i for p, i in gaps if p.match(form)]
    found += [f"name:{_licence_of()[m['name']]}" for m in notice.finditer(form)]
    found += [exact[m.group()] for m in _inside().finditer(form)]
    return list(dict.fromkeys(found))


def _pieces(text: str, breaks: re.Pattern) -> Iterator[tuple[int, int]]:
    begin = 0
    for m in breaks.finditer(text):
        yield begin, m.start()
        begin = m.end()
    yield begin, len(text)


LINES, PARAGRAPHS = re.compile(rf"\n|{END.pattern}"), re.compile(rf"\n\s*\n|{END.pattern}")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """``start, end, identifier`` in text order; one place gives an identifier once."""
    found: list[tuple[int, int, str]] = []
    for breaks in (LINES, PARAGRAPHS):
        for a, b in _pieces(text, breaks):
            part = text[a:b]
            if cued(part):
                for i in identifiers(normal(part)):
                    if not any(i == k and x < b and a < y for x, y, k in found):
                        found.append((a, b, i))
    return sorted(found)


def licences(text: str | None) -> list[tuple[str, int, int]]:
    """``licence, start, end`` of every rule that applies."""
    if not text or not cued(text):
        return []
    found = sentences(text)
    used, out = [False] * len(found), []
    for licence, rule in RULES:
        k = 0
        while k < len(found):
            at, want, j = [], 0, k
            while j < len(found) and want < len(rule) and (not at or j - at[-1] <= BETWEEN + 1):
                if not used[j] and found[j][2] == rule[want]:
                    at.append(j)
                    want += 1
                elif not at:
                    break
                j += 1
            if want == len(rule):
                for j in at:
                    used[j] = True
                out.append((licence, min(found[j][0] for j in at), max(found[j][1] for j in at)))
            k += 1
    return sorted(set(out), key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, licences, findings`` of every row; places count code points."""
    kind = docs.schema[id_column].dataType.simpleString()
    place = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = [licences(t) for t in b.column(1).to_pylist()]
            names = pa.array([sorted({x for x, *_ in f}) for f in found], pa.list_(pa.string()))
            places = pa.array([[dict(zip(("licence", "start", "end"), x)) for x in f] for f in found], place)
            yield pa.RecordBatch.from_arrays([b.column(0), names, places], names=["id", "licences", "findings"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, licences array<string>, findings array<struct<licence: string, start: bigint, end: bigint>>").withColumnRenamed("id", id_column)
