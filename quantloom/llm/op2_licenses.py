"""License scans by sentence rules.

A text is cut into pieces wherever a sentence may end; pieces that make a known sentence
together (across wrapped lines, abbreviations, colons, or the blank line before an
address) are joined, list numbers that stand alone are left out. Each sentence is normalised (lower case, one blank between words,
no marks, comment signs or quotes, one spelling of "license", names and years of a
copyright line left out) and looked up among known licence sentences. What is found is a
sequence of identifiers, with gaps where other sentences stand. Rules are sequences of
identifiers too, and a license is found where the identifiers of its rule follow one
another in the text without a gap; longer rules come first and use up their sentences.
Sentences that speak of licenses but are unknown, or known but used by no rule, count too.

Texts without any of the trigger words hold no known sentence, and are not cut up.
Defined results: null and empty texts have no licenses; repeated rows stay; ties
between rules of equal length go by the rules' order; a very long text is scanned whole; an empty table gives
an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known sentences by identifier, normalised; "#" stands for any words (fixed values: public licence texts).
SENTENCES = {
    "AllRights": "all rights reserved",
    "Copyright": "copyright #",
    "ApacheUnder": "licensed under the apache license version 2 0",
    "ApacheUnder2": "licensed under the apache license version 2 0 the license",
    "ApacheNotExcept": "you may not use this file except in compliance with the license",
    "ApacheObtain": "you may obtain a copy of the license at #",
    "ApacheAsIs": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "MITUnder": "released under the mit license",
    "MITUnder2": "licensed under the mit license",
    "MITGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction #",
    "MITNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MITNotice2": "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",
    "MITNoWarranty": "the software is provided as is without warranty of any kind express or implied #",
    "MITNoLiability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability #",
    "ISCGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ISCGrant2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ISCNoWarranty": "the software is provided as is and the author disclaims all warranties with regard to this software #",
    "ISCNoWarranty2": "the software is provided as is and # disclaims all warranties with regard to this software #",
    "BSDGrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSDSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSDBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSDEndorse": "neither the name of # nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSDNoWarranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties #",
    "BSDNoWarranty2": "this software is provided by # as is and any express or implied warranties #",
    "GPLUnder3": "this work is licensed under the gnu general public license version 3",
    "GPLUnder2": "this work is licensed under the gnu general public license version 2",
    "GPLFree1": "# is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 1 of the license or at your option any later version",
    "GPLFree2": "# is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "GPLFree3": "# is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "LGPLFree2": "# is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "LGPLFree21": "# is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "LGPLFree3": "# is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "LibraryGPLFree2": "# is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "AGPLFree3": "# is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GPLOnly2": "# is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "GPLOnly2b": "# is free software you can redistribute it and or modify it under the terms of version 2 of the gnu general public license as published by the free software foundation",
    "GPLOnly3": "# is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "GPLOnly3b": "# is free software you can redistribute it and or modify it under the terms of version 3 of the gnu general public license as published by the free software foundation",
    "GPLNoWarranty": "# is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GPLSee": "see the gnu # general public license for more details",
    "GPLSeePlain": "see the gnu general public license for more details",
    "GPLReceived": "you should have received a copy of the gnu # along with #",
    "MPLSubject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "MPLCopy": "if a copy of the mpl was not distributed with this file you can obtain one at #",
    "CCBYNC4": "licensed under cc by nc 4 0",
    "CCBYSA4": "licensed under cc by sa 4 0",
    "CCBY4": "licensed under cc by 4 0",
    "CC0": "licensed under cc0 1 0",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "UnlicenseFree": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "ZlibNoWarranty": "this software is provided as is without any express or implied warranty",
    "ZlibNoLiability": "in no event will the # be held liable for any damages arising from the use of this software",
    "ZlibGrant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "ZlibOrigin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "ZlibThanks": "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required",
    "ZlibAltered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "ZlibNotice": "this notice may not be removed or altered from any source distribution",
    "BoostTitle": "boost software license version 1 0 august 17th 2003",
    "BoostGrant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "BoostUnder": "distributed under the boost software license version 1 0",
    "ZeroGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "EclipseUnder": "this program and the accompanying materials are made available under the terms of the eclipse public license # which is available at #",
    "CDDLUnder": "the contents of this file are subject to the terms of the common development and distribution license #",
    "ApacheTitle": "apache license version 2 0 january 2004",
    "ApacheTitle2": "apache license version 2 0 january 2004 http www apache org licenses",
    "GPLTitle1": "gnu general public license version 1 february 1989",
    "GPLTitle2": "gnu general public license version 2 june 1991",
    "GPLTitle3": "gnu general public license version 3 29 june 2007",
    "LGPLTitle2": "gnu library general public license version 2 june 1991",
    "LGPLTitle21": "gnu lesser general public license version 2 1 february 1999",
    "LGPLTitle3": "gnu lesser general public license version 3 29 june 2007",
    "AGPLTitle3": "gnu affero general public license version 3 19 november 2007",
    "GFDLTitle12": "gnu free documentation license version 1 2 november 2002",
    "GFDLTitle13": "gnu free documentation license version 1 3 3 november 2008",
    "MPLTitle": "mozilla public license version 2 0",
    "CC0Title": "cc0 1 0 universal",
    "GNUVerbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
}

#: License and the sentences that make it, in order (fixed values: public licence texts and notices).
RULES = [
    ("Apache-2.0", ("ApacheUnder", "ApacheNotExcept", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheUnder",)),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDNoWarranty")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDNoWarranty")),
    ("MIT", ("MITGrant", "MITNotice", "MITNoWarranty", "MITNoLiability")),
    ("MIT", ("MITUnder",)),
    ("MIT", ("MITUnder2",)),
    ("ISC", ("ISCGrant", "ISCNoWarranty")),
    ("GPL-1.0-or-later", ("GPLFree1", "GPLNoWarranty", "GPLSeePlain", "GPLReceived")),
    ("GPL-1.0-or-later", ("GPLFree1", "GPLNoWarranty", "GPLSeePlain")),
    ("GPL-1.0-or-later", ("GPLFree1",)),
    ("GPL-2.0-or-later", ("GPLFree2", "GPLNoWarranty", "GPLSeePlain", "GPLReceived")),
    ("GPL-2.0-or-later", ("GPLFree2", "GPLNoWarranty", "GPLSeePlain")),
    ("GPL-2.0-or-later", ("GPLFree2",)),
    ("GPL-3.0-or-later", ("GPLFree3", "GPLNoWarranty", "GPLSeePlain", "GPLReceived")),
    ("GPL-3.0-or-later", ("GPLFree3", "GPLNoWarranty", "GPLSeePlain")),
    ("GPL-3.0-or-later", ("GPLFree3",)),
    ("GPL-2.0-only", ("GPLOnly2", "GPLNoWarranty", "GPLSeePlain", "GPLReceived")),
    ("GPL-2.0-only", ("GPLOnly2", "GPLNoWarranty", "GPLSeePlain")),
    ("GPL-2.0-only", ("GPLOnly2",)),
    ("GPL-3.0-only", ("GPLOnly3", "GPLNoWarranty", "GPLSeePlain", "GPLReceived")),
    ("GPL-3.0-only", ("GPLOnly3", "GPLNoWarranty", "GPLSeePlain")),
    ("GPL-3.0-only", ("GPLOnly3",)),
    ("LGPL-2.0-or-later", ("LGPLFree2", "GPLNoWarranty", "GPLSee", "GPLReceived")),
    ("LGPL-2.0-or-later", ("LGPLFree2", "GPLNoWarranty", "GPLSee")),
    ("LGPL-2.0-or-later", ("LGPLFree2",)),
    ("LGPL-2.0-or-later", ("LibraryGPLFree2", "GPLNoWarranty", "GPLSee", "GPLReceived")),
    ("LGPL-2.0-or-later", ("LibraryGPLFree2", "GPLNoWarranty", "GPLSee")),
    ("LGPL-2.0-or-later", ("LibraryGPLFree2",)),
    ("LGPL-2.1-or-later", ("LGPLFree21", "GPLNoWarranty", "GPLSee", "GPLReceived")),
    ("LGPL-2.1-or-later", ("LGPLFree21", "GPLNoWarranty", "GPLSee")),
    ("LGPL-2.1-or-later", ("LGPLFree21",)),
    ("LGPL-3.0-or-later", ("LGPLFree3", "GPLNoWarranty", "GPLSee", "GPLReceived")),
    ("LGPL-3.0-or-later", ("LGPLFree3", "GPLNoWarranty", "GPLSee")),
    ("LGPL-3.0-or-later", ("LGPLFree3",)),
    ("AGPL-3.0-or-later", ("AGPLFree3", "GPLNoWarranty", "GPLSee", "GPLReceived")),
    ("AGPL-3.0-or-later", ("AGPLFree3", "GPLNoWarranty", "GPLSee")),
    ("AGPL-3.0-or-later", ("AGPLFree3",)),
    ("GPL-3.0", ("GPLUnder3",)),
    ("GPL-2.0", ("GPLUnder2",)),
    ("MPL-2.0", ("MPLSubject", "MPLCopy")),
    ("MPL-2.0", ("MPLSubject",)),
    ("CC-BY-NC-4.0", ("CCBYNC4",)),
    ("CC-BY-SA-4.0", ("CCBYSA4",)),
    ("CC-BY-4.0", ("CCBY4",)),
    ("CC0-1.0", ("CC0",)),
    ("Unlicense", ("Unlicense", "UnlicenseFree")),
    ("Unlicense", ("Unlicense",)),
    ("Zlib", ("ZlibNoWarranty", "ZlibNoLiability", "ZlibGrant", "ZlibOrigin", "ZlibThanks", "ZlibAltered", "ZlibNotice")),
    ("Zlib", ("ZlibNoWarranty", "ZlibNoLiability", "ZlibGrant")),
    ("BSL-1.0", ("BoostTitle", "BoostGrant")),
    ("BSL-1.0", ("BoostGrant",)),
    ("BSL-1.0", ("BoostUnder",)),
    ("0BSD", ("ZeroGrant", "ISCNoWarranty")),
    ("EPL", ("EclipseUnder",)),
    ("CDDL", ("CDDLUnder",)),
    ("Apache-2.0", ("ApacheTitle",)),
    ("GPL-1.0", ("GPLTitle1",)),
    ("GPL-2.0", ("GPLTitle2",)),
    ("GPL-3.0", ("GPLTitle3",)),
    ("LGPL-2.0", ("LGPLTitle2",)),
    ("LGPL-2.1", ("LGPLTitle21",)),
    ("LGPL-3.0", ("LGPLTitle3",)),
    ("AGPL-3.0", ("AGPLTitle3",)),
    ("GFDL-1.2", ("GFDLTitle12",)),
    ("GFDL-1.3", ("GFDLTitle13",)),
    ("MPL-2.0", ("MPLTitle",)),
    ("CC0-1.0", ("CC0Title",)),
    ("AllRightsReserved", ("AllRights",)),
]

#: A known sentence has one of these in it; so has one that may speak of licenses.
TRIGGERS = ("licen", "copyright", "(c)", "©", "reserved", "permi", "warrant", "redistribut", "software", "unencumbered", "liable", "mpl", "gnu", "contributors", "misrepresented", "cc0", "notice", "implied", "acknowledgment", "artistic", "license")

#: Other wordings of a sentence.
SAME = {"ApacheUnder2": "ApacheUnder", "MITNotice2": "MITNotice", "ISCGrant2": "ISCGrant", "ISCNoWarranty2": "ISCNoWarranty", "BSDNoWarranty2": "BSDNoWarranty", "ApacheTitle2": "ApacheTitle", "GPLOnly2b": "GPLOnly2", "GPLOnly3b": "GPLOnly3"}

#: Where sentences may end: at line ends, and at a mark before white space.
_END = re.compile(r"[.!?:;](?=\s)|\n\s*\n|\n(?=\s*(?:[*#/;-]|\d+\.|\()|\s*[A-Z])")
#: Where a sentence with an open end is over.
_OVER = re.compile(r"[.!?]|:(?=\s*\n)|\n[\s*#/;-]*\n|\n(?=\s*\d+\.\s)")
#: A piece that is no more than a list mark or a comment sign.
_MARK = re.compile(r"[\s*#/;•-]*(?:\(?(?:\d+|[a-zA-Z]|[ivx]+)[.):]?)?[\s*#/;-]*")
#: Pieces, and ends of sentences among them, that a known sentence may be spread over.
MAX_PIECES, MAX_ENDS = 40, 3
_NOISE = re.compile(r"[^a-z0-9#]+")
_SPELL = re.compile(r"\blicenc")
_COPYRIGHT = re.compile(r"^(?:\(c\)|©|copyright)[\W_]*(?:\(c\)|©|\d)|^copyright\b", re.I)


def normalise(sentence: str) -> str:
    text = _SPELL.sub("licens", _NOISE.sub(" ", sentence.lower().replace("#", " ")).strip())
    return "copyright #" if _COPYRIGHT.match(sentence.strip(" \t*/#;-")) else text


def cut(text: str) -> list[tuple[int, int, bool]]:
    """Spans of the pieces of a text, and whether a sentence is over after each."""
    out: list[tuple[int, int, bool]] = []

    def add(a: int, b: int, over: bool) -> None:
        if text[a:b].strip():
            out.append((a, b, over))
        elif out and over:
            out[-1] = (*out[-1][:2], True)

    at = 0
    for m in _END.finditer(text):
        add(at, m.end(), _OVER.match(text, m.start()) is not None)
        at = m.end()
    add(at, len(text), True)
    return out


class Known:
    """Known sentences: whole ones by a table, those with open places by patterns."""

    def __init__(self, sentences: dict[str, str] = SENTENCES):
        self.exact = {s: k for k, s in sentences.items() if "#" not in s}
        self.open = [(k, re.compile("^" + re.escape(s).replace(r"\#", r"\S.*") + "$")) for k, s in sentences.items() if "#" in s and s != "copyright #"]
        self.exact["copyright #"] = "Copyright"
        self.loose = {k for k, s in sentences.items() if s.endswith("#")}
        self.starts: dict[str, list[str]] = {}
        for s in sentences.values():
            if s[0] != "#" and s != "copyright #":
                self.starts.setdefault(s.split()[0], []).append(s.split("#")[0].strip())
        self.inner = {" ".join(s.split()[1:4]) for s in sentences.values() if s[0] == "#"}

    def may_start(self, piece: str) -> bool:
        """Whether a known sentence may begin with this normalised piece and go on."""
        starts = self.starts.get(piece.split(" ", 1)[0], ())
        return any(s.startswith(piece) or piece.startswith(s) for s in starts) or any(s in piece for s in self.inner)

    def name(self, sentence: str) -> str | None:
        found = self.exact.get(sentence)
        if found is None:
            found = next((k for k, p in self.open if p.match(sentence)), None)
        return SAME.get(found, found)

    def joined(self, text: str, pieces: list[tuple[int, int, bool]], at: int) -> tuple[str, int] | None:
        """The known sentence that begins with a piece, and the piece after it."""
        if not self.may_start(normalise(text[slice(*pieces[at][:2])])):
            return None
        ends = 0
        for to in range(at, min(at + MAX_PIECES, len(pieces))):
            found = self.name(normalise(text[pieces[at][0] : pieces[to][1]]))
            if found is not None:
                return found, to + 1
            ends += pieces[to][2]
            if ends > MAX_ENDS:
                break
        return None

    def spread(self, text: str, pieces: list[tuple[int, int, bool]], at: int) -> tuple[str, int] | None:
        """The same, with the rest of a sentence whose end is open: up to where it is over or a known one begins."""
        found = self.joined(text, pieces, at)
        if found is None or found[0] not in self.loose:
            return found
        to = found[1]
        while to < len(pieces) and not pieces[to - 1][2] and self.name(normalise(text[slice(*pieces[to][:2])])) is None and self.joined(text, pieces, to) is None:
            to += 1
        return found[0], to


def match(names: list[str | None], rules: list[tuple[str, tuple[str, ...]]] = RULES) -> list[tuple[str, int, int]]:
    """Licenses and the sentences they use (from, to), longer rules first, each sentence once."""
    used = [False] * len(names)
    out = []
    for license_, rule in sorted(rules, key=lambda r: -len(r[1])):
        n = len(rule)
        for i in range(len(names) - n + 1):
            if tuple(names[i : i + n]) == rule and not any(used[i : i + n]):
                used[i : i + n] = [True] * n
                out.append((license_, i, i + n))
    return sorted(out, key=lambda x: x[1:])


def scan_text(text: str, known: Known) -> tuple[list[str], list[str], list[int], list[int], int]:
    """Licenses, identifiers, and spans of a text's known sentences; number of unknown ones that speak of licenses."""
    names, spans, unknown = [], [], 0
    pieces = cut(text)
    i = 0
    while i < len(pieces):
        a, b, _ = pieces[i]
        sentence = text[a:b]
        if _MARK.fullmatch(sentence):
            i += 1
            continue
        low = sentence.lower()
        known_here = known.spread(text, pieces, i)
        if known_here is not None:
            name, i = known_here
            b = pieces[i - 1][1]
        else:
            name = known.name(normalise(sentence)) if any(t in low for t in TRIGGERS) else None
            unknown += name is None and "licen" in low
            i += 1
        names.append(name)
        spans.append((a, b))
    found = [i for i, n in enumerate(names) if n]
    licenses = [license_ for license_, _, _ in match(names)]
    return licenses, [names[i] for i in found], [spans[i][0] for i in found], [spans[i][1] for i in found], unknown


RESULT = "doc_id long, licenses array<string>, sentences array<string>, starts array<int>, ends array<int>, n_unknown int"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Known()
    for batch in batches:
        rows = [scan_text(t, known) if t else ([], [], [], [], 0) for t in batch.column("text").to_pylist()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [c.split()[0] for c in RESULT.split(", ")])


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licenses of every text, in the order of the text, and its known sentences with their places."""
    low = F.lower(F.col(text))
    speaks = F.lit(False)
    for t in TRIGGERS:
        speaks = speaks | low.contains(t)
    # texts that can't hold a known sentence stay in the JVM
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.when(speaks, F.col(text)).alias("text")).mapInArrow(_scan, RESULT)
