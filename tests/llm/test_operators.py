"""The corpus operators against brute force, round trips and their stated edge cases."""

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import op1_warc, op2_licenses, op3_fingerprints, op4_line_dedup, op5_quality, op6_sharding, op7_html, op8_decontamination, op9_bpe, op10_dartminhash
from quantloom.llm.common import begin, mix, span_hashes, tidy
from quantloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, h string, key int, c string, line string, own int, found int"


def docs(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 2, 3) for i, t in rows], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


EDGE = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id at all"), (4, " \n \n"), (5, "long " * 30000), (6, "é中😀 ñ"), (7, "one"), (-9, "x\ny\nx")]


# -- 1: WARC ----------------------------------------------------------------


def test_warc_round_trip_and_revisits(spark):
    page = "<p>" + "same " * 40 + "</p>"
    rows = [(5, "http://a/5", page), (2, "http://a/2", page), (9, None, page), (1, "http://a/1", "short"), (3, "u", "short"), (4, "", None), (None, "n", page), (7, "é", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in op1_warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert [(i, got[i].record_type, got[i].refers_to) for i in (2, 5, 9, 1, 3)] == [(2, "response", None), (5, "revisit", 2), (9, "revisit", 2), (1, "response", None), (3, "response", None)]


def test_warc_reader_checks(spark):
    dictionary = op1_warc.train([b" ".join(w.encode() for w in words(800, i)) for i in range(60)])
    assert dictionary
    out = io.BytesIO()
    writer = op1_warc.Writer(out, dictionary)
    raw = op1_warc.record(1, "http://x", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    for _ in range(3):
        writer.write(raw)
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    assert len(list(op1_warc.Reader(io.BytesIO(data), buffer=7))) == 3
    with pytest.raises(op1_warc.BadRecord):
        list(op1_warc.Reader(io.BytesIO(data[:-3])))
    for bad in (raw.replace(b"WARC/1.1", b"WARK/1.1"), raw.replace(b"payload\r\n\r\n", b"payloaX\r\n\r\n"), raw + b"x", raw.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(op1_warc.BadRecord):
            op1_warc.parse(bad)


def test_warc_reads_foreign_archives(spark):
    """Records of other makers: any type, ids that are no pages, digests in base 32, headers that go on in a next line."""
    out = io.BytesIO()
    writer = op1_warc.Writer(out, b"")

    def put(fields, block):
        head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
        writer.write(head.encode() + block + b"\r\n\r\n")

    body = b"<html>x</html>"
    http = b"HTTP/1.1 200 OK\r\nServer: s\r\nContent-Length: 14\r\n\r\n" + body
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    base = [("WARC-Date", "2024-05-01T00:00:00Z")]
    put([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:1>"), *base, ("Content-Type", "application/warc-fields")], b"software: s\r\n")
    put([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:2>"), *base, ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\nHost: h\r\n\r\n")
    put([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:3>"), *base, ("WARC-Target-URI", "http://h/\r\n a"), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http; msgtype=response")], http)
    put([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:4>"), *base, ("WARC-Refers-To", "<urn:uuid:3>"), ("Content-Type", "application/http")], b"")
    put([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:uuid:5>"), *base, ("Content-Type", "text/dns")], b"1.2.3.4")
    archives = spark.createDataFrame([(bytearray(out.getvalue()),)], "archive binary")
    got = {r.record_id: r for r in op1_warc.read(archives).collect()}
    assert [got[f"<urn:uuid:{i}>"].record_type for i in range(1, 6)] == ["warcinfo", "request", "response", "revisit", "resource"]
    assert bytes(got["<urn:uuid:3>"].payload) == body and got["<urn:uuid:3>"].url == "http://h/ a" and got["<urn:uuid:3>"].page_id is None
    assert got["<urn:uuid:4>"].refers_to_record == "<urn:uuid:3>" and bytes(got["<urn:uuid:5>"].payload) == b"1.2.3.4"
    wrong = ((http.replace(b"14", b"x4"), "isn't a number"), (http.replace(b"14", b"13"), "its head says"), (http.replace(b"html", b"hxml"), "doesn't match"))
    for block, why in wrong:
        headers = {"warc-type": "response", "warc-record-id": "<urn:uuid:3>", "warc-payload-digest": f"sha1:{sha1}", "content-type": "application/http"}
        with pytest.raises(op1_warc.BadRecord, match=why):
            op1_warc._row(headers, block, True)
    with pytest.raises(op1_warc.BadRecord, match="UTF-8"):
        op1_warc.parse(b"WARC/1.0\r\nX: \xff\r\n\r\n")


def test_warc_clashing_columns_long_payloads_and_many_repeats(spark, monkeypatch):
    monkeypatch.setattr(op1_warc, "REPEATED_ROWS", 0)  # the way for many repeated payloads
    page = "é" * 700_000
    rows = [(i, f"http://h/{i}", page if i % 2 else f"short {i}", "x", 1) for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, refers_to int")
    got = {r.page_id: r for r in op1_warc.round_trip(pages).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {i: ("revisit", 1, 1_400_000) if i in (3, 5, 7) else ("response", None, 1_400_000 if i == 1 else 7) for i in range(8)}


def test_warc_files_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "text %d " % i * 50) for i in range(30)], "page_id long, url string, html string")
    archives = op1_warc.write(pages, f"file://{tmp_path}/table")
    assert op1_warc.export_files(archives, f"file://{tmp_path}/files").count() == archives.count()
    back = op1_warc.read_files(spark, f"file://{tmp_path}/files")
    assert {r.page_id: bytes(r.payload).decode() for r in back.collect()} == {r.page_id: r.html for r in pages.collect()}
    assert op1_warc.round_trip(pages.limit(0)).count() == 0


# -- 2: licenses ------------------------------------------------------------


def test_license_rules(spark):
    mit = "Copyright (c) 2020 Someone\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including all. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING ALL. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER."
    rows = [(1, mit), (2, "Text. Licensed under the Apache Licence, Version 2.0.\nMore text"), (3, "Under some licence of ours."), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (7, "plain")]
    got = {r.doc_id: r for r in op2_licenses.scan(docs(spark, rows)).collect()}
    assert got[1].licenses == ["MIT"] and got[1].sentences[0] == "Copyright"
    assert got[2].licenses == ["Apache-2.0"] and rows[1][1][got[2].starts[0] : got[2].ends[0]].strip() == "Licensed under the Apache Licence, Version 2.0."
    assert got[3].licenses == [] and got[3].n_unknown == 1
    assert got[4].licenses == got[5].licenses == got[7].licenses == []
    assert got[6].licenses == ["CC-BY-NC-4.0", "AllRightsReserved"]
    assert op2_licenses.scan(docs(spark, [])).count() == 0


def test_license_prefilter_loses_nothing():
    known = op2_licenses.Known()
    for sentence in op2_licenses.SENTENCES.values():
        filled = sentence.replace("#", "some words here")
        assert any(t in filled for t in op2_licenses.TRIGGERS), filled
        assert known.name(op2_licenses.normalise(filled)) is not None, filled


DISCLAIMED = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {0}General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {0}General Public License for more details.

You should have received a copy of the GNU {0}General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
""",
    "BSD-2-Clause": BSD + DISCLAIMED,
    "BSD-3-Clause": BSD + ENDORSE + DISCLAIMED,
    "GPL-3.0-or-later": GNU.format(""),
    "GPL-2.0-or-later": GNU.format("").replace("version 3", "version 2"),
    "LGPL-3.0-or-later": GNU.format("Lesser "),
    "LGPL-2.1-or-later": GNU.format("Lesser ").replace("version 3", "version 2.1"),
    "AGPL-3.0-or-later": GNU.format("Affero "),
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
}


@pytest.mark.parametrize("license_", NOTICES)
@pytest.mark.parametrize("sign", ["", " * ", "# ", "// "])
def test_license_notices_as_published(license_, sign):
    text = "".join(sign + line for line in ("Copyright (c) 2020 Someone\n\n" + NOTICES[license_]).splitlines(True))
    found, sentences, starts, ends, _ = op2_licenses.scan_text(text, op2_licenses.Known())
    longest = max((rule for name, rule in op2_licenses.RULES if name == license_), key=len)
    assert found == [license_] and [s for s in sentences if s in longest] == list(longest)
    assert all(a < b for a, b in zip(starts, ends, strict=True)) and all(b <= a for a, b in zip(starts[1:], ends, strict=False))


TITLES = {
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n",
    "LGPL-2.1": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n",
    "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE\n",
}


@pytest.mark.parametrize("license_", TITLES)
def test_license_titles_of_full_texts(license_):
    assert op2_licenses.scan_text(TITLES[license_], op2_licenses.Known())[0] == [license_]


def brute_licenses(text):
    """Rules whose sentences stand one after another in the normalised text, by search in it; used up longest first."""
    flat = op2_licenses.normalise(re.sub(r"\n\s*(\*|#|//|\(?\d+[.)])", "\n", text))
    taken, out = [], []
    other = defaultdict(list)
    for name, sentence in op2_licenses.SENTENCES.items():
        other[op2_licenses.SAME.get(name, name)].append(re.escape(sentence).replace(r"\#", r"\S.{0,900}?"))
    for license_, rule in sorted(op2_licenses.RULES, key=lambda r: -len(r[1])):
        pattern = r"\b" + " ".join("(?:" + "|".join(sorted(other[n], key=len, reverse=True)) + ")" for n in rule) + r"\b"
        for m in re.finditer(pattern, flat):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                taken.append(m.span())
                out.append((m.start(), license_))
    return [license_ for _, license_ in sorted(out)]


def test_license_query_against_brute_force(spark):
    r, rows = random.Random(17), []
    one = ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License version 3.", "Released under the MIT license.", "Licensed under CC BY 4.0.", "All rights reserved."]
    for i in range(80):
        parts = [" ".join(words(r.randint(3, 12), 70 * i + k)).capitalize() + "." for k in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), r.choice(one + [NOTICES[k] for k in ("MIT", "ISC", "BSD-2-Clause", "Apache-2.0", "Zlib")]))
        rows.append((i, "\n\n".join(parts)))
    rows += [(1000 + i if i is not None else None, t) for i, t in EDGE]
    got = sorted((x.doc_id is None, x.doc_id or 0, x.licenses) for x in op2_licenses.scan(docs(spark, rows)).collect())
    assert got == sorted((i is None, i or 0, brute_licenses(t or "")) for i, t in rows)


def test_license_sequences_prefer_longer_rules():
    rules = [("short", ("A",)), ("long", ("A", "B"))]
    assert op2_licenses.match(["A", "B", None, "A"], rules) == [("long", 0, 2), ("short", 3, 4)]
    assert op2_licenses.match(["A", None, "B"], rules) == [("short", 0, 1)]


# -- 3: fingerprints --------------------------------------------------------


def shingle_set(text, n=5):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_sketch_estimates_and_merge():
    a, b = words(3000, 1), words(3000, 1)[:2000] + words(1500, 2)
    x, y = op3_fingerprints.sketches([" ".join(a), " ".join(b)])
    sa, sb = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    assert abs(op3_fingerprints.resemblance(x, y) - len(sa & sb) / len(sa | sb)) < 0.12
    assert abs(op3_fingerprints.containment(x, y) - len(sa & sb) / len(sa)) < 0.2
    assert abs(op3_fingerprints.distinct(x) / len(sa) - 1) < 0.2
    parts = op3_fingerprints.sketches([" ".join(a[:1504]), " ".join(a[1500:])])
    assert (op3_fingerprints.merge(*parts) == x).all()
    assert (op3_fingerprints.unpack(op3_fingerprints.pack(x)) == x).all()


def test_sketch_of_repeats_is_exact():
    text = "a b c d e f g " * 5000
    (x,) = op3_fingerprints.sketches([text])
    assert len(x) == len(shingle_set(text)) == op3_fingerprints.distinct(x)


def test_fingerprint_compare(spark):
    rows = [(i, " ".join(words(30 + i, i))) for i in range(40)] + [r for r in EDGE if r[0] not in (3, None)] + [(100, "same text here for all of them"), (101, "same text here for all of them")]
    frame = docs(spark, rows)
    got = {r.doc_id: r for r in op3_fingerprints.compare(frame).collect() if r.doc_id not in (1, 2, 4, 5, 6, 7)}
    order = sorted((r for r in rows), key=lambda r: (-r[0], r[1] or ""))
    for k, (i, text) in enumerate(order):
        if i in (1, 2, 4, 5, 6, 7) or order[(k + 1) % len(order)][0] in (1, 2, 4, 5, 6, 7):
            continue
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        h = len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sa, sb, sc = shingle_set(text), shingle_set(edited), shingle_set(after)
        assert got[i].near_edited == pytest.approx(len(sa & sb) / len(sa | sb) if sa | sb else 1.0)  # below k all is exact
        assert got[i].near_next == pytest.approx(len(sa & sc) / len(sa | sc) if sa | sc else 1.0)
    assert got[100].fingerprint == got[101].fingerprint
    assert op3_fingerprints.compare(frame).count() == len(rows)
    assert op3_fingerprints.compare(frame.limit(0)).count() == 0


def test_fingerprint_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(op3_fingerprints, "RANGE_ROWS", 7)
    rows = [(i * 3, " ".join(words(9, i))) for i in range(100)] + [(None, "none")]
    got = op3_fingerprints.compare(docs(spark, rows)).collect()
    assert len(got) == 101
    order = sorted(rows, key=lambda r: -1e18 if r[0] is None else r[0], reverse=True)
    want = {i: hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % 101][1][: len(t) // 2]).encode()).hexdigest() for k, (i, t) in enumerate(order)}
    assert {r.doc_id: r.edited_sha256 for r in got} == want


def test_fingerprint_groups_merge(spark):
    texts = [" ".join(words(400, i)) for i in range(4)]
    prints = op3_fingerprints.fingerprint(docs(spark, list(enumerate(texts)))).selectExpr("doc_id % 2 AS g", "fingerprint")
    got = {r.g: r.fingerprint for r in op3_fingerprints.merged(prints, "g").collect()}
    s = op3_fingerprints.sketches(texts)
    assert got == {g: op3_fingerprints.pack(op3_fingerprints.merge(s[g], s[g + 2])) for g in (0, 1)}


# -- 4: line dedup ----------------------------------------------------------


def test_line_dedup(spark):
    block = "\n".join(" ".join(words(8, 100 + i)) for i in range(6))
    rows = [(10, "head ten\n" + block + "\nfoot ten"), (20, "head twenty\n" + block + "\nfoot twenty"), (30, block), (40, "short line\nown text of forty"), (50, "short line\nown text of fifty"), *EDGE]
    frame = docs(spark, rows)
    out = op4_line_dedup.without_repeats(frame)
    assert out.columns == frame.columns and out.count() == len(rows)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[10] == rows[0][1] and got[20] == "head twenty\nfoot twenty" and got[30] == ""
    assert got[40] == rows[3][1] and got[50] == rows[4][1] and got[1] is None and got[2] == "" and got[5] == "long " * 30000
    report = {r.doc_id: r for r in op4_line_dedup.report(frame).collect()}
    assert report[20].n_deleted == 6 and report[20].partners == [10] and report[30].n_deleted == report[30].n_lines == 6
    assert report[1].n_lines == 0
    assert op4_line_dedup.report(frame.limit(0)).count() == 0


def test_line_dedup_hot_line(spark):
    line = " ".join(words(12, 5))
    rows = [(i, f"own line {i}\n{line}\nlast {i}") for i in range(300)]
    got = {r.doc_id: r.text for r in op4_line_dedup.without_repeats(docs(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own line {i}\nlast {i}" for i in range(1, 300))


def test_line_dedup_blocks_with_scattered_first_holders(spark):
    p = [" ".join(words(9, 700 + i)) for i in range(6)] + ["tail"]
    alone = [(i, f"own {i}\n{line}\nend {i}") for i, line in enumerate(p)]
    turned = [(20, "\n".join(x for line in p[::-1] for x in (line, "between")))]
    for earlier in (alone, turned):
        rows = [*earlier, (50, "\n".join(["c", *p, "d"])), (60, "\n".join(["e", *p, "f"])), (70, "\n".join(["g", *p[:1], "h"]))]
        got = {r.doc_id: r.text for r in op4_line_dedup.without_repeats(docs(spark, rows)).collect()}
        assert got[60] == "e\nf" and all(got[i] == t for i, t in rows if i != 60)


def test_line_runs_cover_blocks():
    r = random.Random(8)
    for _ in range(100):
        n = [r.choice([0, 1, 3, 9, 12]) for _ in range(r.randint(1, 12))]
        cut = r.randint(0, len(n))
        lines = np.array([r.randint(1, 9) if x else 0 for x in n], np.uint64)
        marks, first = op4_line_dedup.runs_of(lines, np.array(n), np.array([0, cut, len(n)]))
        for k, (a, b) in enumerate([(0, cut), (cut, len(n))]):
            spans = {(i, next((j for j in range(i + 1, b + 1) if sum(n[i:j]) >= 10), None)) for i in range(a, b) if n[i]}
            spans |= {(next((i for i in range(j - 1, a - 1, -1) if sum(n[i:j]) >= 10), None), j) for j in range(a + 1, b + 1) if n[j - 1]}
            spans = [(i, j) for i, j in spans if i is not None and j is not None]
            assert first[k + 1] - first[k] == sum(j - i > 1 for i, j in spans)
            assert {i for i in range(a, b) if n[i] and sum(n[a:b]) >= 10} <= {x for i, j in spans for x in range(i, j)}


def test_line_dedup_repeats_inside_a_document(spark):
    p = " ".join(words(60, 9))
    for earlier, later, left in (("x\nP\ny", "u\nP\nv\nP\nw", {"u\nv\nP\nw", "u\nP\nv\nw"}), ("x\nP\ny\nP\nz", "u\nP\nv", {"u\nv"}), ("x\nP\ny\nP\nz", "u\nP\nv\nP\nw", {"u\nv\nw"})):
        rows = [(i, t.replace("P", p)) for i, t in enumerate((earlier, later))]
        got = {r.doc_id: r.text for r in op4_line_dedup.without_repeats(docs(spark, rows)).collect()}
        assert got[0] == rows[0][1] and got[1].replace(p, "P") in left


def most_words(a, n, b, enough):
    """Most words in common blocks that rise in both, by all of them."""
    top = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            top[i][j] = max(top[i - 1][j], top[i][j - 1])
            k = 1
            while k <= min(i, j) and a[i - k] == b[j - k]:
                if sum(n[i - k : i]) >= enough:
                    top[i][j] = max(top[i][j], top[i - k][j - k] + sum(n[i - k : i]))
                k += 1
    return top[-1][-1]


def test_blocks_between_hold_most_words():
    r = random.Random(12)
    for _ in range(600):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(0, 11))] for _ in range(2))
        n = [(0, 3, 5, 11)[x] for x in a]
        blocks = op4_line_dedup.blocks_between(a, n, b, 10)
        assert all(a[i : i + k] == b[j : j + k] and sum(n[i : i + k]) >= 10 for i, j, k in blocks)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(blocks, blocks[1:], strict=False))
        assert sum(sum(n[i : i + k]) for i, j, k in blocks) == most_words(a, n, b, 10)


def test_patience_alignment():
    a, b = list("abcxyz"), list("qabcpxyz")
    assert [a[i] for i, _ in op4_line_dedup.aligned(a, b)] == a
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 9))] for _ in range(2))
        pairs = op4_line_dedup.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


# -- 5: quality -------------------------------------------------------------


def quality_data(spark):
    good = [(i, " ".join(words(60, i))) for i in range(0, 240)]
    bad = [(i, "### " + "$$$ ".join(words(60, i)) + "$$$") for i in range(240, 400)]
    labels = spark.createDataFrame([(i, int(i < 240)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    return docs(spark, good + bad), labels


def test_quality_held_out_accuracy(spark):
    frame, labels = quality_data(spark)
    got = op5_quality.classify(frame, labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([(r.predicted == 1) == (r.doc_id < 240) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = op5_quality.accepted(frame, labels)
    assert kept.columns == frame.columns and 200 < kept.count() < 260


def test_quality_edges(spark):
    _, labels = quality_data(spark)
    frame = docs(spark, EDGE)
    got = op5_quality.classify(frame, labels.limit(0)).collect()
    assert len(got) == len(EDGE) and {r.score for r in got} == {0.5}
    assert op5_quality.classify(frame.limit(0), labels).count() == 0


def test_quality_of_edge_rows_by_a_trained_network(spark):
    frame, labels = quality_data(spark)
    rows = [*EDGE, (8, "### " + "$$$ " * 20000), (9, "good words here " * 40000)]
    both = frame.unionByName(docs(spark, [(i + 5000 if i is not None else None, t) for i, t in rows]))
    got = {r.doc_id: r.score for r in op5_quality.classify(both, labels).collect() if r.doc_id is None or r.doc_id > 4000}
    assert len(got) == len({i for i, _ in rows}) and all(0 <= s <= 1 for s in got.values())
    assert got[5001] == got[5002] and got[5008] < 0.3  # null and empty alike; a very long text is scored whole


def test_quality_learns_from_long_texts(spark):
    """What marks a text stands at the end of 200 KB: only a network that sees all of it can tell."""
    plain = "the same words again and again " * 60
    rows = [(i, plain * (100 if i % 7 == 0 else 1) + ("@@@@@@@@@@@@@@@@" if i % 2 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, quality int")
    got = op5_quality.classify(docs(spark, rows), labels).collect()
    assert np.mean([(r.score > 0.5) == bool(r.doc_id % 2) for r in got if r.held_out]) > 0.9


def test_network_gradient_and_chunking():
    net = op5_quality.Network(3)
    rng = np.random.default_rng(0)
    raw = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 5, 40, 300)]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    label = np.array([1.0, 0.0, 1.0, 0.0])
    data = np.concatenate(raw)
    whole = net.score(data, offs)
    assert np.allclose(whole, [net.score(r, np.array([0, len(r)]))[0] for r in raw], atol=1e-5)
    old, op5_quality.CHUNKS = op5_quality.CHUNKS, 3
    try:
        assert np.allclose(net.score(data, offs), whole, atol=1e-5)
    finally:
        op5_quality.CHUNKS = old

    def loss():
        s = net.score(data, offs)
        return -np.mean(label * np.log(s) + (1 - label) * np.log(1 - s))

    grad = net.gradients(data, offs, label)
    for name, at in (("weight", (3,)), ("shift", (0,)), ("bias", (2,)), ("filter", (5, 1))):
        base, step = net.p[name][at], 1e-2
        net.p[name][at] = base + step
        up = loss()
        net.p[name][at] = base - step
        down = loss()
        net.p[name][at] = base
        assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-3 + 0.1 * abs(grad[name][at]), name


# -- 6: sharding ------------------------------------------------------------


def test_sharding(spark):
    rows = [(i, "t" * (i % 7)) for i in range(2000)] + [*EDGE]
    got = op6_sharding.place(docs(spark, rows), [1.0] * 8, [1.0] * 9).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    moved = sum(r.grown_shard == 8 for r in got) / len(got)
    assert 0.07 < moved < 0.16 and max(map(len, by.values())) < 1.4 * len(rows) / 8
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    assert op6_sharding.place(docs(spark, []), [1.0] * 8, [1.0] * 9).count() == 0


def brute_shard(key, weights):
    """The shard with the largest -weight / ln(u), from scratch."""

    def drawn(i):
        digits = hashlib.md5(f"{i}\x1f{'null' if key is None else key}".encode()).hexdigest()[:13]
        return -weights[i] / math.log((int(digits, 16) + 0.5) / 2**52)

    return max(range(len(weights)), key=lambda i: (drawn(i), -i))


def test_sharding_against_brute_force(spark):
    rows = [(i * 7919 % 5000, "t") for i in range(700)] + [*EDGE]
    weights, grown = [1.0, 2.5, 0.5, 1.0], [1.0, 2.5, 0.5, 1.0, 3.0]
    got = op6_sharding.place(docs(spark, rows), weights, grown).collect()
    assert all((r.shard, r.grown_shard) == (brute_shard(r.doc_id, weights), brute_shard(r.doc_id, grown)) for r in got)


def test_sharding_of_one_repeated_row(spark):
    rows = spark.range(200_000).selectExpr("5L AS doc_id", "'same' AS text")
    got = op6_sharding.place(rows, [1.0] * 8, [1.0] * 9).selectExpr("count(distinct slot) AS n", "min(slot) AS lo", "max(slot) AS hi", "count(distinct shard) AS s").first()
    assert (got.n, got.lo, got.hi, got.s) == (200_000, 0, 199_999, 1)


def test_sharding_weights(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "'x' AS text")
    got = {r.shard: r["count"] for r in op6_sharding.place(rows, [1.0, 3.0], [1.0, 3.0, 1.0]).groupBy("shard").count().collect()}
    assert 2.6 < got[1] / got[0] < 3.4


# -- 7: HTML ----------------------------------------------------------------


PAGE = "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li>menu</li></ul></nav><div class=\"ad\">buy</div><article><h1>Head {i}</h1><p>First&nbsp;&amp; {i}<br>line<p>Second <b>bold {i}</p><div class='share-buttons'>share</div></article><section id=comments><p>nice</p></section><footer>foot</footer></body></html>"


def test_html_main_text(spark):
    rows = [(i, f"http://host{i % 2}/x", PAGE.replace("{i}", str(i))) for i in range(40)] + [(100, None, None), (101, "::bad::[", ""), (102, "http://h/", "plain text &lt;only")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in op7_html.extract(pages).collect()}
    assert all(got[i].text == f"Head {i}\nFirst & {i} line\nSecond bold {i}" for i in range(40))
    assert got[100].text == got[101].text == "" and got[102].text == "plain text <only" and got[102].n_chars == 16
    assert op7_html.extract(pages.limit(0)).count() == 0


def test_html_wrapper_names_do_not_hide_the_article():
    page = "<body><div class='with-sidebar'><article><header><h1>H</h1></header><p>body text</article><div class=sidebar>side</div></div></body>"
    assert op7_html.main_text(op7_html.parse(page)) == "H\nbody text"


NAMELESS = "<body><div class=a><p>Welcome to our site</p><p>{i} online</p></div><div class=b><p>Text number {i} is here</p><p>Read more about us</p></div></body>"


def html(spark, rows):
    """Pages with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, host string, low int, print string")


def test_html_style_tree_removes_templates(spark):
    rows = [(i, "http://one.example/p", NAMELESS.replace("{i}", str(i))) for i in range(30)] + [(i, "http://few.example/p", NAMELESS.replace("{i}", str(i))) for i in range(100, 102)]
    got = {r.page_id: r for r in op7_html.extract(html(spark, rows)).collect()}
    assert all(got[i].text == f"{i} online\nText number {i} is here" and got[i].n_tree == 2 and got[i].n_named == 0 for i in range(30))
    assert got[100].text.startswith("Welcome to our site")  # two pages say nothing about a host


def test_html_tree_comes_before_names(spark):
    rows = [(i, "http://one.example/p", PAGE.replace("{i}", str(i))) for i in range(40)]
    got = op7_html.extract(html(spark, rows)).collect()
    assert all(r.n_tree >= 4 and r.text == f"Head {r.page_id}\nFirst & {r.page_id} line\nSecond bold {r.page_id}" for r in got)  # menu, advert, comments, footer


def test_html_templates_of_a_part_of_a_large_host(spark):
    page = "<body><div class=x><p>Text number {i} is here</p><p>{n}</p></div></body>"
    rows = [(i, "http://large.example/p", page.replace("{i}", str(i)).replace("{n}", "Read our notice" if i % 10 == 0 else f"Note {i}")) for i in range(300)]
    rows += [(1000 + i, "http://other.example/p", page.replace("{i}", str(i)).replace("{n}", "Read our notice" if i < 15 else f"Note {i}")) for i in range(300)]
    got = {r.page_id: r.text for r in op7_html.extract(html(spark, rows)).collect()}
    assert all(got[i] == f"Text number {i} is here" + ("" if i % 10 == 0 else f"\nNote {i}") for i in range(300))  # 30 > 300**0.5 = 17.3
    assert got[1000].endswith("Read our notice")  # 15 < 17.3


def test_html_passages_of_an_article_stay(spark):
    """A passage that many articles of a host hold is theirs where the page marks its article."""
    page = "<body><nav>m</nav><article><p>Article {i} begins here</p><p>{p}</p></article></body>"
    rows = [(i, "http://one.example/p", page.replace("{i}", str(i)).replace("{p}", "A passage that is shared" if i % 3 == 0 else f"Own passage {i}")) for i in range(120)]
    got = {r.page_id: r.text for r in op7_html.extract(html(spark, rows)).collect()}
    assert all(got[i] == f"Article {i} begins here\n" + ("A passage that is shared" if i % 3 == 0 else f"Own passage {i}") for i in range(120))


def test_html_near_copies_are_no_template(spark):
    long = " ".join(words(60, 3))
    page = "<body><div><p>Edit {i}</p><p>{long}</p><p>third part {j}</p></div></body>"
    rows = [(i, "http://one.example/p", page.replace("{i}", str(i)).replace("{long}", long).replace("{j}", str(i % 4))) for i in range(40)]
    rows += [(100 + i, "http://one.example/p", page.replace("{i}", str(900 + i)).replace("{long}", " ".join(words(40, 50 + i))).replace("{j}", str(100 + i))) for i in range(12)]
    got = {r.page_id: r.text for r in op7_html.extract(html(spark, rows)).collect()}
    assert all(got[i] == f"Edit {i}\n{long}\nthird part {i % 4}" for i in range(40))


def test_html_names_of_which_one_word_says_nothing():
    page = "<div class='entry-header'><h1>Headline</h1></div><p class='share-price'>price</p><h2 class='section-header'>Part</h2><div class='related-work'>work</div><div class='share-buttons'>share</div><div id='siteFooter'>foot</div><p class='ad'>buy</p>"
    assert op7_html.main_text(op7_html.parse(page)) == "Headline\nprice\nPart\nwork"


def test_html_main_part_needs_most_of_the_text():
    text = "words of the text " * 9
    assert op7_html.main_text(op7_html.parse(f"<article><h2>teaser</h2></article><div><p>{text}</p></div>")) == "teaser\n" + text.strip()
    assert op7_html.main_text(op7_html.parse(f"<article><p>{text}</p></article><div><p>aside</p></div>")) == text.strip()
    assert op7_html.main_text(op7_html.parse("<main>a<div class=header><h1>T</h1></div><article class=comment>c</article></main><p>b</p>")) == "a\nT"


def test_html_long_and_deep_pages(spark):
    deep = "<div>" * 3000 + "bottom" + "</div>" * 3000
    wide = "".join(f"<p>line {i}</p>" for i in range(30_000))
    got = {r.page_id: r.text for r in op7_html.extract(html(spark, [(1, "http://h/", deep), (2, "http://h/", wide), (2, "http://h/", wide), (None, None, "x")])).collect()}
    assert got[1] == "bottom" and got[2].count("\n") == 29_999 and got[None] == "x"


def test_html_copies_are_no_template(spark):
    rows = [(i, "http://one.example/p", PAGE.replace("{i}", "copy")) for i in range(50)] + [(100 + i, "http://one.example/p", PAGE.replace("{i}", str(i))) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op7_html.extract(pages).collect()}
    assert got[0] == "Head copy\nFirst & copy line\nSecond bold copy"


# -- 8: decontamination -----------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute_hits(text, items, window=13):
    w = tokens(text)
    hit, found = set(), set()
    for item, t in items:
        if item is None:
            continue
        own = tokens(t)
        for j in range(max(1, len(own) - window + 1) if own else 0):
            part = own[j : j + window]
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(item)
    return len(w), len(hit), found


def test_decontamination(spark):
    items = [(i, " ".join(words(25, 900 + i))) for i in range(6)] + [(50, "Tiny item"), (51, None), (52, "..."), (7, " ".join(words(13, 77))), (8, " ".join(words(13, 77))), (None, "no id")]
    r = random.Random(4)
    rows = []
    for i in range(60):
        text = words(r.randint(0, 120), i)
        if i % 3 == 0:
            own = items[i % 6][1].upper().split()
            a = r.randint(0, 8)
            text[5:5] = own[a : a + r.randint(10, 25)]
        if i % 10 == 0:
            text += ["tiny,", "ITEM"] + items[9][1].split()
        rows.append((i, "; ".join(text)))
    rows += [(i + 1000 if i else None, t) for i, t in EDGE]
    frame, bench = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = op8_decontamination.decontaminate(frame, bench).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        n, hit, found = brute_hits(t, items)
        want[i].append((n, hit, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    have = defaultdict(list)
    for r_ in got:
        have[r_.doc_id].append((r_.n_words, r_.n_hit, r_.n_items, r_.items_sha256, r_.contaminated))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    clean = op8_decontamination.clean(frame, bench)
    assert clean.columns == frame.columns and clean.count() == sum(not w[-1] for v in want.values() for w in v)
    assert op8_decontamination.decontaminate(frame.limit(0), bench).count() == 0
    assert all(r_.n_hit == 0 for r_ in op8_decontamination.decontaminate(frame, bench.limit(0)).collect())


def test_decontamination_in_blocks(spark, monkeypatch):
    items = [(i, " ".join(words(15, 900 + i))) for i in range(5)]
    frame, bench = docs(spark, [(i, "x " + items[i % 5][1] + " " + items[(i + 1) % 5][1]) for i in range(9)]), spark.createDataFrame(items, "item_id long, text string")
    one = {r.doc_id: r for r in op8_decontamination.decontaminate(frame, bench).collect()}
    monkeypatch.setattr(op8_decontamination, "BLOCK_BYTES", 100)
    assert len(list(op8_decontamination.blocks_of(bench))) > 2
    assert {r.doc_id: r for r in op8_decontamination.decontaminate(frame, bench).collect()} == one


def test_phrase_and_proximity(spark):
    frame = docs(spark, [(1, "the cat sat on the mat"), (2, "the mat sat near a cat"), (3, "cat"), (4, None)])
    index = op8_decontamination.build_index(frame)
    assert {(r.doc_id, r.at) for r in op8_decontamination.find_phrases(index, ["Cat sat"]).collect()} == {(1, 1)}
    assert {r.doc_id for r in op8_decontamination.find_near(index, ["cat mat"], 4).collect()} == {1, 2}
    assert {r.doc_id for r in op8_decontamination.find_near(index, ["cat sat"], 1).collect()} == {1}


# -- 9: BPE -----------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_matches_library(library):
    encoder = op9_bpe.encoder_of(tokenizer_path())
    r = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "'S", "é", "中", "1", "½", "!", "…", " ", "\x1c", "́", "😀", "<|endoftext|>", "'veto", "\r\n", "​", "hello", "ing"]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert op9_bpe.encode_text(text, encoder) == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_collisions_of_polynomial_hashes(library):
    """Words of alternating letters and their twins, which meet in every polynomial hash modulo 2**64."""
    encoder = op9_bpe.encoder_of(tokenizer_path())
    for n in (64, 1024, 2048, 4096):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        twin = word.translate(str.maketrans("ab", "ba"))
        data = np.frombuffer((word + twin).encode(), np.uint8)
        a, b = span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
        for text in (word, twin):
            assert op9_bpe.encode_text(text, encoder) == library.encode(text, add_special_tokens=False).ids


def test_workers_forget_what_other_operators_keep():
    path = tokenizer_path()
    first = op9_bpe.encoder_of(path)
    begin("op9_bpe")
    assert op9_bpe.encoder_of(path) is first  # its own tasks share it
    begin("op4_line_dedup")
    assert op9_bpe.encoder_of(path) is not first
    assert list(tidy("op9_bpe")(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]


def test_bpe_memo_starts_anew(library):
    encoder = op9_bpe.Encoder(op9_bpe.load(tokenizer_path()), memo=5)
    for seed in range(20):
        text = " ".join(words(9, seed))
        assert op9_bpe.encode_text(text, encoder) == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.memo) <= 5 and len(encoder.older) <= 5


def test_bpe_long_runs_stream_with_bounded_memory(library):
    merges = op9_bpe.load(tokenizer_path())
    r = random.Random(6)
    for text in ("".join(r.choice("abehinorst") for _ in range(4000)), "a" * 3000, "-" * 3000, " " * 3000):
        machine, out, most = op9_bpe.Transducer(merges), [], 0
        for i in range(0, len(text), 50):
            out += machine.feed(text[i : i + 50].encode())
            most = max(most, len(machine.text))
        out += machine.finish()
        assert most <= 2 * merges.lookahead + merges.longest
        if not text.isspace():
            assert out == library.encode(text, add_special_tokens=False).ids


def test_bpe_tables(spark, library):
    rows = [*EDGE, (11, "Hello <|endoftext|> world"), (12, "x" * 5000)]
    frame = docs(spark, rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op9_bpe.tokenize(frame, tokenizer_path()).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i is None, i or 0, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    back = op9_bpe.decode(op9_bpe.encode(frame, tokenizer_path()), tokenizer_path())
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert op9_bpe.tokenize(frame.limit(0), tokenizer_path()).count() == 0


def test_decoder_splits_characters():
    merges = op9_bpe.load(tokenizer_path())
    ids = [merges.token[bytes([b])] for b in "é😀".encode()]
    machine = op9_bpe.Decoder(merges)
    assert "".join(machine.feed([i]) for i in ids) + machine.finish() == "é😀"
    assert machine.feed([merges.token[b"\xc3"], merges.token[b"A"]]) == "�A"


# -- 10: near-duplicates ----------------------------------------------------


def brute_classes(rows):
    def s(t):
        w = tokens(t)
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    texts = sorted({t or "" for _, t in rows})
    sets = {t: s(t) for t in texts}
    up = {t: t for t in texts}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if sets[a] and sets[b] and (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total():
                up[root(a)] = root(b)
    ids = defaultdict(list)
    for i, t in rows:
        ids[root(t or "")].append(i)
    return sorted(((i is None, i or 0), min([x for x in ids[root(t or "")] if x is not None], default=None)) for i, t in rows)


def test_near_duplicates(spark):
    r = random.Random(8)
    rows = [(1000 + i, t) for i, (_, t) in enumerate(EDGE)] + [(None, "one")]
    for base in range(12):
        text = words(r.randint(20, 200), base)
        for copy in range(r.randint(1, 6)):
            own = list(text)
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = "changed" + str(r.randint(0, 9))
            rows.append((base * 10 + copy, " ".join(own)))
    chant = "one two three four five six seven " * 20
    rows += [(500, chant), (501, chant * 2), (502, chant + "one two three four five six seven " * 3)]  # equal sets, other counts
    frame = docs(spark, rows)
    got = sorted(((x.doc_id is None, x.doc_id or 0), x.class_id) for x in op10_dartminhash.near_duplicates(frame).collect())
    assert got == brute_classes(rows)
    kept = op10_dartminhash.keep_one(frame)
    assert kept.columns == frame.columns and kept.count() == len({c for _, c in got})
    assert op10_dartminhash.near_duplicates(frame.limit(0)).count() == 0


def test_near_duplicate_recall_of_the_bands():
    """Share of pairs of likeness 0.8 and more that share a band, against brute force."""
    texts, r = [], random.Random(31)
    for base in range(150):
        own = words(r.randint(40, 200), base)
        texts.append(" ".join(own))
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = "other"
        texts.append(" ".join(own + own[:20] * r.randint(0, 1)))
    elements, times, ptr = op10_dartminhash.counted(*op10_dartminhash.word_shingles(pa.array(texts)))
    rows = op10_dartminhash.bands(op10_dartminhash.signatures(elements, ptr, weights=times.astype(float)))
    met = alike = 0
    for i in range(0, 300, 2):
        a, b = (Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for t in texts[i : i + 2])
        if (a & b).total() >= 0.8 * (a | b).total():
            alike += 1
            met += bool((rows[i] == rows[i + 1]).any())
    assert alike > 50 and met == alike
    once, twice = op10_dartminhash.numbered(np.array([5, 9], np.uint64), np.array([1, 3])), op10_dartminhash.numbered(np.array([9], np.uint64), np.array([2]))
    assert len(set(once.tolist())) == 4 and len(set(once.tolist()) & set(twice.tolist())) == 2


def test_bitmaps_never_differ_in_more_than_the_sets():
    r = random.Random(4)
    for _ in range(50):
        a, b = ({r.getrandbits(64) for _ in range(r.randint(0, 400))} for _ in range(2))
        both = {r.getrandbits(64) for _ in range(200)}
        sets = [np.array(sorted(x | both), np.uint64) for x in (a, b)]
        maps = op10_dartminhash.bitmaps(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        assert sum(bin(int(x ^ y)).count("1") for x, y in zip(*maps, strict=True)) <= len(a ^ b)


def test_dart_signatures_estimate_weighted_likeness():
    e = mix(np.arange(400, dtype=np.uint64) + np.uint64(7))
    a, b = np.array([3.0, 1.0, 2.0, 0.5] * 100), np.array([1.0, 1.0, 4.0, 0.5] * 100)
    rows = op10_dartminhash.signatures(np.concatenate([e, e]), np.array([0, 400, 800]), t=2000, weights=np.concatenate([a, b]))
    assert abs((rows[0] == rows[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05
    alone = op10_dartminhash.signatures(e, np.array([0, 400, 400]), t=96)
    assert alone[0].all() and not alone[1].any()
    assert (op10_dartminhash.signatures(np.concatenate([e, e]), np.array([0, 800]), t=96)[0] == alone[0]).all()  # repeats count once


def test_word_shingles_of_short_texts():
    h, p = op10_dartminhash.word_shingles(pa.array(["a b c", "A, b; c", "a b", "", None, "a b c d e f"]))
    assert np.diff(p).tolist() == [1, 1, 1, 0, 0, 2] and h[0] == h[1] != h[2]
