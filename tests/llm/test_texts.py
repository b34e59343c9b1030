"""Language, quality, pieces, licences and SpotSigs against definitions, libraries and brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import langid, licences, pieces, quality, queries, spotsigs

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# Language


def plain_ngrams(text):
    out, word = {}, ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded = f" {word} "
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    g = padded[i : i + n]
                    if g != " ":
                        out[g] = out.get(g, 0) + 1
            word = ""
    return out


@pytest.mark.parametrize("text", ["", "a", "Ab ab!", "l'été d'Éva", "x1y2 zz", "日本 語", "a  b\n\nc"])
def test_ngrams_match_definition(text, monkeypatch):
    blank = lambda c: 1 if c == " " else ord(c)

    def key(g):
        out = 0
        for c in g:
            out = out << 21 | blank(c)
        return out

    want = {key(g): n for g, n in plain_ngrams(text).items()}
    for block in (1 << 20, 3):
        monkeypatch.setattr(langid, "_BLOCK", block)
        k, c = langid.ngrams(text)
        assert dict(zip(k.tolist(), c.tolist(), strict=True)) == want


def test_out_of_place_distance():
    known = np.array([30, 10, 20])
    ready = (np.sort(known), np.argsort(known))
    assert langid.out_of_place(np.array([30, 20, 99]), *ready, 300) == 0 + 1 + 300


def test_language_edge_rows(spark):
    rows = [(i, f"the cat and the dog number {chr(97 + i % 26)}", "en") for i in range(30)] + [(100 + i, f"der hund und die katze {chr(97 + i % 26)}", "de") for i in range(30)]
    docs = frame(spark, [*rows, (None, None, None), (7, "12 34 !", "en"), (8, "", None)], "doc_id long, text string, lang string")
    profiles = langid.learn(docs)
    assert set(profiles) == {"en", "de"} and all(0 < len(p) <= 300 for p in profiles.values())
    got = langid.predict(docs.withColumn("score", F.lit(5)), profiles, keep=(F.col("lang"),)).collect()
    assert len(got) == 63 and all(r.lang_pred == r.lang for r in got if r.lang and r.doc_id != 7)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (None, 7, 8) and r.lang in (None, "en") and r.score == 0} == {("und", 0.0)}
    none = frame(spark, [], "doc_id long, text string, lang string")
    assert langid.learn(none) == {} and langid.predict(docs, {}).where("lang_pred != 'und'").count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op9_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.held_out for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2} == {True}
    assert np.mean([r.lang_pred == r.lang for r in got if r.held_out]) > 0.95


# Quality


def test_pooling_covers_the_whole_document():
    rng = np.random.default_rng(1)
    model = {"table": rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), "shift": np.zeros(quality.FILTERS, np.float32), "weights": rng.normal(size=quality.FILTERS).astype(np.float32), "bias": np.zeros(1, np.float32)}
    for n in (0, 1, 5, quality.CHUNK - 1, quality.CHUNK, quality.CHUNK + 1, 2 * quality.CHUNK + 7):
        data = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        codes = np.frombuffer(bytes(quality.WIDTH) + data, np.uint8)
        full = np.stack([sum(model["table"][w, codes[p + w]] for w in range(quality.WIDTH)) for p in range(len(codes) - quality.WIDTH + 1)])
        features, where = quality.pooled(model, data)
        assert np.allclose(features, np.maximum(full.max(axis=0), 0), atol=1e-4) and (where < len(full)).all()
        assert 0 <= quality.probability(model, data) <= 1


def test_quality_learns_and_keeps_clean_rows():
    rng = random.Random(2)
    words = ["wind", "stone", "river", "lamp", "grey", "house"]
    clean = [" ".join(rng.choices(words, k=60)).capitalize() + "." for _ in range(80)]
    junk = [" ".join(w + "###" for w in rng.choices(words, k=60)) for _ in range(20)]
    model = quality.train([t.encode() for t in clean[:60] + junk[:15]], [1] * 60 + [0] * 15, 0.8)
    assert all(quality.probability(model, t.encode()) >= 0.5 for t in clean[60:]) and all(quality.probability(model, t.encode()) < 0.3 for t in junk[15:])


def test_quality_edge_rows(spark):
    rows = frame(spark, [(1, "good text", 1), (1, "good text", 1), (2, None, 0), (None, "x", None), (3, "", 1)], "doc_id long, text string, quality int")
    model = quality.learn(rows, rows, "quality")
    got = quality.predict(rows.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = rows.where("false")
    assert quality.predict(none, quality.learn(none, none, "quality")).count() == 0


def test_quality_learns_from_whole_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "train", lambda texts, labels, prior: seen.update(zip(labels, texts, strict=True)))
    texts = ["x " * 10_000 + "bad end", "x " * 10_000 + "good end"]
    quality.learn(frame(spark, list(enumerate(texts))), frame(spark, [(0, 0), (1, 1)], "doc_id long, quality int"), "quality")
    assert seen == {i: t.encode() for i, t in enumerate(texts)}


def test_quality_held_out(spark):
    got = queries.op4_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    clean, junk = ([r.predicted for r in got if r.quality == q] for q in (1, 0))
    assert np.mean(clean) > 0.95 and np.mean(junk) < 0.5


# Pieces


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    path = pieces.default_model()
    return pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_match_the_library(both):
    own, lib = both
    rng = random.Random(3)
    texts = ["", " ", "  x", "日本語のテキスト です", "\x00\n\n\t tab", "ﬁ ﷺ é", "x" * 300, "aaaaaaa", "   " * 9, "🙂🙂 ok", "http://a.b/c?d=e&f" * 20]
    texts += ["".join(rng.choices("ab etaoin\n.,", k=rng.randrange(80))) for _ in range(500)] + ["".join(rng.choices("xyzé=+/AB09_-{}();\r", k=rng.randrange(200))) for _ in range(300)]
    assert [x.tolist() for x in own.encode(texts)] == lib.encode(texts)
    assert [own.decode(x) for x in own.encode(texts)] == texts


def test_long_units_and_groups_agree(both, monkeypatch):
    own, _ = both
    words = ["▁" + "".join(random.Random(i).choices("etaoinshr", k=40)) for i in range(60)]
    assert [own._alone(w) for w in words] == list(own._group(words))


def test_forgetting_keeps_results(both, monkeypatch):
    own, lib = both
    monkeypatch.setattr(pieces, "KEPT", 5)
    texts = ["one two three", "three two one", "brand new words entirely"]
    for _ in range(3):
        assert [x.tolist() for x in own.encode(texts)] == lib.encode(texts)


def test_pairs_are_worked_out_once_a_process(both, monkeypatch):
    own, lib = both
    worked, apart = [], own._apart
    monkeypatch.setattr(own, "_apart", lambda left, right: worked.append(left[-1] + right[-1]) or apart(left, right))
    texts = [f"{a}{b}ing {b}ly{a}" for a in ("whirl", "snork", "plum") for b in ("bet", "gard", "ost")]
    assert [x.tolist() for x in own.encode(texts)] == lib.encode(texts)
    own.forget()  # as at the end of a task
    worked.clear()
    assert [x.tolist() for x in own.encode(texts)] == lib.encode(texts) and worked == []


def test_characters_without_a_piece_in_groups():
    own = pieces.Pieces([("<unk>", 0, 2), ("cd", 0, 1), ("ab", -1, 1), ("abcd", -2, 1), ("a", -9, 1), ("d", -9, 1)], add_blank=False)
    units = ["".join(random.Random(i).choices("abcdx", k=9)) for i in range(200)]
    assert list(own._group(units)) == [own._alone(u) for u in units] == [np.array([own.ids.get(p, 0) for p in own.merge(u)], np.int32).tobytes() for u in units]


def test_pieces_in_spark(spark, both):
    rows = frame(spark, [(1, "a b"), (1, "a b"), (2, None), (None, ""), (3, " é")])
    got = pieces.encode(rows, keep=(F.col("doc_id"),), decoded=True)
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in got.collect()) == sorted((str(r.doc_id), tuple(both[1].encode(r.text or "")), r.text or "") for r in rows.collect())
    assert [r.text for r in pieces.decode(got, keep=(F.col("doc_id"),)).where("doc_id = 3").collect()] == [" é"]
    assert pieces.encode(rows.where("false")).count() == 0


# Licences

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
)


def test_licences(spark):
    cases = {
        "A title\nReleased under the MIT License.\nMore": ["MIT"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3"],
        "no full stop\nLicensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
        "Licensed under the Apache License, Version 2.0. Licensed under CC BY 3.0.": ["Apache-2.0", "CC-BY-3.0"],
        MIT: ["MIT"],
        "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at": ["Apache-2.0"],
        "We license bikes. All wrongs reserved.": [],
        "": [],
        None: [],
    }
    got = licences.scan(frame(spark, list(enumerate(cases))), keep=(F.col("doc_id"),)).collect()
    assert {r.doc_id: r.licences for r in got} == dict(enumerate(cases.values()))
    # Out of order, a rule of many sentences does not match.
    parts = MIT.split("\n\n")
    wrong = licences.scan(frame(spark, [(1, "\n\n".join(reversed(parts))), (1, "\n\n".join(reversed(parts)))])).collect()
    assert [r.licences for r in wrong] == [[], []] and len(wrong[0].identifiers) == 3
    assert licences.scan(frame(spark, [])).count() == 0


def test_public_notices(spark):
    def gpl(kind, mark, version, wrap="\n# "):
        lesser, what = ("Lesser ", "library") if kind == "LGPL" else ("", "program")
        return wrap.join(
            [f"# a tool\n# Copyright (C) 2020  Somebody\n#\n# This {what} is free software{mark} you can redistribute it and/or modify", f"it under the terms of the GNU {lesser}General Public License as published by", f"the Free Software Foundation{';' if mark == ';' else ','} either version {version} of the License, or", "(at your option) any later version.",
             "", f"This {what} is distributed in the hope that it will be useful,", "but WITHOUT ANY WARRANTY; without even the implied warranty of", "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the", "GNU General Public License for more details."]
        )

    def bsd(endorse):
        head = "Copyright (c) 2010, Somebody\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
        return head + endorse + '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT'

    named = "3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    apache = 'Copyright 2020 Somebody\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.'
    cases = [
        (gpl("GPL", ":", 3), "GPL-3-or-later"), (gpl("GPL", ";", 2), "GPL-2-or-later"), (gpl("LGPL", ";", "2.1"), "LGPL-2.1-or-later"),
        ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", "GPL-2-only"),
        ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", "MPL-2.0"),
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"),
        (bsd(""), "BSD-2-Clause"), (bsd(named.format("the copyright holder")), "BSD-3-Clause"), (bsd(named.format("Google Inc.")), "BSD-3-Clause"), (bsd(named.format("the University")), "BSD-3-Clause"),
        (apache, "Apache-2.0"), ("MIT License\n\nCopyright (c) 2020 Somebody\n\n" + MIT, "MIT"),
        ("ISC License\n\nCopyright (c) 2020, Somebody\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
        ("This is free and unencumbered software released into the public domain.\n\nAnyone", "Unlicense"),
        *((f"Licensed under CC {k} 4.0.", f"CC-{k}-4.0") for k in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND")), ("Licensed under CC0 1.0.", "CC0-1.0"),
        ("Licensed under the GNU General Public License, version 3.", "GPL-3"), ("Licensed under the GNU Lesser General Public License, version 3.", "LGPL-3"),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the MIT License.", "MIT"),
    ]
    got = licences.scan(frame(spark, [(i, t) for i, (t, _) in enumerate(cases)]), keep=(F.col("doc_id"),)).collect()
    assert {r.doc_id: r.licences for r in got} == {i: [x] for i, (_, x) in enumerate(cases)}
    seen = {r.doc_id: r.identifiers for r in got}
    assert seen[0] == ["GPL_LATER", "GPL_WARRANTY", "GPL_SEE"] and seen[11][-2:] == ["APACHE_BASIS", "APACHE_SEE"]


def test_notices_of_more_families(spark):
    disclaimer = '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT\nHOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    head = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    advert = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n   This product includes software developed by Somebody.\n"
    endorse = "4. Neither the name of Somebody nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    isc = '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    zlib_text = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
    agpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    apache = '# Licensed to Somebody under one or more agreements.\n# The ASF licenses this file\n# to you under the Apache License, Version 2.0 (the\n# "License"); you may not use this file except in compliance\n# with the License.  You may obtain a copy of the License at\n#   http://www.apache.org/licenses/LICENSE-2.0\n# Unless required by applicable law or agreed to in writing,\n# software distributed under the License is distributed on an\n# "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY\n# KIND, either express or implied.  See the License for the\n# specific language governing permissions and limitations\n# under the License.'
    odd = "An odd one. "
    cases = [
        (head + advert + endorse + disclaimer, ["BSD-4-Clause"]), (head + endorse + disclaimer, ["BSD-3-Clause"]), (head + disclaimer, ["BSD-2-Clause"]), (apache, ["Apache-2.0"]), (agpl, ["AGPL-3-or-later"]), (zlib_text, ["Zlib"]),
        ("Copyright (c) 2020, Somebody\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies." + isc, ["ISC"]),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + isc, ["0BSD"]),
        ("The MIT License (MIT)\n\nCopyright (c) 2020 Somebody\n\n" + MIT, ["MIT"]), ("The MIT License (MIT)\n\nno more", []), ("Mozilla Public License Version 2.0\n=====\n\n1. Definitions", ["MPL-2.0"]), ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nmore", ["GPL-3"]),
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS", ["Apache-2.0"]), ("Eclipse Public License - v 2.0\n\nTHE", ["EPL-2.0"]), ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0\nwhich accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", ["EPL-1.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]), ("CC0 1.0 Universal\n\nmore", ["CC0-1.0"]),
        ("// SPDX-License-Identifier: GPL-3.0-or-later\nint x;", ["GPL-3.0-or-later"]), ("/* SPDX-License-Identifier: BSD-3-Clause */\nint x;", ["BSD-3-Clause"]), ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\nimport os", ["(MIT OR Apache-2.0)"]),
        ("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only WITH Classpath-exception-2.0"]), ("# SPDX-License-Identifier:", []),
        # A match's sentences are near each other, and its version is its own.
        ("\n\n".join(MIT.split("\n\n")[:1] + [odd * licences.GAP] + MIT.split("\n\n")[1:]), ["MIT"]), ("\n\n".join(MIT.split("\n\n")[:1] + [odd * (licences.GAP + 1)] + MIT.split("\n\n")[1:]), []),
        ("Licensed under CC BY 3.0. Licensed under CC BY-SA 4.0.", ["CC-BY-3.0", "CC-BY-SA-4.0"]),
        ('Licensed under the Apache License, Version 1.1 (the "License"); nothing. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', ["Apache-2.0"]),
    ]
    got = licences.scan(frame(spark, [(i, t) for i, (t, _) in enumerate(cases)]), keep=(F.col("doc_id"),)).collect()
    assert {r.doc_id: r.licences for r in got} == {i: sorted(x) for i, (_, x) in enumerate(cases)}


def test_short_notices(spark):
    """The usual sentences of READMEs and headers, whatever stands before and after the licence's name."""
    cases = [
        ("This code is released under the MIT license.", ["MIT"]), ("Distributed under the MIT License. See `LICENSE` for more information.", ["MIT"]), ("The project is available under the Apache License 2.0", ["Apache-2.0"]),
        ("It is licensed under GPLv3.", ["GPL-3"]), ("This package is licensed under the GPL v2.", ["GPL-2"]), ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", ["BSD"]),
        ("This project is dual licensed under MIT and Apache 2.0.", ["Apache-2.0 AND MIT"]), ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0 OR MIT"]),
        ("Licensed under the Artistic License 2.0.", ["Artistic-2.0"]), ("Published under the terms of the European Union Public Licence v1.2.", ["EUPL-1.2"]), ("Covered by the WTFPL.", ["WTFPL"]),
        ("Licensed under the Common Development and Distribution License, version 1.1.", ["CDDL-1.1"]), ("Distributed under the OpenSSL License.", ["OpenSSL"]), ("Provided under the PSF License Version 2.", ["PSF-2"]),
        ("All files are licensed under the 3-Clause BSD License.", ["BSD-3-Clause"]), ("licensed under BSD-2-Clause", ["BSD-2-Clause"]), ("Licensed under the ISC license, see the LICENSE file.", ["ISC"]),
        ("The library is provided under the terms of the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]), ("This work is licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("Released under the Unlicense.", ["Unlicense"]),
        ("The MPL 2.0 is a licence.", []), ("We were under the MIT bridge.", []), ("The talk was given by the author of the MIT license.", []), ("licensed under", []), ("covered by insurance", []),
    ]
    got = licences.scan(frame(spark, [(i, t) for i, (t, _) in enumerate(cases)]), keep=(F.col("doc_id"),)).collect()
    assert {cases[r.doc_id][0]: r.licences for r in got} == dict(cases)


def test_whole_texts(spark):
    cases = [
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Somebody\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The licenses for most software are designed to take away your\nfreedom to share and change it.  By contrast,", ["GPL-2"]),
        ("  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n", ["GPL-3"]),
        ("GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n Preamble\n\n  The GNU Affero General Public License is a free, copyleft license for\nsoftware and other kinds of works, specifically designed to ensure\ncooperation with the community in the case of network server software.", ["AGPL-3"]),
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.\n\n\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.", ["Apache-2.0"]),
        ("1.1. Definitions\n\n\"Contributor\"\n means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.", ["MPL-2.0"]),
        ("Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION\n    OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.", ["EPL", "EPL-2.0"]),
        ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", ["WTFPL"]),
    ]
    got = licences.scan(frame(spark, [(i, t) for i, (t, _) in enumerate(cases)]), keep=(F.col("doc_id"),)).collect()
    found = {r.doc_id: r.licences for r in got}
    assert {i: set(want) <= set(found[i]) or found[i] for i, (_, want) in enumerate(cases)} == {i: True for i in range(len(cases))}


def plain_licences(text):
    """Identifiers and licences by loops over characters, lines and lists."""
    import re

    def normal(raw):
        plain = re.sub(rf"(version[ \t\n\r\f\x0b]+|licenses?[/ ]|v\.? ?|cc0 |-|by |nc |sa |nd |attribution |sharealike |commercial |derivatives |apache |gpl |mpl |epl |eupl |cddl )({licences.VERSION})", r"\1 # ", raw.lower().replace("#", " "))
        plain = " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789#" else " " for c in plain).split())
        name, _, rest = plain.removeprefix("neither the name of ").partition(" nor the names of ")
        if plain.startswith("neither the name of ") and rest and 0 < len(name) <= 200:
            return f"neither the name of the copyright holder nor the names of {rest}"
        return plain if plain in licences.KNOWN_WHOLE or len(plain) >= 200 else notice(plain)

    def notice(plain):
        """A short notice without its subject and verb, and without what follows the licence's name."""
        words = plain.split()
        for n in range(8):
            if len(words) < n + 3 or words[n] not in ("licensed", "licenced", "released", "distributed", "available", "provided", "published", "offered", "covered", "governed") or words[n + 1] not in ("under", "by", "with"):
                continue
            rest = words[n + 2 :]
            skip = lambda own, *options: next((own[len(o.split()) :] for o in options if own[: len(o.split())] == o.split() and len(own) > len(o.split())), own)
            rest = skip(skip(rest, "either of", "either", "both"), "the", "a", "an")
            if rest[:2] == ["terms", "of"] and len(rest) > 2:
                rest = skip(skip(rest[2:], "either of", "either", "both"), "the", "a", "an")
            return "licensed under " + shorn(rest)
        return plain

    def shorn(words):
        tails = ["at your option", "that can be found in", "which can be found in", "as found in", "see", "in the license file"]
        for i in range(len(words)):
            after = words[i:]
            after = after[1:] if after[0] in ("license", "licence") else after
            after = after[1:] if after[:1] == ["only"] else after
            left = " ".join(after)
            if i and (not after or left in (tails[0], tails[5]) or any(left.startswith(t + " ") and len(left) <= len(t) + 81 for t in tails[1:5])):
                return " ".join(words[:i])
        return " ".join(words)

    space, cuts = " \t\n\r\f\x0b", [0]
    for i, c in enumerate(text):
        if c not in ".!?:;" or i + 1 < len(text) and text[i + 1] not in space:
            continue
        rest = text[i + 1 :].lstrip(space)
        bare = re.sub(r"^[^A-Za-z0-9]*", "", rest).lower()
        goes_on = rest and (bare.startswith(tuple(licences.GOES_ON.split("|"))) or c == "." and re.search(r"\bv$", text[:i]) and rest[0].isdigit())
        if not goes_on and not text[: i + 1].lower().endswith("spdx-license-identifier:"):
            cuts += [i + 1]
    found = []

    def take(raw, place, line):
        plain = normal(raw)
        if plain in licences.SENTENCES:
            version = re.search(rf"(?<!cc)(?<!CC){licences.VERSION}", raw)
            found.append((licences.SENTENCES[plain], version.group() if version else "", place))
        elif line and plain.startswith("spdx license identifier ") and "\n" not in raw.strip(" "):
            tag = re.search(licences.TAG.removeprefix("(?i)"), raw, re.I)
            found.append(("SPDX_TAG", tag.group(1) if tag else "", place))
        else:
            return False
        return True

    for place, (a, b) in enumerate(zip(cuts, cuts[1:] + [len(text)], strict=True)):
        raw = text[a:b].lstrip(space) if a else text[a:b]
        if take(raw, place, "\n" not in raw) or "\n" not in raw:
            continue
        part = []
        for line in [*raw.split("\n"), None]:
            bare = re.sub(r"^[^A-Za-z0-9]*", "", line or "").lower()
            lone = bare.startswith("spdx-license-identifier:") or re.match(r"copyright (\(c\)|©|[0-9]{4})", bare) or re.fullmatch(r"https?://[^ ]+[^a-z0-9]*", bare)
            if line is not None and bare and not lone:
                part.append(line)
                continue
            if part and not take("\n".join(part), place, False):
                for x in part:
                    take(x, place, True)
            part = []
            if lone:
                take(line, place, True)
    names, left = set(), [[i, v, p] for i, v, p in found]

    def ends(at, items):
        """Where a match of the items from at on ends, the longest first."""
        if not items:
            return at
        fits = at < len(left) and left[at] is not None and left[at][0] == items[0].rstrip("?")
        if fits and (end := ends(at + 1, items[1:])) is not None:
            return end
        return ends(at, items[1:]) if items[0].endswith("?") else None

    far = [i for i in range(1, len(left)) if left[i][2] - left[i - 1][2] > licences.GAP + 1]
    for i in reversed(far):
        left.insert(i, None)
    for sequence, name in licences.RULES:
        items, at = sequence.split(), 0
        while at < len(left):
            end = ends(at, items)
            if end is None:
                at += 1
                continue
            own = next(x for x in left[at:end] if x[0] == next(i for i in items if i[-1] != "?"))
            names.add(name.replace("#", own[1]))
            left[at:end] = [None]
            at += 1
    return " ".join(i for i, _, _ in found), ", ".join(sorted(names))


def test_op2_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    known = [s.replace("#", rng.choice(["version 2.0", "2.0", "3"])) for s in licences.SENTENCES]
    known += ["Licensed under the Apache License, Version 2.0", 'licensed under the Apache License, version 2.0 (the "License")', "SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: GPL-2.0-only OR MIT", "Copyright (c) 2020 Some Body", "http://some.place/x", "mozilla public license, v. 2.0"]
    runs = [[k for s in seq.split() for k in [next((t for t, i in licences.SENTENCES.items() if i == s.rstrip("?")), "SPDX-License-Identifier: X11")]] for seq, _ in licences.RULES]
    texts = ["", None, ".", "\n\n"]
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(1, 6)):
            what = rng.random()
            parts += rng.choice(runs) if what < 0.4 else [rng.choice(known)] if what < 0.7 else ["some other words"] * rng.randint(1, 9)
        parts = [p.replace("version #", "version 3").replace("#", "v2.0" if "eclipse" in p else "4.0") for p in parts]
        parts = [p.replace(" ", "\n# ", 1) if rng.random() < 0.1 else p for p in parts]
        texts.append("".join(p + rng.choice([". ", "; ", ":\n", ".\n\n", "\n", "\n\n", "\n#\n# ", ". # "]) for p in parts))
    frame(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.identifiers, r.licences) for r in queries.op2_licences(spark, str(tmp_path)).collect()}
    want = {i: plain_licences(t or "") for i, t in enumerate(texts)}
    assert {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert len({x for _, x in want.values()}) > 30


# SpotSigs


def plain_signatures(text):
    words = "".join(c if c.isalpha() or c.isnumeric() else " " for c in (text or "").lower()).split()
    content = [w for w in words if w not in spotsigs.WORDS]
    out = []
    for i, w in enumerate(words):
        after = [x for x in words[i + 1 :] if x not in spotsigs.WORDS][: spotsigs.CHAIN]
        if w in spotsigs.WORDS and len(after) == spotsigs.CHAIN:
            out.append(" ".join(after))
    return set(out or content or words)


TEXTS = ["", "   ", "the", "the and of", "a quick brown fox", "The cat, and the dog of the house is old", "plain words only here", "der Hund und die Katze", "it's the end of a day", "the the the x y", "x the", "Ünï the Çö dé", None, "a b c d e f the g h i", "the 12 34 of 56"]


def test_signatures_match_definition(spark):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choices(["the", "of", "a", "is", "kol", "ban", "mir", "und", "der", "les", "x,", "Y."], k=rng.randrange(60))) for _ in range(60)]
    rows = spotsigs.with_signatures(frame(spark, list(enumerate(texts))), F.col("text"), "s").collect()
    sets = [plain_signatures(r.text) for r in rows]
    words = sorted(set().union(*sets))
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64(F.when(F.contains("w", F.lit(" ")), F.concat(F.lit(" "), "w")).otherwise(F.col("w"))).alias("h")).collect()}
    for r, want in zip(rows, sets, strict=True):
        # A chain has a blank before each word.
        assert r.s == sorted(hashes[w] for w in want), r.text


def test_words_by_first_letters():
    import re

    pattern = re.compile(spotsigs._branches(list(spotsigs.WORDS)))
    assert all(pattern.fullmatch(w) for w in spotsigs.WORDS)
    assert not any(pattern.fullmatch(w) for w in ("", "x", "thex", "th", "dela", "notx"))


def test_next_rows_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS", 3)
    monkeypatch.setattr(spotsigs, "PROBES", 4)
    rng = random.Random(9)
    ids = [rng.choice([rng.randrange(100), rng.randrange(10**12), -rng.randrange(50)]) for _ in range(120)] + [None, None, -(2**63), 2**63 - 1]
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    got = spotsigs.with_next(frame(spark, rows).repartition(6), "doc_id", "text", "after").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = {t: ordered[(k + 1) % len(ordered)][1] for k, (_, t) in enumerate(ordered)}
    assert {r.text: r.after for r in got} == want


def test_near_pairs_match_all_pairs(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = rng.choice(rows)[1].split() if rows and rng.random() < 0.6 else rng.choices(words + ["the"] * 30, k=rng.randrange(3, 60))
        for _ in range(rng.choice([0, 0, 1, 2])):
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, " ".join(base)))
    rows += [(500, None), (501, ""), (None, "the x y z")]
    sets = {i: plain_signatures(t) for i, t in rows}
    pairs, classes = spotsigs.near_pairs(frame(spark, rows))
    own = {str(r.doc_id): r.class_id for r in classes.collect()}
    assert len(own) == len(rows)
    for a in sets:
        for b in sets:
            if a is not None and b is not None:
                assert (own[str(a)] == own[str(b)]) == (sets[a] == sets[b])
    reps = sorted({c for c in own.values() if c is not None})
    want = {(a, b) for a in reps for b in reps if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.class_a, r.class_b) for r in pairs.collect()} == want and want
    assert spotsigs.near_pairs(frame(spark, []))[0].count() == 0


def test_op10_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = [*TEXTS, *[" ".join(rng.choices(["the", "of", "kol", "ban", "mir", "é", "🙂"], k=rng.randrange(40))) for _ in range(40)]]
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    frame(spark, [(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_spotsigs(spark, str(tmp_path)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    import hashlib

    def like(a, b):
        return 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / len(a | b)

    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = map(plain_signatures, (t, edited, nxt))
        assert got[i].near_edited == pytest.approx(like(a, b)) and got[i].near_next == pytest.approx(like(a, c)), (t, edited)
    by = {}
    for i, t in ordered:
        by.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by.values())
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op10_spotsigs(spark, f"{tmp_path}/none").count() == 0
    frame(spark, [(1, "the only one here")]).write.parquet(f"{tmp_path}/one/documents.parquet")
    assert queries.op10_spotsigs(spark, f"{tmp_path}/one").first().near_next == 1.0
