"""Licence texts as files have them, against the rules and against a plain reading of the same tables."""

import random
import re
import textwrap

import duckdb
import pytest

from strandforge.llm import licenses

MIT = """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD2 = """Copyright (c) 2021, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED."""
BSD3 = BSD2.format(third="3. Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n")
BSD2 = BSD2.format(third="")
APACHE = """Copyright 2021 Some Body

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful."
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
GPL2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.'
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
TEXTS = {
    "MIT": [MIT, "some prose\nReleased under the MIT License.\nmore", "# SPDX-License-Identifier: MIT\nx = 1"],
    "BSD-2-Clause": [BSD2], "BSD-3-Clause": [BSD3], "Apache-2.0": [APACHE, "so\nLicensed under the Apache License, Version 2.0.\n", "                                 Apache License\n                           Version 2.0, January 2004\n\n   2. Grant of Copyright License. Subject to the terms and conditions of\n      this License, each Contributor hereby grants to You a perpetual,\n      worldwide, non-exclusive, no-charge, royalty-free, irrevocable\n      copyright license to reproduce, prepare Derivative Works of,\n      publicly display, publicly perform, sublicense, and distribute the\n      Work and such Derivative Works in Source or Object form."],
    "GPL-3.0-or-later": [GPL3], "GPL-2.0-only": [GPL2], "LGPL-2.1-or-later": [LGPL], "ISC": [ISC], "MPL-2.0": [MPL], "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-3.0": ["                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007"], "CC-BY-NC-4.0": ["end of it.\nLicensed under CC BY-NC 4.0."],
    "": ["You may not use this file except in compliance with the License, says he.", "Permission is hereby granted, they said. The software is provided.", "licensed under the mitten license", None, ""],
}


def layouts(text):
    """The text as it is, wrapped, and wrapped in comments."""
    out = [text]
    for width in (46, 78):
        wrapped = "\n".join(textwrap.fill(p, width) if "\n" not in p and len(p) > width else p for p in text.split("\n\n")) if "\n\n" not in text else "\n\n".join(textwrap.fill(p, width) if len(p) > width else p for p in text.split("\n\n"))
        out += [wrapped] + [head + "\n".join(mark + line for line in wrapped.split("\n")) + tail for head, mark, tail in (("", "# ", ""), ("/*\n", " * ", "\n */"), ("", "// ", "\n"), ("<!--\n", "   ", "\n-->"))]
    return out


def plain(text):
    """Known sentences by trying every stretch of lines of every sentence, word by word."""
    text = text or ""
    if not re.search(licenses.HINTS, text):
        return []
    out = []
    known = licenses._lookup()
    text = "".join(c.lower() if c.isascii() else c for c in text)
    paragraphs, held = [], []
    for line in text.split("\n"):
        if re.search("[a-z0-9]", line):
            held.append(line)
        else:
            paragraphs.append(held)
            held = []
    for lines in [*paragraphs, held]:
        cells, cell = [], []  # sentences: lists of lines of words
        for line in lines:
            pieces = re.split(r"[.!?;:][\"')\]]*[\x20\x09-\x0D]|[.!?;:][\"')\]]*$", line)
            for k, piece in enumerate(pieces):
                if words := re.findall("[a-z0-9]+", piece):
                    cell.append(words)
                if k < len(pieces) - 1 and cell:
                    cells.append(cell)
                    cell = []
        cells.append(cell)
        for cell in cells:
            at = 0
            while at < len(cell):
                best = None
                for end in range(len(cell), at, -1):
                    words = [w for line in cell[at:end] for w in line]
                    for skip in (0, 1):
                        if skip and not (len(words) > 1 and re.fullmatch("[a-z]|[0-9]{1,2}|[ivx]+", words[0])):
                            continue
                        s = " ".join(words[skip:])
                        s = re.sub(r"^(this (work|project|software|program|library|file|code|document) is )?(licensed|released|distributed|made available) under (the )?", "under ", s)
                        for star in [k for k in known if "*" in k]:
                            a, b = star.split(" * ")
                            if s.startswith(a + " ") and s.endswith(" " + b) and 1 <= len(s[len(a) : -len(b)].split()) <= 12:
                                s = star
                        if s in known and best is None:
                            best = (end, known[s])
                if best:
                    out.append(best[1])
                at = best[0] if best else at + 1
    return out


@pytest.fixture(scope="module")
def cases():
    return [(name, x) for name, texts in TEXTS.items() for t in texts for x in (layouts(t) if t else [t])]


def test_licence_files_are_recognised(spark, cases):
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan_licenses(table).collect())
    assert [(i, r[3]) for i, r in enumerate(got)] == [(i, n) for i, (n, _) in enumerate(cases)]
    assert [r[2] for r in got] == [",".join(plain(t)) for _, t in cases]
    con = duckdb.connect()
    con.register("documents", table.toArrow())
    assert got == sorted(con.sql(licenses.license_sql()).fetchall())


def test_mangled_texts_read_the_same_everywhere(spark, cases):
    rng = random.Random(7)
    pieces = [p for _, t in cases if t for p in re.split(r"(?<=[.;:\n]) ?", t)]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "\n", "", "\n\n", " -- ", "\x01", "\x02é "]) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan_licenses(table).collect())
    assert [r[2] for r in got] == [",".join(plain(re.sub("[\x01\x02]", " ", t))) for t in texts]
    con = duckdb.connect()
    con.register("documents", table.toArrow())
    assert got == sorted(con.sql(licenses.license_sql()).fetchall())


def test_every_known_sentence_has_a_hint():
    for s in licenses.SENTENCES:
        assert re.search(licenses.HINTS, s), s


def test_long_separators_take_linear_time(spark):
    texts = ["-" * 2_000_000 + " Licensed under the MIT License", "license" + "\n" * 500_000 + "." * 500_000 + " :" * 300_000, "license " + "a\n" * 500_000]
    got = sorted(tuple(r) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r[3] for r in got] == ["MIT", "", ""]


@pytest.mark.parametrize(
    ("text", "licences"),
    [
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\n", "Apache-2.0,MIT"),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC\ncode", "Apache-2.0,ISC,MIT"),
        ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0-or-later"),
        ("/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note OR MIT */", "GPL-2.0,MIT"),
        ("SPDX-License-Identifier: LGPL-2.1+\n", "LGPL-2.1-or-later"),
        ("SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1"),
        ("SPDX-License-Identifier: MIT", "MIT"),
        ("Licensed under MIT.", "MIT"),
        ("MIT OR Apache-2.0", ""),
    ],
)
def test_licence_expressions(spark, text, licences):
    assert licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses == licences


def test_a_holder_of_any_length(spark):
    """A name of many words stands where a sentence has a holder's."""
    head = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
    for n in (1, 12, 13, 60, 20_000):
        holder = "\n".join(" ".join(f"word{i}" for i in range(at, min(n, at + 9))) for at in range(0, n, 9))
        text = f"{head}3. Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
        assert licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses == "BSD-3-Clause", n
