import duckdb
import pytest

from docengine.llm.licenses import CUES, IDS, INSTEAD, RULES, oracle, recognise

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
NAME = """3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


def commented(text, mark):
    return "\n".join(mark + line for line in text.split("\n"))


TEXTS = {
    1: ("Some words.\n" + MIT, "MIT"), 2: ("\n\n".join(MIT.split("\n\n")[::-1]), ""), 3: ("un | a |\nReleased under the MIT License.", "MIT"),
    4: ("Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", "Apache-2.0,CC-BY-NC-4.0"), 5: ("a license of no kind", ""), 6: ("", ""), 7: (None, ""),
    8: ("Released under the MIT License.\n" * 3000, "MIT"), 9: (GPL3, "GPL-3.0"), 10: (commented(GPL3, "# "), "GPL-3.0"), 11: ("/*\n" + commented(GPL3, " * ") + "\n */", "GPL-3.0"),
    12: (GPL3.replace("\n", "\r\n"), "GPL-3.0"), 13: (MIT.replace("\n", "\r\n"), "MIT"), 14: (GPL3.replace("version 3", "version 2").replace("software:", "software;"), "GPL-2.0"),
    15: (GPL3.replace("GNU General Public License as", "GNU Affero General Public License as"), "AGPL-3.0"), 16: ("This library is released under the MIT License.", "MIT"), 17: (BSD, "BSD-2-Clause"),
    18: (commented(BSD + NAME, "// "), "BSD-3-Clause"), 19: (commented(APACHE, "; "), "Apache-2.0"), 20: ("# SPDX-License-Identifier: BSD-3-Clause\nimport os", "BSD-3-Clause"),
    21: ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"), 22: ("Released under the\rMIT License.", "MIT"), 23: ("released under the mit licenses", ""),
    24: ("All rights reserved under copyright.", "Proprietary"), 25: (" \n\t ", ""), 26: (GPL3.split("\n\n")[0], "GPL-3.0"), 27: (GPL3.split("\n\n")[1], ""),
}


def test_tables():
    assert all(any(c in s for c in CUES) for s in IDS), [s for s in IDS if not any(c in s for c in CUES)]
    names = {name for name, _ in RULES}
    assert all(i in IDS.values() for _, ids in RULES for i in ids) and all(a in names and b in names for a, b in INSTEAD)


@pytest.fixture(scope="module")
def got(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in TEXTS.items()], "doc_id long, text string")
    return {r.doc_id: r for r in recognise(docs).collect()}


def test_rules(got):
    assert {i: r.licenses for i, r in got.items()} == {i: want for i, (_, want) in TEXTS.items()}
    assert got[1].sentences == "<mit-grant><mit-notice><as-is>"
    assert [got[i].n_sentences for i in (2, 5, 6, 7, 8)] == [3, 0, 0, 0, 3000]


def test_sql_gives_the_same(got):
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", [(i, t) for i, (t, _) in TEXTS.items()])
    rows = {r[0]: r[1:] for r in db.execute(oracle()).fetchall()}
    assert rows == {i: (r.n_sentences, r.sentences, r.licenses) for i, r in got.items()}


def test_odd_rows(odd_docs):
    assert recognise(odd_docs).count() == 9 and recognise(odd_docs.limit(0)).count() == 0
