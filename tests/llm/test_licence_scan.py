"""op1: real licence texts, short notices, odd rows; and DuckDB's answer to the same SQL."""

import random
import re
from re import _parser

import duckdb
import pytest

from vellum.llm import licence_scan as L

MIT = """The MIT License (MIT)

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, and to permit persons to do so, subject to the following
conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.  IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.
"""
APACHE = """# Copyright 2019 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of fitness.
 */"""
CASES = [
    (MIT, "MIT"), (APACHE, "Apache-2.0"), (GPL, "GPL-3.0-or-later"),
    ("words.\nReleased under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("*x\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("A. Licensed under CC BY 4.0. B", "CC-BY-4.0"),
    ("Distributed under the GNU Lesser General Public License v2.1 or later.", "LGPL-2.1-or-later"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"), ("SPDX-License-Identifier: MIT", "MIT"),
    ("Available under the GPL.", "GPL"), ("This work is in the public domain.", "Public-Domain"), ("Released under the MIT License. Licensed under CC BY-SA 3.0.", "MIT,CC-BY-SA-3.0"),
    ("You need a driving licence. The licence fee is due.", ""), ("Copyright 2001 A. B.", ""), ("no cue here", ""), ("", ""), (None, ""), ("Released under the MIT License.\n" * 3000, "MIT"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(CASES)] + [(3, CASES[3][0], 1)], "doc_id long, text string, ids int")


def test_cases(docs):
    got = L.scan(docs).collect()
    assert len(got) == len(CASES) + 1
    for r in got:
        assert r["licences"] == CASES[r["doc_id"]][1], (CASES[r["doc_id"]][0], r)


def test_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.execute(L.SQL).fetchall())
    assert sorted(tuple(r) for r in L.scan(docs).collect()) == want
    assert L.scan(docs.limit(0)).count() == 0


def test_cues_leave_no_sentence_out(spark):
    cases = [
        ("This work is released under GPLv3.", "GPL-3.0-only"), ("Published under the GPLv2 only.", "GPL-2.0-only"), ("Distributed under the LGPLv2.1.", "LGPL-2.1-only"), ("Released under CC0.", "CC0-1.0"),
        ("This file is in the public\ndomain.", "Public-Domain"), ("# This file is in the public\n# domain.", "Public-Domain"), ("Available under creative\ncommons attribution 4.0.", "CC-BY-4.0"), ("Published under CC\nBY 4.0.", "CC-BY-4.0"), ('Published under "G"PLv3.', "GPL-3.0-only"),
    ]
    got = {r["doc_id"]: r["licences"] for r in L.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == [x for _, x in cases]


def _sample(rng, parsed):
    out = ""
    for op, x in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(x)
        elif name == "ANY":
            out += "x"
        elif name == "IN":
            out += chr(rng.choice(x)[1])
        elif name == "SUBPATTERN":
            out += _sample(rng, x[-1])
        elif name == "BRANCH":
            out += _sample(rng, rng.choice(x[1]))
        else:
            assert name == "MAX_REPEAT", name
            out += "".join(_sample(rng, x[2]) for _ in range(rng.randint(x[0], min(x[1], x[0] + 1))))
    return out


def test_every_sentence_has_a_cue():
    rng = random.Random(4)
    for name, pattern in L.SENTENCES:
        for _ in range(200):
            s = _sample(rng, _parser.parse(pattern))
            assert re.fullmatch(pattern, s) and re.search(L.CUES, s), (name, s)


def plain_ids(text):
    """Identifiers without any gate: every sentence is compared with the whole table."""
    bare = re.sub(L._COMMENT, "", text)
    flat = re.sub("\n[ \t]*\n", "\u2029", bare).replace("\n", " ")

    def named(parts):
        out = []
        for s in parts:
            s = re.sub("[^a-z0-9.,()/+-]+", " ", s.translate({**{i: i + 32 for i in range(65, 91)}, 34: None, 39: None})).strip(" ")
            s = re.sub("^[ .,/+-]+|[ .,/-]+$", "", s).strip(" ")
            out += [next((i for i, p in L.SENTENCES if re.fullmatch(p, s)), None)] if s else []
        return [x for x in out if x]

    a = named(re.split("[.;!?]+[ \u2029]+|\u2029", flat))
    return a + [x for x in named(re.split("\\n|[.;!?]+ +", bare)) if x not in a]


def test_identifiers_without_a_gate(spark):
    """Random sentences of the table among other text, on lines of their own, repeated, alone: as a search without a gate, in Spark and in the SQL."""
    rng = random.Random(9)
    texts = ["All rights reserved.", "(c) 2024 Jane Doe", "MIT License\nwords\nApache License 2.0\nMIT License", "Copyright 2001 A\n\nwords\nCopyright 2002 B\nAll rights reserved"]
    for name, pattern in L.SENTENCES:
        s = _sample(rng, _parser.parse(pattern))
        texts.append(rng.choice(["{}", "{}.", "Some words. {}. More words.", "# {}\n", "words\n{}\nwords\n{}", "a\n\n{}\n\nb"]).replace("{}", s))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i]["sentence_ids"] == ",".join(plain_ids(t)), t
        assert i > 1 or got[i]["n_sentences"] == 1
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(con.execute(L.SQL).fetchall()) == sorted(tuple(r) for r in got.values())
