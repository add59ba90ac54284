"""Licence sentences as they stand in files: wrapped, in comments, over blank lines."""

import textwrap

import pytest
from pyspark.sql import types as T

from scorelens.llm import licenses

S = licenses.SENTENCES
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), T.StructType().add("doc_id", "long").add("text", "string"))
    return licenses.scan(docs).orderBy("doc_id").collect()


@pytest.mark.parametrize("lead", ["", "# ", " * ", "// "])
def test_wrapped_texts(spark, lead):
    bsd = "\n".join(textwrap.wrap(S["bsd-grant"], 60) + ["", "1. " + S["bsd-source"][:50].rstrip() + "\n" + S["bsd-source"][50:] + "."] + textwrap.wrap("2. " + S["bsd-binary"] + ".", 60))
    mit = "\n".join([S["mit-title"], ""] + textwrap.wrap(S["mit-grant"], 70) + [""] + textwrap.wrap(S["mit-condition"] + ".", 70) + [""] + textwrap.wrap(S["mit-warranty"] + ". IN NO EVENT", 70))
    bsd = bsd.replace(S["bsd-source"][:50].rstrip() + "\n" + S["bsd-source"][50:], "\n".join(textwrap.wrap(S["bsd-source"], 50)))
    texts = ["".join(lead + line + end for line in t.splitlines()) for t in (GPL, APACHE, MPL, mit, bsd) for end in ("\n", "\r\n")]
    got = scanned(spark, texts)
    assert [r.licences for r in got] == [x for x in ("GPL-3.0-or-later", "Apache-2.0", "MPL-2.0", "MIT", "BSD-2-Clause") for _ in "ab"]
    assert all(r.rest == "" for r in got) and got[2].sentence_ids == "apache-notice,apache-use,apache-copy,apache-asis,apache-see"


def test_every_sentence(spark):
    whole = scanned(spark, list(S.values()))
    wrapped = scanned(spark, ["x\n" + s.replace(" ", "\n  # ") + ".\ny" for s in S.values()])
    assert [r.sentence_ids for r in whole] == [r.sentence_ids for r in wrapped] == list(S)


def test_not_inside_a_sentence(spark):
    texts = ["they say all rights reserved here", "All rights. reserved", "all rights reserved by\nsomeone", "some all\nrights reserved"]
    assert [r.sentence_ids for r in scanned(spark, texts)] == ["", "", "", ""]


def test_long_runs_of_other_characters(spark):
    texts = ["All rights reserved " + "-" * 2500, "All" + " " * 5000 + "rights reserved", "=" * 4000 + "\nAll rights reserved\n" + "=" * 4000]
    assert [r.sentence_ids for r in scanned(spark, texts)] == ["reserved"] * 3


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented
"""


@pytest.mark.parametrize("lead", ["", " * "])
def test_more_licences(spark, lead):
    texts = ["".join(lead + line + "\n" for line in t.splitlines()) for t in (LGPL, ISC, ZLIB, "SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under CC BY-NC-SA 4.0.")]
    got = scanned(spark, texts)
    assert [r.licences for r in got] == ["LGPL-2.1-or-later", "ISC", "Zlib", "GPL-2.0-or-later", "CC-BY-NC-SA-4.0"] and all(r.rest == "" for r in got)


def test_rules_name_known_sentences():
    assert {i for ids, _ in licenses.RULES for i in ids} <= set(S)
    assert len({licenses._key(s) for s in S.values()}) == len(S)
