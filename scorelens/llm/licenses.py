"""Licence scans by sentence rules, in DataFrame functions.

A text is normalised (lower case; every run of characters other than a-z, 0-9 and '+' is one
space), except that ends of sentences (after . ! ? ; before white space) and of lines are kept.
A known licence sentence is found where it stands between two such ends with nothing but line
ends, or sentence ends of its own (as in 'v. 2.0'), inside; of several from one place the
longest.  So hard-wrapped texts and comments are read.  The identifiers found, in order, are matched against
ordered rules: the first rule that applies takes its sentences out, so a full licence text
is reported as such and not as the notices inside it.

Defined cases: null or empty text has no sentences and no licence; sentences that are known but
belong to no rule in this order are reported in ``rest``; a sentence that occurs again is found
again; texts of any length are read as a whole; rows repeated give rows repeated; an empty table
gives an empty result; further columns, whatever their names, are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences as their licences word them, by identifier.
SENTENCES = {
    "apache-ref": "Licensed under the Apache License, Version 2.0",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-ref": "Released under the MIT License",
    "mit-ref-2": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "bsd-ref": "Licensed under the BSD License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-ref-2": "Licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-ref-2": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-ref": "Licensed under CC BY 4.0",
    "cc-by-ref-2": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0",
    "cc-by-sa-ref-2": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-ref": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "mit-style": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file",
    "gpl2-ref": "Licensed under the GNU General Public License, version 2",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl-details": "See the GNU Lesser General Public License for more details",
    "lgpl3-ref": "Licensed under the GNU Lesser General Public License, version 3",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-details": "See the GNU Affero General Public License for more details",
    "agpl3-ref": "Licensed under the GNU Affero General Public License, version 3",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd0-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-ref": "Distributed under the Boost Software License, Version 1.0",
    "epl-ref": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cddl-ref": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "ofl-ref": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "unlicense-any": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc0-ref-2": "This work is licensed under CC0 1.0 Universal",
}
#: Short names that stand in a tag, and further parts of Creative Commons licences.
TAGGED = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 ISC Zlib BSL-1.0 EPL-2.0 CDDL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 Unlicense 0BSD OFL-1.1".split()
COMMONS = {"BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
SENTENCES |= {f"tag-{n.lower()}": f"SPDX-License-Identifier: {n}" for n in TAGGED}
SENTENCES |= {f"cc-{k.lower()}-ref": f"Licensed under CC {k} 4.0" for k in COMMONS}
SENTENCES |= {f"cc-{k.lower()}-ref-2": f"This work is licensed under a Creative Commons {v} 4.0 International License" for k, v in COMMONS.items()}
#: Ordered rules: identifiers in sequence, and the licence.  Earlier rules go first.
RULES = [
    (("mit-title", "mit-grant", "mit-condition", "mit-warranty"), "MIT"),
    (("mit-grant", "mit-condition", "mit-warranty"), "MIT"),
    (("apache-notice", "apache-use", "apache-copy", "apache-asis", "apache-see"), "Apache-2.0"),
    (("apache-notice", "apache-use"), "Apache-2.0"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("gpl-free", "gpl-hope", "gpl-implied", "gpl-details", "gpl-received"), "GPL-3.0-or-later"),
    (("gpl-free", "gpl-hope", "gpl-implied", "gpl-details"), "GPL-3.0-or-later"),
    (("gpl2-free", "gpl-hope", "gpl-implied", "gpl-details", "gpl-received"), "GPL-2.0-or-later"),
    (("gpl2-free", "gpl-hope", "gpl-implied", "gpl-details"), "GPL-2.0-or-later"),
    (("lgpl-free", "lgpl-hope", "gpl-implied", "lgpl-details"), "LGPL-2.1-or-later"),
    (("agpl-free", "gpl-hope", "gpl-implied", "agpl-details"), "AGPL-3.0-or-later"),
    (("isc-grant", "isc-warranty"), "ISC"),
    (("bsd0-grant", "isc-warranty"), "0BSD"),
    (("zlib-asis", "zlib-liable", "zlib-grant"), "Zlib"),
    (("mpl-notice", "mpl-copy"), "MPL-2.0"),
    (("unlicense", "unlicense-any"), "Unlicense"),
    (("gpl2-free",), "GPL-2.0-or-later"),
    (("gpl2-only",), "GPL-2.0-only"),
    (("gpl2-ref",), "GPL-2.0-only"),
    (("lgpl-free",), "LGPL-2.1-or-later"),
    (("lgpl3-ref",), "LGPL-3.0-only"),
    (("agpl-free",), "AGPL-3.0-or-later"),
    (("agpl3-ref",), "AGPL-3.0-only"),
    (("isc-grant",), "ISC"),
    (("zlib-grant",), "Zlib"),
    (("boost-ref",), "BSL-1.0"),
    (("epl-ref",), "EPL-2.0"),
    (("cddl-ref",), "CDDL-1.0"),
    (("ofl-ref",), "OFL-1.1"),
    (("bsd-style",), "BSD"),
    (("mit-style",), "MIT"),
    (("cc0-ref-2",), "CC0-1.0"),
    (("gpl-free",), "GPL-3.0-or-later"),
    (("apache-notice",), "Apache-2.0"),
    (("apache-ref",), "Apache-2.0"),
    (("mit-ref",), "MIT"),
    (("mit-ref-2",), "MIT"),
    (("mit-title",), "MIT"),
    (("bsd-ref",), "BSD"),
    (("gpl3-ref",), "GPL-3.0-only"),
    (("gpl3-ref-2",), "GPL-3.0-only"),
    (("mpl-notice",), "MPL-2.0"),
    (("cc-by-nc-ref",), "CC-BY-NC-4.0"),
    (("cc-by-nc-ref-2",), "CC-BY-NC-4.0"),
    (("cc-by-ref",), "CC-BY-4.0"),
    (("cc-by-ref-2",), "CC-BY-4.0"),
    (("cc-by-sa-ref",), "CC-BY-SA-4.0"),
    (("cc-by-sa-ref-2",), "CC-BY-SA-4.0"),
    (("cc0-ref",), "CC0-1.0"),
    (("unlicense",), "Unlicense"),
    (("reserved",), "LicenseRef-all-rights-reserved"),
]
RULES += [((f"tag-{n.lower()}",), n) for n in TAGGED]
RULES += [((f"cc-{k.lower()}-ref{more}",), f"CC-{k}-4.0") for k in COMMONS for more in ("", "-2")]
BREAK = r"(?<=[.!?;])[ \t\r\n]+"
#: What normalised text keeps of a sentence end and of a line end.
STOP, LINE = "\x01", "\x02"


def normalised(text: Column) -> Column:
    """Words with one of ' ', LINE and STOP between them."""
    ended = F.regexp_replace(F.regexp_replace(F.lower(text), BREAK, STOP), "[\r\n]+", LINE)
    words = F.regexp_replace(ended, f"[^a-z0-9+{STOP}{LINE}]+", " ")
    one = F.regexp_replace(words, f"[ {LINE}]*{STOP}[ {STOP}{LINE}]*", STOP)
    return F.trim(F.regexp_replace(one, f" ?{LINE}[ {LINE}]*", LINE))


def _key(sentence: str) -> str:
    import re

    return re.sub("[^a-z0-9+]+", " ", sentence.lower()).strip()


def _pattern(sentence: str) -> str:
    """The sentence in normalised text; a STOP may stand where it has one itself."""
    import re

    parts = [_key(p).replace("+", "[+]").replace(" ", f"[ {LINE}]") for p in re.split(BREAK, sentence)]
    return f"[ {LINE}{STOP}]".join(p for p in parts if p)


def _cover(keys: list[str]) -> list[str]:
    """Words of which every key has one."""
    left, out = list(keys), []
    while left:
        words = sorted({w for k in left for w in k.split()})
        out.append(max(words, key=lambda w: (sum(w in k.split() for k in left) * (len(w) > 5), len(w))))
        left = [k for k in left if out[-1] not in k.split()]
    return out


def identifiers(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    keys = {_key(s): i for i, s in sentences.items()}
    known, ids = (F.array(*map(F.lit, x)) for x in (list(keys), list(keys.values())))
    longest = sorted(sentences.values(), key=lambda s: -len(_key(s)))
    pattern = f"(?<![^{STOP}{LINE}])(?:{'|'.join(map(_pattern, longest))})(?![^{STOP}{LINE}])"
    possible = reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(w)) for w in _cover(list(keys))))
    found = F.when(possible, F.regexp_extract_all(normalised(text), F.lit(pattern), F.lit(0)))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda s: F.get(ids, F.array_position(known, F.translate(s, STOP + LINE, "  ")).cast("int") - 1))


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_known, sentence_ids, licences (sorted, each once)
    and rest, comma-joined."""
    sentences, rules = sentences or SENTENCES, RULES if rules is None else rules
    rows = docs.select(F.col(id_col).alias("doc_id"), identifiers(F.col(text_col).cast("string"), sentences).alias("ids"))

    def joined(ids) -> str:
        return "".join(f"<{i}>" for i in ids)

    line = F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    # An applied rule leaves a mark, so that no later rule matches across its place.
    marked = reduce(lambda s, r: F.replace(s, F.lit(joined(r[0])), F.lit(f"[{r[1]}]")), rules, line)
    rows = rows.withColumn("line", F.when(F.size("ids") == 0, "").otherwise(marked))
    licences = F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\[([^\]]+)\]"), F.lit(1)))), ",")
    rest = F.array_join(F.regexp_extract_all("line", F.lit("<([^>]+)>"), F.lit(1)), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), licences.alias("licences"), rest.alias("rest"))


def oracle_sql() -> str:
    """The same over ``documents`` for DuckDB, whose patterns have no look-behind: sentence ends
    get a line end first."""
    values = ", ".join(f"('{i}', '{_key(s)}')" for i, s in SENTENCES.items())
    line = "string_agg('<' || id || '>', '' ORDER BY k)"
    for ids, name in RULES:
        line = f"replace({line}, '{''.join(f'<{i}>' for i in ids)}', '[{name}]')"
    return f"""
        WITH known(id, key) AS (VALUES {values}),
        sentences AS (
            SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS k
            FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \\t]+|\\r', '\\1' || chr(10), 'g'), chr(10)) AS s FROM documents)),
        found AS (
            SELECT doc_id, id, k FROM sentences
            JOIN known ON key = trim(regexp_replace(lower(s), '[^a-z0-9+]+', ' ', 'g'))),
        lines AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY k) AS ids, {line} AS line FROM found GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_known, coalesce(ids, '') AS sentence_ids,
               coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(line, '\\[([^\\]]+)\\]', 1))), ','), '') AS licences,
               coalesce(array_to_string(regexp_extract_all(line, '<([^>]+)>', 1), ','), '') AS rest
        FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id
    """
