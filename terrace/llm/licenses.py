"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised (A-Z lowered, signs and spaces
to one space) and looked up among known licence sentences; the identifiers found
make up a sequence.  Rules, each an identifier sequence and a licence, are
tried in order: where a rule's sequence occurs its identifiers are used up.

Sentences are read twice: with a line's end as a sentence's end (notices on a
line of their own), and with it as a space (wrapped licence texts).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import UPPER, prepare

# Licence sentences as they are published, by identifier.
SENTENCES = {
    "allrights": "All rights reserved.",
    "apache2see": "Licensed under the Apache License, Version 2.0.",
    "apache2head": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache2both": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2you": "you may not use this file except in compliance with the License.",
    "apache2copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2perm": "See the License for the specific language governing permissions and limitations under the License.",
    "mitsee": "Released under the MIT License.",
    "mitlicensed": "Licensed under the MIT License.",
    "mitgrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mitnotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mitasis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mitliable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsdgrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsdsource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsdbinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsdendorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsdasis": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd3see": "Licensed under the BSD 3-Clause License.",
    "bsd2see": "Licensed under the BSD 2-Clause License.",
    "iscgrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "iscasis": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "gpl3see": "This work is licensed under the GNU General Public License, version 3.",
    "gplfree2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gplfree3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gplhope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpldetails": "See the GNU General Public License for more details.",
    "gplcopy": "You should have received a copy of the GNU General Public License along with this program.",
    "lgplsee": "Licensed under the GNU Lesser General Public License, version 3.",
    "agplsee": "Licensed under the GNU Affero General Public License, version 3.",
    "mpl2source": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl2see": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "ccbysee": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbyshort": "Licensed under CC BY 4.0.",
    "ccbysasee": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbysashort": "Licensed under CC BY-SA 4.0.",
    "ccbyncsee": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "ccbyncshort": "Licensed under CC BY-NC 4.0.",
    "cc0see": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

# Rules in the order in which they are tried.
RULES = [
    ("gplfree3 gplhope gpldetails gplcopy", "GPL-3.0-or-later"),
    ("gplfree3 gplhope gpldetails", "GPL-3.0-or-later"),
    ("gplfree3", "GPL-3.0-or-later"),
    ("gplfree2 gplhope gpldetails gplcopy", "GPL-2.0-or-later"),
    ("gplfree2 gplhope gpldetails", "GPL-2.0-or-later"),
    ("gplfree2", "GPL-2.0-or-later"),
    ("gpl3see", "GPL-3.0-only"),
    ("lgplsee", "LGPL-3.0-only"),
    ("agplsee", "AGPL-3.0-only"),
    ("apache2head apache2you apache2copy apache2basis apache2perm", "Apache-2.0"),
    ("apache2head apache2you", "Apache-2.0"),
    ("apache2both", "Apache-2.0"),
    ("apache2see", "Apache-2.0"),
    ("mitgrant mitnotice mitasis mitliable", "MIT"),
    ("mitgrant mitnotice", "MIT"),
    ("mitsee", "MIT"),
    ("mitlicensed", "MIT"),
    ("bsdgrant bsdsource bsdbinary bsdendorse bsdasis", "BSD-3-Clause"),
    ("bsdgrant bsdsource bsdbinary bsdasis", "BSD-2-Clause"),
    ("bsd3see", "BSD-3-Clause"),
    ("bsd2see", "BSD-2-Clause"),
    ("iscgrant iscasis", "ISC"),
    ("mpl2source mpl2copy", "MPL-2.0"),
    ("epl2see", "EPL-2.0"),
    ("ccbysasee", "CC-BY-SA-4.0"),
    ("ccbysashort", "CC-BY-SA-4.0"),
    ("ccbyncsee", "CC-BY-NC-4.0"),
    ("ccbyncshort", "CC-BY-NC-4.0"),
    ("ccbysee", "CC-BY-4.0"),
    ("ccbyshort", "CC-BY-4.0"),
    ("cc0see", "CC0-1.0"),
    ("unlicense", "Unlicense"),
    ("allrights", "LicenseRef-All-Rights-Reserved"),
]

_SIGNS = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_END = "[.:!?]+([ \\t]+|\\n|$)"


def normal_form(sentence: str) -> str:
    low = sentence.translate(str.maketrans(UPPER, UPPER.lower()))
    return re.sub(_SIGNS, " ", re.sub(_END, "\n", low)).replace("\n", " \n ").strip()


def known_sentences() -> dict[str, str]:
    """Normal form to identifier; of a sentence that has a sentence's end inside, its longest part stands for it."""
    out: dict[str, str] = {}
    for name, sentence in SENTENCES.items():
        out.setdefault(max((p.strip() for p in normal_form(sentence).split("\n")), key=len), name)
    return out


def sentences(text: Column, lines_end: bool) -> Column:
    low = F.translate(F.regexp_replace(text, "\\r\\n?", "\n"), UPPER, UPPER.lower())
    if not lines_end:
        low = F.translate(low, "\n", " ")
    cut = F.regexp_replace(F.regexp_replace(low, _END, "\n"), _SIGNS, " ")
    return F.filter(F.transform(F.split(cut, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def identifiers(found: Column) -> Column:
    known = known_sentences()
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.transform(F.filter(found, lambda s: F.map_contains_key(table, s)), lambda s: F.element_at(table, s))


def recognise(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_sentences, n_known, sentence_ids, licenses (both comma-joined, in order).

    Null and empty texts have no sentence and no licence.  licenses follows the
    order of the rules, each once.  Other columns are not read.
    """
    prepare(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.select(F.col(doc_id).alias("doc_id"), sentences(body, True).alias("own_lines"), sentences(body, False).alias("wrapped"))
    out = out.select("doc_id", F.size("own_lines").cast("long").alias("n_sentences"), identifiers(F.col("own_lines")).alias("ids"), identifiers(F.col("wrapped")).alias("more"))
    out = out.withColumn("rest", F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">|<"), F.array_join("more", "><"), F.lit(">")))
    # Each rule sees what the rules before it have left.
    state = F.struct(F.col("rest"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit("".join(f"<{i}>" for i in ids.split())).alias("ids"), F.lit(name).alias("name")) for ids, name in RULES])
    found = F.aggregate(
        rules,
        state,
        lambda a, r: F.struct(
            F.replace(a["rest"], r["ids"], F.lit("|")).alias("rest"),
            F.when(F.contains(a["rest"], r["ids"]), F.array_append(a["found"], r["name"])).otherwise(a["found"]).alias("found"),
        ),
        lambda a: F.array_join(F.array_distinct(a["found"]), ","),
    )
    nothing = (F.size("ids") == 0) & (F.size("more") == 0)
    return out.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.when(nothing, "").otherwise(found).alias("licenses"))


def recognise_sql() -> str:
    """The same for DuckDB over ``documents``, made from the same tables."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = known_sentences()
    table = f"MAP {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in known.items())}}}"
    low = f"translate(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '{UPPER}', '{UPPER.lower()}')"

    def cut_up(lines_end: bool) -> str:
        start = low if lines_end else f"replace({low}, chr(10), ' ')"
        cut = f"regexp_replace(regexp_replace({start}, '{_END}', chr(10), 'g'), '{_SIGNS}', ' ', 'g')"
        return f"list_filter(list_transform(string_split({cut}, chr(10)), lambda s: trim(s)), lambda s: s <> '')"

    steps = ["s0 AS (SELECT *, '<' || array_to_string(ids, '><') || '>|<' || array_to_string(more, '><') || '>' AS rest, CAST([] AS VARCHAR[]) AS found FROM n)"]
    for k, (sequence, name) in enumerate(RULES, 1):
        pattern = quoted("".join(f"<{i}>" for i in sequence.split()))
        steps.append(
            f"s{k} AS (SELECT doc_id, n_sentences, ids, more, replace(rest, {pattern}, '|') AS rest, CASE WHEN contains(rest, {pattern}) AND NOT list_contains(found, {quoted(name)}) THEN list_append(found, {quoted(name)}) ELSE found END AS found FROM s{k - 1})"
        )
    names = lambda col: f"list_transform(list_filter({col}, lambda s: m[s] IS NOT NULL), lambda s: m[s])"
    return (
        f"WITH t AS (SELECT doc_id, {cut_up(True)} AS a, {cut_up(False)} AS b, {table} AS m FROM documents), "
        f"n AS MATERIALIZED (SELECT doc_id, CAST(len(a) AS BIGINT) AS n_sentences, {names('a')} AS ids, {names('b')} AS more FROM t), "
        + ", ".join(steps)
        + f" SELECT doc_id, n_sentences, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licenses FROM s{len(RULES)}"
    )
