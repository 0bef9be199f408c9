"""Licence scans by sentence rules.

A text is cut into sentences, sentences are normalised and looked up in a table of known licence
sentences, and the sequence of identifiers is matched against ordered rules. All of it happens
inside the row, with built-in functions: no text is shuffled.

Marks, capitals at the start of lines and blank lines cut notices inside. A known sentence is
therefore found at a piece that opens like it if the pieces from there on, put together, begin with
it and it ends where one of them does. A known sentence has so many words at most, so no more
pieces than that can make one. Where one known sentence runs into the next on one line, the place
between them is a cut too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: normalised licence sentences and their identifiers
SENTENCES = {
    "licensed under the apache license version 2.0": "apache-2-under",
    "licensed under the apache license version 2.0 the license": "apache-2-under",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at http www.apache.org licenses license-2.0": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "released under the mit license": "mit-under",
    "licensed under the mit license": "mit-under",
    "this project is licensed under the mit license": "mit-under",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this work is licensed under the gnu general public license version 3": "gpl-3-under",
    "licensed under the gnu general public license version 3": "gpl-3-under",
    "this work is licensed under the gnu general public license version 2": "gpl-2-under",
    "licensed under the gnu general public license version 2": "gpl-2-under",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl-under",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl-21-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl-21-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-warranty",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3-later",
    "see the gnu affero general public license for more details": "agpl-see",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0": "epl-2-under",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2.0 which is available at http www.eclipse.org legal epl-2.0": "epl-2-under",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0": "epl-2-under",
    "this software is provided as-is without any express or implied warranty": "zlib-as-is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liable",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1.0": "bsl-under",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedicated",
    "this software is distributed without any warranty": "cc0-warranty",
    "licensed under cc0 1.0": "cc0-under",
    "licensed under cc by 4.0": "cc-by-4",
    "licensed under cc by-sa 4.0": "cc-by-sa-4",
    "licensed under cc by-nc 4.0": "cc-by-nc-4",
    "licensed under cc by-nc-sa 4.0": "cc-by-nc-sa-4",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc-by-4",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
# fixed values: licence and sequence of identifiers; an earlier rule takes its sentences first
RULES = (
    ("Apache-2.0", ("apache-2-under", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-3-later", "gnu-warranty", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-2-later", "gnu-warranty", "gpl-see")),
    ("LGPL-3.0-or-later", ("lgpl-3-later", "gnu-warranty", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl-21-later", "gnu-warranty", "lgpl-see")),
    ("AGPL-3.0-or-later", ("agpl-3-later", "gnu-warranty", "agpl-see")),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("CC0-1.0", ("cc0-dedicated", "cc0-warranty")),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("LGPL-3.0-or-later", ("lgpl-3-later",)),
    ("LGPL-2.1-or-later", ("lgpl-21-later",)),
    ("AGPL-3.0-or-later", ("agpl-3-later",)),
    ("EPL-2.0", ("epl-2-under",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-under",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("CC0-1.0", ("cc0-under",)),
    ("Apache-2.0", ("apache-2-under",)),
    ("MIT", ("mit-under",)),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-only", ("gpl-3-under",)),
    ("GPL-2.0-only", ("gpl-2-under",)),
    ("MPL-2.0", ("mpl-under",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("Unlicense", ("unlicense",)),
)
# a line ``SPDX-License-Identifier: name`` for each licence above; of an expression its first name counts
SPDX = tuple(dict.fromkeys(name for name, _ in RULES))
SENTENCES |= {f"spdx-license-identifier {name.lower()}": f"spdx-{name}" for name in SPDX}
RULES += tuple((name, (f"spdx-{name}",)) for name in SPDX)
# fixed value: every known sentence has one of these, however it is wrapped; other texts need no cutting
MARKS = r"(?i)licen[sc]|permission|warrant|redistribut|public\W+domain|held\W+liable"


def _ends(words: int, last: bool) -> str:
    """The first or last words of the known sentences as alternatives of a pattern."""
    parts = [s.split(" ") for s in SENTENCES if not s.startswith("spdx-")]
    ends = {" ".join(p[-words:] if last else p[:words]) for p in parts}
    return "|".join(e.replace(".", r"\.") for e in sorted(ends, key=lambda e: (-len(e), e)))


# marks of comments at the start of lines, lines that go on in lower case, ends of sentences, other signs,
# one known sentence running into the next
STEPS = (
    (r"\n[ \t]*[/*#;%!>|-]+[ \t]*", "\n"), (r"\n[ \t]*([a-z])", " {1}"), (r"([.!?;:])[ \t\r\n]+", "{1}\n"),
    (r"[^a-z0-9.\n-]+", " "), (r"[ .-]*\n[ .\n-]*", "\n"), (f"({_ends(3, True)}) ({_ends(2, False)})", "{1}\n{2}"),
)
LOWERED = 3  # the steps from here on work on lower case


def sentences(text: Column) -> Column:
    """Normalised sentences: ASCII lower case, words, digits, inner dots and hyphens, single blanks."""
    for pattern, put in STEPS[:LOWERED]:
        text = F.regexp_replace(text, pattern, put.replace("{", "$").replace("}", ""))
    text = F.translate(text, UPPER, LOWER)
    for pattern, put in STEPS[LOWERED:]:
        text = F.regexp_replace(text, pattern, put.replace("{", "$").replace("}", ""))
    return F.split(F.regexp_replace(text, r"^[ .\n-]+|[ .\n-]+$", ""), "\n", -1)


MOST_WORDS = max(len(s.split(" ")) for s in SENTENCES)
OPENERS = sorted({" ".join(s.split(" ")[:n]) for s in SENTENCES for n in (1, 2)})
#: Longest first: a sentence that goes on as a known one is that one.
BY_LENGTH = sorted(SENTENCES.items(), key=lambda x: (-len(x[0]), x[0]))


def _recognised(s: Column, i: Column) -> Column:
    """``at, n, id`` of the known sentence that the piece at ``i`` and the ``n - 1`` after it make, or null."""
    known = F.array(*(F.struct(F.lit(k).alias("sentence"), F.lit(v).alias("id"), F.lit(len(k)).alias("n")) for k, v in BY_LENGTH))

    def found(r: Column) -> Column:
        ends = lambda k: F.substring(r["cut"], k["n"] + 1, F.lit(1)).isin("", "\n")
        best = F.get(F.filter(known, lambda k: r["flat"].startswith(k["sentence"]) & ends(k)), 0)
        pieces = F.size(F.split(F.substring(r["cut"], F.lit(1), best["n"]), "\n", -1))
        return F.when(best.isNotNull(), F.struct(i.alias("at"), pieces.alias("n"), best["id"].alias("id")))

    rest = F.array_join(F.slice("cut", i + 1, MOST_WORDS), "\n")
    # arrays of one, so that the text from here on is put together once
    both = F.transform(F.array(rest), lambda r: F.struct(r.alias("cut"), F.translate(r, "\n", " ").alias("flat")))
    return F.when(F.substring_index(s, " ", 2).isin(OPENERS), F.get(F.transform(both, found), 0))


def _starts(number: int, license_name: str, wanted: tuple[str, ...]) -> Column:
    """Where the identifiers of ``found`` go on as a rule wants them."""
    sequence, length = F.array(*map(F.lit, wanted)), len(wanted)
    here = F.filter(
        F.sequence(F.lit(1), F.size("found")), lambda i: F.slice(F.col("found.id"), i, length) == sequence
    )
    return F.transform(
        here,
        lambda i: F.struct(
            i.alias("start"), F.lit(length).alias("n"), F.lit(number).alias("rule"), F.lit(license_name).alias("license")
        ),
    )


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, place, license, rule, first_sentence, n_sentences``.

    One row per recognised statement: ``place`` counts those of a document from 1,
    ``first_sentence`` is the number of the piece it begins at (from 0), ``rule`` that of the rule
    (from 0), ``n_sentences`` the known sentences it takes. A known sentence that begins inside one
    found before it is left out. Rules match runs of known sentences, whatever other sentences stand
    between; a match that shares a sentence with one of an earlier rule is left out. Documents
    without a licence, also those with a null or empty text, have no row; repeated rows give
    repeated rows. Whole texts are read, other columns are not.
    """
    rows = docs.select("doc_id", "text").filter(F.col("text").rlike(MARKS))
    cut = rows.select("doc_id", sentences(F.col("text")).alias("cut"))
    named = cut.select("doc_id", F.filter(F.transform("cut", _recognised), lambda x: x.isNotNull()).alias("named"))
    inside = lambda x: F.exists("named", lambda o: (o["at"] < x["at"]) & (x["at"] < o["at"] + o["n"]))
    found = named.filter(F.size("named") > 0).select("doc_id", F.filter("named", lambda x: ~inside(x)).alias("found"))
    starts = [_starts(number, name, wanted) for number, (name, wanted) in enumerate(RULES)]
    matches = found.select("doc_id", "found", F.flatten(F.array(*starts)).alias("all"))
    kept = F.filter(
        "all",
        lambda m: ~F.exists(
            F.col("all"), lambda o: (o["rule"] < m["rule"]) & (o["start"] < m["start"] + m["n"]) & (m["start"] < o["start"] + o["n"])
        ),
    )
    placed = matches.select("doc_id", "found", F.posexplode(F.array_sort(kept)).alias("i", "m"))
    return placed.select(
        "doc_id", (F.col("i") + 1).alias("place"), "m.license", "m.rule",
        F.get(F.col("found.at"), F.col("m.start") - 1).alias("first_sentence"), F.col("m.n").alias("n_sentences"),
    )


def scan_sql(table: str = "documents") -> str:
    """The same in DuckDB SQL."""

    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    cleaned = "text"
    for pattern, put in STEPS[:LOWERED]:
        cleaned = f"regexp_replace({cleaned}, {text(pattern)}, {_escaped(put)}, 'g')"
    cleaned = f"translate({cleaned}, '{UPPER}', '{LOWER}')"
    for pattern, put in STEPS[LOWERED:]:
        cleaned = f"regexp_replace({cleaned}, {text(pattern)}, {_escaped(put)}, 'g')"
    cleaned = rf"regexp_replace({cleaned}, '^[ .\n-]+|[ .\n-]+$', '', 'g')"
    sentence_rows = ", ".join(f"({text(s)}, {text(i)})" for s, i in SENTENCES.items())
    rule_rows = ", ".join(f"({k}, {text(n)}, [{', '.join(map(text, w))}])" for k, (n, w) in enumerate(RULES))
    return f"""
WITH known(sentence, id) AS (VALUES {sentence_rows}),
openers AS (SELECT DISTINCT unnest([regexp_extract(sentence, '^[^ ]+'), regexp_extract(sentence, '^[^ ]+ [^ ]+')]) AS opener FROM known),
rules(rule, license, wanted) AS (VALUES {rule_rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM {table} WHERE regexp_matches(text, {text(MARKS)})),
cut AS (SELECT r, doc_id, string_split({cleaned}, chr(10)) AS s FROM docs),
lines AS (SELECT r, doc_id, s, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS line FROM cut),
opened AS (SELECT r, doc_id, line, array_to_string(s[line + 1 : line + {MOST_WORDS}], chr(10)) AS rest FROM lines
           WHERE regexp_extract(sentence, '^[^ ]*( [^ ]+)?') IN (SELECT opener FROM openers)),
known_at AS (SELECT r, doc_id, line, arg_max(id, length(sentence)) AS id, max(length(sentence)) AS n, any_value(rest) AS rest
             FROM opened JOIN known ON starts_with(replace(rest, chr(10), ' '), sentence)
               AND substr(rest, length(sentence) + 1, 1) IN ('', chr(10)) GROUP BY r, doc_id, line),
spans AS (SELECT r, doc_id, line, id, len(string_split(substr(rest, 1, n), chr(10))) AS pieces FROM known_at),
found AS (SELECT r, doc_id, line, id, row_number() OVER (PARTITION BY r ORDER BY line) AS i FROM spans x
          WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.r = x.r AND o.line < x.line AND x.line < o.line + o.pieces)),
runs AS (SELECT r, doc_id, list(id ORDER BY i) AS ids FROM found GROUP BY r, doc_id),
matches AS (SELECT f.r, f.doc_id, f.line, f.i, rule, license, len(wanted) AS n FROM found f JOIN runs USING (r)
            JOIN rules ON ids[f.i : f.i + len(wanted) - 1] = wanted),
kept AS (SELECT * FROM matches m WHERE NOT EXISTS (SELECT 1 FROM matches o
         WHERE o.r = m.r AND o.rule < m.rule AND o.i < m.i + m.n AND m.i < o.i + o.n))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY r ORDER BY i, n, rule) AS INT) AS place, license, CAST(rule AS INT) AS rule,
       CAST(line AS INT) AS first_sentence, CAST(n AS INT) AS n_sentences FROM kept
"""


def _escaped(put: str) -> str:
    parts = put.replace("{", "\\").replace("}", "").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)
