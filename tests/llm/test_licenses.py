"""Licence notices as they are published: wrapped, with capitals, marks and blank lines, and in comments."""

from fairstream.llm import licenses

GPL = """This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{comma} either version {n} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details."""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
BOOST = """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at
http://www.boost.org/LICENSE_1_0.txt)"""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty."""
UNLICENSE = """This is free and unencumbered software released into the public
domain."""
NOTICES = [
    ("GPL-3.0-or-later", 3, GPL.format(mark=":", comma=",", n=3)), ("GPL-2.0-or-later", 3, GPL.format(mark=";", comma=";", n=2)),
    ("MPL-2.0", 1, MPL), ("Apache-2.0", 5, APACHE), ("MIT", 3, MIT), ("LGPL-2.1-or-later", 3, LGPL), ("AGPL-3.0-or-later", 3, AGPL),
    ("EPL-2.0", 1, EPL), ("Zlib", 3, ZLIB), ("BSL-1.0", 1, BOOST), ("CC0-1.0", 2, CC0), ("Unlicense", 1, UNLICENSE),
    ("MIT", 1, "SPDX-License-Identifier: MIT"), ("AGPL-3.0-or-later", 1, "SPDX-License-Identifier: AGPL-3.0-or-later"),
]


def _shapes(notice):
    """As published, a paragraph a line, all in one line, one word a line, in comments, with other line ends."""
    lines, words = notice.split("\n"), notice.split()
    yield notice
    yield "\n\n".join(" ".join(p.split()) for p in notice.split("\n\n"))
    yield " ".join(words)
    yield "\n".join(words)
    yield "\n".join(f"# {x}".rstrip() for x in lines)
    yield "\n".join(f"// {x}".rstrip() for x in words)
    yield "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */"
    yield "\r\n".join(lines)


def _rows():
    rows, wanted = [], {}
    for name, n, notice in NOTICES:
        for shape in _shapes(notice):
            wanted[len(rows)] = [(name, n)]
            rows.append((len(rows), f"Copyright (C) 2020 Someone\n\n{shape}\n\nint main;"))
    return rows, wanted


def test_published_notices(spark):
    rows, wanted = _rows()
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {i: [(r.license, r.n_sentences) for r in found if r.doc_id == i] for i in wanted} == wanted


def test_sql_agrees_on_wrapped_notices(spark):
    import duckdb
    import pyarrow as pa

    rows, _ = _rows()
    several = "\n\n".join(text for _, text in rows[:20:3])
    rows += [(900, several), (901, several * 2), (902, "This project\nis Licensed under the MIT License.\n(MIT)"), (903, None), (904, "")]
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    con = duckdb.connect()
    con.register("notices", table)
    expected = sorted(con.execute(licenses.scan_sql("notices")).fetchall())
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in found.collect()) == expected and len(expected) > len(rows)


def test_what_is_no_statement(spark):
    """Words of a notice inside other sentences, or a notice that breaks off, say nothing."""
    texts = ["He said it was licensed under the MIT License yesterday.", "Licensed under the", "This is free and unencumbered software released into the public domain of maps."]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert found.collect() == []
