import textwrap

import duckdb

from coursewright.llm import licenses
from coursewright.llm.common import documents
from tests.duck import same
from tests.llm.conftest import SF


def test_query_gives_the_rows_of_its_sql(spark):
    same(licenses.query(documents(spark, SF)), licenses.ORACLE, SF)


def test_rules_ask_for_order(spark):
    known = {"a": "first sentence", "b": "second sentence"}
    rules = [("AB", True, ["a", "b"]), ("B", False, ["b"])]
    texts = ["First  sentence! other words. SECOND, sentence", "second sentence\nfirst sentence", "first sentence 2", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan(rows, rules, known).orderBy("doc_id").collect()
    assert [(r.sentence_ids, r.licenses, r.commercial) for r in got] == [(["a", "b"], ["AB"], True), (["b", "a"], ["B"], False), ([], [], None), ([], [], None)]


def test_full_texts(spark):
    said = licenses.SENTENCES
    text = f"{said['mit-grant'].capitalize()}:\n\n{said['mit-condition']}.\n{said['mit-as-is']}."
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.licenses == ["MIT"] and row.commercial


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_wrapped_texts(spark):
    said = licenses.SENTENCES
    wrap = lambda name, end: textwrap.fill(said[name].capitalize() + end, 72)
    mit = "MIT License\n\n" + "\n\n".join([wrap("mit-grant", ":"), wrap("mit-condition", "."), wrap("mit-as-is", ".")])
    bsd = wrap("bsd-redistribute", ":") + "\n1. Source code must keep the notice.\n\n" + wrap("bsd-as-is", ".")
    lead = lambda text, mark: "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))
    whole = {"MIT": mit, "BSD": bsd, "Apache-2.0": APACHE, "GPL-3.0": GPL}
    rows = [(name, form) for name, text in whole.items() for form in (text, lead(text, "#"), lead(text, " *"), lead(text, "//"), text.replace("\n", "\r\n"))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.doc_id, r.licenses, r.commercial) for r in got] == [(name, [name], True) for name, _ in rows]
    assert {tuple(r.sentence_ids) for r in got if r.doc_id == "Apache-2.0"} == {("apache-2-header", "apache-2-copy")}


def test_one_line_notices_stay(spark):
    text = "some words\nReleased under the MIT license\nAll rights reserved\nmore"
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().sentence_ids == ["mit-notice", "reserved"]


def wrapped(names, mark=""):
    """The sentences of a licence text as they are usually set: 72 columns, a comment leader, numbered clauses."""
    said, paragraphs = licenses.SENTENCES, []
    for i, name in enumerate(names):
        number = f"{i}. " if name in ("bsd-source", "bsd-binary", "bsd-endorse") else ""
        paragraphs.append(textwrap.fill(number + said[name].capitalize() + (":" if name in ("mit-grant", "bsd-redistribute", "zlib-grant") else "."), 72))
    return "\n".join(f"{mark} {line}".rstrip() for line in "\n\n".join(paragraphs).split("\n"))


def test_every_rule_over_wrapped_texts_and_its_sql(spark):
    rows = [(4 * i + j, wrapped(ids, mark)) for i, (_, _, ids) in enumerate(licenses.RULES) for j, mark in enumerate(("", "#", " *", "//"))]
    rows += [(1000, None), (1001, ""), (1002, "See http\n\n  http://x.org/a. All rights\nreserved. Or not:\nAll rights reserved")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(docs.filter("doc_id < 1000")).collect()
    assert len(got) == 4 * len(licenses.RULES)
    for r in got:
        name, free, ids = licenses.RULES[r.doc_id // 4]
        assert (r.sentence_ids, r.licenses, r.commercial) == (ids, [name], free)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(licenses.ORACLE).fetchall()
    columns = [d[0] for d in con.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in licenses.query(docs).collect()))) == sorted(map(str, want))


def test_particular_rules_use_sentences_up(spark):
    bsd3 = ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]
    gpl2 = ["gpl-2-free", "gpl-hope", "gpl-see"]
    rows = [(1, wrapped(bsd3)), (2, wrapped([x for x in bsd3 if x != "bsd-endorse"])), (3, wrapped(gpl2)), (4, wrapped([*bsd3, *gpl2, "reserved"]))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [["BSD-3-Clause"], ["BSD-2-Clause"], ["GPL-2.0"], ["GPL-2.0", "BSD-3-Clause", "proprietary"]]
    assert [r.commercial for r in got] == [True, True, True, False]


BSD_REGENTS = """Copyright (c) 1990 The Regents of the University of California.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.  IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""
APACHE_BODY = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License.

   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      copyright license to reproduce, prepare Derivative Works of,
      publicly display, publicly perform, sublicense, and distribute the
      Work and such Derivative Works in Source or Object form."""
GPL_BODY = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc.
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  The licenses for most software and other practical works are designed
to take away your freedom to share and change the works."""
LGPL_BODY = """                   GNU LESSER GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.


  This version of the GNU Lesser General Public License incorporates
the terms and conditions of version 3 of the GNU General Public
License, supplemented by the additional permissions listed below."""
MPL_BODY = """Mozilla Public License Version 2.0
==================================

1. Definitions
--------------

1.1. "Contributor"
    means each individual or legal entity that creates, contributes to
    the creation of, or owns Covered Software."""


def test_bodies_and_holders(spark):
    lead = lambda text, mark: "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))
    alone = 'Licensed under the Apache License, Version 2.0 (the "License");'
    whole = {"BSD-3-Clause": BSD_REGENTS.split("All rights reserved.\n\n")[1], "Apache-2.0": APACHE_BODY, "GPL-3.0": GPL_BODY, "LGPL-3.0": LGPL_BODY, "MPL-2.0": MPL_BODY}
    rows = [(name, form) for name, text in whole.items() for form in (text, lead(text, "#"), lead(text, "//"))] + [("Apache-2.0", alone)]
    rows.append(("BSD-3-Clause", whole["BSD-3-Clause"].replace("THE REGENTS AND CONTRIBUTORS", "Jane Doe, Inc., AND OTHERS").replace("the University", "Jane Doe, Inc.,")))
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = licenses.scan(docs).orderBy("doc_id").collect()
    assert [(rows[r.doc_id][0], r.licenses, r.commercial) for r in got] == [(name, [name], True) for name, _ in rows]
    assert {len(r.sentence_ids) for r in got if rows[r.doc_id][0] == "BSD-3-Clause"} == {6}
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(licenses.ORACLE).fetchall()
    columns = [d[0] for d in con.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in licenses.query(docs).collect()))) == sorted(map(str, want))
