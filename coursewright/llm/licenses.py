"""Licence scans by sentence rules, with DataFrame operations only.

A text is cut into sentences, which may be wrapped over lines with comment leaders; each is
normalised (lower case, runs of anything but ASCII letters and digits become one blank, whoever
holds the rights becomes the holder of the standard text) and
looked up among known licence sentences. Where it is none, each of its lines is looked up, so
that one-line notices are found. The identifiers found, in order, are matched against ordered
rules: a rule holds where its identifiers follow one another among those found. Rules are tried in
order, the more particular first, and a rule that holds uses its identifiers up, so that the
sentences of one licence text don't tell another that shares some of them. Everything is a
projection of the row itself: no shuffle, and a text of any length stays in its row.

Defined results: a null or empty text has no sentence and no licence. A sentence that several
licences share is one identifier. Licences are told once, in the order of the rules. A very long
text is cut and looked up as a whole. Rows that repeat give rows that repeat; no rows give no
rows. Other columns of the input are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of well-known licence texts and notices.
SENTENCES = {
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-spdx": "spdx license identifier mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "x11-name": "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium",
    "apache-2-notice": "licensed under the apache license version 2 0",
    "apache-2-defined": "licensed under the apache license version 2 0 the license",
    "apache-2-title": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache-2-title-alone": "apache license version 2 0 january 2004",
    "apache-2-terms": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "apache-2-licensor": "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
    "apache-2-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "apache-2-spdx": "spdx license identifier apache 2 0",
    "apache-2-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-2-use": "you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-2-copy-https": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "apache-2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-2-spdx": "spdx license identifier gpl 2 0 only",
    "gpl-2-later-spdx": "spdx license identifier gpl 2 0 or later",
    "gpl-3-spdx": "spdx license identifier gpl 3 0 only",
    "gpl-3-later-spdx": "spdx license identifier gpl 3 0 or later",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-2-only-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl-3-only-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "gpl-title-2": "gnu general public license version 2 june 1991",
    "gpl-title-3": "gnu general public license version 3 29 june 2007",
    "gpl-verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl-price": "when we speak of free software we are referring to freedom not price",
    "gpl-2-preamble": "the licenses for most software are designed to take away your freedom to share and change it",
    "gpl-3-preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl-3-practical": "the licenses for most software and other practical works are designed to take away your freedom to share and change the works",
    "agpl-preamble": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "agpl-title": "gnu affero general public license version 3 19 november 2007",
    "lgpl-title-21": "gnu lesser general public license version 2 1 february 1999",
    "lgpl-title-3": "gnu lesser general public license version 3 29 june 2007",
    "lgpl-21-applies": "this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it",
    "lgpl-3-incorporates": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "lgpl-21-spdx": "spdx license identifier lgpl 2 1 or later",
    "lgpl-3-spdx": "spdx license identifier lgpl 3 0 or later",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "agpl-spdx": "spdx license identifier agpl 3 0 or later",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-copy-https": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-title": "mozilla public license version 2 0",
    "mpl-contributor": "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
    "mpl-covered": "covered software means source code form to which the initial contributor has attached the notice in exhibit a the executable form of such source code form and modifications of such source code form in each case including portions thereof",
    "mpl-spdx": "spdx license identifier mpl 2 0",
    "epl-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-spdx": "spdx license identifier epl 2 0",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-old": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-2-spdx": "spdx license identifier bsd 2 clause",
    "bsd-3-spdx": "spdx license identifier bsd 3 clause",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-0-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-spdx": "spdx license identifier isc",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost-notice": "distributed under the boost software license version 1 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "unlicense-spdx": "spdx license identifier unlicense",
    "wtfpl-title": "do what the fuck you want to public license",
    "wtfpl-do": "you just do what the fuck you want to",
    "cc0-waived": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc0-title": "cc0 1 0 universal",
    "cc0-spdx": "spdx license identifier cc0 1 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa-work": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-nd-work": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "ofl-notice": "this font software is licensed under the sil open font license version 1 1",
    "eupl-notice": "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl",
    "artistic-spdx": "spdx license identifier artistic 2 0",
    "public-domain": "this work is in the public domain",
    "reserved": "all rights reserved",
}

#: Ordered rules, the more particular first: licence, whether it allows commercial use, and the sentences that must follow one another.
RULES = [
    ("X11", True, ["mit-grant", "mit-condition", "mit-as-is", "mit-liability", "x11-name"]),
    ("MIT", True, ["mit-grant", "mit-condition", "mit-as-is", "mit-liability"]),
    ("MIT", True, ["mit-grant", "mit-condition", "mit-as-is"]),
    ("MIT", True, ["mit-grant", "mit-condition"]),
    ("MIT", True, ["mit-condition", "mit-as-is"]),
    *[("MIT", True, [x]) for x in ("mit-title", "mit-title-short", "mit-notice", "mit-licensed", "mit-spdx")],
    *[("Apache-2.0", True, [x, y, "apache-2-as-is", "apache-2-see"]) for x in ("apache-2-header", "apache-2-use") for y in ("apache-2-copy", "apache-2-copy-https")],
    *[("Apache-2.0", True, [x, y]) for x in ("apache-2-header", "apache-2-use") for y in ("apache-2-copy", "apache-2-copy-https")],
    *[("Apache-2.0", True, [x]) for x in ("apache-2-header", "apache-2-notice", "apache-2-spdx", "apache-2-defined")],
    ("Apache-2.0", True, ["apache-2-terms", "apache-2-licensor"]),
    *[("Apache-2.0", True, [x]) for x in ("apache-2-title", "apache-2-title-alone", "apache-2-terms", "apache-2-grant")],
    ("AGPL-3.0", True, ["agpl-free", "gpl-hope", "agpl-see"]),
    ("AGPL-3.0", True, ["agpl-free"]),
    ("AGPL-3.0", True, ["agpl-spdx"]),
    ("AGPL-3.0", True, ["agpl-title", "gpl-verbatim"]),
    *[("AGPL-3.0", True, [x]) for x in ("agpl-title", "agpl-preamble")],
    ("LGPL-2.1", True, ["lgpl-title-21", "gpl-verbatim"]),
    ("LGPL-3.0", True, ["lgpl-title-3", "gpl-verbatim", "lgpl-3-incorporates"]),
    *[("LGPL-2.1", True, [x]) for x in ("lgpl-title-21", "lgpl-21-applies")],
    *[("LGPL-3.0", True, [x]) for x in ("lgpl-title-3", "lgpl-3-incorporates")],
    ("GPL-3.0", True, ["gpl-title-3", "gpl-verbatim", "gpl-3-preamble", "gpl-3-practical"]),
    ("GPL-3.0", True, ["gpl-title-3", "gpl-verbatim"]),
    ("GPL-2.0", True, ["gpl-title-2", "gpl-verbatim", "gpl-2-preamble"]),
    ("GPL-2.0", True, ["gpl-title-2", "gpl-verbatim"]),
    ("LGPL-3.0", True, ["lgpl-3-free", "lgpl-hope"]),
    ("LGPL-2.1", True, ["lgpl-free", "lgpl-hope"]),
    ("LGPL-3.0", True, ["lgpl-3-spdx"]),
    ("LGPL-2.1", True, ["lgpl-21-spdx"]),
    *[(name, True, [x, "gpl-hope", "gpl-see", "gpl-received"]) for name, x in (("GPL-3.0", "gpl-free"), ("GPL-3.0", "gpl-3-only-free"), ("GPL-2.0", "gpl-2-free"), ("GPL-2.0", "gpl-2-only-free"))],
    *[(name, True, [x, "gpl-hope"]) for name, x in (("GPL-3.0", "gpl-free"), ("GPL-3.0", "gpl-3-only-free"), ("GPL-2.0", "gpl-2-free"), ("GPL-2.0", "gpl-2-only-free"))],
    *[("GPL-3.0", True, [x]) for x in ("gpl-3-notice", "gpl-3-spdx", "gpl-3-later-spdx", "gpl-title-3", "gpl-3-preamble", "gpl-3-practical")],
    *[("GPL-2.0", True, [x]) for x in ("gpl-2-spdx", "gpl-2-later-spdx", "gpl-title-2", "gpl-2-preamble")],
    ("MPL-2.0", True, ["mpl-form", "mpl-copy"]),
    ("MPL-2.0", True, ["mpl-form", "mpl-copy-https"]),
    ("MPL-2.0", True, ["mpl-form"]),
    ("MPL-2.0", True, ["mpl-spdx"]),
    *[("MPL-2.0", True, [x]) for x in ("mpl-title", "mpl-contributor", "mpl-covered")],
    ("EPL-2.0", True, ["epl-terms"]),
    ("EPL-2.0", True, ["epl-spdx"]),
    *[("BSD-4-Clause", True, ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertising", x, "bsd-as-is"]) for x in ("bsd-endorse", "bsd-endorse-old")],
    *[("BSD-3-Clause", True, ["bsd-redistribute", "bsd-source", "bsd-binary", x, "bsd-as-is"]) for x in ("bsd-endorse", "bsd-endorse-old")],
    ("BSD-2-Clause", True, ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-3-Clause", True, ["bsd-3-spdx"]),
    ("BSD-2-Clause", True, ["bsd-2-spdx"]),
    ("BSD", True, ["bsd-redistribute", "bsd-as-is"]),
    ("BSD", True, ["bsd-redistribute", "bsd-source"]),
    ("ISC", True, ["isc-grant", "isc-as-is"]),
    ("ISC", True, ["isc-grant-and", "isc-as-is"]),
    ("0BSD", True, ["bsd-0-grant", "isc-as-is"]),
    ("ISC", True, ["isc-spdx"]),
    ("Zlib", True, ["zlib-as-is", "zlib-liability", "zlib-grant"]),
    ("BSL-1.0", True, ["boost-grant"]),
    ("BSL-1.0", True, ["boost-notice"]),
    ("Unlicense", True, ["unlicense-free", "unlicense-anyone"]),
    ("Unlicense", True, ["unlicense-free"]),
    ("Unlicense", True, ["unlicense-spdx"]),
    ("WTFPL", True, ["wtfpl-title", "wtfpl-do"]),
    ("WTFPL", True, ["wtfpl-title"]),
    *[("CC0-1.0", True, [x]) for x in ("cc0-waived", "cc0-title", "cc0-spdx")],
    *[("CC-BY-4.0", True, [x]) for x in ("cc-by-notice", "cc-by-work")],
    *[("CC-BY-SA-4.0", True, [x]) for x in ("cc-by-sa-notice", "cc-by-sa-work")],
    *[("CC-BY-NC-4.0", False, [x]) for x in ("cc-by-nc-notice", "cc-by-nc-work")],
    ("CC-BY-ND-4.0", True, ["cc-by-nd-work"]),
    ("CC-BY-NC-SA-4.0", False, ["cc-by-nc-sa-work"]),
    ("CC-BY-NC-ND-4.0", False, ["cc-by-nc-nd-work"]),
    ("OFL-1.1", True, ["ofl-notice"]),
    ("EUPL-1.2", True, ["eupl-notice"]),
    ("Artistic-2.0", True, ["artistic-spdx"]),
    ("public-domain", True, ["public-domain"]),
    ("proprietary", False, ["reserved"]),
]

#: A line without words: blanks and a comment leader.
EMPTY = r"[^\S\n]*[#*/;%-]*[^\S\n]*\n"
#: A sentence ends with an empty line, a colon that ends a line, or . ! ? before a blank or the end.
BREAK = rf"\n(?:{EMPTY})+|:[^\S\n]*\n|[.!?]+(?:\s+|\z)"
#: An empty line before an address does not end a sentence; nor does the number of a clause, which is no part of one.
BEFORE_URL = rf"\n(?:{EMPTY})+([^\S\n]*[#*/;%-]*[^\S\n]*https?://)"
CLAUSE = r"(\n[^\S\n]*[#*/;%-]*[^\S\n]*)(?:[0-9]\.|\([0-9a-z]\)|[0-9]\))[^\S\n]+"
OTHER = "[^a-z0-9]+"
#: Where a normalised sentence names who holds the rights, and what stands there in SENTENCES.
HOLDERS = [
    ("^(this software is provided by) [a-z0-9 ]{1,200} (as is and any express)", r"$1 the copyright holders and contributors $2"),
    ("^(in no event shall) [a-z0-9 ]{1,200} (be liable for any direct indirect)", r"$1 the copyright holder or contributors $2"),
    ("^(neither the names? of) [a-z0-9 ]{1,200} (may be used to endorse or promote products derived from)", r"neither the name of the copyright holder nor the names of its contributors $2"),
    ("^the names? of [a-z0-9 ]{1,200} (may not be used to endorse or promote products derived from)", r"the name of the author $1"),
    ("^(except as contained in this notice the names?) of [a-z0-9 ]{1,200} (shall not be used in advertising or otherwise) (to promote the sale use or other dealings in this software without prior written authorization) from [a-z0-9 ]{1,200}$", "except as contained in this notice the name of the x consortium $2 $3 from the x consortium"),
]


def normal(sentence: Column) -> Column:
    said = F.btrim(F.regexp_replace(F.lower(sentence), OTHER, " "))
    for pattern, instead in HOLDERS:
        said = F.regexp_replace(said, pattern, instead)
    return said


def sentence_ids(text: Column, known: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    names = {sentence: name for name, sentence in known.items()}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), BEFORE_URL, "\n$1"), CLAUSE, "$1")
    is_known = lambda s: s.isin(list(names))
    lines = lambda part: F.filter(F.transform(F.split(part, "\n"), normal), is_known)
    found = lambda part: F.when(is_known(normal(part)), F.array(normal(part))).otherwise(lines(part))
    return F.transform(F.flatten(F.transform(F.split(plain, BREAK), found)), lambda s: F.element_at(lookup, s))


HITS = "array<struct<name string, free boolean>>"


def rules_held(ids: Column, rules) -> Column:
    """(name, free) of the rules that hold over identifiers, in order; what a rule has used is no other's."""
    every = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(free).alias("free"), F.lit(f",{','.join(some)},").alias("ids")) for name, free, some in rules])
    start = F.struct(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")).alias("trail"), F.array().cast(HITS).alias("hits"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.concat(state["hits"], F.array(F.struct(rule["name"].alias("name"), rule["free"].alias("free"))))
        used = F.struct(F.replace(state["trail"], rule["ids"], F.lit(",,")).alias("trail"), hit.alias("hits"))
        return F.when(state["trail"].contains(rule["ids"]), used).otherwise(state)

    return F.when(F.size(ids) == 0, F.array().cast(HITS)).otherwise(F.aggregate(every, start, step)["hits"])


def scan(docs: DataFrame, rules=RULES, known: dict[str, str] = SENTENCES) -> DataFrame:
    """doc_id, sentence_ids (array, in order), licenses (array, in the order of the rules), commercial (null without a licence)."""
    return (
        docs.select("doc_id", sentence_ids(F.col("text"), known).alias("sentence_ids"))
        .withColumn("hits", rules_held(F.col("sentence_ids"), rules))
        .select(
            "doc_id",
            "sentence_ids",
            F.array_distinct(F.transform("hits", lambda h: h["name"])).alias("licenses"),
            F.when(F.size("hits") > 0, F.forall("hits", lambda h: h["free"])).alias("commercial"),
        )
    )


def query(docs: DataFrame) -> DataFrame:
    return scan(docs).select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        "commercial",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
    )


def _oracle() -> str:
    known = ", ".join(f"('{name}', '{sentence}')" for name, sentence in SENTENCES.items())

    def normal(x: str) -> str:
        said = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
        for pattern, instead in HOLDERS:
            said = f"regexp_replace({said}, '{pattern}', '{instead.replace('$', chr(92))}')"
        return said

    steps = "SELECT doc_id, ids, k, ',' || ids || ',' AS t0 FROM g"
    for i, (_, _, ids) in enumerate(RULES):
        seq = f",{','.join(ids)},"
        steps = f"SELECT * EXCLUDE t{i}, contains(t{i}, '{seq}') AS h{i}, replace(t{i}, '{seq}', ',,') AS t{i + 1} FROM ({steps})"
    any_of = lambda wanted: " OR ".join(f"h{i}" for i, rule in enumerate(RULES) if wanted(rule)) or "false"
    names = dict.fromkeys(name for name, _, _ in RULES)
    first = {name: [f"CASE WHEN h{i} THEN {i} END" for i, rule in enumerate(RULES) if rule[0] == name] for name in names}
    told = ", ".join(f"{{'place': least({', '.join(first[name])}), 'name': '{name}'}}" for name in names)
    return f"""
WITH known(id, sentence) AS (VALUES {known}),
p AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part
  FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '{BEFORE_URL}', E'\\n\\\\1', 'g'), '{CLAUSE}', '\\1', 'g'), '{BREAK}') AS parts FROM documents)),
w AS (SELECT doc_id, i, part, {normal('part')} AS sentence FROM p),
s AS (
  SELECT doc_id, i, 0 AS j, sentence FROM w SEMI JOIN known USING (sentence)
  UNION ALL SELECT doc_id, i, generate_subscripts(lines, 1) AS j, unnest(lines) AS sentence
  FROM (SELECT doc_id, i, list_transform(string_split(part, chr(10)), lambda x: {normal('x')}) AS lines FROM w ANTI JOIN known USING (sentence))),
f AS (SELECT doc_id, string_agg(id, ',' ORDER BY i, j) AS ids, count(*) AS k FROM s JOIN known USING (sentence) GROUP BY doc_id),
g AS (SELECT d.doc_id, coalesce(ids, '') AS ids, coalesce(k, 0)::BIGINT AS k FROM documents d LEFT JOIN f USING (doc_id)),
r AS ({steps})
SELECT doc_id, ids AS sentence_ids, array_to_string(list_transform(list_sort(list_filter([{told}], lambda x: x.place IS NOT NULL)), lambda x: x.name), ',') AS licenses,
  CASE WHEN {any_of(lambda rule: True)} THEN NOT ({any_of(lambda rule: not rule[1])}) END AS commercial, k AS n_sentences
FROM r
"""


ORACLE = _oracle()
