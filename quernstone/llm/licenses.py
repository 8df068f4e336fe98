"""Operator 10, licence scans by sentence rules; DataFrame functions only.

Texts are cut into sentences, sentences are normalised (lower case, letters and digits only) and mapped to the
identifiers of known licence sentences. A licence rule is an ordered sequence of identifiers, which must occur in that
order in a text's sequence. Licence texts are wrapped in lines, so sentences are taken twice, with line ends as
sentence ends and with line ends as spaces; rules are matched on both sequences and their hits united. The sequence with more
identifiers is reported (the first one if both have as many). A version mark ("v. 2.0") ends no sentence. Where a rule is the beginning of a longer
one (two clauses of three), the longer one takes its identifiers and the shorter needs others. Expressions behind SPDX-License-Identifier
add the licences that they name.

The table of sentences has a fixed size; the texts are read once and nothing is shuffled. A sentence is looked up only
if it holds one of KEYWORDS, which every known sentence does.

Cases: null text counts as empty; texts without known sentences give empty strings and zero; repeated rows give equal
rows; a text with several licences gives all of them in alphabetical order; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of

# Names that notices use for licences.
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"],
    "MIT": ["mit license", "mit licence", "mit"],
    "BSD-2-Clause": ["bsd 2 clause license", "bsd 2 clause", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "bsd 3 clause", "new bsd license", "modified bsd license"],
    "ISC": ["isc license", "isc"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2", "gnu general public license v2 0", "gnu gpl v2", "gpl v2", "gpl 2 0", "gplv2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl v3", "gpl v3", "gpl 3 0", "gplv3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgpl 2 1", "lgpl v2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl 3 0", "lgpl v3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl 3 0", "agpl v3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "CC0-1.0": ["cc0 1 0", "cc0", "creative commons zero v1 0 universal"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "Unlicense": ["unlicense"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "bsl 1 0"],
    "Zlib": ["zlib license", "zlib"],
    "0BSD": ["0bsd", "bsd zero clause license"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license 2 0", "epl 2 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic 2 0"],
    "WTFPL": ["wtfpl"],
    "BSD-4-Clause": ["bsd 4 clause license", "bsd 4 clause", "original bsd license"],
}
# Openings of notices.
OPENINGS = [
    "licensed under", "licensed under the", "released under", "released under the", "this work is licensed under", "this work is licensed under the", "this work is licensed under a",
    "this software is licensed under the", "this project is licensed under the", "this file is licensed under the", "this program is licensed under the", "distributed under the", "this software is released under the",
    "this project is released under the", "available under the", "this code is licensed under the", "content is available under", "spdx license identifier",
]
# Sentences of licence texts and headers, normalised.
SENTENCES = {
    "MIT/grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MIT/notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MIT/warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MIT/liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "ISC/grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ISC/warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "BSD/grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSD/source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSD/binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSD/endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "Apache/notice": "licensed under the apache license version 2 0 the license",
    "Apache/comply": "you may not use this file except in compliance with the license",
    "Apache/copy": "you may obtain a copy of the license at",
    "Apache/warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "Apache/see": "see the license for the specific language governing permissions and limitations under the license",
    "GPL3/grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GPL2/grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "GPL/warranty": "without any warranty",
    "GPL/implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "GPL/see": "see the gnu general public license for more details",
    "MPL/notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "BSD/advertise": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "LGPL21/grant": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "LGPL3/grant": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "LGPL/see": "see the gnu lesser general public license for more details",
    "AGPL3/grant": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "AGPL/see": "see the gnu affero general public license for more details",
    "GPL/terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "LGPL/terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "AGPL/terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "later/2": "either version 2 of the license or at your option any later version",
    "later/2.1": "either version 2 1 of the license or at your option any later version",
    "later/3": "either version 3 of the license or at your option any later version",
    "Unlicense/grant": "this is free and unencumbered software released into the public domain",
    "Boost/grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "Zlib/warranty": "this software is provided as is without any express or implied warranty",
    "Zlib/grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "0BSD/grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "EPL/notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "CC0/waive": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "rights": "all rights reserved",
}
# The same sentences as other texts cut them.
VARIANTS = {
    "this program is distributed in the hope that it will be useful but without any warranty": "GPL/warranty",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL/warranty",
} | {f"this {what} is free software {SENTENCES[k]}": k for what in ("program", "library") for k in ("GPL2/grant", "GPL3/grant", "LGPL21/grant", "LGPL3/grant", "AGPL3/grant")}
# Licence, identifiers in order.
RULES = [
    ("MIT", ["MIT/grant", "MIT/notice"]),
    ("MIT", ["MIT/grant", "MIT/warranty"]),
    ("ISC", ["ISC/grant", "ISC/warranty"]),
    ("BSD-2-Clause", ["BSD/grant", "BSD/source", "BSD/binary"]),
    ("BSD-3-Clause", ["BSD/grant", "BSD/source", "BSD/binary", "BSD/endorse"]),
    ("Apache-2.0", ["Apache/notice", "Apache/comply"]),
    ("Apache-2.0", ["Apache/warranty", "Apache/see"]),
    ("GPL-2.0", ["GPL2/grant", "GPL/see"]),
    ("GPL-3.0", ["GPL3/grant", "GPL/see"]),
    ("MPL-2.0", ["MPL/notice"]),
    ("BSD-4-Clause", ["BSD/grant", "BSD/source", "BSD/binary", "BSD/advertise"]),
    ("LGPL-2.1", ["LGPL21/grant", "LGPL/see"]),
    ("LGPL-3.0", ["LGPL3/grant", "LGPL/see"]),
    ("AGPL-3.0", ["AGPL3/grant", "AGPL/see"]),
    ("GPL-2.0", ["GPL/terms", "later/2"]),
    ("GPL-3.0", ["GPL/terms", "later/3"]),
    ("LGPL-2.1", ["LGPL/terms", "later/2.1"]),
    ("LGPL-3.0", ["LGPL/terms", "later/3"]),
    ("AGPL-3.0", ["AGPL/terms", "later/3"]),
    ("Unlicense", ["Unlicense/grant"]),
    ("BSL-1.0", ["Boost/grant"]),
    ("Zlib", ["Zlib/warranty", "Zlib/grant"]),
    ("0BSD", ["0BSD/grant"]),
    ("EPL-2.0", ["EPL/notice"]),
    ("CC0-1.0", ["CC0/waive"]),
    ("all-rights-reserved", ["rights"]),
]
KEYWORDS = ["licen", "permission", "copyright", "warrant", "rights reserved", "redistribut", "released under", "available under", "distributed under", "public domain", "advertising materials"]

#: Names of the GPL family may say whether later versions are meant.
LATER = {k: [f"{n}{x}" for n in names for x in (("", " only", " or later") if "GPL" in k else ("",))] for k, names in NAMES.items()}
KNOWN = {f"{o} {n}": f"notice/{k}" for k, names in LATER.items() for n in names for o in OPENINGS} | {s: k for k, s in SENTENCES.items()} | VARIANTS
ALL_RULES = RULES + [(k, [f"notice/{k}"]) for k in NAMES]
assert all(any(w in s for w in KEYWORDS) for s in KNOWN)
#: What a notice may say behind the licence's name.
TAIL = r" (?:see|refer to|as found in|in) (?:the )?(?:accompanying )?(?:file )?(?:licen[cs]e|copying)(?: (?:licen[cs]e|copying|md|txt|file))*(?: for (?:more |further |the )?(?:details|information|terms|full text))?$"
#: An expression of identifiers behind its tag, up to what can't belong to one; its operators and brackets.
EXPRESSION = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)"
OPERATORS = r"[() \t]+(?:(?:OR|AND|or|and)[() \t]+)?"
#: What qualifies an identifier without changing the licence.
LATER_MARK = r"(?:-only|-or-later|[+])$"
EXCEPTION = r"(?:WITH|with)[ \t]+[A-Za-z0-9.-]+"
#: A sentence ends at its mark and white space; the mark stays.
ENDS = r"([.!?;])[ \t\r\n\f]+"
#: A version mark before a number, whose point ends no sentence.
VERSION = r"\b([vV])\.[ \t\r\n]+([0-9])"
#: Where text is taken as wrapped, a colon that ends a line and an empty line end a sentence too.
GAP = r":[ \t\r]*\n|\n[ \t\r]*\n[ \t\r\n]*"


def _sentences(text: Column, wrapped: bool) -> Column:
    text = F.regexp_replace(text, VERSION, "$1 $2")
    if wrapped:
        text = F.replace(F.regexp_replace(text, GAP, "\u0001"), F.lit("\n"), F.lit(" "))
    return F.split(F.regexp_replace(text, ENDS, "$1\n"), "[\n\u0001]")


def _identifiers(text: Column, wrapped: bool) -> Column:
    table = F.create_map(*[F.lit(x) for pair in sorted(KNOWN.items()) for x in pair])
    relevant = F.filter(F.transform(_sentences(text, wrapped), F.lower), _has_keyword)
    return F.array_compact(F.transform(relevant, lambda s: F.try_element_at(table, F.regexp_replace(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), TAIL, ""))))


def _has_keyword(low: Column) -> Column:
    some = F.contains(low, F.lit(KEYWORDS[0]))
    for w in KEYWORDS[1:]:
        some = some | F.contains(low, F.lit(w))
    return some


def rule_pattern(ids: list[str]) -> str:
    """The identifiers in order, with any others between; a sequence is written as " a b c "."""
    return " " + r" (?:\S+ )*".join(re.sub(r"([./-])", r"\\\1", i) for i in ids) + " "


def longer_rules(ids: list[str]) -> list[list[str]]:
    """The rules that begin as this one does and go on: where one of them matches, this one doesn't."""
    return [other for _, other in ALL_RULES if len(other) > len(ids) and other[: len(ids)] == ids]


def whole_pattern(ids: list[str]) -> str:
    """A match of a rule from one first identifier, written as "#", to its last one with no other first identifier between; in a sequence "<a><b>"."""
    return "<#>" + "".join(r"(?:<[^#>]+>)*<" + re.sub(r"([./-])", r"\\\1", i) + ">" for i in ids[1:])


def _rule(seq: Column, ids: list[str]) -> Column:
    if not (longer := longer_rules(ids)):
        return seq.rlike(rule_pattern(ids))
    rest = F.replace(F.concat(F.lit("<"), F.replace(F.trim(seq), F.lit(" "), F.lit("><")), F.lit(">")), F.lit(f"<{ids[0]}>"), F.lit("<#>"))
    for other in longer:
        rest = F.regexp_replace(rest, whole_pattern(other), "")
    return rest.rlike(whole_pattern(ids))


def _expressions(text: Column) -> Column:
    """Licences named in SPDX expressions: identifiers between operators, exceptions and marks of later versions apart."""
    known = F.create_map(*[F.lit(x) for k in sorted([*NAMES]) for x in (k, k)])
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(EXPRESSION), F.lit(1)), lambda e: F.split(F.regexp_replace(e, EXCEPTION, ""), OPERATORS)))
    return F.array_compact(F.transform(parts, lambda i: F.try_element_at(known, F.regexp_replace(F.trim(i), LATER_MARK, ""))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids (in order, space-joined), licenses (comma-joined)."""
    docs = documents_of(docs)
    none = F.array().cast("array<string>")
    relevant = _has_keyword(F.lower("text"))
    either = lambda c: F.when(relevant, c).otherwise(none)
    rows = docs.select("doc_id", either(_identifiers(F.col("text"), False)).alias("a"), either(_identifiers(F.col("text"), True)).alias("b"), either(_expressions(F.col("text"))).alias("spdx"))
    a, b = (F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" ")) for c in ("a", "b"))
    rows = rows.select("doc_id", "spdx", F.when(F.size("b") > F.size("a"), F.col("b")).otherwise(F.col("a")).alias("ids"), a.alias("seq_a"), b.alias("seq_b"))
    hits = F.array_compact(F.array(*[F.when(_rule(F.col("seq_a"), ids) | _rule(F.col("seq_b"), ids), F.lit(k)) for k, ids in ALL_RULES]))
    of_sentences = F.when(F.size("ids") == 0, none).otherwise(hits)
    licenses = F.array_join(F.array_sort(F.array_distinct(F.concat(of_sentences, "spdx"))), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), licenses.alias("licenses"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table = "MAP {" + ", ".join(f"{q(s)}: {q(k)}" for s, k in sorted(KNOWN.items())) + "}"
    has = lambda c: "(" + " OR ".join(f"contains({c}, {q(w)})" for w in KEYWORDS) + ")"
    joined = "regexp_replace(text, '\\b([vV])\\.[ \\t\\r\\n]+([0-9])', '\\1 \\2', 'g')"
    cut = lambda t: f"string_split(replace(regexp_replace({t}, '([.!?;])[ \\t\\r\\n\\f]+', '\\1' || chr(10), 'g'), chr(1), chr(10)), chr(10))"
    wrap = f"replace(regexp_replace({joined}, ':[ \\t\\r]*\\n|\\n[ \\t\\r]*\\n[ \\t\\r\\n]*', chr(1), 'g'), chr(10), ' ')"
    ids = lambda t: f"list_filter(list_transform(list_filter(list_transform({cut(t)}, lambda s: lower(s)), lambda s: {has('s')}), lambda s: known[regexp_replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), {q(TAIL)}, '')]), lambda x: x IS NOT NULL)"

    def rule(seq: str, ids: list[str]) -> str:
        if not (longer := longer_rules(ids)):
            return f"regexp_matches({seq}, {q(rule_pattern(ids))})"
        rest = f"replace('<' || replace(trim({seq}), ' ', '><') || '>', {q(f'<{ids[0]}>')}, '<#>')"
        for other in longer:
            rest = f"regexp_replace({rest}, {q(whole_pattern(other))}, '', 'g')"
        return f"regexp_matches({rest}, {q(whole_pattern(ids))})"

    names = "MAP {" + ", ".join(f"{q(k)}: {q(k)}" for k in sorted(NAMES)) + "}"
    spdx = f"list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, {q(EXPRESSION)}, 1), lambda e: string_split_regex(regexp_replace(e, {q(EXCEPTION)}, '', 'g'), {q(OPERATORS)}))), lambda i: names[regexp_replace(trim(i), {q(LATER_MARK)}, '')]), lambda x: x IS NOT NULL)"
    rules = ", ".join(f"CASE WHEN {rule('seq_a', r)} OR {rule('seq_b', r)} THEN {q(k)} END" for k, r in ALL_RULES)
    written = lambda c: f"' ' || array_to_string({c}, ' ') || ' '"
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {table} AS known, {names} AS names FROM documents),
    s AS (SELECT doc_id, {ids(joined)} AS a, {ids(wrap)} AS b, {spdx} AS spdx FROM t WHERE {has('lower(text)')}),
    c AS (SELECT doc_id, a, b, spdx FROM s UNION ALL SELECT doc_id, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM t WHERE NOT {has('lower(text)')}),
    j AS (SELECT doc_id, spdx, CASE WHEN len(b) > len(a) THEN b ELSE a END AS ids, {written('a')} AS seq_a, {written('b')} AS seq_b FROM c)
    SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ' ') AS sentence_ids,
      array_to_string(list_sort(list_distinct(list_concat(CASE WHEN len(ids) = 0 THEN [] ELSE list_filter([{rules}], lambda x: x IS NOT NULL) END, spdx))), ',') AS licenses
    FROM j"""
