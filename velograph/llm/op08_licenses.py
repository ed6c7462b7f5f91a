"""License scans: sentences to identifiers, identifier sequences to licences.

A text is cut at line ends and after sentence marks; a sentence is normalised to its letters and digits, A-Z in
lower case, one space between words. n_sentences counts these. Known licence sentences have identifiers; the
others drop out. A known sentence is found between any two cuts, wrapped over lines too, with or without comment
marks before each; but not over a line without a word, nor over a sentence mark that it doesn't have itself.
Of known sentences that begin at one cut the longest counts. Ordered
rules then rewrite the sequence: where a rule's identifiers stand side by side, its licence takes their
place, whole texts before single notices. What no rule takes is reported as unmatched.

All in DataFrame functions, row by row, with no shuffle: known sentences are one constant pattern, a tree of
their words tried at cuts only, so a row
costs as much as its text is long. Null and empty texts have no sentences and no licences. A text of
any length is one row; licences are listed once, in order of their first place. Repeated rows come back each. Of rules that
fit the one that stands first takes its identifiers. Bytes beyond ASCII, UTF-8 or not, part words. An empty table gives none.
Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm import common

#: Sentences of public licences and of common notices, by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "mit-asis": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",),
    "mit-liability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
    "mit-short": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "MIT License", "The MIT License"),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "isc-short": ("Released under the ISC License", "Licensed under the ISC License"),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-names": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd-2-short": ("Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License"),
    "bsd-3-short": ("Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License"),
    "apache-short": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Released under the Apache License, Version 2.0"),
    "apache-comply": ("you may not use this file except in compliance with the License",),
    "apache-copy": ("You may obtain a copy of the License at",),
    "gpl-3-short": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"),
    "gpl-2-short": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"),
    "gpl-grant-3": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl-grant-2": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",),
    "gpl-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",),
    "lgpl-short": ("Licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    "agpl-short": ("Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"),
    "mpl-short": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "public-domain": ("This work is in the public domain", "Released into the public domain"),
    "cc0": ("Licensed under CC0 1.0", "This work is licensed under CC0 1.0"),
    "reserved": ("All rights reserved",),
    "apache-title": ("Apache License Version 2.0, January 2004",),
    "apache-terms": ("TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",),
    "gpl-3-title": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "gpl-2-title": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "lgpl-3-title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "lgpl-2.1-title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "agpl-3-title": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "gnu-verbatim": ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",),
    "terms-end": ("END OF TERMS AND CONDITIONS",),
    "lgpl-grant-3": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "lgpl-grant-2.1": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",),
    "agpl-grant-3": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "mpl-title": ("Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"),
    "bsl-title": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "epl-title": ("Eclipse Public License - v 2.0",),
    "zlib-asis": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
}
SENTENCES |= {
    f"cc-{kind}-{version}": (f"Licensed under CC {kind.upper()} {version}", f"This work is licensed under CC {kind.upper()} {version}", f"Released under CC {kind.upper()} {version}")
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
    for version in ("3.0", "4.0")
}

#: In order; the first that fits takes its identifiers.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-short", "mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-title", "apache-terms", "terms-end", "apache-short", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-title", "apache-terms", "terms-end")),
    ("Apache-2.0", ("apache-short", "apache-comply", "apache-copy")),
    ("GPL-3.0-only", ("gpl-3-title", "gnu-verbatim", "terms-end", "gpl-grant-3", "gpl-hope")),
    ("GPL-3.0-only", ("gpl-3-title", "gnu-verbatim", "terms-end")),
    ("GPL-2.0-only", ("gpl-2-title", "gnu-verbatim", "terms-end", "gpl-grant-2", "gpl-hope")),
    ("GPL-2.0-only", ("gpl-2-title", "gnu-verbatim", "terms-end")),
    ("AGPL-3.0-only", ("agpl-3-title", "gnu-verbatim", "terms-end", "agpl-grant-3", "gpl-hope")),
    ("LGPL-2.1-only", ("lgpl-2.1-title", "gnu-verbatim", "terms-end", "lgpl-grant-2.1", "gpl-hope")),
    ("LGPL-3.0-only", ("lgpl-3-title", "gnu-verbatim")),
    ("GPL-3.0-only", ("gpl-3-title", "gnu-verbatim")),
    ("GPL-2.0-only", ("gpl-2-title", "gnu-verbatim")),
    ("AGPL-3.0-only", ("agpl-3-title", "gnu-verbatim")),
    ("LGPL-2.1-only", ("lgpl-2.1-title", "gnu-verbatim")),
    ("LGPL-3.0-or-later", ("lgpl-grant-3", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl-grant-2.1", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl-grant-3", "gpl-hope")),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("GPL-3.0-or-later", ("gpl-grant-3", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-grant-2", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-grant-3",)),
    ("GPL-2.0-or-later", ("gpl-grant-2",)),
    ("LGPL-3.0-or-later", ("lgpl-grant-3",)),
    ("LGPL-2.1-or-later", ("lgpl-grant-2.1",)),
    ("AGPL-3.0-or-later", ("agpl-grant-3",)),
    ("Apache-2.0", ("apache-title",)),
    ("GPL-3.0-only", ("gpl-3-title",)),
    ("GPL-2.0-only", ("gpl-2-title",)),
    ("LGPL-3.0-only", ("lgpl-3-title",)),
    ("LGPL-2.1-only", ("lgpl-2.1-title",)),
    ("AGPL-3.0-only", ("agpl-3-title",)),
    ("MPL-2.0", ("mpl-title", "mpl-short")),
    ("MPL-2.0", ("mpl-title",)),
    ("BSL-1.0", ("bsl-title",)),
    ("EPL-2.0", ("epl-title",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-short",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-short",)),
    ("BSD-2-Clause", ("bsd-2-short",)),
    ("BSD-3-Clause", ("bsd-3-short",)),
    ("Apache-2.0", ("apache-short",)),
    ("GPL-3.0-only", ("gpl-3-short",)),
    ("GPL-2.0-only", ("gpl-2-short",)),
    ("LGPL-3.0-only", ("lgpl-short",)),
    ("AGPL-3.0-only", ("agpl-short",)),
    ("MPL-2.0", ("mpl-short",)),
    ("Unlicense", ("unlicense",)),
    ("Public-Domain", ("public-domain",)),
    ("CC0-1.0", ("cc0",)),
    *((f"CC-{k[3:].upper()}", (k,)) for k in SENTENCES if k.startswith("cc-")),
    ("All-Rights-Reserved", ("reserved",)),
)
_CUT, _ODD = r"[.!?;:]+(?:[ \t\r\n\f\x0B]|\z)", "[^a-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: str) -> str:
    return re.sub(_ODD, " ", "".join(c.lower() if c in _UPPER else c for c in sentence)).strip()


KNOWN = {normalised(s): k for k, ss in SENTENCES.items() for s in ss}


#: In a text as `_marked` gives it, a word is of a-z and 0-9; S is a sentence mark, L a line end. All between
#: is one gap, taken whole: the next thing is none of it, so there is nothing to go back for.
_SOME, _ANY_GAP = "[^a-z0-9SL]++", "[^a-z0-9SL]*+"
_GAP, _END = f"(?:{_SOME}L?{_ANY_GAP}|L{_ANY_GAP})", f"(?={_ANY_GAP}(?:[SL]|$))"
_NAME_GAP = f"(?:{_SOME}S?{_ANY_GAP}L?{_ANY_GAP}|[SL]{_ANY_GAP}L?{_ANY_GAP})"
#: Sentences with a name of one to 20 words at *, in which "Inc." and the like may stand; as pieces.
NAMED: dict[str, tuple[str, ...]] = {
    "bsd-names": (
        "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of * nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of * nor the names of other contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission",
        "The name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
        "The names of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    )
}
_ANY = f"[a-z0-9]+(?:{_NAME_GAP}[a-z0-9]+){{0,19}}?"


def _steps(sentence: str) -> list[str]:
    """A pattern for each word, with the gap before it; a gap has a sentence mark where the sentence has one."""
    low = "".join(c.lower() if c in _UPPER else c for c in sentence)
    marked = re.findall(r"[a-z0-9*]+|S", re.sub(r"[.!?;:]+(?=[ ])", "S", low))
    out, gap = [], ""
    for w in marked:
        if w == "S":
            gap = f"{_ANY_GAP}S{_ANY_GAP}L?{_ANY_GAP}"
            continue
        out.append(gap + (_ANY if w == "*" else w))
        gap = _NAME_GAP if w == "*" else _GAP
    return out


def _tree(ways: list[list[str]]) -> str:
    """A pattern of any of the ways, the longest first."""
    heads: dict[str, list[list[str]]] = {}
    for way in ways:
        if way:
            heads.setdefault(way[0], []).append(way[1:])
    inner = "|".join(head + _tree(rest) for head, rest in heads.items())
    if not inner:
        return ""
    return f"(?:{inner})?" if [] in ways else inner if len(heads) == 1 else f"(?:{inner})"


_KNOWN_PATTERN = f"[SL]{_ANY_GAP}({_tree([_steps(x) for xs in [*SENTENCES.values(), *NAMED.values()] for x in xs])}){_END}"


def _cut(text: Column) -> Column:
    """The text with A-Z in lower case, S for sentence marks and L for line ends."""
    # lower() makes ASCII letters of these two alone besides A-Z; to the rules they are no letters.
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("-")), F.lit("\u0130"), F.lit("-"))
    low = F.concat(F.lit("L"), F.replace(F.lower(plain), F.lit("\n"), F.lit("L")))
    return F.regexp_replace(low, r"[.!?;:]+(?=[ \t\r\f\x0BL]|\z)", "S")


def _marked(cut: Column) -> Column:
    """The same, with a mark in place of what numbers a line."""
    return F.regexp_replace(cut, r"(L[^a-z0-9SL]*)\(?[0-9a-z]{1,2}\)(?=[ \t])", "$1S")


def _known(cut: Column) -> Column:
    """The known sentences of a text, normalised, in order."""
    return F.transform(F.regexp_extract_all(_marked(cut), F.lit(_KNOWN_PATTERN), F.lit(1)), lambda s: F.regexp_replace(s, "[^a-z0-9]+", " "))


def _named(sentence: Column) -> Column:
    out = F.lit(None).cast("string")
    # What a pattern of NAMED takes has no other name.
    for k, ss in NAMED.items():
        for x in ss:
            out = F.when(sentence.startswith(normalised(x.split("*")[0]) + " "), k).otherwise(out)
    for s, k in KNOWN.items():
        out = F.when(sentence == s, k).otherwise(out)
    return out


def _scanned(cut: Column) -> dict[str, Column]:
    # A sentence has a letter or digit, and ends at a mark or line end.
    ids = F.transform(_known(cut), _named)
    return {"n_sentences": F.regexp_count(cut, F.lit("[a-z0-9][^SL]*")).cast("bigint"), "sentence_ids": F.array_join(ids, " ")}


def scan(text: Column) -> dict[str, Column]:
    """Columns: n_sentences, sentence_ids. sentence_ids is of the known ones."""
    return _scanned(_cut(text))


def matched(sentence_ids: Column) -> tuple[Column, Column]:
    """Licences, comma-joined, each once; and the number of identifiers that no rule takes."""
    # Each identifier stands between two spaces of its own, so neighbours match side by side.
    seq = F.concat(F.lit(" "), F.replace(sentence_ids, F.lit(" "), F.lit("  ")), F.lit(" "))
    for name, ids in RULES:
        seq = F.replace(seq, F.lit(" " + "  ".join(ids) + " "), F.lit(f" ={name} "))
    items = F.filter(F.split(seq, " "), lambda x: x != "")
    names = F.array_distinct(F.transform(F.filter(items, lambda x: x.startswith("=")), lambda x: F.substring(x, 2, 100)))
    return F.array_join(names, ","), F.size(F.filter(items, lambda x: ~x.startswith("="))).cast("bigint")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    # Cut once for both columns: what is used twice isn't put into its uses.
    found = docs.select("doc_id", _cut(F.col("text")).alias("cut")).select("doc_id", *[c.alias(k) for k, c in _scanned(F.col("cut")).items()])
    names, rest = matched(F.col("sentence_ids"))
    return found.select("doc_id", "n_sentences", "sentence_ids", names.alias("licenses"), rest.alias("n_unmatched"))


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {q(s)} THEN {q(k)}" for s, k in KNOWN.items())
    seq = "' ' || replace(sentence_ids, ' ', '  ') || ' '"
    for name, ids in RULES:
        seq = f"replace({seq}, {q(' ' + '  '.join(ids) + ' ')}, {q(f' ={name} ')})"
    return f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(translate(coalesce(text, ''), {q(_UPPER)}, {q(_LOWER)}), {q(_CUT)}, chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, {q(_ODD)}, ' ', 'g'))), lambda x: x <> '') AS ss FROM documents),
k AS (SELECT doc_id, len(ss)::BIGINT AS n_sentences, coalesce(array_to_string(list_filter(list_transform(ss, lambda x: CASE x {cases} END), lambda x: x IS NOT NULL), ' '), '') AS sentence_ids FROM s),
m AS (SELECT *, list_filter(string_split({seq}, ' '), lambda x: x <> '') AS items FROM k),
n AS (SELECT *, list_transform(list_filter(items, lambda x: x[1] = '='), lambda x: x[2:]) AS names FROM m)
SELECT doc_id, n_sentences, sentence_ids, coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ','), '') AS licenses, (len(items) - len(names))::BIGINT AS n_unmatched FROM n
"""


ORACLE_SQL = _oracle()
