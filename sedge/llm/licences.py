"""Licence scans by sentence rules.

Sentences are normalised and looked up among known licence sentences; the sequence
of their identifiers, in the order of the text, is matched against ordered rules.
A text is cut at stops and line ends, and again in the layout of licence texts: at stops,
blank lines and the ends of lines that hold a copyright or end in a URL, while other line
ends join. Either sequence may satisfy a rule. A known sentence that holds stops is found by all
its parts in a row. The most specific rule wins: a licence is left out where a rule of another one
that holds its sentences and more is met, and the reservation of all rights where any licence is.

A text without any of the words that all known sentences share one of holds none of them,
and is not cut.

Defined results: a null text counts as empty and has no licence; case, punctuation, white space and marks of
comments at the start of lines do not matter; other sentences may stand between those of a rule; repeated
sentences count once each time; the sequence given is the longer of the two, that of the lines at a tie; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import arrow_rows

#: Known sentences of public licence texts and notices, by a name of ours.
TEXTS = {
    "mit-short": "Released under the MIT License.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "reserved": "All rights reserved.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-apart": "You may obtain a copy of the License at: http://www.apache.org/licenses/LICENSE-2.0",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "x11-names": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-regents": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-old": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "gpl2-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "mpl11-notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1-notice": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "cddl-notice": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "wtfpl": "You just DO WHAT THE FUCK YOU WANT TO.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "artistic2-title": "The Artistic License 2.0",
    "ncsa-title": "University of Illinois/NCSA Open Source License",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "eupl12-notice": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");",
    "ofl-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "sspl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the Server Side Public License, version 1, as published by MongoDB, Inc.",
    "busl-title": "Business Source License 1.1",
    "elastic2-title": "Elastic License 2.0",
    "beer-notice": "As long as you retain this notice you can do whatever you want with this stuff.",
    "curl-grant": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder.",
    "json-good": "The Software shall be used for Good, not Evil.",
    "hpnd-grant": "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies, and that both that the copyright notice and this permission notice appear in supporting documentation.",
    "psf-title": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "confidential": "This document is proprietary and confidential.",
}

#: Licences and the sentences that must appear in this order.
RULES = [
    ("0BSD", ("0bsd-grant",)), ("AGPL-3.0", ("agpl3-notice",)), ("AGPL-3.0", ("agpl3-title",)),
    ("Apache-2.0", ("apache-short",)), ("Apache-2.0", ("apache-grant", "apache-use")), ("Apache-2.0", ("apache-use", "apache-copy")), ("Apache-2.0", ("apache-use", "apache-copy-apart")),
    ("Artistic-2.0", ("artistic2-title",)), ("BSD-1-Clause", ("bsd-grant", "bsd-source")), ("BSD-2-Clause", ("bsd-grant",)), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-names")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-regents")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-regents")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-advertising", "bsd-names")), ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-advertising", "bsd-regents")), ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-regents")),
    ("BSL-1.0", ("boost-notice",)), ("BSL-1.0", ("boost-grant",)), ("BUSL-1.1", ("busl-title",)), ("Beerware", ("beer-notice",)), ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC0-1.0", ("cc0-title",)), ("CC0-1.0", ("cc0-notice",)), ("CDDL-1.0", ("cddl-notice",)), ("EPL-1.0", ("epl1-notice",)), ("EPL-2.0", ("epl2-notice",)), ("EUPL-1.2", ("eupl12-notice",)),
    ("Elastic-2.0", ("elastic2-title",)), ("GPL-2.0", ("gpl2-notice",)), ("GPL-2.0", ("gpl2-only",)), ("GPL-2.0", ("gpl2-title",)),
    ("GPL-3.0", ("gpl3-short",)), ("GPL-3.0", ("gpl3-notice",)), ("GPL-3.0", ("gpl3-title",)), ("HPND", ("hpnd-grant",)), ("ISC", ("isc-grant",)), ("ISC", ("isc-grant-old",)),
    ("JSON", ("mit-grant", "mit-notice", "json-good")), ("LGPL-2.1", ("lgpl21-notice",)), ("LGPL-2.1", ("lgpl21-title",)), ("LGPL-3.0", ("lgpl3-notice",)), ("LGPL-3.0", ("lgpl3-title",)),
    ("MIT", ("mit-short",)), ("MIT", ("mit-grant", "mit-notice")), ("MIT-0", ("mit0-grant",)), ("MPL-1.1", ("mpl11-notice",)), ("MPL-2.0", ("mpl2-notice",)), ("MPL-2.0", ("mpl2-title",)),
    ("NCSA", ("ncsa-title",)), ("OFL-1.1", ("ofl-notice",)), ("PSF-2.0", ("psf-title",)), ("PostgreSQL", ("postgresql-grant",)),
    ("SSPL-1.0", ("sspl-notice",)), ("Unlicense", ("unlicense",)), ("WTFPL", ("wtfpl",)), ("WTFPL", ("wtfpl-title",)), ("X11", ("mit-grant", "mit-notice", "x11-names")), ("Zlib", ("zlib-grant", "zlib-origin")), ("curl", ("curl-grant",)),
    ("Proprietary", ("reserved",)), ("Proprietary", ("confidential",)),
]

#: Stands back where any other licence is found.
WEAKEST = "Proprietary"

# The Creative Commons licences by their conditions, and the tags of all licences.
for _code, _words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _form, _text in (("short", f"Licensed under CC {_code} 4.0."), ("long", f"This work is licensed under a Creative Commons {_words} 4.0 International License."), ("new", f"This work is licensed under CC {_code} 4.0.")):
        if _text not in TEXTS.values():
            TEXTS[f"cc-{_code.lower()}-{_form}"] = _text
            RULES.append((f"CC-{_code}-4.0", (f"cc-{_code.lower()}-{_form}",)))
for _name in sorted({n for n, _ in RULES} - {WEAKEST}):
    TEXTS[f"spdx-{_name}"] = f"SPDX-License-Identifier: {_name}"
    RULES.append((_name, (f"spdx-{_name}",)))

#: Identifiers of the sentences are their places here, from 0.
SENTENCES = tuple(TEXTS.values())
_NUMBER = {name: i for i, name in enumerate(TEXTS)}
#: One of these, each within a word, is in each known sentence.
ANCHORS = ("licen", "permi", "right", "redistrib", "software", "advertis", "notice", "proprietary", "cc0", "fuck")

#: A stop ends a sentence before white space or the end; the marks of a sentence become one blank each.
_WHITE = r"[ \t\n\r\f]"
STOP = rf"[.!?;:]+({_WHITE}+|$)"
LINE = r"[\r\n]+"
MARKS = r"[^a-z0-9|]+"
#: Of the layout: what a comment puts before a line, and the borders besides stops.
COMMENT = r"(?m)^[ \t]*(/\*+|\*+/|\*+([ \t]|$)|//+|#+|;+|--+)"
BLANK = r"\n[ \t]*\n[ \t\n]*"
NOTICE = r"(?m)^([ \t]*(copyright[ \t]*(\(c\)|[©:<\[]|[0-9])|(\(c\)|©)[ \t]*[0-9])[^\n]*)$"
URL = r"(?m)(https?://[^ \t\n]+)[ \t]*$"


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def parts(sentence: str) -> list[str]:
    return [p for p in (normalised(x) for x in re.split(STOP, sentence.lower())[::2]) if p]


@lru_cache(1)
def known() -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Numbers of the parts of known sentences, and what stands for each sentence in a sequence of parts, those of most parts first."""
    numbers: dict[str, int] = {}
    for sentence in SENTENCES:
        for p in parts(sentence):
            numbers.setdefault(p, len(numbers))
    of = [("".join(f"|{numbers[p]}|" for p in parts(s)), f"|={i}|") for i, s in enumerate(SENTENCES)]
    return numbers, sorted(of, key=lambda x: (-x[0].count("|"), x[0]))


def pattern(rule: tuple[str, ...]) -> str:
    return r"\|" + r"\|([0-9]+\|)*".join(str(_NUMBER[s]) for s in rule) + r"\|"


def _holds(outer: tuple[str, ...], inner: tuple[str, ...]) -> bool:
    rest = iter(outer)
    return len(outer) > len(inner) and all(s in rest for s in inner)


@lru_cache(1)
def ordered() -> list[tuple[str, list[tuple[str, str]]]]:
    """By name: the pattern of each of its rules, and that of the rules of others before which it stands back (or '')."""
    out = []
    for name in sorted({n for n, _ in RULES}):
        own = [r for n, r in RULES if n == name]
        out.append((name, [(pattern(x), "|".join(pattern(r) for n, r in RULES if n not in (name, WEAKEST) and (name == WEAKEST or _holds(r, x)))) for x in own]))
    return out


_CUTS = {
    "lines": [(re.compile(f"{STOP}|{LINE}"), "|")],
    "layout": [(re.compile(LAYOUT), to) for LAYOUT, to in ((r"\r\n?", "\n"), (COMMENT, " "), (NOTICE, r"|\1|"), (URL, r"\1|"), (BLANK, "|"), (STOP, "|"))],
}
_MARKS = re.compile(MARKS)
_UNKNOWN = re.compile(r"\|[0-9-]+\|")


def sequence(text: str, cut: str) -> str:
    """Identifiers in order as |1|2|."""
    for border, to in _CUTS[cut]:
        text = border.sub(to, text)
    numbers, of = known()
    found = "".join("|-|" if (k := numbers.get(p)) is None else f"|{k}|" for p in map(str.strip, _MARKS.sub(" ", text).split("|")) if p)
    if found.strip("|-"):
        for inner, outer in of:
            found = found.replace(inner, outer)
    return _UNKNOWN.sub("", found).replace("=", "").replace("||", "|") or "|"


def scan(text: str) -> tuple[int, str, str]:
    """Number of known sentences, their identifiers, licences."""
    low = text.lower().replace("|", " ")
    if not any(a in low for a in ANCHORS):
        return 0, "|", ""
    a, b = sequence(low, "lines"), sequence(low, "layout")
    if a == b == "|":
        return 0, "|", ""
    both = f"{a} {b}"  # a rule's pattern cannot cross the blank
    found = [name for name, rules in ordered() if any(re.search(own, both) and not (over and re.search(over, both)) for own, over in rules)]
    best = b if len(b) > len(a) else a
    return best.count("|") - 1, best, ",".join(found)


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences (sorted, comma-joined)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("sentence_ids", pa.string()), ("licences", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, take = arrow_rows(schema, 5000)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                add(doc, *scan(text.as_py() or ""))
                yield from take()
        yield from take(True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_sentences long, sentence_ids string, licences string")


def oracle() -> str:
    """DuckDB SQL of the same result."""
    numbers, of = known()
    table = ", ".join(f"('{s}', {i})" for s, i in numbers.items())
    low = "replace(lower(coalesce(text, '')), '|', ' ')"
    layout = low
    for border, to in ((r"\r\n?", "\n"), (COMMENT, " "), (NOTICE, r"|\1|"), (URL, r"\1|"), (BLANK, "|"), (STOP, "|")):
        layout = f"regexp_replace({layout}, '{border}', '{to}', 'g')"
    found = "ids"
    for inner, outer in of:
        found = f"replace({found}, '{inner}', '{outer}')"

    def side(name: str, cut: str) -> str:
        return f"""{name} AS (SELECT rid, replace(replace(regexp_replace({found}, '\\|[0-9-]+\\|', '', 'g'), '=', ''), '||', '|') AS ids FROM (
            SELECT d.rid, string_agg(CASE WHEN k.id IS NULL THEN '|-|' ELSE '|' || k.id || '|' END, '' ORDER BY pos) AS ids FROM
            (SELECT rid, trim(unnest(parts)) AS s, generate_subscripts(parts, 1) AS pos FROM (SELECT rid, string_split(regexp_replace({cut}, '{MARKS}', ' ', 'g'), '|') AS parts FROM src)) d
            LEFT JOIN k ON k.s = d.s WHERE d.s <> '' GROUP BY d.rid))"""

    def meets(p: str) -> str:
        return f"regexp_matches(ab, '{p}')"

    def any_of(rules: list[tuple[str, str]]) -> str:
        free = "|".join(own for own, over in rules if not over)
        return " OR ".join(([meets(free)] if free else []) + [f"({meets(own)} AND NOT {meets(over)})" for own, over in rules if over])

    cases = ", ".join(f"CASE WHEN {any_of(rules)} THEN '{name}' END" for name, rules in ordered())
    lines = f"regexp_replace({low}, '{STOP}|{LINE}', '|', 'g')"
    return f"""WITH src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), k(s, id) AS (VALUES {table}),
        {side("x", lines)}, {side("y", layout)},
        z AS (SELECT doc_id, CASE WHEN coalesce(x.ids, '') = '' THEN '|' ELSE x.ids END AS a, CASE WHEN coalesce(y.ids, '') = '' THEN '|' ELSE y.ids END AS b FROM src LEFT JOIN x USING (rid) LEFT JOIN y USING (rid)),
        w AS (SELECT *, a || ' ' || b AS ab, CASE WHEN length(b) > length(a) THEN b ELSE a END AS best FROM z)
        SELECT doc_id, CAST(length(best) - length(replace(best, '|', '')) - 1 AS BIGINT) AS n_sentences, best AS sentence_ids, concat_ws(',', {cases}) AS licences FROM w"""
