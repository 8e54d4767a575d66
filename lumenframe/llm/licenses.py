"""Licence scan by sentence rules.

A text is cut into words; a known licence sentence is recognised where its words stand one after the other, begin
where a sentence or line begins and end where one ends, so wrapped lines and changed punctuation do not matter. The
identifiers of the recognised sentences, in order, are matched against ordered rules: a rule names a licence and the
sentences that must follow one another; more specific rules come first and take the sentences they use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import small_batches

#: Identifiers and texts of public licences' sentences. An asterisk stands for any words: inside, up to where the
#: sentence goes on, and before it begins anew; at the end, up to the end of the line or sentence.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-short-title": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is-software": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-released": "Released under the BSD License.",
    "apache2-short": "Licensed under the Apache License, Version 2.0.",
    "apache2-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache2-comply": "you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "mpl2-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc4": "Licensed under CC BY-NC 4.0.",
    "cc-by4": "Licensed under CC BY 4.0.",
    "cc-by-sa4": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd4": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa4": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0": "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain.",
    "cc0-title": "CC0 1.0 Universal",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "apache2-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache2-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl-copies": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "agpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "bsl1-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl1-short": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-held": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsd4-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "artistic2-title": "The Artistic License 2.0",
    "psf2-title": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "spdx": "SPDX-License-Identifier: *",
}

#: Ordered rules. Sentences of a rule follow one another, with others allowed between them.
RULES = (
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd4-advert")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-released",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is-software")),
    ("MIT", ("mit-short-title", "mit-grant", "mit-notice", "as-is-software")),
    ("MIT", ("mit-grant", "mit-notice", "as-is-software")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("ISC", ("isc-grant", "as-is-software")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Apache-2.0", ("apache2-title", "apache2-terms", "apache2-header", "apache2-comply", "apache2-copy", "apache2-basis")),
    ("Apache-2.0", ("apache2-title", "apache2-terms")),
    ("Apache-2.0", ("apache2-title",)),
    ("Apache-2.0", ("apache2-header", "apache2-comply", "apache2-copy", "apache2-basis")),
    ("Apache-2.0", ("apache2-header", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-header",)),
    ("Apache-2.0", ("apache2-short",)),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("GPL-2.0-or-later", ("gpl2-redistribute", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-redistribute",)),
    ("LGPL-2.1-or-later", ("lgpl-redistribute",)),
    ("AGPL-3.0-or-later", ("agpl-redistribute", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl-redistribute",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-2.0", ("gpl2-work",)),
    ("MPL-2.0", ("mpl2-terms",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("EPL-2.0", ("epl2-title",)),
    ("BSL-1.0", ("bsl1-title",)),
    ("BSL-1.0", ("bsl1-short",)),
    ("Zlib", ("zlib-warranty", "zlib-held", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Artistic-2.0", ("artistic2-title",)),
    ("PSF-2.0", ("psf2-title",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-ND-4.0", ("cc-by-nd4",)),
    ("CC-BY-4.0", ("cc-by4",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("Unlicense", ("unlicense", "unlicense-anyone")),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0-title", "cc0")),
    ("CC0-1.0", ("cc0-title",)),
    ("CC0-1.0", ("cc0",)),
)

WORD = re.compile(r"[^\W_]+")
#: Between two words: the end of a sentence or line. A point between two digits, as in a version, is none.
BREAK = re.compile(r"\n|[.;:!?]+[\s\"')\]]|[.;:!?]+$")
#: The end of a line, or of a sentence within it; a point inside a version is none.
STOP = re.compile(r"\n|[.;:!?]+\s")


class SentenceBook:
    """Known sentences as normalised words, found by their first two words."""

    def __init__(self, sentences: dict[str, str] | None = None, rules=RULES):
        self.rules = rules
        self.by_head: dict[tuple[str, ...], list[tuple[str, list[list[str]], bool]]] = {}
        for name, text in (sentences or SENTENCES).items():
            parts = [WORD.findall(p.lower()) for p in text.split("*")]
            self.by_head.setdefault(tuple(parts[0][:2]), []).append((name, parts, text.rstrip().endswith("*")))
        for own in self.by_head.values():
            own.sort(key=lambda x: -sum(map(len, x[1])))
        #: The longest word of each sentence: a text with none of them has no known sentence; most texts stop here.
        self.hints = sorted({max((w for part in parts for w in part), key=len) for own in self.by_head.values() for _, parts, _ in own})

    def sentences(self, text: str) -> list[tuple[str, int, int]]:
        """(identifier, start, end) of the recognised sentences, in order, in code points."""
        low = text.lower()
        if not any(w in low for w in self.hints):
            return []
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        found = []
        spans = [m.span() for m in WORD.finditer(low)]
        words = [low[a:b] for a, b in spans]
        opens = [i == 0 or self._breaks(low, spans[i - 1][1], spans[i][0]) for i in range(len(words))]
        closes = [*opens[1:], True]
        stops = lambda j: j + 1 == len(words) or bool(STOP.search(low[spans[j][1] : spans[j + 1][0]]))
        i = 0
        while i < len(words):
            end = next((e for head in (tuple(words[i : i + 2]), (words[i],)) for e in self._at(words, closes, stops, i, head)), None) if opens[i] else None
            if end:
                found.append((end[0], spans[i][0], spans[end[1] - 1][1]))
                i = end[1]
            else:
                i += 1
        return found

    @staticmethod
    def _breaks(low: str, a: int, b: int) -> bool:
        gap = low[a:b]
        return gap != " " and bool(BREAK.search(gap)) and not (gap == "." and low[a - 1].isdigit() and low[b].isdigit())

    def _at(self, words, closes, stops, i, head) -> Iterator[tuple[str, int]]:
        for name, parts, to_line_end in self.by_head.get(head, ()):
            at, ok = i, True
            for k, part in enumerate(parts):
                if not part and k:  # trailing asterisk: the rest of the line
                    stop = next((j for j in range(at, len(words)) if stops(j)), None)
                    ok = stop is not None
                    at = stop + 1 if ok else at
                    break
                hit = at if words[at : at + len(part)] == part else None
                if k:
                    hit = next((s for s in self._until_again(words, at + 1, head) if words[s] == part[0] and words[s : s + len(part)] == part), None)
                if hit is None:
                    ok = False
                    break
                at = hit + len(part)
            if ok and closes[at - 1]:
                yield name, at

    @staticmethod
    def _until_again(words, at, head) -> Iterator[int]:
        """Places from at on, up to where the head of the sentence stands again."""
        for s in range(at, len(words)):
            if words[s] == head[0] and tuple(words[s : s + len(head)]) == head:
                return
            yield s

    def licences(self, names: list[str]) -> list[str]:
        """Licences that the ordered rules see in a sequence of identifiers, in the order of the rules' last use."""
        free, out = list(enumerate(names)), []
        for licence, rule in self.rules:
            while True:
                at, used = -1, []
                for want in rule:
                    hit = next((k for k, n in free if k > at and n == want), None)
                    if hit is None:
                        break
                    used.append(hit)
                    at = hit
                if len(used) < len(rule):
                    break
                out.append((used[0], licence))
                free = [x for x in free if x[0] not in used]
        return [x for _, x in sorted(out)]


def expression(text: str, start: int, end: int) -> str:
    """What an SPDX line names, with the plus sign and the brackets after its last word that belong to it."""
    own = text[start:end].split(":", 1)[-1].strip()
    for c in text[end:]:
        if c != "+" and (c != ")" or own.count("(") <= own.count(")")):
            break
        own += c
    return own


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules=RULES) -> DataFrame:
    """One row per document: doc_id, sentences (array of id, start, end), licences (distinct, sorted).

    Offsets are code points. Null and empty texts have none; whole texts are read, of any length; repeated rows give
    equal rows; an empty table gives none. Sentences that no rule uses are reported but give no licence. An SPDX line
    gives the identifier it names. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    item = pa.struct([("id", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("sentences", pa.list_(item)), ("licences", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = SentenceBook(sentences, rules)
        for batch in batches:
            found, names = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                own = book.sentences(text)
                spdx = [expression(text, a, b) for n, a, b in own if n == "spdx"]
                found.append([{"id": n, "start": a, "end": b} for n, a, b in own])
                names.append(sorted({*book.licences([n for n, _, _ in own]), *spdx}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item)), pa.array(names, pa.list_(pa.string()))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, sentences array<struct<id:string,start:long,end:long>>, licences array<string>")


def flat(scanned: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentences and licences as comma-joined strings."""
    return scanned.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join(F.transform("sentences", lambda s: s["id"]), ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))
