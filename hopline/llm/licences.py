"""Licence scan: sentences become identifiers, and identifier sequences match ordered licence rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import giving_back

# Normalised sentences of public licence texts and notices, by identifier.  A sentence is
# lower-cased, has one space between words and no other marks than those inside words; asides that only
# give a term its name, as (the "License"), are left out.
SENTENCES = {
    "apache2-ref": "licensed under the apache license version 2.0",
    "apache2-may-not-use": "you may not use this file except in compliance with the license",
    "apache2-obtain": "you may obtain a copy of the license at",
    "as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-ref": "released under the mit license",
    "mit-ref-2": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-ref": "released under the bsd license",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl2-ref": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-ref": "licensed under the gnu lesser general public license",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "cc-by-4": "licensed under cc by 4.0",
    "cc-by-sa-4": "licensed under cc by-sa 4.0",
    "cc-by-nc-4": "licensed under cc by-nc 4.0",
    "cc-by-nc-nd-4": "licensed under cc by-nc-nd 4.0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "mpl2-copy-s": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}

# A licence is found where its identifiers occur in this order, with at most ``GAP`` other
# sentences between two of them; longer rules are tried first and use up the sentences they match.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("Apache-2.0", ("apache2-ref", "apache2-may-not-use", "apache2-obtain", "as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-ref", "apache2-may-not-use", "apache2-obtain")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0-only", ("gpl2-only-free", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-program", "gpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope")),
    ("MPL-2.0", ("mpl2", "mpl2-copy")),
    ("MPL-2.0", ("mpl2", "mpl2-copy-s")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-only", ("gpl2-only-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-program",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("Apache-2.0", ("apache2-ref",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-2",)),
    ("BSD", ("bsd-ref",)),
    ("ISC", ("isc-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("LGPL", ("lgpl-ref",)),
    ("MPL-2.0", ("mpl2",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("all-rights-reserved", ("reserved",)),
)
GAP = 3

_BY_TEXT = {text: name for name, text in SENTENCES.items()}
_MOST_WORDS = max(len(text.split()) for text in _BY_TEXT)
#: A known sentence holds its longest word as it stands, so texts with none of these words have no known sentence.
_WORDS_OF_ALL = re.compile("|".join(sorted({re.escape(max(text.split(), key=len)) for text in _BY_TEXT})))
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)")
_SPDX_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.:\-]*\+?))")
#: Asides that give a term its name.
_ASIDE = re.compile(r"\(\s*(?:the\s+)?[\"\u201c\u2018'`]+[^()\"\u201d\u2019'`]{1,40}[\"\u201d\u2019'`]+\s*\)")
#: Sentences end here for certain; a point after "v" does not end one.
_HARD = re.compile(r"(?<!\bv)[.!?](?=[\s\"')\]]|$)|\n[ \t]*\n")
#: Sentences may end here.
_SOFT = re.compile(r"\n|[:;,](?=\s)|(?<=\s)[-\u2013\u2014*#|>/](?=\s)")
_MARKS = re.compile(r"(?<!\w)[^\w]+|[^\w]+(?!\w)|[^\w.\-]+")


def normalised(sentence: str) -> str:
    return " ".join(_MARKS.sub(" ", _ASIDE.sub(" ", sentence).lower()).split())


def spdx_identifiers(expression: str) -> list[str]:
    """Licences of an SPDX expression, as far as it is well-formed: ids with AND, OR, WITH and parentheses."""
    found: list[str] = []
    at, depth, want_id = 0, 0, True
    while match := _SPDX_TOKEN.match(expression, at):
        bracket, word = match.groups()
        if bracket == "(" and want_id:
            depth += 1
        elif bracket == ")" and not want_id and depth:
            depth -= 1
        elif word and not want_id and word in ("AND", "OR"):
            want_id = True
        elif word and not want_id and word == "WITH":
            exception = _SPDX_TOKEN.match(expression, match.end())
            if not exception or not exception.group(2):
                break
            match = exception
        elif word and want_id and word not in ("AND", "OR", "WITH"):
            found.append(word)
            want_id = False
        else:
            break
        at = match.end()
    return found


def sentence_ids(text: str) -> list[tuple[int, str]]:
    """(number of the sentence, identifier) of the known sentences, in order.

    Between certain ends, the longest run of pieces from a possible end to another that is a known
    sentence counts.  SPDX lines are sentences with an identifier for each licence they name.
    """
    out: list[tuple[int, str]] = []
    spdx = "SPDX-License-Identifier:" in text
    if not spdx and not _WORDS_OF_ALL.search(text.lower()):
        return out
    n = 0
    # split by a pattern with a group: texts between SPDX lines and their expressions in turn
    for nth, part in enumerate(_SPDX.split(text)):
        if nth % 2:
            out += [(n, f"spdx:{name}") for name in spdx_identifiers(part)]
            n += 1
            continue
        for sentence in _HARD.split(_ASIDE.sub(" ", part)):
            pieces = [p for p in map(normalised, _SOFT.split(sentence)) if p]
            sizes = [p.count(" ") + 1 for p in pieces]
            at = 0
            while at < len(pieces):
                end, words = at, 0
                while end < len(pieces) and words + sizes[end] <= _MOST_WORDS:
                    words += sizes[end]
                    end += 1
                while end > at and (name := _BY_TEXT.get(" ".join(pieces[at:end]))) is None:
                    end -= 1
                if end > at:
                    out.append((n, name))
                    n += 1
                at = max(end, at + 1)
            n += 1
    return out


def match_rules(found: list[tuple[int, str]]) -> list[str]:
    """Licences whose rules the sentences satisfy, in the order of their first sentences."""
    used = [name.startswith("spdx:") for _, name in found]
    out: list[tuple[int, str]] = [(n, name.removeprefix("spdx:")) for n, name in found if name.startswith("spdx:")]
    for licence, rule in RULES:
        for first in range(len(found)):
            if used[first] or found[first][1] != rule[0]:
                continue
            places = [first]
            for wanted in rule[1:]:
                at = places[-1]
                after = next((i for i in range(at + 1, len(found)) if found[i][0] - found[at][0] <= GAP + 1 and not used[i] and found[i][1] == wanted), None)
                if after is None:
                    break
                places.append(after)
            else:
                for i in places:
                    used[i] = True
                out.append((found[first][0], licence))
    return [licence for _, licence in sorted(out, key=lambda x: x[0])]


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licences (comma-joined, in order of place) of every whole text.

    A licence named twice is listed once, at its first place.  Null and empty texts name none; repeated
    rows are scanned alike, rows without an id too; other columns are not read; an empty table gives an
    empty result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sentence_ids(t or "") for t in batch.column(1).to_pylist()]
            licences = [",".join(dict.fromkeys(match_rules(f))) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(i for _, i in f) for f in found], pa.string()), pa.array(licences, pa.string())], names=["doc_id", "n_sentences", "sentence_ids", "licences"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(giving_back(scan), "doc_id long, n_sentences long, sentence_ids string, licences string")
