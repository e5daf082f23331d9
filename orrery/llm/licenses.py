"""License scans: fuzzy search for short notices.

A notice of ``n`` characters may differ by ``n // 12`` edits (one at least).  If it
does, then one of that number plus one pieces of it stands in the text unchanged:
all pieces of all notices are sought at once by an Aho-Corasick automaton, and
around each find the regex library looks for the best match within the bound.
The short codes of Creative Commons licenses ("CC BY-NC 4.0") must stand exactly:
one edit makes another license of them.  A code without a version is not sought.

Texts are compared in lower case with every white space as one space; both keep
the number of characters, so spans count the characters of the text as it is.
Finds of one notice that overlap become the one with the fewest edits, then the
leftmost.

Nulls, empties and ties: null and empty texts give no rows; a null id passes
through; repeated rows give repeated rows.  Other columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import small_batches

NOTICES = {
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify",
    "lgpl-2.1": "GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd-3": "Redistribution and use in source and binary forms, with or without modification",
    "bsd-named": "Use of this source code is governed by a BSD-style license",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose",
    "epl-2.0": "made available under the terms of the Eclipse Public License 2.0",
}
#: Short codes of the Creative Commons licenses, as written in prose and in SPDX.
_CC = {f"cc-{kind.lower()}-{v}-{form}": code for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("1.0", "2.0", "2.5", "3.0", "4.0") for form, code in (("code", f"CC {kind} {v}"), ("spdx", f"CC-{kind}-{v}"))}
NOTICES |= _CC
_EXACT = {x.lower() for x in _CC.values()}
_SPACE = re.compile(r"\s")


def normalised(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return _SPACE.sub(" ", low)


def bound(notice: str) -> int:
    return 0 if notice.lower() in _EXACT else max(1, len(notice) // 12)


def pieces(notice: str) -> list[tuple[int, str]]:
    """Offset and text of the ``bound + 1`` pieces."""
    n, k = len(notice), bound(notice) + 1
    cut = [n * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Scanner:
    def __init__(self, notices: dict[str, str]) -> None:
        self.names = list(notices)
        self.texts = [normalised(notices[x]) for x in self.names]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, text in enumerate(self.texts):
            for at, piece in pieces(text):
                found.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, where in found.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()
        self.fuzzy = [regex.compile(rf"(?b)(?:{regex.escape(t, special_only=True)}){{e<={bound(t)}}}") for t in self.texts]

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        """``(notice, start, end, edits)`` of all finds, by place."""
        text = normalised(text)
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.seeds.iter(text):
            for k, at in where:
                starts.setdefault(k, set()).add(end - size + 1 - at)
        out = []
        for k, diagonals in starts.items():
            n, e = len(self.texts[k]), bound(self.texts[k])
            found = set()
            for d in diagonals:
                if m := self.fuzzy[k].search(text, max(0, d - e), min(len(text), d + n + e)):
                    found.add((sum(m.fuzzy_counts), m.start(), m.end()))
            taken: list[tuple[int, int]] = []
            for edits, a, b in sorted(found):
                if all(b <= x or y <= a for x, y in taken):
                    taken.append((a, b))
                    out.append((self.names[k], a, b, edits))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def license_scan(docs: DataFrame, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, notice, start, end, edits``, one row a find."""
    notices = dict(NOTICES if notices is None else notices)
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scanner = Scanner(notices)
        for batch in batches:
            rows, out = [], []
            for r, text in enumerate(batch.column(1)):
                if (t := text.as_py()) and (found := scanner.scan(t)):
                    rows += [r] * len(found)
                    out += found
            names, start, end, edits = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(edits, pa.int32())],
                names=["doc_id", "notice", "start", "end", "edits"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, notice string, start int, end int, edits int")
