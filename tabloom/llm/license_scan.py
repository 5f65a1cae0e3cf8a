"""License scans by conditional compression.

Licensing cues mark candidate stretches: the text round a cue, as wide as a wording can reach from it; those that
touch are one. A stretch is cut into blocks of bounded width that overlap by the longest wording, so every wording lies
whole in a block, however many cues follow each other. A block is compressed alone and once with each known wording as a
zstandard raw dictionary, with the same parameters. A wording that is in the block saves about as many bytes as it has
itself, so wordings are ranked by that share. Every wording that saves enough is confirmed at every cue by the exact
differences of its words: *exact* (all words there, in order, nothing between them) or *modified* (few words
differ; they are listed). Where spans overlap the closest wording stands; a block may name several licenses. A block
that a wording explains by its bytes but none by its words is one *unconfirmed* row. One pass over whole texts, no
exchange; texts without a cue never leave the JVM.

Defined cases: a null or empty text has no block; texts, lines and stretches of cues of any length are searched whole; repeated rows
give repeated results; ties go to fewer differences, then the larger reduction, then the name; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Cue words of licensing text (a regular expression for both engines).
CUES = r"(?i)licen[sc]e|copyright|©|spdx|public domain|permission is hereby|redistribution and use|warranty|all rights reserved|creative commons"

#: Known wordings by license (public notices).
WORDINGS: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

_CUE = re.compile(CUES)
_WORD = re.compile(r"\w+(?:[.\-]\w+)*")


@dataclass(frozen=True)
class ScanRules:
    min_saving: float = 0.3  # of the wording's own compressed size
    max_changed: float = 0.25  # of the wording's words
    slack: int = 3  # words beyond the wording's length that are compared


def candidate_stretches(text: str, reach: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(first character, end, cues) of the stretches within ``reach`` characters of a cue."""
    lo = hi = -1
    cues: list[tuple[int, int]] = []
    for m in _CUE.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if cues and a > hi:
            yield lo, hi, cues
            cues = []
        lo, hi = (a if not cues else lo), b
        cues.append(m.span())
    if cues:
        yield lo, hi, cues


def candidate_blocks(lo: int, hi: int, cues: list[tuple[int, int]], reach: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """A stretch in blocks of at most three times ``reach`` characters, each overlapping the next by ``reach``, with the cues they touch."""
    ends = [b for _, b in cues]
    while True:
        end = min(lo + 3 * reach, hi)
        first = bisect_left(ends, lo + 1)
        inside = []
        for a, b in cues[first:]:
            if a >= end:
                break
            inside.append((a, b))
        if inside:
            yield lo, end, inside
        if end == hi:
            return
        lo = end - reach


class Matcher:
    """Compressors for all wordings, made once a task."""

    def __init__(self, rules: ScanRules, wordings: tuple[tuple[str, str], ...] = WORDINGS):
        self.rules, self.wordings = rules, wordings
        self.words = [_WORD.findall(w.lower()) for _, w in wordings]
        self.reach = max(len(w) for _, w in wordings)
        params = zstandard.ZstdCompressionParameters.from_level(19, source_size=16 * self.reach, write_content_size=False)  # one set for all
        self.plain = zstandard.ZstdCompressor(compression_params=params)
        empty = len(self.plain.compress(b""))
        self.own = [max(1, len(self.plain.compress(w.encode())) - empty) for _, w in wordings]
        self.given = [zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(w.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, w in wordings]

    def found(self, text: str) -> Iterator[tuple]:
        """(block, first character, license, saving, missing, extra, differences, verdict) of all confirmed wordings, stretch by stretch."""
        number = 0
        for stretch in candidate_stretches(text, self.reach):
            hits: dict[tuple, tuple] = {}
            explained: list[tuple[int, int, int, int, float]] = []
            for lo, hi, cues in candidate_blocks(*stretch, self.reach):
                raw = text[lo:hi].encode("utf-8", "replace")
                alone = len(self.plain.compress(raw))
                savings = [(alone - len(c.compress(raw))) / own for c, own in zip(self.given, self.own, strict=True)]
                ranked = [i for i in sorted(range(len(savings)), key=lambda i: (-savings[i], i)) if savings[i] >= self.rules.min_saving]
                if ranked:
                    explained.append((number, lo, hi, ranked[0], savings[ranked[0]]))
                    low = text[lo:hi].lower()
                    words = [(m[0], m.start() + lo, m.end() + lo) for m in _WORD.finditer(low)] if len(low) == hi - lo else [(m[0].lower(), m.start() + lo, m.end() + lo) for m in _WORD.finditer(text[lo:hi])]
                    starts = [w[1] for w in words]
                    for i in ranked:
                        for a, b in cues:
                            for h in self._confirm(i, words, bisect_left(starts, a), bisect_left(starts, b), savings[i]):
                                hits.setdefault((h[2], h[1], h[8], h[6]), (number, *h[1:]))  # overlapping blocks find it twice
                number += 1
            taken: list[tuple[int, int]] = []  # in order, none touching another
            sure = []
            for hit in sorted(hits.values(), key=lambda h: (h[7] != "exact", -(h[8] - h[1]) if h[7] == "exact" else h[4] + h[5], -h[3], h[2], h[1])):
                if not _touches(taken, hit[1], hit[8]):
                    insort(taken, (hit[1], hit[8]))
                    sure.append(hit[:8])
            sure += [(n, lo, self.wordings[best][0], saving, len(self.words[best]), 0, "", "unconfirmed") for n, lo, hi, best, saving in explained if not _touches(taken, lo, hi)]
            yield from sorted(sure, key=lambda h: (h[1], h[0]))

    def _confirm(self, i: int, words: list[tuple[str, int, int]], first: int, end: int, saving: float) -> Iterator[tuple]:
        """The wording's closest place that touches the cue (words ``first`` to ``end``), if few words differ."""
        want, slack = self.words[i], self.rules.slack
        near = words[max(0, first - len(want) - slack) : end + len(want) + slack]
        have = [w for w, _, _ in near]
        core = difflib.SequenceMatcher(None, want, have, autojunk=False).find_longest_match()
        if not core.size:
            return
        at = max(0, core.b - core.a - slack)
        inner = have[at : core.b + len(want) - core.a + slack]
        matches = [m for m in difflib.SequenceMatcher(None, want, inner, autojunk=False).get_matching_blocks() if m.size]
        lo, hi = matches[0].b, matches[-1].b + matches[-1].size
        same = sum(m.size for m in matches)
        missing, extra = len(want) - same, hi - lo - same
        if missing + extra > self.rules.max_changed * len(want):
            return
        inside = inner[lo:hi]
        edits = [f"{' '.join(want[a:b])} -> {' '.join(inside[c:d])}" for kind, a, b, c, d in difflib.SequenceMatcher(None, want, inside, autojunk=False).get_opcodes() if kind != "equal"]
        verdict = "modified" if missing or extra else "exact"
        yield 0, near[at + lo][1], self.wordings[i][0], saving, missing, extra, "; ".join(edits), verdict, near[at + hi - 1][2]


def _touches(spans: list[tuple[int, int]], lo: int, hi: int) -> bool:
    """Does one of some ordered spans that lie apart reach into ``lo`` to ``hi``?"""
    at = bisect_left(spans, (lo, lo))
    return (at < len(spans) and spans[at][0] < hi) or (at > 0 and spans[at - 1][1] > lo)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ScanRules | None = None) -> DataFrame:
    """One row per confirmed wording and place, or per block that a wording explains by its bytes alone: id, ``block`` (its number), ``at`` (character offset),
    ``license``, ``saving``, ``n_missing``, ``n_extra``, ``differences``, ``verdict``."""
    rules = rules or ScanRules()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["block", "at", "license", "saving", "n_missing", "n_extra", "differences", "verdict"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rules)
        for batch in batches:
            ids, rows = [], []
            for ident, text in zip(batch.column(0), batch.column(1), strict=True):
                for found in matcher.found(text.as_py()):
                    ids.append(ident.as_py())
                    rows.append(found)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["id", *names])

    cued = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(CUES))
    schema = "id long, block long, at long, license string, saving double, n_missing long, n_extra long, differences string, verdict string"
    return cued.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def licenses(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Documents by confirmed license: id, ``license``, ``blocks``, and whether all of them are exact."""
    sure = scan(docs, id_col, **options).where("verdict <> 'unconfirmed'")
    return sure.groupBy(id_col, "license").agg(F.count(F.lit(1)).alias("blocks"), F.min(F.col("verdict") == "exact").alias("all_exact"))
