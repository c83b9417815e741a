"""License texts found by how much a template helps to compress a passage.

A template whose words may differ in k places is cut into k + 1 pieces, of which every wording of it keeps one unedited.
Blocks of a text in which such a piece stands are candidates. Each is compressed alone and with every template as a raw
Zstandard dictionary, and what they save ranks the templates. Down this ranking they are confirmed by the exact words in
which the block differs from them. No saving proves that a wording is absent, as its parts may stand elsewhere in the block
too, so the ranking is walked to its end. Of wordings that overlap, the one with more words in agreement is named; the share
that a template saves of the wording itself decides among equals.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import pieces

#: Public license identifiers and the wordings of their notices.
NOTICES: tuple[tuple[str, str], ...] = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or"
        " (at your option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or"
        " (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
        "software and accompanying documentation covered by this license to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software.",
    ),
)
#: The names that short statements use.
NAMES: tuple[tuple[str, str], ...] = (
    ("MIT", "the MIT License"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "the Mozilla Public License, Version 2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("ISC", "the ISC License"),
    ("BSL-1.0", "the Boost Software License, Version 1.0"),
    ("EPL-2.0", "the Eclipse Public License, Version 2.0"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    ("CC-BY-4.0", "a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
#: How short statements begin.
OPENINGS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under")
TEMPLATES = (*NOTICES, *((name, f"{opening} {said}.") for name, said in NAMES for opening in OPENINGS))
_GAP = "[^a-z0-9]+"
#: A text must hold one of these. Every template has more of them than words of it may be edited.
SIGNALS = (
    *("licen", "copyright", "permission", "distribut", "warrant", "software", "binary", "mozilla"),
    *(f"public{_GAP}domain", f"under{_GAP}cc", f"creative{_GAP}commons", f"general{_GAP}public"),
)
#: Differing words allowed, as a share of the template's words.
TOLERANCE = 0.1
#: Fits and savings that a Python worker remembers.
REMEMBERED = 20_000
#: Words between the beginnings of blocks; a block reaches beyond the next one's beginning by the longest window.
BLOCK = 200

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_FREE = re.compile(rb"\0+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Match(NamedTuple):
    license: str
    template: int
    begin: int
    end: int
    saved: float
    differing: int


class Scanner:
    """Templates made ready: their words, a compressor with each as its dictionary, and their pieces.

    A template of which k words may be edited is cut into k + 1 pieces: at least one of them stays as it is.
    """

    def __init__(self, templates: tuple[tuple[str, str], ...]) -> None:
        self.names = [t[0] for t in templates]
        self.words = [words(t[1]) for t in templates]
        plain = [" ".join(w).encode() for w in self.words]
        kept = {"level": 6, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        raw = [zstandard.ZstdCompressionDict(p, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for p in plain]
        self.alone = zstandard.ZstdCompressor(**kept)
        self.given = [zstandard.ZstdCompressor(dict_data=d, **kept) for d in raw]
        self.allowed = [int(TOLERANCE * len(w)) for w in self.words]
        #: Any other word is 0.
        self.codes = {w: i for i, w in enumerate(dict.fromkeys(w for t in self.words for w in t), 1)}
        self.coded = [np.array([self.codes[w] for w in t], np.int32) for t in self.words]
        self.distinct = [set(c.tolist()) for c in self.coded]
        self.fits: dict[tuple[int, bytes], tuple[int, int, int] | None] = {}
        self.savings: dict[tuple[int, bytes], float] = {}
        self.rankings: dict[bytes, list[int]] = {}
        self.reach = max(len(w) + 3 * k for w, k in zip(self.words, self.allowed, strict=True))
        # By the code of a piece's longest word, which stands for a rare one, that word's place in it and its length.
        self.pieces: dict[int, dict[tuple[int, int], dict[bytes, list[tuple[int, int]]]]] = {}
        for i, said in enumerate(self.words):
            cuts = [len(said) * c // (self.allowed[i] + 1) for c in range(self.allowed[i] + 2)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at < end:
                    rare = max(range(at, end), key=lambda j: len(said[j]))
                    group = self.pieces.setdefault(self.codes[said[rare]], {}).setdefault((rare - at, end - at), {})
                    group.setdefault(self.coded[i][at:end].tobytes(), []).append((i, at))
        self.rare = np.zeros(len(self.codes) + 1, bool)
        self.rare[list(self.pieces)] = True

    def starts(self, said: np.ndarray) -> Iterator[tuple[int, int]]:
        """Templates of which a piece stands unedited in the coded words, and where each would begin."""
        for place in np.flatnonzero(self.rare[said]).tolist():
            for (before, length), pieces in self.pieces[int(said[place])].items():
                if before <= place:
                    for i, at in pieces.get(said[place - before : place - before + length].tobytes(), ()):
                        yield i, place - before - at

    def windows(self, said: np.ndarray) -> list[tuple[int, int, int]]:
        """Template, begin and end: any wording within the allowed edits lies in a window of its template."""
        found: list[tuple[int, int, int]] = []
        first = last = of = -1
        for i, start in sorted(set(self.starts(said))):
            if i == of and start <= first + self.allowed[i]:
                last = start
                found.pop()
            else:
                of, first, last = i, start, start
            k = self.allowed[i]
            found.append((i, max(first - k, 0), min(last + len(self.words[i]) + k, len(said))))
        return found

    def saved(self, i: int, found: str) -> float:
        """The share of the compressed size of the found words that a template saves."""
        data = " ".join(words(found)).encode()
        key = (i, data)
        if key not in self.savings:
            if len(self.savings) >= REMEMBERED:
                self.savings.clear()
            self.savings[key] = 1 - len(self.given[i].compress(data)) / len(self.alone.compress(data))
        return self.savings[key]

    def ranked(self, block: str) -> list[int]:
        """All templates, those first with which the words of a block compress best."""
        data = " ".join(words(block)).encode()
        if data not in self.rankings:
            if len(self.rankings) >= REMEMBERED // 10:
                self.rankings.clear()
            alone = len(self.alone.compress(data))
            less = [alone - len(given.compress(data)) for given in self.given]
            self.rankings[data] = sorted(range(len(less)), key=lambda i: (-less[i], i))
        return self.rankings[data]

    def candidates(self, said: np.ndarray) -> Iterator[tuple[int, int, dict[int, list[tuple[int, int]]]]]:
        """Blocks that hold a piece of a template: begin, end, and the windows of each template in it, every window in one block."""
        blocks: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, low, high in self.windows(said):
            blocks.setdefault(low // BLOCK, {}).setdefault(i, []).append((low, high))
        for at, windows in sorted(blocks.items()):
            yield at * BLOCK, min((at + 1) * BLOCK + self.reach, len(said)), windows

    def fit(self, i: int, said: np.ndarray) -> tuple[int, int, int] | None:
        """The closest part of the words to a template, if it is within the allowed edits: begin, end, edits."""
        k, size = self.allowed[i], len(self.coded[i])
        if len(said) < size - k:
            return None
        if not k:
            return (0, size, 0) if np.array_equal(said, self.coded[i]) else None
        key = (i, said.tobytes())
        if key not in self.fits:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            # Each word of the template that the part lacks is an edit.
            lacking = len(self.distinct[i].difference(said.tolist()))
            near = closest(self.coded[i].tolist(), said.tolist()) if lacking <= k else (0, 0, lacking)
            self.fits[key] = near if near[2] <= k else None
        return self.fits[key]

    def scan(self, text: str) -> Iterator[tuple[int, int, Match]]:
        """Begin and end of each confirmed wording, in characters, and what it is; places count in the lower-cased text.

        Templates are confirmed in each candidate block in the order of what they save in compressing it. The best fit of all is taken first. A fit that meets words already taken is sought again in what is left of its
        window.
        """
        lower = _lowered(text)
        codes, begins, ends = array("i"), array("i"), array("i")
        for w in _WORD.finditer(lower):
            codes.append(self.codes.get(w.group(), 0))
            begins.append(w.start())
            ends.append(w.end())
        said = np.array(codes, np.int32)
        taken = bytearray(len(said))
        waiting: list[tuple] = []

        def put(i: int, low: int, high: int) -> None:
            near = self.fit(i, said[low:high])
            if near is not None:
                begin, end, differing = near[0] + low, near[1] + low, near[2]
                saved = self.saved(i, lower[begins[begin] : ends[end - 1]])
                # More words in agreement win, then fewer edits; the ranking decides among equals.
                size = len(self.words[i])
                heapq.heappush(waiting, (differing - size, differing, -saved, -size, i, begin, end, low, high))

        for first, last, windows in self.candidates(said):
            for i in self.ranked(lower[begins[first] : ends[last - 1]]):
                for low, high in windows.get(i, ()):
                    put(i, low, high)
        matches = []
        while waiting:
            _, differing, less, _, i, begin, end, low, high = heapq.heappop(waiting)
            if not any(taken[begin:end]):
                taken[begin:end] = b"\1" * (end - begin)
                matches.append(Match(self.names[i], i, begin, end, -less, differing))
                continue
            for free in _FREE.finditer(taken, low, high):
                put(i, free.start(), free.end())
        for match in sorted(matches, key=lambda m: m.begin):
            yield begins[match.begin], ends[match.end - 1], match


def _lowered(text: str) -> str:
    """Lower case of the same length, so that places stay."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def closest(template: list[str], passage: list[str]) -> tuple[int, int, int]:
    """The part of the passage with the fewest word edits to the template: begin, end, edits. The first of equals."""
    ends = _edits(template, passage)
    end = int(np.argmin(ends))
    starts = _edits(template[::-1], passage[:end][::-1])
    # The longest start of equals would add words that agree with nothing.
    return end - int(np.argmin(starts)), end, int(ends[end])


def _edits(template: list[str], passage: list[str]) -> np.ndarray:
    """Fewest word edits between the template and some part of the passage that ends at each place."""
    codes = {w: i for i, w in enumerate(dict.fromkeys([*template, *passage]))}
    said = np.array([codes[w] for w in passage], np.int64)
    place = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    for i, word in enumerate(template, 1):
        kept = np.concatenate([[i], np.minimum(row[:-1] + (said != codes[word]), row[1:] + 1)])
        row = np.minimum.accumulate(kept - place) + place
    return row


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    if templates not in _SCANNERS:
        _SCANNERS[templates] = Scanner(templates)
    return _SCANNERS[templates]


FOUND = "doc_id long, place int, license string, template int, begin int, end int, saved double, differing int, words int"


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each license wording: ``doc_id, place, license, template, begin, end, saved, differing, words``.

    ``place`` numbers a document's wordings from 0; ``begin`` and ``end`` are characters of the text; ``saved`` is the
    share of the wording's compressed size that the template saves; ``differing`` counts the words edited, of the
    template's ``words``. Every document is looked at whole; documents without such wording, null texts among them, give
    no row. Repeated rows each get their rows, a null id stays null, an empty table gives no rows, other columns are
    ignored. Of templates that fit, the one with more words in agreement, then with fewer edits, then with more saved, is named.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates)
        for batch in pieces(batches, 500):
            out = []
            for doc, said in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for place, (begin, end, m) in enumerate(scanner.scan(said)):
                    out.append((doc, place, m.license, m.template, begin, end, m.saved, m.differing, len(scanner.words[m.template])))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FOUND.split(", ")])

    said = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Only texts with a signal leave the engine; the others can't hold a candidate.
    signalled = F.col("text").rlike("(?i)" + "|".join(SIGNALS))
    return said.where(signalled).mapInArrow(rows, FOUND)
