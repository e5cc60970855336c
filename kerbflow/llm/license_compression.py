"""License scans by conditional compression.

Sentences and lines with a license word, and what stands between them, form candidate blocks. All templates are compared
word by word with the blocks and the words around them: a template is confirmed for a span of words when hardly any of
its words is missing there and no difference is in a word that decides (``DECIDES``: a version, a variant, a negation); the
differences are reported. A span is compressed alone and with each template as raw
dictionary; the share of the compressed size that a template saves ranks it among the others.

Every confirmed template and span is a row, so a text under two licenses gives both. Of confirmed templates that rest on
the same words of the text, the one that lacks the smallest share of its own words is reported (then the longer one,
then the one that saves more, then by name). A block that no confirmed span touches gives one unconfirmed row with the
template that saves most.

Defined results: NULL and empty texts, and texts without a license word, have no block. Every row is scanned by itself,
whole (a sentence of more than ``UNIT_WORDS`` words is cut into several), so repeated rows give repeated blocks, told
apart by nothing but their number. Equal savings rank by template name. An empty table gives no block. Only doc_id and
text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import bounded_batches

# Public license notices, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-header": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"),
}
FAMILY = "you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version."
# The same notices for other versions and variants, and further public notices.
TEMPLATES |= {
    "AGPL-3.0-header": "This program is free software: " + FAMILY.format("Affero General Public License", ",", "3"),
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty."),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; " + FAMILY.format("General Public License", ";", "2"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1-header": "This library is free software; " + FAMILY.format("Lesser General Public License", ";", "2.1"),
    "LGPL-3.0-header": "This library is free software: " + FAMILY.format("Lesser General Public License", ",", "3"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}
#: A difference in such a word makes another license of it, or none: variants, negations and versions (years are none).
DECIDES = re.compile(
    r"(?:.*(?:lesser|library|affero|noncommercial|sharealike|noderiv|n't)|not|non|never|neither|nor|longer|cannot|except|excluding|by|nc|sa|nd)\W*"
    r"|\W*v?(?!(?:19|20)\d\d\W*$)\d+(?:\.\d+)*\W*|.*-(?:nc|sa|nd)\b.*", re.S)
MARKS = ".,;:!?()[]\"'"
NEGATION = re.compile(r"(?:not|never|neither|nor|longer|cannot|.*n't)\W*")
CUE = r"licen[cs]e|copyright|warrant(?:y|ies)|permission is hereby|redistribut|creative commons|\bCC BY\b"
UNIT = re.compile(r"\S[^\n]*?(?:[.:;!?](?=\s)|(?=\n)|$)", re.M)
UNIT_WORDS, BLOCK_WORDS, GAP = 200, 400, 2
WORD = re.compile(r"\S+")
SCHEMA = ("doc_id bigint, block int, start bigint, length int, license string, rank int, saved double, missing int, extra int, "
          "confirmed boolean, differences string, text string")


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def blocks(text: str) -> list[tuple[int, int]]:
    """Character ranges of the candidate blocks."""
    cue = re.compile(CUE, re.I)
    if not cue.search(text):
        return []
    units = []
    for m in UNIT.finditer(text):
        words = list(WORD.finditer(m[0]))
        for k in range(0, len(words), UNIT_WORDS):
            part = words[k:k + UNIT_WORDS]
            units.append((m.start() + part[0].start(), m.start() + part[-1].end(), len(part)))
    out: list[list[int]] = []  # first unit, last unit, words
    for i, (start, end, n) in enumerate(units):
        if not cue.search(text, start, end):
            continue
        if out and i - out[-1][1] <= GAP + 1 and (size := out[-1][2] + sum(u[2] for u in units[out[-1][1] + 1:i + 1])) <= BLOCK_WORDS:
            out[-1][1:] = [i, size]
        else:
            out.append([i, i, n])
    return [(units[a][0], units[b][1]) for a, b, _ in out]


def aligned(want: list[str], have: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places."""
    rest = [[0] * (len(have) + 1) for _ in range(len(want) + 1)]
    for i in range(len(want) - 1, -1, -1):
        row, below = rest[i], rest[i + 1]
        for j in range(len(have) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if want[i] == have[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(want) and j < len(have):
        if want[i] == have[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rest[i + 1][j] >= rest[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


class Scanner:
    """Compressors for every template, and the comparison of a text with them."""

    def __init__(self, templates: dict[str, str], least: float = 0.2, lost: float = 0.1):
        self.templates = {name: plain(t) for name, t in sorted(templates.items())}
        self.words = {name: t.split() for name, t in self.templates.items()}
        self.least, self.lost = least, lost
        self.around = 3 * max(map(len, self.words.values()))
        how = zstandard.ZstdCompressionParameters.from_level(
            19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = zstandard.ZstdCompressor(compression_params=how)
        self.given = {name: zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(
            t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, t in self.templates.items()}

    def ranked(self, block: str) -> list[tuple[str, float]]:
        """Templates by the share of the compressed size that they save."""
        data = plain(block).encode("utf-8", "replace")
        size = len(self.alone.compress(data))
        saved = {name: 1 - len(c.compress(data)) / size for name, c in self.given.items()}
        return sorted(saved.items(), key=lambda x: (-x[1], x[0]))

    def same_license(self, name: str, have: list[str], before: list[str], after: list[str]) -> bool:
        """Whether no difference between the template and the words of a span decides which license it is.

        ``before``: the words before the span, where a negation counts too; ``after``: the word behind it, which may be the
        template's last one with another mark.
        """
        want = self.words[name]
        same = aligned(want, have)
        mine, theirs = {i for i, _ in same}, {j for _, j in same}
        lost = {w.strip(MARKS) for i, w in enumerate(want) if i not in mine}
        added = {w.strip(MARKS) for j, w in enumerate(have) if j not in theirs}
        lost -= {w.strip(MARKS) for w in after}
        return not any(DECIDES.fullmatch(w) for w in lost ^ added) and not any(NEGATION.fullmatch(w) for w in before)

    def differences(self, name: str, block: str) -> tuple[int, int, str]:
        """Words of the template that the block lacks, words it has besides, and each difference in wording."""
        want, have = self.words[name], plain(block).split()
        same, shown, i, j = aligned(want, have), [], 0, 0
        for a, b in [*same, (len(want), len(have))]:
            if (i, j) != (a, b):
                shown.append(f"-[{' '.join(want[i:a])}] +[{' '.join(have[j:b])}]")
            i, j = a + 1, b + 1
        return len(want) - len(same), len(have) - len(same), "; ".join(shown)

    def spans(self, name: str, have: list[str]) -> list[tuple[int, int]]:
        """Disjoint ranges of ``have`` that lack at most the share ``lost`` of the template's words, closest wording first.

        For every place where such a range can begin, the common subsequence with the template is grown word by word (bits
        of ``open``: template words not matched yet), and the end with the fewest missing and added words is taken.
        """
        want = self.words[name]
        m, most = len(want), int(self.lost * len(want))
        present = set(have)
        if sum(w not in present for w in want) > most:
            return []
        places: dict[str, int] = {}
        for i, w in enumerate(want):
            places[w] = places.get(w, 0) | 1 << i
        heads, full, reach = set(want[:most + 1]), (1 << m) - 1, max(BLOCK_WORDS, 3 * m)
        found = []
        for s, w in enumerate(have):
            if w not in heads:
                continue
            open_, best = full, None
            for e in range(s, min(s + reach, len(have))):
                if (bits := places.get(have[e])) is None:
                    continue
                u = open_ & bits
                open_ = ((open_ + u) | (open_ - u)) & full
                missing = open_.bit_count()
                if missing <= most and (best is None or 2 * missing + e + 1 - s - m < best[0]):
                    best = (2 * missing + e + 1 - s - m, s, e + 1)
            if best:
                found.append(best)
        out, taken = [], bytearray(len(have))
        for _, s, e in sorted(found):
            if not any(taken[s:e]):
                taken[s:e] = b"\1" * (e - s)
                out.append((s, e))
        return out

    def confirmed(self, text: str, found: list[tuple[int, int]]) -> list[tuple]:
        """start, end, license, rank, saved, missing, extra, differences of every confirmed template and span around blocks."""
        tokens = [(m.start(), m.end()) for m in WORD.finditer(text)]
        starts, ends = [a for a, _ in tokens], [b for _, b in tokens]
        regions: list[list[int]] = []
        for start, end in found:
            a, b = max(bisect_right(ends, start) - self.around, 0), min(bisect_left(starts, end) + self.around, len(tokens))
            if regions and a <= regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], b)
            else:
                regions.append([a, b])
        hits = []
        for a, b in regions:
            have = [text[s:e].lower() for s, e in tokens[a:b]]
            for name, want in self.words.items():
                for s, e in self.spans(name, have):
                    if not self.same_license(name, have[s:e], have[max(s - 3, 0):s], have[e:e + 1]):
                        continue
                    start, end = tokens[a + s][0], tokens[a + e - 1][1]
                    missing, extra, shown = self.differences(name, text[start:end])
                    rank, saved = next((k, x) for k, (other, x) in enumerate(self.ranked(text[start:end]), 1) if other == name)
                    # a notice drawn out over many other words must also save enough of them
                    if extra <= 2 * len(want) or saved >= self.least:
                        same = frozenset(a + s + j for _, j in aligned(want, have[s:e]))
                        hits.append((missing / len(want), -len(want), -saved, name, same,
                                     (start, end, name, rank, round(saved, 6), missing, extra, shown)))
        kept: list[tuple] = []
        owners: dict[int, list[frozenset]] = {}
        for *_, same, row in sorted(hits, key=lambda h: h[:4]):
            if not any(same <= other for other in owners.get(min(same), [])):
                kept.append(row)
                for at in same:
                    owners.setdefault(at, []).append(same)
        return sorted(kept)

    def scan(self, text: str) -> Iterator[tuple]:
        """Rows (block number, start, length, license, rank, saved, missing, extra, confirmed, differences, text).

        One for each confirmed template and span, under the first block it touches (or the next one), and one for each
        block without any.
        """
        found = blocks(text)
        rows, touched = [], set()
        for start, end, *row, shown in self.confirmed(text, found) if found else []:
            number = min(bisect_right([b for _, b in found], start), len(found) - 1)
            touched.update(k for k in range(number, len(found)) if found[k][0] < end and start < found[k][1])
            rows.append((number, start, end - start, *row, True, shown, text[start:end]))
        for number, (start, end) in enumerate(found):
            if number not in touched:
                block = text[start:end]
                name, saved = self.ranked(block)[0]
                missing, extra, shown = self.differences(name, block)
                rows.append((number, start, end - start, name, 1, round(saved, 6), missing, extra, False, shown, block))
        return iter(sorted(rows))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Confirmed licenses and unconfirmed blocks of ``docs``; see ``Scanner.scan``."""
    bounded_batches(docs.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(),
             pa.string(), pa.string()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(doc_id, *row) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for row in scanner.scan(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.where(F.col("text").rlike(f"(?i){CUE}")).select("doc_id", "text").mapInArrow(search, SCHEMA)
