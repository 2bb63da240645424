"""License scans by conditional compression.

Blocks around licence cues are compressed alone and with each template as a raw zstandard
dictionary. Templates that make the block smaller by at least ``SHARE`` of what they save on their own text, or by
``LEAST_SAVED`` bytes, are ranked by the bytes saved; no other is looked at. They are compared word by word in
that order, and the first that is confirmed names the notice. The exact wording comes first, then
wordings with differences: the block is aligned with the template word by word, and the inserted, missing and
replaced words are reported. They are harmless (a subject, a holder, a verb) unless one is in ``TELLING`` or
has a digit, which would make another licence or version of it; at most a ``DIFFERENT``-th of a template's words may
differ. Last, an excerpt of at least ``EXCERPT`` words that fills its lines counts if it fits the templates of one
licence alone. Words are runs of letters and digits in lower case, so marks and capitals make no difference, but
"2.0" and "3.0" do.

Null texts are empty texts without blocks. Repeated rows give a row each. Texts are read whole;
blocks run over line ends, ``REACH`` words (more than the longest template) on both sides of a cue.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import Recent, query, read, text_of, text_pieces

EXCERPT = 8
DIFFERENT = 4
#: A template is tried if it saves this share of what it saves on itself, or so many bytes.
SHARE = 0.35
LEAST_SAVED = 24
#: Characters on either side of a cue in which short templates are looked for.
NEAR = 120
BATCH_BYTES = 8_000_000

# Public licence notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    *(
        (f"{short}-{version}.0-or-later", f"This work is licensed under the GNU {long}General Public License, version {version}{later}.")
        for short, long, versions in (("GPL", "", (2, 3)), ("AGPL", "Affero ", (3,)), ("LGPL", "Lesser ", (3,)))
        for version in versions
        for later in (" or later", ", or any later version", ", or (at your option) any later version")
    ),
    (
        "GPL-2.0-or-later",
        "it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0-or-later",
        "it under the terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0-or-later",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-3.0-or-later",
        "it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    *(
        (f"CC-{short}-4.0", f"Licensed under CC {short} 4.0.") for short in ("BY-ND", "BY-NC-SA", "BY-NC-ND")
    ),
    *(
        (f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License.")
        for short, long in (
            ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
            ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    ),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("all-rights-reserved", "All rights reserved."),
    ("EPL-2.0", "Licensed under the Eclipse Public License 2.0."),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0",
    ),
    ("ISC", "Licensed under the ISC License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"),
    (
        "BSD",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
)
CUE = re.compile(
    r"licen[cs]e|\brights\W+reserved|permission\W+is\W+hereby|redistribution\W+and\W+use"
    r"|public\W+license|\bcc\W+by|\bcc0|permission\W+to\W+use|unencumbered|neither\W+the\W+name",
    re.IGNORECASE,
)
WORD = re.compile(r"[^\W_]+")
#: Words that tell licences, their versions and conditions apart; so do all words with a digit.
TELLING = frozenset(
    "mit apache gnu gpl lgpl agpl affero lesser library general public mozilla mpl bsd isc eclipse european "
    "creative commons cc by nc sa nd attribution noncommercial commercial sharealike share alike "
    "noderivatives derivatives no not non without never neither nor only except unless prohibited forbidden "
    "denied version v later either option license licence rights reserved all permission granted "
    "redistribution permitted universal international unported".split()
)
#: Cost of a difference in such a word; more than any number of other differences that may pass.
OTHER = 1000
#: Words of a block on either side of its cue.
REACH = 8 + max(len(WORD.findall(text)) for _, text in TEMPLATES)


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of ``REACH`` words around the cues, whatever the lines; overlapping ones are joined."""
    found: list[list[int]] = []
    for cue in CUE.finditer(text):
        first, end = before(text, cue.start()), cue.end()
        for i, word in enumerate(WORD.finditer(text, cue.end())):
            end = word.end()
            if i == REACH:
                break
        if found and first <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([first, end])
    return [(a, b) for a, b in found]


def before(text: str, end: int) -> int:
    """Start of the ``REACH`` words in front of a place, or of the first word there is."""
    size = 512
    while True:
        first = max(0, end - size)
        starts = [m.start() for m in WORD.finditer(text, first, end)]
        # a word at the very edge may have begun earlier
        if first == 0 or len(starts) > REACH:
            return starts[-REACH:][0] if starts else end
        size *= 4


def plain_words(text: str) -> bytes:
    """The words of a text as they are compressed: lower case, a blank between them."""
    return " ".join(WORD.findall(text)).lower().encode()


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.templates = [
            (name, [w.lower() for w in WORD.findall(text)], text) for name, text in templates
        ]
        self.plain = zstandard.ZstdCompressor(level=19)
        self.given = [
            zstandard.ZstdCompressor(
                level=19,
                dict_data=zstandard.ZstdCompressionDict(
                    plain_words(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
            )
            for _, _, text in self.templates
        ]
        #: what each template saves on its own text, the most there is to save
        texts = [plain_words(text) for _, _, text in self.templates]
        self.own = [len(self.plain.compress(t)) - len(g.compress(t)) for t, g in zip(texts, self.given)]
        self.judged = Recent(self._judge, 20_000)

    def ranked(self, block: str) -> list[int]:
        """The templates that the block is likely to hold: those that save enough bytes, best first.

        Saving is measured against what a template saves on itself, since a short one cannot save much.
        """
        saved = [0] * len(self.given)
        # a short template hardly shows in a long block, so the surroundings of each cue are compressed, too
        for part in {block, *(block[max(0, m.start() - NEAR) : m.end() + NEAR] for m in CUE.finditer(block))}:
            data = plain_words(part)
            alone = len(self.plain.compress(data))
            saved = [max(n, alone - len(given.compress(data))) for n, given in zip(saved, self.given)]
        likely = [i for i, n in enumerate(saved) if n >= min(self.own[i] * SHARE, LEAST_SAVED)]
        return sorted(likely, key=lambda i: (-saved[i], i))

    def wording(self, words: list[str], i: int, lines) -> tuple[int, int, str] | None:
        """Word span with the template's exact wording."""
        template = self.templates[i][1]
        size = len(template)
        for at in range(len(words) - size + 1):
            if words[at] == template[0] and words[at : at + size] == template:
                return at, at + size, ""
        return None

    def nearly(self, words: list[str], i: int, lines) -> tuple[int, int, str] | None:
        """Word span that differs from the template in harmless words only, with the differences."""
        template = self.templates[i][1]
        found = align(words, template, len(template) // DIFFERENT)
        # a version or condition that goes on right behind (or stands right before) is another one's
        if found and any(
            telling(words[at]) for at in (found[0] - 1, found[1]) if 0 <= at < len(words) and at in lines[2]
        ):
            return None
        return found

    def excerpt(self, words: list[str], i: int, lines) -> tuple[int, int, str] | None:
        """Longest run of whole lines that is a part of this template and of no other licence's."""
        name, template, _ = self.templates[i]
        starts, ends, _ = lines
        best = None
        for at in starts:
            for place, word in enumerate(template):
                if word != words[at]:
                    continue
                size = 0
                while at + size < len(words) and place + size < len(template) and words[at + size] == template[place + size]:
                    size += 1
                while size >= EXCERPT and at + size not in ends:
                    size -= 1
                if size < EXCERPT or best and size <= best[1] - best[0]:
                    continue
                part = f" {' '.join(words[at : at + size])} "
                if {n for n, t, _ in self.templates if part in f" {' '.join(t)} "} == {name}:
                    best = at, at + size, "excerpt"
        return best

    def _judge(self, block: str) -> list[tuple[str, int, int, str]]:
        """(licence, start, end, differences) of confirmed wordings within the block, by place."""
        # every notice takes its own wording out, so that the next best can show
        found, rest = [], block
        while True:
            hit = None
            words = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(rest)]
            if not words:
                break
            lines = lines_of(rest, words)
            plain = [w for w, _, _ in words]
            order = self.ranked(rest)
            for step in (self.wording, self.nearly, self.excerpt):
                hits = [(i, h) for i in order if (h := step(plain, i, lines))]
                if hits:
                    which, hit = hits[0]
                    # "version 2 or later" holds "version 2": the longer one is what is said
                    if step == self.wording:
                        hits += [(i, h) for i in order if (h := self.nearly(plain, i, lines))]
                    for i, h in hits[1:]:
                        if h[0] <= hit[0] and hit[1] <= h[1] and h[1] - h[0] > hit[1] - hit[0]:
                            which, hit = i, h
                    break
            if not hit:
                break
            first, end = words[hit[0]][1], words[hit[1] - 1][2]
            found.append((self.templates[which][0], first, end, hit[2]))
            rest = rest[:first] + " " * (end - first) + rest[end:]
        return sorted(found, key=lambda f: f[1])

    def examine(self, text: str) -> tuple[int, list[tuple[str, int, int, str]]]:
        spans = blocks(text)
        found = [(n, a + s, a + e, d) for a, b in spans for n, s, e, d in self.judged[text[a:b]]]
        return len(spans), found

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int]]]:
        size, found = self.examine(text)
        return size, [f[:3] for f in found]


def telling(word: str) -> bool:
    return word in TELLING or any(c.isdigit() for c in word)


def align(words: list[str], template: list[str], most: int) -> tuple[int, int, str] | None:
    """Best place of the template among the words by edit distance, and its differences as
    ``+inserted``, ``-missing`` and ``missing>inserted``; none if more than ``most`` words or a
    telling one differ."""
    # an added "by" is followed by a name; only a template's own one ("CC BY") tells
    cost = [OTHER if telling(w) and w != "by" else 1 for w in words]
    rows = [[0] * (len(words) + 1)]
    for wanted in template:
        last, gone = rows[-1], OTHER if telling(wanted) else 1
        row = [last[0] + gone]
        for j, word in enumerate(words):
            swap = last[j] + (0 if word == wanted else max(gone, cost[j]))
            row.append(min(swap, last[j + 1] + gone, row[j] + cost[j]))
        if min(row) > most:
            return None
        rows.append(row)
    i, j = len(template), min(range(len(words) + 1), key=rows[-1].__getitem__)
    end, changes = j, []
    while i:
        row, last = rows[i], rows[i - 1]
        gone = OTHER if telling(template[i - 1]) else 1
        same = j and words[j - 1] == template[i - 1]
        if j and row[j] == last[j - 1] + (0 if same else max(gone, cost[j - 1])):
            i, j = i - 1, j - 1
            if not same:
                changes.append(f"{template[i]}>{words[j]}")
        elif row[j] == last[j] + gone:
            i -= 1
            changes.append(f"-{template[i]}")
        else:
            j -= 1
            changes.append(f"+{words[j]}")
    return (j, end, " ".join(reversed(changes))) if end > j else None


def lines_of(text: str, words: list[tuple[str, int, int]]) -> tuple[list[int], set[int], set[int]]:
    """Places of the words that begin a line, the places after those that end one, and the places on
    either side of a joint within one name, like the one in "2.0" or "BY-NC"."""
    gaps = {i: text[words[i - 1][2] : words[i][1]] for i in range(1, len(words))}
    breaks = [i for i, gap in gaps.items() if "\n" in gap]
    joints = {k for i, gap in gaps.items() if gap in (".", "-", "/", "+") for k in (i - 1, i)}
    return [0, *breaks], {*breaks, len(words)}, joints


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in text_pieces(batches, "text", BATCH_BYTES):
        results = [scanner.examine(t) for t in batch.column("text").to_pylist()]
        names = [sorted({n for n, *_ in found}) for _, found in results]
        spans = [",".join(f"{n}:{a}:{b}" for n, a, b, _ in found) for _, found in results]
        changes = [",".join(f"{n}:{a}:{b}:{d}" for n, a, b, d in found if d) for _, found in results]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([n for n, _ in results], pa.int64()),
                pa.array([len(found) for _, found in results], pa.int64()),
                pa.array([",".join(n) for n in names], pa.string()),
                pa.array(spans, pa.string()),
                pa.array(changes, pa.string()),
            ],
            ["doc_id", "n_blocks", "n_notices", "licenses", "spans", "differences"],
        )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: blocks, confirmed notices, their licences (sorted), places in code points, and how
    the notices that are not worded like their template differ from it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        _scan,
        f"doc_id {kind}, n_blocks bigint, n_notices bigint, licenses string, spans string, differences string",
    )


@query("op1_license_scans")
def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
