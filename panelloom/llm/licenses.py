"""License notices by conditional compression.

Text around a word that license notices use is a candidate block. It is compressed with each template
as a raw zstandard dictionary; the templates that shrink it are compared word by word, and a
notice is reported with its exact wording differences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wordings by SPDX identifier; {} stands for any words, such as a year and a holder.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "Licensed under the GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-3.0",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CC0-1.0": [
        "Released under CC0 1.0",
        "To the extent possible under law, {} has waived all copyright and related or neighboring rights",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "all-rights-reserved": ["Copyright {} All rights reserved", "All rights reserved"],
}

WORD = re.compile(r"\{\}|[^\W_]+(?:[.-][^\W_]+)*")
LEVEL = 9
LONG = 6  # letters of words that are rare enough for a cue
SLOT = 1000  # words that a slot may take; more are prose between two mentions
SLOT_CHARS = 16 * SLOT
CHANGED = 0.1  # share of a template's words that may differ; words with a digit never may


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def align(template: Sequence[str], words: Sequence[str]) -> tuple[int, int, list[str], list[str]]:
    """The run of ``words`` that is closest to the template: start, end, words missing, words added.

    Least number of words missing, added or replaced; a replaced word is one change, in both lists. A
    word is replaced by a like one rather than left out, and left out rather than replaced by an unlike one. Ties go to
    the earliest and shortest run. A slot ``{}`` takes any words for nothing.
    """
    width = len(words) + 1
    swap = [[_swap(x, w) for w in words] for x in template]
    cost = [[0] * width]
    for i, x in enumerate(template, 1):
        above, row = cost[-1], [cost[-1][0] + (0 if x == "{}" else CHANGE)]
        for j in range(1, width):
            if x == "{}":
                row.append(min(above[j], row[j - 1]))
            else:
                row.append(min(above[j - 1] + swap[i - 1][j - 1], above[j] + CHANGE, row[j - 1] + CHANGE))
        cost.append(row)
    j = end = min(range(width), key=lambda j: (cost[-1][j], j))
    i, missing, added = len(template), [], []
    while i:
        x = template[i - 1]
        if x == "{}":
            if cost[i][j] == cost[i - 1][j]:
                i -= 1
            else:
                j -= 1
        elif j and cost[i][j] == cost[i - 1][j - 1] + swap[i - 1][j - 1]:
            if x != words[j - 1]:
                missing.append(x)
                added.append(words[j - 1])
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + CHANGE:
            missing.append(x)
            i -= 1
        else:
            added.append(words[j - 1])
            j -= 1
    return j, end, missing[::-1], added[::-1]


CHANGE = 8  # cost of a change; a like word in place of another costs one less, so that it wins a tie


def _swap(x: str, w: str) -> int:
    if x == w:
        return 0
    alike = x[:1] == w[:1] and abs(len(x) - len(w)) < 3 and SequenceMatcher(None, x, w).ratio() >= 0.7
    return CHANGE - 1 if alike else CHANGE


def cues(templates: Mapping[str, Sequence[str]]) -> str:
    """A regular expression, for Java and Python, that matches a word of every notice of the templates.

    Of each wording it has one word more than may be changed, the longest ones; where these are short, and so
    common, all of its words. Of a wording with a slot the words before the slot count.
    """
    picked: set[str] = set()
    for text in (w for listed in templates.values() for w in listed):
        words = [w for w, _, _ in words_of(text)]
        cut = words.index("{}") if "{}" in words else len(words)
        part = [w for w in words[:cut] if w != "{}"] or [w for w in words if w != "{}"]
        longest = sorted(set(part), key=lambda w: (-len(w), w))
        need = allowed(words) + 1
        if not longest:
            raise ValueError(f"a wording without a word: {text!r}")
        if need > 1 and len(longest) >= need and len(longest[need - 1]) < LONG:
            fixed = [w for w in longest if any(c.isdigit() for c in w)]
            longest, need = (fixed, 1) if fixed else (longest, need)
        picked.update(longest[:need])
    return "(?iu)(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(picked, key=lambda w: (-len(w), w)))) + ")(?![a-z0-9])"


def allowed(template: Sequence[str]) -> int:
    """How many words of a template may be changed: a share, and one of at least four."""
    n = sum(w != "{}" for w in template)
    return max(int(CHANGED * n), 1 if n >= 4 else 0)


class Scanner:
    """Templates as words and as compressors that know them."""

    def __init__(self, templates: Mapping[str, Sequence[str]]) -> None:
        wordings = [(name, w) for name, listed in templates.items() for w in listed]
        self.cue = re.compile(cues(templates))
        self.names = [name for name, _ in wordings]
        self.words = [[w for w, _, _ in words_of(text)] for _, text in wordings]
        self.bags = [Counter(x for x in w if x != "{}") for w in self.words]
        # Words that name a license occur with a third of the licenses at most.
        ids: dict[str, set[str]] = {}
        for name, listed in zip(self.names, self.words, strict=True):
            for w in listed:
                for x in {w, *re.split(r"[.-]", w)}:
                    ids.setdefault(x, set()).add(name)
        some = len(templates) // 3
        self.naming = {w for w, of in ids.items() if len(of) <= max(1, some)} if len(templates) > 1 else set()
        self.reach = max(len(text) for _, text in wordings) + 40
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.primed = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(
                    " ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
            )
            for w in self.words
        ]

    def scan(self, text: str) -> list[tuple]:
        """(start, end, license, reduction, differences, exact, wording) of each notice in a text."""
        found: list[tuple] = []
        done = 0
        for cue in self.cue.finditer(text):
            if cue.start() < done:
                continue
            first = max(done, cue.start() - self.reach)
            words = words_of(text[first : cue.end() + self.reach])
            best = self.rank(words, cue.start() - first, text, first)
            if best:
                start, end, name, reduction, missing, added = best
                changes = " ".join([*(f"-{w}" for w in missing), *(f"+{w}" for w in added)])
                span = (first + start, first + end)
                found.append((*span, name, reduction, changes, not changes, text[slice(*span)]))
                done = span[1]
        return found

    def block(
        self, k: int, words: list[tuple[str, int, int]], at: int, text: str, first: int
    ) -> list[tuple[str, int, int]]:
        """The words around the one at ``at`` that may hold template ``k``; a slot reaches to the template's next words."""
        template = self.words[k]
        begin = max(0, at - len(template))
        if "{}" not in template[:-1]:
            return words[begin : at + len(template) + 8]
        after = template[len(template) - template[::-1].index("{}") :]
        if not after:
            return words[begin : at + len(template) + 8]
        anchor = max(after, key=len)
        start = first + words[at][2]
        there = re.compile(rf"(?i)(?<![^\W_]){re.escape(anchor)}(?![^\W_])").search(text, start, start + SLOT_CHARS)
        if there is None:
            return words[begin : at + len(template) + 8]
        longer = words_of(text[first : there.end() + self.reach])
        last = next((i for i, w in enumerate(longer) if w[2] >= there.end() - first), len(longer))
        return longer[begin : last + len(template)]

    def firm(self, k: int, missing: list[str], added: list[str]) -> bool:
        """If the changes leave the license the same: few, no numbers, and in short wordings no word that names a license."""
        changed = Counter(missing), Counter(added)
        if max(len(missing), len(added)) > allowed(self.words[k]) or any(c.isdigit() for w in missing + added for c in w):
            return False
        plain = sum(w != "{}" for w in self.words[k])
        return int(CHANGED * plain) > 1 or not any(w in self.naming for c in changed for w in c)

    def rank(self, words: list[tuple[str, int, int]], cue: int, text: str, first: int) -> tuple | None:
        """The first confirmed template in the order of the bytes that it saves as a dictionary of its block.

        Ties go to the wording with fewest differences, then the longest.
        """
        at = next((i for i, w in enumerate(words) if w[2] > cue), None)
        if at is None:
            return None
        ranking = []
        near = Counter(w for w, _, _ in words)
        for k, template in enumerate(self.words):
            slot = "{}" in template
            if not slot and (self.bags[k] - near).total() > allowed(template):
                continue  # more words are missing than may be changed
            block = self.block(k, words, at, text, first)
            if (self.bags[k] - Counter(w for w, _, _ in block)).total() > allowed(template):
                continue
            data = " ".join(w for w, _, _ in block).encode()
            plain = len(self.plain.compress(data))
            saved = plain - len(self.primed[k].compress(data))
            if saved > 0:
                ranking.append((saved, saved / plain, k, block))
        ranking.sort(key=lambda r: (-r[0], -len(self.words[r[2]]), r[2]))
        best, most = None, None
        for saved, reduction, k, block in ranking:
            if best and saved < most:
                break
            template = self.words[k]
            i, j, missing, added = align(template, [w for w, _, _ in block])
            if not (i < j and block[i][1] <= cue < block[j - 1][2] and self.firm(k, missing, added)):
                continue
            start, end = block[i][1], block[j - 1][2]
            if "{}" in template:
                if j - i > SLOT + len(template):
                    continue
                if any(f[2] != self.names[k] for f in self.scan(text[first + block[i][2] : first + end])):
                    continue  # the slot would swallow another notice
            key = (max(len(missing), len(added)), -len(template), k)
            if best is None or key < best[0]:
                best, most = (key, start, end, self.names[k], reduction, missing, added), saved
        return best and best[1:]


FOUND = (
    "start long, end long, license string, reduction double, differences string, "
    "exact boolean, wording string"
)


def scan_licenses(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
) -> DataFrame:
    """One row for each notice: (doc_id, start, end, license, reduction, differences, exact, wording).

    start and end count code points of the text. Documents without a notice, null and empty texts give no
    row; repeated rows give their notices again. Whole texts are searched; where several wordings fit, the
    one that saves most bytes as a dictionary counts, of equal ones that with fewest differences, then the longest.
    A slot takes SLOT words at most. Other columns of ``docs`` are not read.
    """
    candidates = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    candidates = candidates.where(F.col("text").rlike(cues(templates)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for batch in batches:
            for doc, found in zip(batch["doc_id"], map(scanner.scan, batch["text"]), strict=True):
                if found:
                    rows = [(None if pd.isna(doc) else doc, *f) for f in found]
                    yield pd.DataFrame(rows, columns=["doc_id", *NAMES])

    kind = dict(candidates.dtypes)["doc_id"]
    return candidates.mapInPandas(run, f"doc_id {kind}, {FOUND}")


NAMES = [part.split()[0] for part in FOUND.split(", ")]
