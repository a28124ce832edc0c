"""License scans: winnowed fingerprints find candidates, alignment decides.

Templates are fingerprinted by winnowing: of every ``WINDOW`` neighbouring
hashes of ``GRAM`` letters and digits the smallest is kept. They form an inverted
index from hash to (template, place). A text is winnowed whole in the same way;
a hash it shares with the index proposes a template at a place. Around each
proposed place the words of template and text are aligned within a band, and a
match is reported if enough of the template's words are found in order and the
words that tell licenses apart are the same: between its ends, a match has the
``NAMES`` of the template and no others, and the numbers of the template in order.

* NULL, empty texts and texts without letters and digits have no matches.
* Case, punctuation and line breaks do not count.
* Of overlapping matches the one with most matched words stays, then the one
  with the larger coverage, then the earlier one.
* Equal rows get equal results; an empty table gives an empty result.
* The index is held by every task; templates are a fixed, short list of notices.
  Full license texts are not among them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seston.llm.common import over_texts

GRAM = 10
WINDOW = 4
BAND = 6
COVERAGE = 0.8
WORD = re.compile(rb"[a-z0-9]+")

#: words that carry the identity of a license
NAMES = frozenset(
    b"apache mit bsd isc mozilla mpl gnu gpl lgpl agpl general lesser library affero cc cc0 creative commons zero by nc "
    b"nd sa attribution noncommercial noderivatives noderivs sharealike eclipse boost artistic eupl unlicense zlib".split()
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the "
    "Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
#: fixed values: short notices of public licenses
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    *[
        (f"CC-{short}-4.0", text)
        for short, name in [
            ("BY-SA", "ShareAlike"), ("BY-ND", "NoDerivatives"),
            ("BY-NC-SA", "NonCommercial-ShareAlike"), ("BY-NC-ND", "NonCommercial-NoDerivatives"),
        ]
        for text in (
            f"Licensed under CC {short} 4.0.",
            f"This work is licensed under a Creative Commons Attribution-{name} 4.0 International License.",
        )
    ],
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    *[
        (spdx, text)
        for spdx, name, version in [
            ("GPL-2.0", "GNU General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
            ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"),
        ]
        for text in (f"This work is licensed under the {name}, version {version}.", _GNU.format(name, version))
    ],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("ISC", "Licensed under the ISC License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
]
_COUNTS = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_POWERS = np.array([pow(0x100000001B3, j, 2**64) for j in range(GRAM)], np.uint64)


def winnowed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes of lower-cased text and the byte at which each gram begins."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_COUNTS[raw])
    if len(at) < GRAM:
        return np.empty(0, np.uint64), at[:0]
    s = raw[at].astype(np.uint64)
    n = len(s) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h += s[j : j + n] * _POWERS[j]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    w = min(WINDOW, n)
    least = h[: n - w + 1].copy()
    for j in range(1, w):
        np.minimum(least, h[j : j + len(least)], out=least)
    kept = np.zeros(n, bool)
    for j in range(w):
        kept[j : j + len(least)] |= h[j : j + len(least)] == least
    return h[kept], at[:n][kept]


def align(template: list[bytes], words: list[bytes], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Most template words found in order within a band around the diagonal
    ``shift``: their number, and the first and last text word among them."""
    best = {}  # column -> (found, first, last) after the rows so far
    for i, t in enumerate(template):
        row = {}
        left = (0, -1, -1)
        for j in range(max(0, i + shift - band), min(len(words), i + shift + band + 1)):
            up = max(best.get(j, (0, -1, -1)), left, key=lambda x: x[0])
            if words[j] == t:
                before = best.get(j - 1, (0, -1, -1))
                if before[0] + 1 > up[0]:
                    up = (before[0] + 1, j if before[1] < 0 else before[1], j)
            row[j] = left = up
        # columns that fall out of the band keep what they had
        best = {j: max(row.get(j, (0, -1, -1)), best.get(j, (0, -1, -1)), key=lambda x: x[0]) for j in {*row, *best} if j >= i + shift - band - 1}
    return max(best.values(), key=lambda x: (x[0], -(x[2] - x[1])), default=(0, -1, -1))


def marks(words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """The names among words, and the numbers."""
    return [w for w in words if w in NAMES], [w for w in words if w.isdigit()]


def same_license(template: list[bytes], words: list[bytes]) -> bool:
    names, numbers = marks(template)
    found, rest = marks(words)
    rest = iter(rest)
    return names == found and all(n in rest for n in numbers)


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE):
        self._coverage = coverage
        self._names = [n for n, _ in templates]
        data = [t.encode().lower() for _, t in templates]
        self._words = [WORD.findall(d) for d in data]
        self._index: dict[int, list[tuple[int, int]]] = {}
        for k, d in enumerate(data):
            for h, at in zip(*winnowed(d), strict=True):
                self._index.setdefault(int(h), []).append((k, len(WORD.findall(d[: int(at)]))))
        self._hashes = np.array(sorted(self._index), np.uint64)
        self._low = np.zeros(1 << 16, bool)
        self._low[(self._hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """license, coverage, first and last+1 character of every match."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass").lower()
        h, at = winnowed(data)
        near = self._low[(h & np.uint64(0xFFFF)).astype(np.int64)]
        h, at = h[near], at[near]
        near = np.isin(h, self._hashes)
        if not near.any():
            return []
        spans = [m.span() for m in WORD.finditer(data)]
        words = [data[a:b] for a, b in spans]
        starts = np.array([a for a, _ in spans])
        seen: dict[int, list[int]] = {}
        found = []
        for value, place in zip(h[near].tolist(), at[near].tolist(), strict=True):
            word = int(np.searchsorted(starts, place, "right")) - 1
            for k, in_template in self._index[value]:
                diagonal = word - in_template
                if any(abs(diagonal - d) <= BAND // 2 for d in seen.setdefault(k, [])[-4:]):
                    continue
                seen[k].append(diagonal)
                template = self._words[k]
                low = max(0, diagonal - BAND)
                part = words[low : diagonal + len(template) + BAND]
                n, first, last = align(template, part, diagonal - low)
                if n >= self._coverage * len(template) and same_license(template, part[first : last + 1]):
                    found.append((k, n / len(template), spans[low + first][0], spans[low + last][1]))
        return self._distinct(found, data)

    def _distinct(self, found: list[tuple[int, float, int, int]], data: bytes) -> list[tuple[str, float, int, int]]:
        kept: list[tuple[str, float, int, int]] = []
        matched = lambda x: round(x[1] * len(self._words[x[0]]))
        for k, share, a, b in sorted(found, key=lambda x: (-matched(x), -x[1], x[2], x[0])):
            if all(b <= c or d <= a for _, _, c, d in kept):
                kept.append((self._names[k], share, a, b))
        length = lambda x: len(data[:x].decode("utf-8", "replace"))
        return sorted((n, s, length(a), length(b)) for n, s, a, b in kept)


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the text; adds ``matches``: license, coverage, start and
    end (characters)."""
    kind = pa.list_(
        pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
    )

    def make():
        scanner = Scanner(templates, coverage)

        def work(texts: list) -> dict[str, pa.Array]:
            rows = [[dict(zip(("license", "coverage", "start", "end"), m, strict=True)) for m in scanner(t)] for t in texts]
            return {"matches": pa.array(rows, kind)}

        return work

    return over_texts(docs, text, make, "matches array<struct<license:string,coverage:double,start:int,end:int>>")
