"""Licence scan: Dice coefficient over word bigrams against licence templates.

A unit of text is a line, a run of lines, the whole document, or a window of words anywhere in it, so that
a notice is found that is wrapped over lines or shares a line with other words. Texts are lower-cased and reduced to words; a unit
matches a template when twice the shared bigrams over all bigrams, counted as multisets, reaches
``least``. With sizes a and b that needs min/max >= least / (2 - least), so only templates inside those
bounds are compared, and of them only those that share a bigram with the unit.

A window has at least as many bigrams as its template, so that it cannot end before a word that differs;
shorter texts match as lines and runs of them. Of windows and runs that overlap the one of highest score
counts, then the first licence by name, template and place. Lines go before windows: a window that shares words with a line that matches counts only
if it is of another licence, of a higher score, and not inside that line; one of the licence that the whole
document matches does not count.

Cases: null text is empty; a unit of one word counts that word as its only bigram; a unit without words
matches nothing. Of equal scores the first licence by name, then the first template, wins. Repeated rows
each give rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, texts

LEAST = 0.8

#: Licence notices in common use: fixed texts.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(found: Sequence[str]) -> Counter:
    return Counter(zip(found, found[1:])) if len(found) > 1 else Counter((w,) for w in found)


def dice(a: Counter, b: Counter) -> float:
    both = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / both if both else 0.0


class Scanner:
    def __init__(self, templates: Mapping[str, Sequence[str]], least: float) -> None:
        self.least = least
        self.all = [(name, k, bigrams(words(t))) for name in sorted(templates) for k, t in enumerate(templates[name])]
        self.sizes = [sum(b.values()) for _, _, b in self.all]
        self.holders: dict[tuple, list[int]] = {}
        for i, (_, _, grams) in enumerate(self.all):
            for g in grams:
                self.holders.setdefault(g, []).append(i)
        ratio = least / (2 - least)
        self.low = [n * ratio for n in self.sizes]
        self.high = [n / ratio for n in self.sizes]
        #: Bigrams that a unit must share: with s and n of them in all, 2 * shared >= least * (s + n) and n >= shared.
        self.need = [n * ratio - 1e-9 for n in self.sizes]
        self.span = (min(self.low, default=1), max(self.high, default=0))

    def unit(self, found: Sequence[str]) -> tuple[float, str, int] | None:
        """(dice, licence, template) of the best match."""
        n = max(len(found) - 1, 1 if found else 0)
        if not self.span[0] <= n <= self.span[1]:
            return None
        seen = set(zip(found, found[1:])) if len(found) > 1 else {(w,) for w in found}
        near = {i for g in seen & self.holders.keys() for i in self.holders[g] if self.low[i] <= n <= self.high[i]}
        best = None
        grams = bigrams(found) if near else None
        for i in sorted(near):
            name, k, own = self.all[i]
            d = dice(own, grams)
            if d >= self.least and (best is None or d > best[0]):
                best = (d, name, k)
        return best

    def windows(self, found: Sequence[str], lines: Sequence[tuple[int, int]]) -> list[tuple[float, int, int, int]]:
        """(dice, template, first word, word after the last) of each window, and run of ``lines``, that matches."""
        at: dict[int, list[int]] = {}
        grams = list(zip(found, found[1:]))
        for p, g in enumerate(grams):
            if g in self.holders:
                for i in self.holders[g]:
                    at.setdefault(i, []).append(p)
        out = [(1.0, i, p, p + 1) for p, w in enumerate(found) for i in self.holders.get((w,), ())] if self.least <= 1 else []
        starts = [x for x, _ in lines]
        for i, hits in at.items():
            own, size = self.all[i][2], self.sizes[i]
            if len(hits) < self.need[i] or sum((own & Counter(grams[p] for p in hits)).values()) < self.need[i]:
                continue
            if len(grams) >= size:
                for k, first in enumerate(hits):
                    seen: Counter = Counter()
                    shared = 0
                    for last in hits[k:]:
                        if last - first >= self.high[i]:
                            break
                        seen[grams[last]] += 1
                        if seen[grams[last]] <= own[grams[last]]:
                            shared += 1
                            # a window of fewer bigrams is filled up to those of the template
                            if (d := 2 * shared / (size + max(size, last - first + 1))) >= self.least:
                                out.append((d, i, first, last + 2))
            for k in sorted({bisect_right(starts, p) - 1 for p in hits}):
                x, seen, shared = starts[k], Counter(), 0
                h = bisect_left(hits, x)
                for m in range(k, len(lines)):
                    y = lines[m][1]
                    if y - x - 1 > self.high[i]:
                        break
                    while h < len(hits) and hits[h] + 2 <= y:
                        g = grams[hits[h]]
                        seen[g] += 1
                        shared += seen[g] <= own[g]
                        h += 1
                    if m > k and (d := 2 * shared / (size + y - x - 1)) >= self.least:
                        out.append((d, i, x, y))
        return out

    def document(self, text: str) -> dict[str, tuple[float, int, int]]:
        """licence -> (best dice, its template, units and windows that match)."""
        out: dict[str, tuple[float, int, int]] = {}
        lines = [words(line) for line in text.split("\n")]
        every = [w for line in lines for w in line]
        taken: list[tuple[int, int, float, str]] = []

        def add(d: float, name: str, k: int) -> None:
            was = out.get(name, (0.0, 0, 0))
            out[name] = (d, k, was[2] + 1) if d > was[0] else (*was[:2], was[2] + 1)

        at, places = 0, []
        for found in lines:
            if found:
                places.append((at, at + len(found)))
            if got := self.unit(found):
                d, name, k = got
                add(d, name, k)
                taken.append((at, at + len(found), d, name))
            at += len(found)
        over = None
        if sum(map(bool, lines)) > 1 and (got := self.unit(every)):
            d, over, k = got
            add(d, over, k)
        windows = sorted(self.windows(every, places), key=lambda w: (-w[0], w[1:]))
        starts, ends, used = [t[0] for t in taken], [t[1] for t in taken], bytearray(len(every) if windows else 0)
        for d, i, x, y in windows:
            name, k, _ = self.all[i]
            near = taken[bisect_right(ends, x) : bisect_left(starts, y)]
            if name == over or any(name == t[3] or d <= t[2] or (t[0] <= x and y <= t[1]) for t in near) or used.find(1, x, y) >= 0:
                continue
            used[x:y] = b"\x01" * (y - x)
            add(d, name, k)
        return out


def scan(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and licence found: id, license, template, dice, n_units; one row of nulls for a document with none. A narrow map."""
    bound_batches(docs.sparkSession)
    scanner = Scanner(templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, raw in enumerate(texts(batch.column("text"))):
                found = scanner.document(raw.decode("utf-8", "replace"))
                rows += [(i, name, k, d, n) for name, (d, k, n) in sorted(found.items())] or [(i, None, None, None, 0)]
            columns = list(zip(*rows)) or [[]] * 5
            ids = batch.column("id").take(pa.array(columns[0], pa.int64()))
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns[1:], kinds)], names=["id", "license", "template", "dice", "n_units"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, license string, template int, dice double, n_units int").withColumnRenamed("id", id_col)
