"""Operator 2, license scans: patience alignment of texts with license templates.

The words of a text that a template has, foreign words between them left out, are
aligned with it: words unique to both sides are anchors; the longest increasing
subsequence of their places is kept, and the gaps between anchors are aligned the
same way, recursively. A stretch ends where more foreign words stand in a row than
the template has words; long stretches are cut into overlapping windows of 1.25 and
of 3 times its words, so that copies that follow each other are told apart and a
notice may hold as many stray words of its own kind as it has words. Coverage is the share of the template's words that the alignment matched; a window
whose words can't reach the asked coverage is left out before, which loses nothing.

Words are lower-cased runs of letters and digits. Null and empty texts and
texts without a license give one row with null license and coverage 0;
repeated rows give repeated rows. Spans count words of the text from 0.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import batched, ddl, ship, small_batches, table
from kinweave.llm.contamination import CACHE_WORDS, _DROP, plain_words

ship(__name__)

COVERAGE = 0.8
#: Cells of the table by which a gap without anchors is aligned, at most.
GAP_CELLS = 1 << 15

# Public license notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


def _increasing(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            at.append(i)
        else:
            tops[k], at[k] = p, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by the table of its lengths."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of two word lists: common ends, then anchors, then the gaps between them.

    A gap without anchors, where every common word stands twice or more, is aligned word by word.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        one_a, one_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: y for y, w in enumerate(b[k:m], k) if one_b[w] == 1}
        anchors = [(x, place[w]) for x, w in enumerate(a[i:j], i) if one_a[w] == 1 and w in place]
        anchors = [anchors[x] for x in _increasing([y for _, y in anchors])]
        if not anchors and (j - i) * (m - k) <= GAP_CELLS:
            out.extend((i + x, k + y) for x, y in _common(a[i:j], b[k:m]))
            continue
        out.extend(anchors)
        for (x0, y0), (x1, y1) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)], strict=True) if anchors else ():
            todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


class LicenseScanner:
    def __init__(self, templates: dict[str, str], least: float) -> None:
        self.least, self.ids = least, {}
        self.templates = []
        for name, text in templates.items():
            ws = [self.ids.setdefault(w, len(self.ids)) for w in plain_words(text)]
            if ws:
                self.templates.append((name, ws, Counter(ws)))

    def windows(self, ids: list[int], ws: list[int], has: Counter) -> Iterator[list[int]]:
        """Places of the template's words in stretches of the text; long ones are cut with overlap.

        Foreign words between them don't count: they match nothing and only part stretches
        where there are more of them in a row than the template has words.
        """
        gap, n = max(6, len(ws)), len(ws)
        hits = [i for i, w in enumerate(ids) if w in has]
        s = 0
        while s < len(hits):
            e = s
            while e + 1 < len(hits) and hits[e + 1] - hits[e] <= gap:
                e += 1
            stretch = hits[s : e + 1]
            for width, step in (n + max(1, n // 4), max(1, n // 4)), (3 * n, n):
                yield from (stretch[at : at + width] for at in range(0, max(1, len(stretch) - width + step), step))
                if len(stretch) <= width:
                    break
            s = e + 1

    def scan(self, ids: list[int]) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, word after the last) of the best window of every license found."""
        out, present = [], set(ids)
        for name, ws, has in self.templates:
            need = self.least * len(ws) - 1e-9
            if sum(n for w, n in has.items() if w in present) < need:
                continue
            best = None
            for places in self.windows(ids, ws, has):
                part = [ids[i] for i in places]
                if len(part) < need or sum((Counter(part) & has).values()) < need:
                    continue
                pairs = align(part, ws)
                if len(pairs) >= need and (best is None or len(pairs) > best[0]):
                    best = (len(pairs), places[pairs[0][0]], places[pairs[-1][0]] + 1)
            if best:
                out.append((name, best[0] / len(ws), best[1], best[2]))
        # A notice inside a longer license that was found is a part of it.
        return [x for x in out if not any(y is not x and y[2] <= x[2] and x[3] <= y[3] and y[3] - y[2] > x[3] - x[2] for y in out)]


def _scanner(templates: dict[str, str], least: float, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, cache = LicenseScanner(templates, least), {}
        for b in batches:
            rows, hits = [], []
            for i, text in enumerate(batched(b.column(keys))):
                ids = []
                for w in (text or "").lower().split():
                    n = cache.get(w)
                    if n is None:
                        if len(cache) > CACHE_WORDS:
                            cache.clear()
                        p = _DROP.sub("", w)
                        n = cache[w] = scanner.ids.get(p, -1) if p else -2
                    if n > -2:
                        ids.append(n)
                for hit in scanner.scan(ids) or [(None, 0.0, None, None)]:
                    rows.append(i)
                    hits.append(hit)
            at = pa.array(rows, pa.int64())
            cols = [pa.array([h[k] for h in hits], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(keys)), *cols], [*b.schema.names[:keys], "license", "coverage", "first_word", "end_word"])

    return run


def scan_licenses(docs: DataFrame, keys: list[str], templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """One row for each document and license found in it; one with nulls where none is."""
    rows = small_batches(docs).select(*keys, F.col("text").cast("string"))
    schema = ddl(docs.select(*keys)) + ", license string, coverage double, first_word long, end_word long"
    return rows.mapInArrow(_scanner(templates or TEMPLATES, least, len(keys)), schema)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
