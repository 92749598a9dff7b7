"""License scans: MinHash bands over overlapping windows, verified by shingle containment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm import text as tx

#: Notices of public licenses, by SPDX name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    (
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
]
MATCH = "struct<license:string,template:int,start:int,words:int,containment:double>"


class Bands:
    """Signatures of the templates by length class.

    A template of 2^j shingles or more, but fewer than 2^(j+1), is looked for in
    windows of three blocks of 2^j shingles, one at each block, so that one window
    holds it whole. Of window and template at least ``share`` of the template's
    shingles agree, so one minimum agrees with the probability ``low`` at least; so
    many bands of one minimum are taken that none agrees with at most ``miss``.
    """

    def __init__(self, templates: list[tuple[str, str]], share: float, miss: float, size: int):
        self.size, self.share = size, share
        batch = pa.RecordBatch.from_arrays(
            [pa.array([t for _, t in templates], pa.string())], ["text"]
        )
        self.names, self.sets, self.words = [], [], []
        for row, end, data, offsets in tx.text_slices(batch, "text"):
            words, first = tx.word_hashes(data, offsets, tx.LETTERS_DIGITS)
            values, bounds = tx.shingle_sets(words, first, size)
            for k in range(end - row):
                self.names.append(templates[row + k][0])
                self.sets.append(values[bounds[k] : bounds[k + 1]])
                self.words.append(int(first[k + 1] - first[k]))
        self.level = [max(len(s), 1).bit_length() - 1 for s in self.sets]
        self.levels = sorted({j for j, s in zip(self.level, self.sets, strict=True) if len(s)})
        self.bands = {}
        for j in self.levels:
            window = 1 if not j else 3 << j
            low = min(
                self.needed(k) / (window + len(self.sets[k]) - self.needed(k))
                for k in range(len(self.sets))
                if self.level[k] == j and len(self.sets[k])
            )
            self.bands[j] = 1 if low >= 1 else math.ceil(math.log(miss) / math.log(1 - low))
        self.count = max(self.bands.values(), default=0)
        rng = np.random.default_rng(11)
        self.odd = rng.integers(0, 1 << 63, self.count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.table = {}
        for j in self.levels:
            for i in range(self.bands[j]):
                entries = sorted(
                    (int((self.sets[k] * self.odd[i]).min()), k)
                    for k in range(len(self.sets))
                    if self.level[k] == j and len(self.sets[k])
                )
                values = np.array([v for v, _ in entries], np.uint64)
                mask = np.zeros(1 << 16, bool)
                mask[(values >> np.uint64(48)).astype(np.int64)] = True
                self.table[j, i] = (values, np.array([k for _, k in entries]), mask)

    def needed(self, k: int) -> int:
        """Shingles of template k that a window must hold."""
        return math.ceil(self.share * len(self.sets[k]))

    def candidates(self, shingles: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, first block, template) with an agreeing minimum in some band."""
        found: set[tuple[int, int, int]] = set()
        plans = [bounds]
        steps = []
        for _ in range(max(self.levels, default=0)):
            n = np.diff(plans[-1])
            half = (n + 1) // 2
            steps.append(np.repeat(plans[-1][:-1], half) + 2 * tx.ranges(half))
            plans.append(np.concatenate([[0], np.cumsum(half)]))
        for i in range(self.count):
            value = shingles * self.odd[i]
            for j in range(len(plans)):
                if j:
                    value = np.minimum.reduceat(value, steps[j - 1]) if len(value) else value
                if j in self.bands and i < self.bands[j] and len(value):
                    found |= self._look_up(value, plans[j], j, i)
        return found

    def _look_up(self, value: np.ndarray, bounds: np.ndarray, j: int, i: int):
        values, names, mask = self.table[j, i]
        window = value
        if j:
            window = value.copy()
            last = bounds[1:][np.diff(bounds) > 0] - 1
            for step in (1, 2):
                ahead = np.full(len(value), np.iinfo(np.uint64).max, np.uint64)
                ahead[:-step] = value[step:]
                for back in range(step):
                    ahead[np.maximum(last - back, 0)] = np.iinfo(np.uint64).max
                np.minimum(window, ahead, out=window)
        at = np.flatnonzero(mask[(window >> np.uint64(48)).astype(np.int64)])
        out = set()
        for p in at.tolist():
            for k in names[values == window[p]].tolist():
                text = int(np.searchsorted(bounds, p, "right")) - 1
                out.add((text, p - int(bounds[text]), k))
        return out


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    share: float = 0.75,
    miss: float = 1e-6,
    size: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: its id and the license notices in its text.

    A notice is found where a window holds ``share`` of the template's distinct
    shingles (runs of ``size`` words; a template with fewer words is one shingle and
    is only found as a whole text of those words). ``matches`` has one entry for each
    stretch of such windows of one template: its best window (first of equal ones),
    place of its first word, words, containment. Windows are stretches of the text as
    the length classes lay them. Null and empty texts have no matches; repeated rows are
    answered one by one; other columns are left out. An empty table gives no rows.
    The templates are the caller's list and travel with the task; nothing is shuffled.
    """
    bands = Bands(TEMPLATES if templates is None else templates, share, miss, size)
    shared = docs.sparkSession.sparkContext.broadcast(bands)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = own.schema[0].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = shared.value
        for batch in batches:
            for row, end, data, offsets in tx.text_slices(batch, "text"):
                words, first = tx.word_hashes(data, offsets, tx.LETTERS_DIGITS)
                rows = _matches(bands, words, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[row:end], pa.array(rows, _match_type())],
                    ["doc_id", "matches"],
                )

    return own.mapInArrow(scan, f"doc_id {kind}, matches array<{MATCH}>")


def _match_type() -> pa.DataType:
    fields = [
        ("license", pa.string()), ("template", pa.int32()), ("start", pa.int32()),
        ("words", pa.int32()), ("containment", pa.float64()),
    ]
    return pa.list_(pa.struct(fields))


def text_shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in the order of the text; a text with fewer words is one shingle."""
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(bounds[-1], np.uint64)
    long = counts >= size
    inner = tx.ranges(n[long])
    runs = tx.run_hashes(words, size)
    out[np.repeat(bounds[:-1][long], n[long]) + inner] = runs[np.repeat(first[:-1][long], n[long]) + inner]
    for d in np.flatnonzero((counts > 0) & ~long):
        out[bounds[d]] = tx._rows_hash(words[first[d] : first[d + 1]][None, :])[0]
    return out, bounds


def _matches(bands: Bands, words: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    shingles, bounds = text_shingles(words, first, bands.size)
    by_place: dict[tuple[int, int], list[tuple[int, float, int]]] = {}
    for text, block, k in sorted(bands.candidates(shingles, bounds)):
        step = 1 << bands.level[k]
        start = block * step
        window = shingles[bounds[text] + start : bounds[text + 1]][: 3 * step if step > 1 else 1]
        held = np.isin(bands.sets[k], window).mean()
        if held >= bands.share:
            by_place.setdefault((text, k), []).append((start, float(held), len(window)))
    rows: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    for (text, k), windows in by_place.items():
        groups: list[list[tuple[int, float, int]]] = []
        for w in windows:
            if groups and w[0] < groups[-1][-1][0] + groups[-1][-1][2]:
                groups[-1].append(w)
            else:
                groups.append([w])
        for group in groups:
            start, held, n = max(group, key=lambda w: (w[1], -w[0]))
            total = int(first[text + 1] - first[text])
            rows[text].append(
                {
                    "license": bands.names[k],
                    "template": k,
                    "start": start,
                    "words": min(n + bands.size - 1, total - start),
                    "containment": held,
                }
            )
    return [sorted(r, key=lambda m: (m["start"], m["template"])) for r in rows]
