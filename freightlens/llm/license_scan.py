"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies them.

Templates of like length share a window size and a step, so that every copy lies
whole in some window. For each size the bands are set by the worst case: a window
that holds just the least containment of a template collides with it in some band
with a probability of at least ``COLLISION``. Windows run over the shingles of a
whole slice; one that reaches into the next text holds the copy all the same, and
verification keeps to the text. A text and a template that collide are compared on
all shingles of the text: positions that are shingles of the template form runs,
and a run with at least the least containment is a match.

Every task needs the templates only, a parameter of bounded size, and nothing is
shuffled.

Defined cases: null and empty texts have no matches; a template of fewer words than
a shingle matches as one shingle only in texts of just these words; repeated rows and
rows without id are scanned like others; clashing columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.common import slices
from freightlens.llm.words import mixed, shingle_hashes, word_hashes

CONTAINMENT = 0.8
COLLISION = 0.999
ROWS = 2
#: Notices as they are published, by SPDX id or family. Fixed values.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def least_common(n: int, containment: float) -> int:
    """Shingles of a template of n that a match has at least."""
    return ceil(containment * n - 1e-9)


@dataclass
class Size:
    """Window size and step in shingles, bands, and the templates' values in each band."""

    window: int
    step: int
    bands: int
    keys: list[tuple[np.ndarray, np.ndarray]]  # of each band: sorted values, their templates

    def candidates(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first shingle of a window, template) of all collisions."""
        starts = np.arange(0, len(shingles), self.step)
        found = []
        for band, (values, template) in enumerate(self.keys):
            key = np.zeros(len(starts), np.uint64)
            for row in range(ROWS):
                low = shingles * _factor(band * ROWS + row)
                if self.step > 1:
                    low = np.minimum.reduceat(low, starts)
                key = mixed(key * np.uint64(31) + _sliding(low, self.window // self.step))
            at = np.flatnonzero(np.isin(key, values))
            first = np.searchsorted(values, key[at])
            for i in range(int((np.searchsorted(values, key[at], "right") - first).max(initial=0))):
                more = (first + i < len(values)) & (values[np.minimum(first + i, len(values) - 1)] == key[at])
                found.append(np.column_stack([starts[at[more]], template[(first + i)[more]]]))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]


def _factor(k: int) -> np.uint64:
    return mixed(np.array([k + 1], np.uint64))[0] | np.uint64(1)


def _sliding(low: np.ndarray, blocks: int) -> np.ndarray:
    """Minimum of each value and the ``blocks - 1`` behind it, by doubling."""
    out, reach = low.copy(), 1
    while reach < blocks:
        move = min(reach, blocks - reach)
        out[:-move] = np.minimum(out[:-move], out[move:]) if move < len(out) else out[:-move]
        reach += move
    return out


def bands_for(n: int, window: int, containment: float, collision: float) -> int:
    """Bands of ROWS minima that make a window with the least containment collide with this probability."""
    common = least_common(n, containment)
    similarity = common / (window + n - common)
    return 1 if similarity >= 1 else ceil(log(1 - collision) / log(1 - similarity**ROWS))


@dataclass
class Scanner:
    names: list[str]
    sets: list[np.ndarray]
    sizes: list[Size]
    containment: float

    @staticmethod
    def compile(templates: Mapping[str, str], containment: float = CONTAINMENT, collision: float = COLLISION) -> Scanner:
        names = [n for n, text in templates.items() if text.split()]
        off, words = word_hashes(pa.array([templates[n] for n in names], pa.string()))
        s_off, shingles = shingle_hashes(off, words)
        sets = [np.unique(shingles[a:b]) for a, b in zip(s_off[:-1], s_off[1:], strict=True)]
        by_size: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, (a, b) in enumerate(zip(s_off[:-1], s_off[1:], strict=True)):
            step = max(1, (b - a) // 8)
            by_size[int(step * ceil((b - a + step - 1) / step)), int(step)].append(i)
        sizes = []
        for (window, step), members in sorted(by_size.items()):
            bands = max(bands_for(len(sets[i]), window, containment, collision) for i in members)
            keys = []
            for band in range(bands):
                values = np.zeros(len(members), np.uint64)
                for row in range(ROWS):
                    low = np.array([(sets[i] * _factor(band * ROWS + row)).min() for i in members], np.uint64)
                    values = mixed(values * np.uint64(31) + low)
                order = np.argsort(values)
                keys.append((values[order], np.array(members)[order]))
            sizes.append(Size(window, step, bands, keys))
        return Scanner(names, sets, sizes, containment)

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, end word, containment) of all matches."""
        off, words = word_hashes(texts)
        s_off, shingles = shingle_hashes(off, words)
        if not len(shingles):
            return []
        pairs = set()
        for size in self.sizes:
            start, template = size.candidates(shingles)
            first = np.searchsorted(s_off, start, "right") - 1
            last = np.searchsorted(s_off, np.minimum(start + size.window, s_off[-1]) - 1, "right") - 1
            for a, b, t in zip(first.tolist(), last.tolist(), template.tolist(), strict=True):
                pairs.update((d, t) for d in range(a, b + 1))
        out = []
        for doc, t in sorted(pairs):
            part, whole = shingles[s_off[doc] : s_off[doc + 1]], self.sets[t]
            at = np.flatnonzero(np.isin(part, whole))
            if not len(at):
                continue
            for run in np.split(at, np.flatnonzero(np.diff(at) > len(whole)) + 1):
                share = len(np.unique(part[run])) / len(whole)
                if share >= self.containment - 1e-9:
                    end = min(int(run[-1]) + 5, int(off[doc + 1] - off[doc]))
                    out.append((doc, t, int(run[0]), end, share))
        return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, license, word_from, word_to (end excluded), containment."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner.compile(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for part in slices(batches):
            found = scanner.matches(part.column("text"))
            if found:
                doc, template, begin, end, share = zip(*found, strict=True)
                ids = part.column("doc_id").take(pa.array(doc))
                columns = [ids, pa.array([scanner.names[t] for t in template]), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(share, pa.float64())]
                yield pa.record_batch(columns, ["doc_id", "license", "word_from", "word_to", "containment"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, word_from long, word_to long, containment double")
