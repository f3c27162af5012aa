"""License scans: MinHash bands over text windows retrieve templates, exact containment verifies.

Templates are dealt to classes by length: class c holds those of c/2 < words <= c.  For each
class the words of a text are taken in windows of 2 c words, c apart, so a window holds any
occurrence of a template of the class whole.  Only shingles that stand in a template of the
class can be shared with one, so a window is reduced to those before it is hashed, and most
windows vanish.  A window has at most 2 c - 4 shingles and the class only as many as its
templates have, so one that holds a share t of a template of n shingles has a similarity of at
least s = t n / (n - t n + min(2 c - 4, all of the class)) to it.  The class takes as many bands
of one row as retrieve its least s with probability 1 - (1 - s) ** bands, above 1 - RISK.
The candidates are confirmed by |window & template| / |template| >= t on the sets themselves.

Words are those of ``larkspur.llm.common.ALNUM`` after lower-casing A-Z, shingles five words.
Defined results: null, empty and license-free texts give no rows; a template of fewer words
than a shingle is refused; repeated rows are scanned one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm import common as C

WIDTH = 5
PERCENT = 80
RISK = 1e-9

#: Notices by which works name their license.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-line": "Released under the MIT License.",
    "MIT-licensed-line": "Licensed under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-line": "Licensed under the BSD 3-Clause License.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain.",
}


def _shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = C.LOWER[data]
    starts, ends, first = C.word_spans(low, offs, C.ALNUM)
    return C.shingle_hash(C.span_hash(C.prefix_hash(low), starts, ends), WIDTH), first


class Class:
    """Templates of one length class: their shingles, vocabulary and band buckets."""

    def __init__(self, words: int, sets: list[tuple[str, np.ndarray]], percent: int):
        self.words, self.names, self.sets = words, [n for n, _ in sets], [s for _, s in sets]
        self.vocab = np.unique(np.concatenate(self.sets))
        self.bands = self._bands(percent)
        self.seeds = C.mix(np.arange(1, self.bands + 1, dtype=np.uint64))
        self.hashed = C.mix(self.vocab[:, None] ^ self.seeds[None, :])  # a row for each shingle of the class
        self.buckets: list[dict[int, list[int]]] = [{} for _ in range(self.bands)]
        for t, s in enumerate(self.sets):
            for band, value in enumerate(self.hashed[np.searchsorted(self.vocab, s)].min(axis=0).tolist()):
                self.buckets[band].setdefault(value, []).append(t)

    def _bands(self, percent: int) -> int:
        """Bands that miss no template at ``percent`` of containment but with probability RISK."""
        most = min(2 * self.words - WIDTH + 1, len(self.vocab))
        least = 1.0
        for s in self.sets:
            shared = -(-percent * len(s) // 100)
            least = min(least, shared / max(len(s), len(s) - shared + most))
        return 1 if least >= 1 else ceil(log(RISK) / log1p(-least))

    def scan(self, at: np.ndarray, number: np.ndarray, n_words: int, percent: int) -> Iterator[tuple[int, int, int]]:
        """(template, window start, shared shingles) over one text; ``at`` are the places of shingles of the class, ``number`` theirs in the vocabulary."""
        c = self.words
        for k in np.unique(np.concatenate([at // c, np.maximum(at // c - 1, 0)])).tolist():
            inside = (at >= k * c) & (at + WIDTH <= (k + 2) * c)
            mine = np.unique(number[inside])
            if not len(mine):
                continue
            found: set[int] = set()
            for band, value in enumerate(self.hashed[mine].min(axis=0).tolist()):
                found.update(self.buckets[band].get(value, ()))
            for t in sorted(found):
                shared = len(np.intersect1d(self.vocab[mine], self.sets[t], assume_unique=True))
                if 100 * shared >= percent * len(self.sets[t]):
                    yield t, k * c, shared


def read_templates(folder: str) -> dict[str, str]:
    """Templates from the files of a folder, each named by its file: for whole license texts."""
    from pathlib import Path

    return {p.stem: p.read_text(encoding="utf-8", errors="replace") for p in sorted(Path(folder).iterdir()) if p.is_file()}


def classes(templates: dict[str, str], percent: int = PERCENT) -> list[Class]:
    by: dict[int, list[tuple[str, np.ndarray]]] = {}
    for name, text in sorted(templates.items()):
        raw = np.frombuffer(text.encode(), np.uint8)
        grams, first = _shingles(raw, np.array([0, len(raw)]))
        n = int(first[1])
        if n < WIDTH:
            raise ValueError(f"template {name} has fewer than {WIDTH} words")
        by.setdefault(max(8, 1 << (n - 1).bit_length()), []).append((name, np.unique(grams)))
    return [Class(c, sets, percent) for c, sets in sorted(by.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id_col, license, containment, first_word, n_windows): a row for each template found in each row.

    ``containment`` is the best over the windows, ``first_word`` where the first such window
    starts, ``n_windows`` how many windows hold the template.  The templates are a parameter
    of the query and are sent with it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = classes(shared.value, percent)
        every = np.unique(np.concatenate([c.vocab for c in levels])) if levels else np.zeros(0, np.uint64)
        low_bits = np.zeros(1 << 20, bool)
        low_bits[(every & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            rows, out = [], []
            for a, _, data, offs in C.chunks(batch, "text"):
                grams, first = _shingles(data, offs)
                hits = np.flatnonzero(low_bits[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
                hits = hits[np.isin(grams[hits], every)]
                row = np.searchsorted(first, hits, "right") - 1
                ok = hits + WIDTH <= first[row + 1]  # shingles do not run into the next text
                hits, row = hits[ok], row[ok]
                for r in np.unique(row).tolist():
                    mine = hits[row == r]
                    for level in levels:
                        at = mine[np.isin(grams[mine], level.vocab)]
                        if not len(at):
                            continue
                        best: dict[int, list[int]] = {}
                        for t, start, n in level.scan(at - first[r], np.searchsorted(level.vocab, grams[at]), int(first[r + 1] - first[r]), percent):
                            x = best.setdefault(t, [n, start, 0])
                            x[0] = max(x[0], n)
                            x[2] += 1
                        for t, (n, start, windows) in best.items():
                            rows.append(a + r)
                            out.append((level.names[t], n / len(level.sets[t]), start, windows))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["id", "license", "containment", "first_word", "n_windows"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, license string, containment double, first_word long, n_windows long").withColumnRenamed("id", id_col)
