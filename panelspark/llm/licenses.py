"""License scans: MinHash bands over overlapping windows of text, then exact containment.

Templates and texts are shingles of five words. A template of n shingles belongs to the class w, the least power of two
that is n or more. A text is cut into blocks of w shingles, and each two neighbouring blocks are a window, so a run of n
shingles lies within one window. Bands are single MinHash values: a window that holds 80 % of a template agrees
with it in one band with probability J >= 0.8 n / (2 w + 0.2 n) >= 0.19, so BANDS = 64 of them retrieve it with
1 - 0.81**64, all but 2 in a million. Blocks of all classes share the values of each shingle. For each template retrieved by a
window its share of distinct shingles there is counted exactly; CONTAINMENT or more is a match, and matches of one template in
windows that touch are one.

Null and empty texts, and texts of fewer words than a template, match nothing but templates of exactly those words.
A text may match any number of templates; rows are independent of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelspark.llm.common import arrow_map, documents, mix
from panelspark.llm.words import shingles, word_hashes

SHINGLE, BANDS, CONTAINMENT = 5, 64, 0.8

# Notices as their publishers word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-notice": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

_seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_odd = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64)) | np.uint64(1)


class Templates:
    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.sets = []
        for name in self.names:
            self.sets.append(np.unique(shingles(*word_hashes([templates[name]]), SHINGLE)[0]))
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                self.classes.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        # A template's least value in each band.
        self.least = np.array([[((s ^ _seeds[b]) * _odd[b]).min() if len(s) else 0 for b in range(BANDS)] for s in self.sets], np.uint64)

    def retrieve(self, h: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """(class, template) -> windows that agree with it in a band. Window j of class w: shingles j * w to (j + 2) * w."""
        out: dict[tuple[int, int], list[np.ndarray]] = {}
        top = max(self.classes, default=1)
        for b in range(BANDS):
            block = (h ^ _seeds[b]) * _odd[b]
            w = 1
            while True:
                if w in self.classes:
                    near = np.minimum(block[:-1], block[1:]) if len(block) > 1 else block
                    for t in self.classes[w]:
                        if len(hit := np.flatnonzero(near == self.least[t, b])):
                            out.setdefault((w, t), []).append(hit)
                if w >= top:
                    break
                if len(block) % 2:
                    block = np.append(block, np.uint64(0xFFFFFFFFFFFFFFFF))
                block = np.minimum(block[::2], block[1::2])
                w *= 2
        return {k: np.unique(np.concatenate(v)) for k, v in out.items()}

    def matches(self, h: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first and past-the-last shingle within h, containment), windows that touch joined."""
        found = []
        for (w, t), windows in self.retrieve(h).items():
            for j in windows.tolist():
                a, z = j * w, min((j + 2) * w, len(h))
                for text in np.unique(owner[a:z]).tolist():  # a window may go over the end of a text
                    mine = np.flatnonzero(owner[a:z] == text) + a
                    inside = np.isin(h[mine], self.sets[t])
                    share = len(np.unique(h[mine][inside])) / len(self.sets[t])
                    if share >= CONTAINMENT - 1e-12:
                        at = mine[inside]
                        found.append((text, t, int(at[0]), int(at[-1]) + 1, share))
        joined: list[tuple[int, int, int, int, float]] = []
        for m in sorted(found):
            last = joined[-1] if joined else None
            if last and last[:2] == m[:2] and m[2] < last[3]:
                joined[-1] = (*last[:3], max(last[3], m[3]), max(last[4], m[4]))
            else:
                joined.append(m)
        return joined


def scan(df: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_matches, licenses (distinct, sorted), matches (license, first word, past-the-last word, containment)."""
    templates = TEMPLATES if templates is None else templates
    match = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("past", pa.int64()), ("containment", pa.float64())]))

    def make():
        known = Templates(templates)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            words, counts = word_hashes(batch.column(1).to_pylist())
            h, owner = shingles(words, counts, SHINGLE)
            order = np.argsort(owner, kind="stable")
            h, owner = h[order], owner[order]
            begin = np.searchsorted(owner, np.arange(n))
            rows: list[list[dict]] = [[] for _ in range(n)]
            for text, t, a, z, share in known.matches(h, owner):
                first = a - int(begin[text])
                rows[text].append({"license": known.names[t], "first": first, "past": min(first + z - a + SHINGLE - 1, int(counts[text])), "containment": share})
            for r in rows:
                r.sort(key=lambda m: (m["first"], m["license"]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in rows], pa.int32()), pa.array([sorted({m["license"] for m in r}) for r in rows], pa.list_(pa.string())), pa.array(rows, match)], names=["doc_id", "n_matches", "licenses", "matches"])

        return each

    return arrow_map(documents(df), make, "doc_id long, n_matches int, licenses array<string>, matches array<struct<license:string,first:bigint,past:bigint,containment:double>>", most=1_000_000)
