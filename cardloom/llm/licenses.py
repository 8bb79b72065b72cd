"""License scan: MinHash bands over text windows retrieve templates, shingles verify."""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, gram_hashes, in_one_text, mixed, released, word_hashes, words

# Notices as they are published, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or "
    "(at your option) any later version",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0/notice": "This program is free software; you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or "
    "(at your option) any later version",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
    "(at your option) any later version",
    "LGPL-2.1/notice": "This library is free software; you can redistribute it and/or modify it under the terms of the "
    "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
    "(at your option) any later version",
    "LGPL-3.0/notice": "This library is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or "
    "(at your option) any later version",
    "MIT": "Released under the MIT License",
    "MIT/notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

# ASCII letters and digits and everything beyond ASCII make words.
GAPS = np.ones(256, dtype=bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    GAPS[_low : _high + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _shingles(data: np.ndarray, offsets: np.ndarray, n: int):
    data = LOWER[data]
    starts, ends, first = words(data, offsets, GAPS)
    grams = gram_hashes(word_hashes(data, starts, ends), n)
    return grams, in_one_text(first, n, len(grams)), first


class Bands:
    """Band index of the templates. A window as long as the template, at most a quarter of
    it out of place, shares at least ``similar`` of its shingles; with ``bands`` bands of
    ``rows`` minima the chance to miss it is under ``miss``."""

    def __init__(self, templates: dict[str, str], shingle: int, contained: float, miss: float = 1e-4, rows: int = 2):
        self.names = sorted(templates)
        self.sets, self.lengths = [], []
        for name in self.names:
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            grams, ok, first = _shingles(raw, np.array([0, len(raw)]), shingle)
            self.sets.append(np.unique(grams[ok]))
            self.lengths.append(int(first[-1]))
        share = contained * 0.75
        similar = share / (2 - share)
        self.rows, self.bands = rows, ceil(log(miss) / log(1 - similar**rows))
        seeds = np.random.default_rng(7).integers(1, 1 << 63, (2, rows * self.bands), dtype=np.uint64)
        self.times, self.plus = seeds[0] | np.uint64(1), seeds[1]
        self.all = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))
        self.classes: dict[int, dict[tuple, set[int]]] = {}
        for k, grams in enumerate(self.sets):
            if len(grams):
                index = self.classes.setdefault(self.lengths[k], {})
                for key in self.keys(grams):
                    index.setdefault(key, set()).add(k)

    def keys(self, grams: np.ndarray) -> list[tuple]:
        minima = mixed(grams[:, None] * self.times + self.plus).min(axis=0).reshape(self.bands, self.rows)
        return [(b, *row) for b, row in enumerate(minima.tolist())]


def _matches(bands: Bands, grams: np.ndarray, known: np.ndarray, n: int, shingle: int, contained: float) -> list:
    """(template, start, end) in words, for one text with shingles ``grams`` and ``n`` words.

    Windows are as long as a template and start at every quarter of it; only those with a
    shingle of some template can collide, others are not hashed. Templates that are alike
    compete for a stretch: the one that it holds the larger share of is reported.
    """
    hits: dict[tuple[int, int, int], float] = {}
    at = np.flatnonzero(known)
    for length, index in bands.classes.items():
        step, size = max(1, (length - shingle) // 4), length - shingle + 1
        low, high = np.maximum(0, (at - size + step) // step), at // step
        windows = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)] or [np.zeros(0, int)]))
        for start in (windows * step).tolist():
            part = grams[start : start + size]
            if not len(part):
                continue
            for k in {k for key in bands.keys(part) for k in index.get(key, ())}:
                # Verify around the window, so that its place does not matter.
                a, b = max(0, start - step), start + size + step
                near = np.flatnonzero(np.isin(grams[a:b], bands.sets[k])) + a
                share = len(np.unique(grams[near])) / len(bands.sets[k])
                if share >= contained:
                    hits[int(near[0]), int(near[-1]) + shingle, k] = share
    found: dict[int, list[list[int]]] = {}
    for start, end, k in _best(hits):
        spans = found.setdefault(k, [])
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return sorted((start, bands.names[k], end) for k, spans in found.items() for start, end in spans)


def _best(hits: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int]]:
    """The (start, end, template) that no other, with a larger share of its template, covers
    half of (or is half covered by), in order."""
    order, beaten = sorted(hits), set()
    for i, one in enumerate(order):
        for other in order[i + 1 :]:
            shared = min(one[1], other[1]) - other[0]
            if shared <= 0:
                break
            if one[2] != other[2] and 2 * shared >= min(one[1] - one[0], other[1] - other[0]) and hits[one] != hits[other]:
                beaten.add(min(one, other, key=hits.get))
    return [x for x in order if x not in beaten]


def _scan(templates: dict[str, str], shingle: int, contained: float):
    def scan(batches):
        bands = Bands(templates, shingle, contained)
        for batch in released(batches):
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for row, data, offsets in chunks(batch.column(1)):
                grams, ok, first = _shingles(data, offsets, shingle)
                place = np.searchsorted(bands.all, grams)
                known = ok & (bands.all[np.minimum(place, len(bands.all) - 1)] == grams) if len(bands.all) else ok & False
                texts = np.unique(np.searchsorted(first, np.flatnonzero(known), side="right") - 1)
                for k in texts.tolist():
                    a, b = first[k], max(first[k], first[k + 1] - shingle + 1)
                    out[row + k] = _matches(bands, grams[a:b], known[a:b], first[k + 1] - a, shingle, contained)
            names = [sorted({name.split("/")[0] for _, name, _ in x}) for x in out]
            spans = [",".join(f"{name}:{start}:{end}" for start, name, end in x) for x in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.string())],
                names=["doc_id", "licenses", "spans"],
            )

    return scan


def find_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, shingle: int = 5, contained: float = 0.8
) -> DataFrame:
    """(doc_id, licenses, spans) for every row of ``docs`` (doc_id, text, ...).

    A template is found where a stretch of the text about as long holds ``contained`` of
    its shingles of ``shingle`` words (lower-cased letters and digits), and no template that
    half overlaps it has a larger share of its shingles there. ``spans`` lists
    template:first word:end by place. Templates with fewer words than a shingle are never
    found. A null text has no words; very long texts are scanned whole; repeated rows are scanned each; other columns are
    ignored. The templates are a parameter and travel with the task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _scan(TEMPLATES if templates is None else templates, shingle, contained),
        "doc_id long, licenses array<string>, spans string",
    )
