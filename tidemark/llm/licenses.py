"""Licence scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Windows of a template's own length start at every word. Each band is one minimum of the
window's five-word shingles; with BANDS bands a window of Jaccard 0.8 is retrieved with probability 1 - 0.2^BANDS.
Retrieved templates are verified: at least 0.8 of their shingles must be in the window.
The template table is a parameter and bounded by MAX_TEMPLATES.

Null and empty texts and texts of under five words match nothing; letters' case and ASCII punctuation do not
count; repeated rows each give their rows; a template that occurs more than once in a text gives one row with its count.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.jaccard import M1, mix, word_hashes

WORDS, SHARE, BANDS, MAX_TEMPLATES = 5, 0.8, 8, 10_000
TABLE = bytes(32 if chr(i) in string.punctuation else i for i in range(256))
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def grams(text: str | None) -> np.ndarray:
    w = word_hashes(text, TABLE)
    h = np.zeros(max(0, len(w) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        h = mix(h * M1 + w[i : i + len(h)])
    return h


def sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    """Minimum of each m neighbouring values, by doubling."""
    width = 1
    while width * 2 <= m:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (m - width)], x[m - width :]) if m > width else x


class Index:
    def __init__(self, templates: dict[str, str]):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError("too many templates")
        self.sets = {k: np.unique(grams(t)) for k, t in sorted(templates.items())}
        self.sets = {k: s for k, s in self.sets.items() if len(s)}
        self.lengths = sorted({len(grams(templates[k])) for k in self.sets})
        self.salts = [np.uint64((i * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for i in range(BANDS)]
        self.bands = []
        for salt in self.salts:
            own: dict[int, list[str]] = {}
            for k, s in self.sets.items():
                own.setdefault(int(mix(s ^ salt).min()), []).append(k)
            self.bands.append((np.array(sorted(own), np.uint64), own))

    def scan(self, text: str | None) -> dict[str, tuple[int, int, float]]:
        """Template -> (first word, places, best containment)."""
        h = grams(text)
        found: dict[tuple[str, int], float] = {}
        if not len(h):
            return {}
        for salt, (keys, own) in zip(self.salts, self.bands, strict=True):
            mixed = mix(h ^ salt)
            for m in self.lengths:
                if len(h) < m:
                    continue
                low = sliding_min(mixed, m)
                at = np.searchsorted(keys, low)
                hit = np.nonzero(keys[np.minimum(at, len(keys) - 1)] == low)[0]
                for p in hit.tolist():
                    for k in own[int(low[p])]:
                        if len(self.sets[k]) <= m and (k, p) not in found:
                            found[k, p] = np.isin(self.sets[k], h[p : p + m]).mean()
        out: dict[str, tuple[int, int, float]] = {}
        reach: dict[str, int] = {}
        for (k, p), c in sorted(found.items(), key=lambda x: (x[0][1], x[0][0])):
            if c >= SHARE:
                first, places, best = out.get(k, (p, 0, 0.0))
                if p >= reach.get(k, -1):
                    places, reach[k] = places + 1, p + len(self.sets[k])
                out[k] = (first, places, max(best, float(c)))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, first_word, places, containment for each template found in a document."""
    templates = templates or TEMPLATES

    def each(frames):
        index = Index(templates)
        for f in frames:
            rows = [(d, k, *v) for d, t in zip(f["doc_id"], f["text"], strict=True) for k, v in index.scan(t).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "first_word", "places", "containment"])

    return docs.select("doc_id", "text").mapInPandas(each, "doc_id long, license string, first_word long, places long, containment double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
