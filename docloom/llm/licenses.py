"""Licence scans: passages of a text against licence templates, by the Dice coefficient of their word bigrams.

Texts and templates are normalised to lower-case words of letters and digits. The similarity of a passage (a run of words) to a template is 2 * shared / (passage + template) over their bags of word
bigrams: a bigram counts as often as it occurs, shared ones as often as in both. A passage can reach the threshold t with a template of n bigrams only if it has from n * t / (2 - t) to n * (2 - t) / t of
them and shares at least n * t / (2 - t). So templates of which a text has fewer are pruned before any passage is looked at, and so are first words after which there are too few of the template's
bigrams up to the upper bound, where a passage ends at the latest. The best passage begins and ends with a bigram of the template, so only such passages are compared, and none is missed. The time is
linear in the text, whatever is repeated in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, map_batches, small_batches, table
from .licence_texts import BODIES, NOTICES
from .tokenfile import text_runs

THRESHOLD = 0.8

#: Licence identifiers and the wording of their usual notices and, where short or without a notice, bodies.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *NOTICES,
    *BODIES,
)

#: Names of families, from words that several licences share. Such a passage gives way to any one of a licence that it overlaps.
FAMILIES = ("BSD",)


#: Passages that are compared at once: first words by the bigrams that may follow.
CELLS = 1 << 19


class Templates:
    """Bigrams of the templates as numbers of word pairs; often[k, c]: how often template k has bigram c."""

    def __init__(self, templates: tuple = TEMPLATES, threshold: float = THRESHOLD):
        self.names, self.threshold = [n for n, _ in templates], threshold
        self.vocabulary: dict[bytes, int] = {}
        pairs = []
        for _, text in templates:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)], np.int64)
            pairs.append(ids[:-1] << 32 | ids[1:])
        self.codes = np.unique(np.concatenate([*pairs, [-1]]))
        self.often = np.array([np.bincount(np.searchsorted(self.codes, p), minlength=len(self.codes)) for p in pairs])
        self.sizes = self.often.sum(1)
        self.least = self.sizes * threshold / (2 - threshold) - 1e-9
        self.most = np.floor(self.sizes * (2 - threshold) / threshold + 1e-9).astype(np.int64)

    def bigrams(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the words have a bigram of any template, and which."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        both = np.flatnonzero((ids[1:] > 0) & (ids[:-1] > 0))
        codes = ids[both] << 32 | ids[both + 1]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[at] == codes
        return both[hit], at[hit]

    def passages(self, k: int, place: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(dice, first word, last word + 1) of the best passage (the longer of equals) from each first word with one that reaches the threshold. place, code: of the bigrams of template k, in order."""
        often = self.often[k][code]
        order = np.argsort(code, kind="stable")
        group = code[order]
        rank = np.arange(len(code)) - np.searchsorted(group, group)
        # a bigram is shared unless the passage has all that the template has of it already: those from `full` on
        full = np.full(len(code), -1)
        again = rank >= often[order]
        full[order[again]] = order[np.flatnonzero(again) - often[order][again]]
        upto = np.searchsorted(place, place + self.most[k])
        starts = np.flatnonzero(upto - np.arange(len(place)) >= self.least[k])
        out = []
        while len(starts):
            width = int((upto[starts] - starts).max())
            some, starts = starts[: max(1, CELLS // width)], starts[max(1, CELLS // width) :]
            stop = some[:, None] + np.arange(width)
            inside = stop < upto[some][:, None]
            stop = np.minimum(stop, len(place) - 1)
            shared = np.cumsum((full[stop] < some[:, None]) & inside, axis=1)
            dice = np.where(inside, 2 * shared / (place[stop] - place[some][:, None] + 1 + self.sizes[k]), 0.0)
            best = width - 1 - dice[:, ::-1].argmax(1)
            row = np.arange(len(some))
            ok = dice[row, best] >= self.threshold - 1e-12
            out.append((dice[row, best][ok], place[some][ok], place[stop[row, best]][ok] + 2))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def matches(self, words: list[bytes]) -> list[tuple[float, int, int, int]]:
        """(dice, template, first word, last word + 1) of passages that don't overlap. Of the best passages from each first word, those of families last, the most similar come first (then the earlier, the longer, the first template)."""
        if len(words) < 2:
            return []
        place, code = self.bigrams(words)
        if len(place) < self.least.min(initial=np.inf):
            return []
        which, n = np.unique(code, return_counts=True)
        found = []
        for k in np.flatnonzero(np.minimum(self.often[:, which], n).sum(1) >= self.least).tolist():
            own = self.often[k][code] > 0
            dice, first, last = self.passages(k, place[own], code[own])
            found += [(self.names[k] in FAMILIES, -d, i, -j, k) for d, i, j in zip(dice.tolist(), first.tolist(), last.tolist(), strict=True)]
        taken, out = np.zeros(len(words), bool), []
        for _, d, i, j, k in sorted(found):
            if not taken[i:-j].any():
                taken[i:-j] = True
                out.append((-d, k, i, -j))
        return out


def scan(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, matches (license, dice, first word, last word + 1; in the order of the text) for every row of docs: doc_id, text (others ignored).

    Null and empty texts, and those of one word, have no matches. Whole texts are scanned, however long. Equal rows have equal results; no rows give no rows. Passages don't overlap:
    of those that do, the most similar counts, but a family (FAMILIES) only where no licence does.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Templates(templates, threshold)
        for b in batches:
            found = []
            texts = b["text"].tolist()
            for s in text_runs(texts):
                for t in texts[s]:
                    m = sorted(known.matches(alnum_words(t)), key=lambda m: m[2])
                    found.append([{"license": known.names[k], "dice": d, "start": i, "stop": j} for d, k, i, j in m])
            yield pd.DataFrame({"doc_id": b["doc_id"], "matches": found})

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, matches array<struct<license:string,dice:double,start:int,stop:int>>")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_matches, licenses (sorted, comma-joined), best_dice (null without matches)."""
    found = scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"),
        F.array_max(F.transform("matches", lambda m: m["dice"])).alias("best_dice"),
    )
