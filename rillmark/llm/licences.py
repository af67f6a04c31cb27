"""License scans: a trained paragraph classifier with an unknown class, confirmed by comparison with templates."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.storage import prepare
from rillmark.llm.words import chunks, sequence_hash, word_bounds, word_hashes

# Licence families with the names that notices use, and the public wording of their notices.
NAMES = {
    "agpl-3.0": ("GNU Affero General Public License, version 3", "GNU AGPLv3"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"),
    "bsd-2-clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "bsd-3-clause": ("BSD 3-Clause License", "New BSD License"),
    "cc-by-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "cc-by-nc-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "cc-by-sa-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "cc0-1.0": ("CC0 1.0 Universal Public Domain Dedication", "CC0 1.0"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU GPLv2"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU GPLv3"),
    "isc": ("ISC License",),
    "lgpl-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPLv2.1"),
    "lgpl-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPLv3"),
    "mit": ("MIT License",),
    "mpl-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"),
}
NOTICES = {
    "agpl-3.0": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS."),
    "bsd-2-clause": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders",),
    "bsd-3-clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.",),
    "gpl-2.0": ("You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
                "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    "gpl-3.0": ("You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
                "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "lgpl-2.1": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",),
    "lgpl-3.0": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
# Notices of families outside the set, and sentences that only speak of licences; they are unknown.
OTHERS = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission.",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
    "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Artistic License 2.0.", "Released under the Unlicense.", "Licensed under the Academic Free License version 3.0.",
    "Do what the fuck you want to public license.", "All rights reserved. No part of this publication may be reproduced without permission of the publisher.",
    "Use of this software is governed by a commercial license agreement with the vendor.",
    "The driver lost their licence after the accident.", "A fishing licence can be bought at the town hall.", "The licence of poets is under review by the general public.",
    "The committee will publish the terms of the public consultation.", "The university of the state granted the permission to use the hall free of charge.",
    "Version 2 of the general terms was published by the foundation.", "The conditions are met without modification of the source.",
)
# What a short notice begins with, before a name.
OPENINGS = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "Licensed under {}.", "Released under {}.",
            "This work is licensed under a {}.")
TEMPLATES = {family: tuple(o.format(n) for n in names for o in OPENINGS) + NOTICES.get(family, ()) for family, names in NAMES.items()}
FAMILIES = (*sorted(TEMPLATES), "unknown")
UNKNOWN = len(FAMILIES) - 1

# Word runs up to this length are features, hashed to this many bits.
LONGEST = 3
BITS = 16
# Bounds of the training set: paragraphs of documents taken as unknown, and variants of every template.
UNKNOWN_ROWS = 2_000
VARIANTS = 16
# Words of a window; windows of a size follow each other by half of it.  No notice is longer than half of the largest,
# and each fills a quarter of some window at least, or of one of the smallest.
WINDOWS = (12, 24, 48, 96)
# Share of a held-out set of unknown paragraphs that may be taken for a licence, and words that a paragraph must share
# with a template of its family to be confirmed.
FALSE_SHARE = 0.001
CONFIRMED = 0.8
# Words that may stand between the words of a notice.
BETWEEN = 12
# Bytes of words compared with templates, folded; all others part words.
_WORD = np.full(256, 32, np.uint8)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789.")] = list(b"abcdefghijklmnopqrstuvwxyz0123456789.")
_WORD[65:91] = np.arange(97, 123)


def _plain_words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of words of ``[a-z0-9.]`` without a stop behind, and the index of every row's first word."""
    folded = _WORD[flat]
    after = np.append(folded[1:], np.uint8(32))
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = 32
    folded = np.where((folded == 46) & ((after == 32) | (after == 46)), np.uint8(32), folded)
    starts, stops, begin = word_bounds(folded, offsets)
    return starts, stops, word_hashes(folded, starts), begin


def _template_pairs() -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """Family, words, sorted distinct word pairs and their first places, of every template."""
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            flat = np.frombuffer(text.encode(), np.uint8)
            hashes = _plain_words(flat, np.array([0, len(flat)]))[2]
            out.append((family, len(hashes), *np.unique(sequence_hash(hashes, 2), return_index=True)))
    return out


class Words:
    """Words of some texts with their lines and paragraphs.

    Paragraphs end at lines without a word, so line breaks and comment marks inside a notice do not part it.
    """

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.hashes, begin = _plain_words(flat, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
        newline = np.flatnonzero(flat == 10)
        line = np.searchsorted(newline, self.starts)
        fresh = np.ones(len(line), bool)
        fresh[1:] = (self.row[1:] != self.row[:-1]) | (line[1:] - line[:-1] > 1)
        self.paragraph = np.cumsum(fresh)
        self.line = line - np.searchsorted(newline, offsets[:-1])[self.row] if len(line) else line
        self.first = np.flatnonzero(fresh)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First words and ends of windows that cover every paragraph in every size."""
        ends = np.append(self.first[1:], len(self.starts)) if len(self.first) else self.first
        lows, highs = [], []
        for size in WINDOWS:
            step = size // 2
            count = np.maximum(-(-(ends - self.first - step) // step), 1)
            low = np.repeat(self.first, count) + step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            lows.append(low)
            highs.append(np.minimum(low + size, np.repeat(ends, count)))
        return np.concatenate(lows), np.concatenate(highs)


def _notices(words: Words, near: np.ndarray) -> list[tuple[int, int, int, str, float]]:
    """Places near the marked words that hold enough of a template's word pairs: first word, last word, line, family, share."""
    paragraph = words.paragraph
    last = np.searchsorted(paragraph, paragraph, "right") - 1
    pairs = sequence_hash(words.hashes, 2)
    pairs_at = np.flatnonzero((paragraph[1:] == paragraph[:-1]) & near[1:] & near[:-1])
    pairs_at = pairs_at[np.isin(pairs[pairs_at], _ALL_PAIRS)]
    out = []
    for family, length, wanted, places in _PAIRS:
        found = np.minimum(np.searchsorted(wanted, pairs[pairs_at]), len(wanted) - 1)
        here = wanted[found] == pairs[pairs_at]
        at, which = pairs_at[here], found[here]
        least = CONFIRMED * len(wanted)
        until = np.searchsorted(at, np.minimum(at + length + BETWEEN, last[at]))
        maybe = np.flatnonzero(until - np.arange(len(at)) >= least)
        done = -1
        for k in maybe.tolist():
            if at[k] <= done:
                continue
            best = None
            for m in maybe[np.searchsorted(maybe, k) : np.searchsorted(maybe, np.searchsorted(at, at[k] + length))].tolist():
                kinds, first = np.unique(which[m : until[m]], return_index=True)
                if len(kinds) >= least:
                    end = int(at[m + first.max()])
                    best = min(best or (1,), (-len(kinds), int(places[which[m]]), end - int(at[m]), int(at[m]), end))
            if best:
                start, done = best[3], best[4]
                out.append((int(start), int(done + 1), int(words.line[start]), family, -best[0] / len(wanted)))
    return out


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Feature number of every run of ``n`` words."""
    return (sequence_hash(hashes, n) >> np.uint64(64 - BITS)).astype(np.int64)


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, one after the other, and how many each has."""
    data = [t.encode() + b"\n" for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    _, _, hashes, begin = _plain_words(np.frombuffer(b"".join(data), np.uint8), offsets)
    low, count = begin[:-1], np.diff(begin)
    found, owner, sizes = [], [], np.zeros(len(texts), np.int64)
    for n in range(1, LONGEST + 1):
        own = np.maximum(count - n + 1, 0)
        at = np.arange(own.sum()) + np.repeat(low - np.cumsum(own) + own, own)
        found.append(_runs(hashes, n)[at])
        owner.append(np.repeat(np.arange(len(texts)), own))
        sizes += own
    order = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(found)[order], sizes


class Classifier:
    """Multinomial logistic regression on the mean of a window's feature weights, with a fitted temperature."""

    def __init__(self, texts: list[str], families: list[int], steps: int = 200, rate: float = 12.0, keep: float = 1e-5):
        part = np.arange(len(texts)) % 4 == 3  # held out
        index, sizes = text_features(texts)
        y = np.array(families)
        self.weights = np.zeros((1 << BITS, len(FAMILIES)), np.float32)
        self.bias = np.zeros(len(FAMILIES), np.float32)
        row = np.repeat(np.arange(len(texts)), sizes)
        used = ~part[row]
        share = (1 / np.sqrt(np.maximum(sizes, 1))).astype(np.float32)
        target = np.eye(len(FAMILIES), dtype=np.float32)[y]
        weight = np.where(part, 0, 1 / np.bincount(y, minlength=len(FAMILIES))[y]).astype(np.float32)
        weight /= weight.sum()
        order = np.flatnonzero(used)[np.argsort(index[used], kind="stable")]
        columns, begins = np.unique(index[order], return_index=True)
        owner = row[order]
        for _ in range(steps):
            error = (self._softmax(self.logits(index, sizes)) - target) * weight[:, None]
            step = np.add.reduceat((error * share[:, None])[owner], begins, axis=0)
            self.weights[columns] -= rate * (step + keep * self.weights[columns])
            self.bias -= rate * error.sum(axis=0)
        # Calibration on the held-out rows: the temperature with the least loss, then the probability that a known
        # family must reach so that at most FALSE_SHARE of the unknown rows are taken for one.
        held = self.logits(index, sizes)[part]
        loss = {t: -np.log(self._softmax(held / t)[np.arange(len(held)), y[part]] + 1e-12).mean() for t in (0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0)}
        self.temperature = min(loss, key=lambda t: (loss[t], t))
        known = self._softmax(held / self.temperature)[y[part] == UNKNOWN][:, :UNKNOWN].max(axis=1, initial=0)
        self.least = float(max(0.5, np.quantile(known, 1 - FALSE_SHARE))) if len(known) else 0.5
        guess, own = self.predict(held)[0], y[part]
        self.accuracy = float((guess == own).mean())
        self.precision = {f: float((own[guess == k] == k).mean()) if (guess == k).any() else 0.0 for k, f in enumerate(FAMILIES)}

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def logits(self, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.tile(self.bias, (len(sizes), 1))
        filled = np.flatnonzero(sizes)
        if len(filled):
            begins = (np.cumsum(sizes) - sizes)[filled]
            out[filled] += np.add.reduceat(self.weights[index], begins, axis=0) / np.sqrt(sizes[filled])[:, None]
        return out

    def window_logits(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Logits of windows of words, as differences of running sums: every word counts once, however windows overlap."""
        out, sizes = np.zeros((len(low), len(FAMILIES))), np.zeros(len(low))
        for n in range(1, LONGEST + 1):
            runs = _runs(hashes, n)
            sums = np.zeros((len(runs) + 1, len(FAMILIES)))
            np.cumsum(self.weights[runs], axis=0, out=sums[1:], dtype=np.float64)
            end = np.clip(high - n + 1, np.minimum(low, len(runs)), len(runs))
            start = np.minimum(low, end)
            out += sums[end] - sums[start]
            sizes += end - start
        return self.bias + out / np.sqrt(np.maximum(sizes, 1))[:, None]

    def predict(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Family of every window, unknown where no probability suffices, and that probability."""
        p = self._softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        top = p[np.arange(len(p)), best]
        return np.where(top >= self.least, best, UNKNOWN), top


_PAIRS = _template_pairs()
_ALL_PAIRS = np.unique(np.concatenate([p[2] for p in _PAIRS]))


def training_set(docs: DataFrame) -> tuple[list[str], list[int]]:
    """Variants of the templates and of OTHERS, and a bounded sample of lines without licence words as unknown.

    Variants drop or swap single words, fold case and add words of the sample on both sides.  The sample has at most
    UNKNOWN_ROWS lines: those of the smallest hashes, below a bound that follows from the number of lines, so that tasks
    send a few of them only.
    """
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).filter(F.length("line").between(10, 2_000))
    share = min(1.0, 10 * UNKNOWN_ROWS / max(lines.count(), 1))
    key = F.xxhash64("line")
    lines = lines.filter(F.shiftrightunsigned(key, 11) < int(share * (1 << 53)) + 1)
    lines = lines.filter(~F.rlike(F.lower("line"), F.lit("licen[sc]e|copyright|redistribut|warrant")))
    unknown = [r["line"] for r in lines.distinct().orderBy(key, "line").limit(UNKNOWN_ROWS).collect()]
    rng = np.random.default_rng(5)
    texts, families = list(unknown), [UNKNOWN] * len(unknown)
    filler = [w for t in unknown[:200] for w in t.split()][:2_000] or ["text"]
    every = [(k, t) for k, family in enumerate(FAMILIES[:UNKNOWN]) for t in TEMPLATES[family]] + [(UNKNOWN, t) for t in OTHERS]
    # Words that no family owns may be missing: those in the templates of four families at least.
    shared = {w for t in TEMPLATES.values() for x in t for w in x.split() if w.isalpha() and sum(any(w in x.split() for x in u) for u in TEMPLATES.values()) >= 4}
    for k, template in every:
        for variant in range(VARIANTS):
            words = template.split()
            loose = [i for i, w in enumerate(words) if w in shared or k == UNKNOWN]
            if variant % 3 and len(words) > 6 and loose:
                at = loose[int(rng.integers(len(loose)))]
                words[at : at + 1] = [filler[int(rng.integers(len(filler)))]] * (variant % 3 - 1)
            if variant % 4 >= 2:
                around = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(1, 2 * len(words) + 6)))]
                cut = int(rng.integers(len(around) + 1))
                words = around[:cut] + words + around[cut:]
            texts.append(" ".join(words))
            families.append(k)
    return texts, families


def judged(words: Words, model: Classifier) -> dict[tuple[int, int, str], float]:
    """Confirmed notices, (row, line, family), with the probability of the window they stand in.

    The classifier judges every window of every paragraph.  Around those it names a family for, the templates of all
    families are compared; a place counts if a window with most of it was named after its family, no other family's
    template fits it better, and no other place of its own family that it overlaps is a better one.
    """
    low, high = words.windows()
    family, top = model.predict(model.window_logits(words.hashes, low, high))
    named = np.flatnonzero(family != UNKNOWN)
    named = named[np.argsort(low[named], kind="stable")]
    reach = max(WINDOWS) // 2  # a notice may reach beyond the window it is known by
    near = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(near, np.maximum(low[named] - reach, 0), 1)
    np.add.at(near, np.minimum(high[named] + reach, len(words.starts)), -1)
    places = sorted(_notices(words, np.cumsum(near)[:-1] > 0)) if len(named) else []
    lows = low[named]
    begins, longest = [p[0] for p in places], max((p[1] - p[0] for p in places), default=0)
    found: dict[tuple[int, int, str], float] = {}
    for first, last, line, name, share in places:
        rank = (share, last - first, -first)
        around = places[bisect_left(begins, first - longest) : bisect_right(begins, last)]
        rivals = [(other == name, (s, z - a, -a)) for a, z, _, other, s in around if first <= z]
        if any(r > rank if same else r[0] > share for same, r in rivals):
            continue
        own = named[slice(*np.searchsorted(lows, (first - max(WINDOWS), last + 1)))]
        shared = np.minimum(high[own], last + 1) - np.maximum(low[own], first)
        inside = own[(2 * shared > last - first) & (family[own] == FAMILIES.index(name))]
        if len(inside):
            key = (int(words.row[first]), line, name)
            found[key] = max(found.get(key, 0.0), float(top[inside].max()))
    return found


def _scan(shared):
    def run(batches):
        model: Classifier = shared.value
        for batch in batches:
            for first, flat, offsets in chunks(batch.column("text")):
                found: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
                words = Words(flat, offsets)
                if len(words.starts):
                    for (row, line, name), p in sorted(judged(words, model).items()):
                        found[row].append({"family": name, "line": line, "probability": round(p, 6)})
                kind = pa.list_(pa.struct([("family", pa.string()), ("line", pa.int64()), ("probability", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(found)), pa.array(found, kind)], names=["doc_id", "found"])

    return run


def scan_licences(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """Licence notices of every whole text: ``doc_id`` and ``found``, an array of (family, line, probability).

    Takes integer ``doc_id`` and ``text``; other columns are ignored.  Paragraphs are
    parted by lines without a word; a notice may be wrapped over lines, with comment marks, and stand anywhere in one.
    ``line`` is the one it begins in; the same family counts once per line.  The classifier judges every window of every
    paragraph.  It is trained on the driver on a bounded set (``training_set``); scoring is one pass over the table
    without a shuffle.  A prediction counts if its calibrated probability keeps it out of the unknown class and a template
    of the family confirms it better than those of all others (``judged``).

    Null and empty texts have no notices.  Repeated rows and null ids are rows like others.  An empty table gives an
    empty result.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    shared = spark.sparkContext.broadcast(model or Classifier(*training_set(docs)))
    return rows.mapInArrow(_scan(shared), "doc_id long, found array<struct<family:string,line:long,probability:double>>")
