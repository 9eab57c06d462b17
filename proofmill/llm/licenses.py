"""License scan: a trained paragraph classifier over word n-grams, confirmed by comparison with templates.

Lines of over WINDOW words are read in windows of that size that overlap by half, so whole texts count. Paragraphs, which
are lines without a blank one between them, are read again in small windows wherever enough of a template lies close
together: so wrapped notices are found at their first line, and a line that grants two licenses has both. Features are hashed words and word pairs (lower-cased, without marks at the ends), each counted, over the root of
their number. Multinomial logistic regression, trained here in numpy, tells license families and an unknown class apart.
It learns from altered templates (words dropped, swapped in or around them) against lines of a bounded sample of
documents and sentences that only mention licenses. A temperature, fitted on a fifth of the material kept from the fit,
calibrates the probabilities. A prediction counts if its probability is LEAST or more and the text holds CONTAINED or
more of a template of that family, as n-grams, and doesn't negate it: a word such as "not" among the REACH words before the
template's first one, or between its words, where the template has none.

Null and empty texts give no row, whatever their id; rows with null ids, or ids that repeat, are scanned each. Lines of any
length are read whole, in windows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_WORDS, Words, as_bytes, batches, bounded_sample, record
from .toxicity import MARKS

BUCKETS, WINDOW, LEAST, CONTAINED, SHORT, REACH = 1 << 20, 60, 0.6, 0.6, 6, 4
UNKNOWN = "unknown"

#: Usual notices of public licenses (fixed values). <year> and <name> stand for any.
TEMPLATES = {
    "AGPL": ("This work is licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program."),
    "Apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD": ("Released under the BSD 3-Clause License.", "This project is licensed under the 2-Clause BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "EPL": ("This program is made available under the terms of the Eclipse Public License 2.0.",),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "You should have received a copy of the GNU General Public License along with this program."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License, version 3.", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    "MIT": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "Proprietary": ("Copyright by the author. All rights reserved.", "Copyright <year> <name>. All rights reserved.", "All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Sentences that mention licenses and grant none.
OTHERS = (
    "The license of the driver was checked at the border.", "Please read the license before you use the software.", "A general public meeting will be held under the terms of the agreement.",
    "He was released under strict conditions.", "The work is free and open to the public.", "Version 2.0 of the program is available.", "They distributed a copy of the paper to any person in the room.",
    "This work was done under the old rules.", "All rights of way are reserved for visitors.", "The software is licensed to many firms.",
    "All rights and duties go to the heirs.", "She has all rights to the house.", "The seats are reserved for all guests.", "The copyright of the book ended in the last century.",
)
#: Identifiers of the families in one-line tags (fixed values).
TAGS = {
    "AGPL": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "Apache": ("Apache-2.0",), "BSD": ("BSD-2-Clause", "BSD-3-Clause"), "CC-BY": ("CC-BY-4.0",), "CC-BY-NC": ("CC-BY-NC-4.0",),
    "CC-BY-SA": ("CC-BY-SA-4.0",), "CC0": ("CC0-1.0",), "EPL": ("EPL-2.0",), "GPL": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"), "ISC": ("ISC",),
    "LGPL": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"), "MIT": ("MIT",), "MPL": ("MPL-2.0",), "Unlicense": ("Unlicense",),
}
TEMPLATES = {k: ts + tuple(f"SPDX-License-Identifier: {tag}" for tag in TAGS.get(k, ())) for k, ts in TEMPLATES.items()}
#: Words that turn a grant into its opposite (fixed values).
NEGATORS = {b"not", b"no", b"never", b"isn't", b"aren't", b"don't", b"doesn't", b"wasn't", b"won't", b"cannot", b"neither", b"nor", b"without", b"instead"}
HOLES = re.compile(r"<(?:year|name)>\.?")


def tokens(text: bytes) -> list[bytes]:
    return [w for w in (x.lower().strip(MARKS) for x in text.split()) if w]


def bucket(word: bytes) -> int:
    return zlib.crc32(word)


def features(numbers: np.ndarray) -> np.ndarray:
    """Buckets of words and of neighbouring pairs, from the words' 32-bit hashes."""
    h = numbers.astype(np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(44)
    return np.concatenate([h % np.uint64(BUCKETS), pairs]).astype(np.int64)


def grams(words: list[bytes]) -> set:
    return {*words, *zip(words, words[1:])}


KNOWN = {k: [set().union(*(grams(tokens(x.encode())) for x in HOLES.split(t))) for t in ts] for k, ts in TEMPLATES.items()}


def contained(words: list[bytes], family: str) -> float:
    """The largest share of a template of the family that the words hold; one of SHORT grams or fewer is held whole or not."""
    own = grams(words)
    return max(len(own & t) / len(t) if len(t) > SHORT or t <= own else 0.0 for t in KNOWN[family])


def negated(before: list[bytes], words: list[bytes], family: str) -> bool:
    """Whether a negator stands before the words of a template, or among them though that template has none."""
    own = grams(words)
    best = max(KNOWN[family], key=lambda t: len(own & t) / len(t))
    return not NEGATORS.isdisjoint(before[-REACH:]) or any(w in NEGATORS and w not in best for w in words)


class Places:
    """Where the words of a text lie close enough to hold CONTAINED of a template, by counts alone: none that do are missed
    in windows of the template's own size and of twice that and four, up to WINDOW."""

    def __init__(self) -> None:
        self.words = np.array(sorted({bucket(g) for ts in KNOWN.values() for t in ts for g in t if isinstance(g, bytes)}), np.uint64)
        code = lambda w: int(np.searchsorted(self.words, np.uint64(bucket(w))))
        pair = lambda g: code(g[0]) * len(self.words) + code(g[1])
        self.pairs = np.array(sorted({pair(g) for ts in KNOWN.values() for t in ts for g in t if isinstance(g, tuple)}))
        self.templates = []
        for family, ts in KNOWN.items():
            for text, t in zip(TEMPLATES[family], ts):
                one, two = np.zeros(len(self.words) + 1, bool), np.zeros(len(self.pairs) + 1, bool)
                one[[code(g) for g in t if isinstance(g, bytes)]] = True
                two[[int(np.searchsorted(self.pairs, pair(g))) for g in t if isinstance(g, tuple)]] = True
                size = len(tokens(text.encode()))
                self.templates.append((family, one, two, CONTAINED * len(t), CONTAINED * len(t) - one.sum(), sorted({size, min(2 * size + 4, WINDOW)})))

    @staticmethod
    def known(values: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Positions of values in a sorted table, or its size."""
        at = np.minimum(np.searchsorted(table, values), len(table) - 1)
        return np.where(table[at] == values, at, len(table))

    def __call__(self, h: np.ndarray, para: np.ndarray):
        """(family, first word, word after the last) of windows that may hold a template; words of a paragraph share para."""
        end = np.searchsorted(para, para, "right")
        word = self.known(h, self.words)
        near = np.flatnonzero((word[:-1] < len(self.words)) & (word[1:] < len(self.words)) & (para[:-1] == para[1:]))
        pair = self.known(word[near] * len(self.words) + word[near + 1], self.pairs)
        for family, one, two, grams_least, pairs_least, sizes in self.templates:
            own = np.flatnonzero(one[word])
            both = near[two[pair]]
            for size in sizes:
                stop = np.minimum(own + size, end[own])
                n_words = np.searchsorted(own, stop) - np.arange(len(own))
                n_pairs = np.searchsorted(both, stop - 1) - np.searchsorted(both, own)
                good = np.flatnonzero((n_words + n_pairs >= grams_least - 1e-9) & (n_pairs >= pairs_least - 1e-9))
                # up to the last word that is in the template
                yield from ((family, a, b + 1) for a, b in zip(own[good].tolist(), own[good + n_words[good] - 1].tolist()))


class Classifier:
    def __init__(self) -> None:
        self.classes = [*sorted(TEMPLATES), UNKNOWN]
        self.w = np.zeros((BUCKETS, len(self.classes)), np.float32)  # while it learns; slot and packed hold the result
        self.b = np.zeros(len(self.classes), np.float32)
        self.temperature = 1.0
        self.pack()

    def pack(self) -> None:
        """Rows in use, after a row of zeros, and each bucket's row among them."""
        used = np.flatnonzero(np.abs(self.w).any(1))
        self.packed = np.concatenate([np.zeros((1, len(self.classes)), np.float32), self.w[used]])
        self.slot = np.zeros(BUCKETS, np.int32)
        self.slot[used] = np.arange(len(used)) + 1

    def logits(self, feats: np.ndarray) -> np.ndarray:
        """Of features, while it learns."""
        return self.w[feats].sum(0) / np.sqrt(max(1, len(feats))) + self.b

    def fit(self, rows: list[np.ndarray], label: np.ndarray, epochs: int = 8, rate: float = 0.5, seed: int = 5) -> None:
        """Stochastic gradient descent; every fifth row is kept for the temperature."""
        rng = np.random.default_rng(seed)
        held = np.arange(len(rows)) % 5 == 0
        for _ in range(epochs):
            for i in rng.permutation(np.flatnonzero(~held)):
                y = self.logits(rows[i])
                p = np.exp(y - y.max())
                p /= p.sum()
                p[label[i]] -= 1
                np.add.at(self.w, rows[i], (-rate / np.sqrt(max(1, len(rows[i]))) * p).astype(np.float32))
                self.b -= (0.1 * rate * p).astype(np.float32)
        y = np.array([self.logits(rows[i]) for i in np.flatnonzero(held)])

        def loss(t: float) -> float:
            z = y / t
            z -= z.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), label[held]]))

        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        self.pack()

    def __getstate__(self) -> dict:
        """Only rows in use travel to the executors."""
        return {"classes": self.classes, "b": self.b, "temperature": self.temperature, "used": np.flatnonzero(self.slot), "packed": self.packed}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.slot = np.zeros(BUCKETS, np.int32)
        self.slot[self.used] = np.arange(len(self.used)) + 1


def material(drawn: list[tuple[bytes, bytes]], variants: int = 40, seed: int = 5) -> tuple[list[list[bytes]], list[str]]:
    """Altered templates with their family; windows of lines as unknown, and so are templates with a negator before them.

    drawn: windows, each with the text around it.
    """
    rng = np.random.default_rng(seed)
    plain = []
    for own, wide in drawn:
        # what is a part of a wrapped notice isn't unknown
        w, around = tokens(own), tokens(wide)
        if w and not any(contained(w, k) >= CONTAINED or (contained(w, k) >= CONTAINED / 3 and contained(around, k) >= CONTAINED) for k in TEMPLATES):
            plain.append(w)
    pool = [w for p in plain for w in p] or [b"and"]
    draw = lambda n: [pool[i] for i in rng.integers(0, len(pool), n)]
    rows, names = [], []
    for family, texts in TEMPLATES.items():
        for t in texts:
            for k in range(variants):
                words = tokens(t.replace("<year>", f"{rng.integers(1970, 2040)}").encode()) if "<" in t else tokens(t.encode())
                words = [x for w in words for x in (draw(int(rng.integers(1, 4))) if w == b"name" else [w])] if "<name>" in t else words
                kept = [w if rng.random() > 0.06 else draw(1)[0] for w in words if rng.random() > 0.06] if k else words
                rows.append([*draw(int(rng.integers(0, 12)) if k % 2 else 0), *kept, *draw(int(rng.integers(0, 12)) if k % 3 == 1 else 0)])
                names.append(family)
                if k % 4 == 0 and not NEGATORS & set(words):
                    lead = [[b"is", b"not"], [b"we", b"do", b"not", b"use"], [b"never"], [b"it", b"is", b"no", b"longer"], [b"instead", b"of"]][int(rng.integers(0, 5))]
                    rows.append([*draw(int(rng.integers(0, 6))), *lead, *words[int(rng.integers(0, 2)) :], *draw(int(rng.integers(0, 6)))])
                    names.append(UNKNOWN)
    for t in OTHERS:
        for _ in range(variants // 2):
            rows.append([w if rng.random() > 0.1 else draw(1)[0] for w in tokens(t.encode())] + draw(int(rng.integers(0, 8))))
            names.append(UNKNOWN)
    rows += plain
    names += [UNKNOWN] * len(plain)
    order = rng.permutation(len(rows))
    return [rows[i] for i in order], [names[i] for i in order]


def draw_lines(text: bytes, n: int, seed: int) -> list[tuple[bytes, bytes]]:
    """Windows of up to WINDOW words at random places of n random lines of the whole text, each with as many words around it."""
    lines = [x.split() for x in text.split(b"\n")]
    words, size = [w for x in lines for w in x], np.array([len(x) for x in lines])
    start, full = np.cumsum(size) - size, np.flatnonzero(size)
    rng, out = np.random.default_rng(seed), []
    for k in rng.choice(full, min(n, len(full)), False) if len(full) else ():
        a = int(start[k] + rng.integers(0, max(1, size[k] - WINDOW + 1)))
        b = int(min(a + WINDOW, start[k] + size[k]))
        out.append((b" ".join(words[a:b]), b" ".join(words[max(0, a - WINDOW) : b + WINDOW])))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 500, lines: int = 6) -> Classifier:
    """Learns with lines of at most max_docs documents, in the order of the id's hash, that executors draw from whole texts."""
    schema = pa.schema([("h", pa.int64()), ("own", pa.list_(pa.binary())), ("wide", pa.list_(pa.binary()))])

    def cut(it):
        for b in it:
            found = [draw_lines(t, lines, h) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield record(schema, b.column(0), [[x for x, _ in f] for f in found], [[x for _, x in f] for f in found])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    chosen = bounded_sample(rows, max_docs, "id", lambda df: df.select("h", "text").mapInArrow(cut, "h long, own array<binary>, wide array<binary>"))
    drawn = [(bytes(x), bytes(y)) for r in chosen.collect() for x, y in zip(r.own, r.wide)]
    rows, names = material(drawn)
    model = Classifier()
    model.fit([features(np.array([bucket(w) for w in r], np.uint64)) for r in rows], np.array([model.classes.index(n) for n in names]))
    return model


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, family, probability, contained): one row for each line and family found, with the best window. What is
    found over several lines has the first one's number.

    Null and empty texts have no rows; rows that repeat are scanned each.
    """
    schema = pa.schema([("id", pa.int64()), ("line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("contained", pa.float64())])
    unknown = model.classes.index(UNKNOWN)

    def run(it):
        words, hashes, places = Words(), np.zeros(0, np.uint64), Places()
        for ids, texts in batches(it):
            for lo in range(0, len(ids), 200):
                if len(words.number) > MAX_WORDS // 2:
                    words, hashes = Words(), hashes[:0]
                lines = [(i, k, line.split()) for i, t in zip(ids[lo : lo + 200].to_pylist(), texts[lo : lo + 200]) if t for k, line in enumerate(t.split(b"\n"))]
                numbers = words.numbers([w for _, _, ws in lines for w in ws])
                if new := words.new():
                    clean = [w.lower().strip(MARKS) for w in new]
                    hashes = np.concatenate([hashes, np.array([bucket(w) if w else 1 << 40 for w in clean], np.uint64)])
                if not len(numbers):
                    continue
                size = np.array([len(ws) for _, _, ws in lines])
                start = np.cumsum(size) - size
                h = hashes[numbers]
                real = np.flatnonzero(h < 1 << 32)
                line_of = np.repeat(np.arange(len(lines)), size)[real]
                h = h[real]
                word = lambda i: lines[line_of[i]][2][real[i] - start[line_of[i]]]
                found, taken = {}, {}

                def find(at, many, family, p, share):
                    mine = taken.setdefault(family, np.zeros(len(h), bool))
                    mine[at : at + many] = True
                    key = (*lines[line_of[at]][:2], family, line_of[at])
                    if key not in found or found[key] < (p, share):
                        found[key] = (p, share)

                para = np.cumsum((size == 0) | (np.array([k for _, k, _ in lines]) == 0))[line_of]
                clean = lambda a, b: [word(i).lower().strip(MARKS) for i in range(a, b)]
                held, denied = [], {}
                for family, a, b in dict.fromkeys(places(h, para)):
                    share = contained(clean(a, b), family)
                    if share >= CONTAINED:
                        if negated(clean(max(a - REACH, int(np.searchsorted(para, para[a]))), a), clean(a, b), family):
                            denied.setdefault(family, np.zeros(len(h), bool))[a:b] = True
                        else:
                            held.append((family, a, b, share))
                at, many = windows(line_of, WINDOW)
                p = probabilities(model, h, at, many)
                best = p.argmax(1)
                for k in np.flatnonzero((best != unknown) & (p.max(1) >= LEAST)):
                    family, own = model.classes[best[k]], slice(at[k], at[k] + many[k])
                    share = contained(clean(own.start, own.stop), family)
                    if share >= CONTAINED and not (family in denied and denied[family][own].any()):
                        find(at[k], many[k], family, float(p[k, best[k]]), share)
                if held:
                    families, a, b, share = zip(*held)
                    p = probabilities(model, h, np.array(a), np.array(b) - np.array(a))[np.arange(len(held)), [model.classes.index(f) for f in families]]
                    for k in sorted(np.flatnonzero(p >= LEAST), key=lambda k: (-share[k], -p[k])):
                        # not again what overlaps a better window of its family
                        if not (families[k] in taken and taken[families[k]][a[k] : b[k]].any()):
                            find(a[k], b[k] - a[k], families[k], float(p[k]), share[k])
                if found:
                    yield record(schema, *zip(*((*key[:3], *value) for key, value in found.items())))

    return as_bytes(docs, id_col, text_col).mapInArrow(run, "id long, line long, family string, probability double, contained double")


def probabilities(model: Classifier, h: np.ndarray, at: np.ndarray, many: np.ndarray) -> np.ndarray:
    score = window_logits(model, h, at, many) / model.temperature
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def windows(line_of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each window; windows start every half size in a line."""
    if not len(line_of):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]]))
    n = np.diff(np.append(first, len(line_of)))
    step = size // 2
    count = np.maximum(1, -(-(n - step) // step))
    at = np.repeat(first, count) + step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return at, np.minimum(np.repeat(first + n, count) - at, size)


def window_logits(model: Classifier, h: np.ndarray, at: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Logits of windows of words with hashes h; only features with weights are looked up and summed."""
    pairs = features(h)
    one, two = pairs[: len(h)], np.append(pairs[len(h) :], 0)
    out = np.zeros((len(at), len(model.classes)))
    for feats, less in ((one, 0), (two, 1)):
        slot = model.slot[feats]
        hit = np.flatnonzero(slot)
        lo, hi = np.searchsorted(hit, at), np.searchsorted(hit, at + many - less)
        sums = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(model.packed[slot[hit]], axis=0, dtype=np.float64)])
        out += sums[hi] - sums[lo]
    return out / np.sqrt(np.maximum(1, 2 * many - 1))[:, None] + model.b
