"""Licence notices in texts, by the Dice coefficient over word bigrams against templates.

A passage is any run of words as long as a template is, or within the bounds that still allow
the wanted coefficient. Passages are tried only where a bigram of a template stands, and only
with templates whose size allows the coefficient.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.texts import SPACES, Words, slices

# Names and customary short notices of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: What parts words: white space, and ASCII that is no letter, digit or full stop.
_BREAKS = SPACES.copy()
for _byte in range(128):
    if not (chr(_byte).isalnum() or chr(_byte) == "."):
        _BREAKS[_byte] = True


def _trimmed(words: list[bytes]) -> list[bytes]:
    return [w.strip(b".") or w for w in words]


@dataclass(frozen=True)
class Template:
    name: str
    bigrams: tuple[tuple[bytes, bytes], ...]


def templates(given: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[Template, ...]:
    made = []
    for name, text in given:
        held = Words(pa.array([text]), _BREAKS, lower=True)
        words = _trimmed(held.words.to_pylist())
        made.append(Template(name, tuple(zip(words, words[1:]))))
    return tuple(t for t in made if t.bigrams)


class Scanner:
    """Best passages of texts against templates, at a coefficient of ``least`` or more."""

    def __init__(self, given: tuple[Template, ...], least: float):
        self.templates, self.least = given, least
        self.bags = [Counter(t.bigrams) for t in given]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in given for w in chain.from_iterable(t.bigrams)}))}
        self.of: dict[tuple[bytes, bytes], list[int]] = {}
        for i, bag in enumerate(self.bags):
            for pair in bag:
                self.of.setdefault(pair, []).append(i)

    def scan(self, texts: pa.Array) -> list[list[dict]]:
        held = Words(texts, _BREAKS, lower=True)
        codes, distinct = held.coded()
        known = np.array([(w.strip(b".") or w) in self.vocabulary for w in distinct.to_pylist()], bool)
        found: list[list[dict]] = [[] for _ in range(len(texts))]
        if not known.any():
            return found
        # Places where two words of templates follow one another.
        marks = known[codes]
        both = np.flatnonzero(marks[:-1] & marks[1:])
        owner = np.searchsorted(held.first, both, "right") - 1
        inside = both + 1 < held.first[owner + 1]
        names = distinct.to_pylist()
        word = lambda i: names[codes[i]].strip(b".") or names[codes[i]]
        groups: dict[int, list[tuple[int, tuple[bytes, bytes]]]] = {}
        for at, text in zip(both[inside].tolist(), owner[inside].tolist()):
            pair = (word(at), word(at + 1))
            if pair in self.of:
                groups.setdefault(text, []).append((at - int(held.first[text]), pair))
        for text, hits in groups.items():
            size = int(held.first[text + 1] - held.first[text])
            found[text] = self._best(hits, size)
        return found

    def _best(self, hits: list[tuple[int, tuple[bytes, bytes]]], size: int) -> list[dict]:
        by_template: dict[int, list[tuple[int, tuple[bytes, bytes]]]] = {}
        for hit in hits:
            for i in self.of[hit[1]]:
                by_template.setdefault(i, []).append(hit)
        passages = []
        for i, own in by_template.items():
            total = sum(self.bags[i].values())
            # 2 * shared / (total + n) >= least with shared <= min(n, total, hits)
            if 2 * min(len(own), total) / (total + min(len(own), total)) < self.least:
                continue
            longest = int(total * (2 - self.least) / self.least + 1e-9)
            for k, (start, _) in enumerate(own):
                left, shared, best = dict(self.bags[i]), 0, None
                for j in range(k, len(own)):
                    at, pair = own[j]
                    if at - start + 1 > longest:
                        break
                    if left.get(pair, 0):
                        left[pair] -= 1
                        shared += 1
                    dice = 2 * shared / (total + at - start + 1)
                    if dice >= self.least and (best is None or dice > best[0]):
                        best = (dice, at + 2)
                if best:
                    passages.append((-best[0], start, best[1], self.templates[i].name))
        starts: list[int] = []
        kept: dict[int, dict] = {}
        for score, start, stop, name in sorted(passages):
            # Kept passages are apart, so only the neighbours can overlap.
            place = bisect_right(starts, start)
            if (place and kept[starts[place - 1]]["stop"] > start) or (place < len(starts) and starts[place] < stop):
                continue
            starts.insert(place, start)
            kept[start] = {"licence": name, "dice": -score, "start": start, "stop": stop}
        return [kept[start] for start in starts]


@lru_cache(maxsize=2)
def scanner(given: tuple[Template, ...], least: float) -> Scanner:
    return Scanner(given, least)


_KIND = "array<struct<licence:string,dice:double,start:int,stop:int>>"
_ARROW = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))


def scan_licences(
    docs: DataFrame, given: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.9, text_column: str = "text"
) -> DataFrame:
    """All rows and columns of ``docs`` with ``licences``: the notices found, in order of place.

    A notice is a passage (words ``start`` to ``stop``) whose bigrams have a Dice coefficient of
    ``least`` or more with those of a template. Of passages that overlap, the better one stays,
    of equals the first. Words are compared in lower case (A-Z), without punctuation. Null and
    empty texts have none, repeated rows the same, an empty table stays empty. A text as a whole
    is licensed by what it holds: see the list. Whole texts are read, nothing is shuffled.
    """
    held = templates(given)

    def scan(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            out += scanner(held, least).scan(part.column("text"))
        return pa.array(out, _ARROW)

    run = F.arrow_udf(scan, _KIND).asNondeterministic()
    return docs.withColumn("licences", run(F.col(text_column).cast("string")))
