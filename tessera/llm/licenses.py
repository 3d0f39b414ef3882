"""Licence scans over a positional rare-token index of licence texts.

The words of every mandatory phrase are posted under their places in it; a template without phrases of its own is one.
The document frequencies of all templates' words are counted over the whole corpus. A text's licence words are looked up from the rarest (highest IDF) on: the rarest word of a mandatory phrase
opens the starts that its places in the text minus its place in the phrase give, and the postings of the phrase's
other words are intersected with them by relative position, until all of its words stand in a row or no start is left.
A template's other words are compared in place.
A template matches where its rarest phrase stands and all its other mandatory phrases stand in order around it, each at
most SLACK words away from its place in the template, as texts insert names and lines. The score is the IDF-weighted
share of the template's words that stand in place relative to one of these phrases.

Null texts count as empty; texts may be of any length. Repeated rows are each scanned; of templates of equal score the
matches keep the templates' order. Extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table

#: label, template text, mandatory phrases in order; a template without its own phrases is mandatory as a whole.
#: The wording of public licences and their notices.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("cc-by", "cc by", ()),
    ("gpl", "general public license", ()),
    ("reserved", "all rights reserved", ()),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc0", "dedicated to the public domain under cc0 1 0", ("cc0 1 0",)),
    ("creative-commons", "licensed under a creative commons attribution license", ("creative commons",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("mpl", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("epl", "made available under the eclipse public license", ("eclipse public license",)),
    ("spdx", "spdx license identifier", ()),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
        ("permission is hereby granted free of charge", "shall be included in all copies or substantial portions of the software"),
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.""",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice"),
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        ("permission to use copy modify and or distribute this software", "appear in all copies"),
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions:""",
        ("in no event will the authors be held liable", "alter it and redistribute it freely"),
    ),
    (
        "boost",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software""",
        ("person or organization obtaining a copy of the software", "execute and transmit the software"),
    ),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
        ("licensed under the apache license version 2 0", "distributed under the license is distributed on an as is basis"),
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        ("under the terms of the gnu general public license", "distributed in the hope that it will be useful"),
    ),
    (
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ("source code form is subject to the terms of the mozilla public license",),
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ("free and unencumbered software released into the public domain",),
    ),
]
#: The first templates are the contract's phrases.
BASE = 3
#: Words that may stand between a phrase and where its template has it.
SLACK = 60
_MAP = bytes(i + 32 if 65 <= i <= 90 else 32 if i < 0x30 or 0x3A <= i <= 0x60 or 0x7B <= i < 0x80 else i for i in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_MAP).split()


def vocabulary() -> list[bytes]:
    return sorted({w for _, t, _ in TEMPLATES for w in words(t.encode())})


def _frequencies(batch: pa.RecordBatch) -> dict:
    vocab = frozenset(vocabulary())
    seen: dict[bytes, int] = {}
    for b in batch.column(0).to_pylist():
        for w in vocab.intersection(words(b or b"")):
            seen[w] = seen.get(w, 0) + 1
    return {"w": [*(w.decode() for w in seen), ""], "n": [*seen.values(), batch.num_rows]}


class Phrase:
    """A mandatory phrase: its words, its place in its template, and its own places by falling IDF."""

    def __init__(self, words: list[bytes], offset: int, idf: dict[bytes, float]) -> None:
        self.words, self.offset = words, offset
        self.order = sorted(range(len(words)), key=lambda i: (-idf[words[i]], words[i], i))
        self.weight = sum(idf[w] for w in words)


class Index:
    """Postings of the mandatory phrases' words; each phrase is opened by its rarest word."""

    def __init__(self, frequency: dict[bytes, int], rows: int) -> None:
        self.idf = {w: math.log((rows + 1) / (frequency.get(w, 0) + 1)) + 1e-9 for w in vocabulary()}
        self.templates: list[tuple[str, list[bytes], float, list[int], int]] = []
        self.phrases: list[Phrase] = []
        known: dict[tuple[bytes, ...], int] = {}
        #: word -> (phrase, place in it, how many rarer words the phrase has)
        self.postings: dict[bytes, list[tuple[int, int, int]]] = {}
        self.offsets: list[list[int]] = []
        for label, text, phrases in TEMPLATES:
            whole, ids, offsets = words(text.encode()), [], []
            for p in phrases or (text,):
                phrase = words(p.encode())
                offsets.append(next(i for i in range(len(whole)) if whole[i : i + len(phrase)] == phrase))
                if tuple(phrase) not in known:
                    known[tuple(phrase)] = len(self.phrases)
                    made = Phrase(phrase, offsets[-1], self.idf)
                    for nth, i in enumerate(made.order):
                        self.postings.setdefault(phrase[i], []).append((len(self.phrases), i, nth))
                    self.phrases.append(made)
                ids.append(known[tuple(phrase)])
            rarest = max(range(len(ids)), key=lambda i: (self.phrases[ids[i]].weight, -i))
            self.templates.append((label, whole, sum(self.idf[w] for w in whole), ids, rarest))
            self.offsets.append(offsets)
        # a phrase may hold a word twice, so postings of a word are taken by their order in the phrase
        for w in self.postings:
            self.postings[w].sort(key=lambda x: (x[0], x[2]))
        self.order = {w: i for i, w in enumerate(sorted(self.postings, key=lambda w: (-self.idf[w], w)))}
        self.openers = frozenset(p.words[p.order[0]] for p in self.phrases)

    def starts(self, ws: list[bytes]) -> dict[int, list[int]]:
        """Phrase -> its first words in the text, by intersecting postings from the rarest word on."""
        if self.openers.isdisjoint(ws):
            return {}
        at: dict[bytes, list[int]] = {}
        order = self.order
        for i, w in enumerate(ws):
            if w in order:
                at.setdefault(w, []).append(i)
        live: dict[int, set[int]] = {}
        met: dict[int, int] = {}
        for w in sorted(at, key=order.__getitem__):
            places: frozenset[int] | None = None
            for phrase, i, nth in self.postings[w]:
                if not nth:
                    live[phrase], met[phrase] = {p - i for p in at[w] if p >= i}, 1
                elif phrase in live and met[phrase] == nth:
                    places = places or frozenset(at[w])
                    live[phrase] = {s for s in live[phrase] if s + i in places}
                    met[phrase] += 1
                if phrase in live and not live[phrase]:
                    del live[phrase]
        return {p: sorted(s) for p, s in live.items() if met[p] == len(self.phrases[p].words)}

    def matches(self, ws: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, first word of its rarest mandatory phrase, share of the template's weight that stands in place)."""
        found = self.starts(ws)
        out = []
        for k, (_, whole, weight, ids, rarest) in enumerate(self.templates if found else ()):
            if any(p not in found for p in ids):
                continue
            offsets = self.offsets[k]
            for a in found[ids[rarest]]:
                start, shifts = a - offsets[rarest], []
                for j, p in enumerate(ids):
                    want = start + offsets[j]
                    near = [s for s in _around(found[p], want) if abs(s - want) <= SLACK]
                    if j == rarest:
                        near = [a]
                    if not near:
                        break
                    shifts.append(min(near, key=lambda s: (abs(s - want), s)) - offsets[j])
                if len(shifts) < len(ids) or any(x + offsets[j] >= y + offsets[j + 1] for j, (x, y) in enumerate(zip(shifts, shifts[1:], strict=False))):
                    continue
                got = sum(self.idf[x] for j, x in enumerate(whole) if any(0 <= s + j < len(ws) and ws[s + j] == x for s in dict.fromkeys(shifts)))
                out.append((k, a, min(1.0, got / weight)))
        return out


def _around(places: list[int], want: int) -> list[int]:
    """The places next to `want` on both sides."""
    i = bisect_left(places, want)
    return places[max(i - 1, 0) : i + 1]


def _scan(index: Index):
    def rows(batch: pa.RecordBatch) -> dict:
        out = []
        for b in batch.column(1).to_pylist():
            ws = words(b or b"")
            found = index.matches(ws)
            base = [(TEMPLATES[k][0], a) for k, a, _ in found if k < BASE]
            ends = [a for _, a in base]
            labels = sorted({TEMPLATES[k][0] for k, *_ in found})
            out.append((len(ws), len(base), min(ends, default=None), max(ends, default=None), ",".join(sorted({x for x, _ in base})), ",".join(labels), max((s for *_, s in found), default=0.0), [{"label": TEMPLATES[k][0], "start": a, "score": s} for k, a, s in sorted(found)]))
        return {"doc_id": batch.column(0)} | dict(zip(("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"), zip(*out, strict=True), strict=True))

    return rows


def license_scan(docs: DataFrame) -> DataFrame:
    """Every document's places of base phrases, its licence labels, the best template's score, and all matches."""
    counts = map_arrow(docs.select(F.col("text").cast("binary").alias("b")), _frequencies, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()  # a row for each word of the templates
    frequency = {r["w"].encode(): r["n"] for r in counts}
    index = Index(frequency, frequency.get(b"", 0))
    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("b")), _scan(index), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, start: bigint, score: double>>")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("matches")
