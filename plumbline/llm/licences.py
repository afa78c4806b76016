"""Licence scans: normalised text compared to licence templates by the Dice coefficient of sets of word bigrams.

A text's units are its lines, its paragraphs and the whole. With a least coefficient d, a unit of a bigrams can only
match a template of b if d / (2 - d) <= a / b <= (2 - d) / d, and needs d * (a + b) / 2 of the template's bigrams. A
document that lacks even the fewest that any such unit would need is done after one pass over its words.

A notice can also span some lines or paragraphs, or be part of a line. Every run of lines or paragraphs is a window of
words, so all windows of words are compared: of those that share no word, the best first. The best window begins and
ends with a bigram of the template that occurs once in it, which leaves few to try.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short notices and the operative parts of common licences.
TEMPLATES = {
    "apache-2.0-reference": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "mit-reference": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions:"
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, '
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so"
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "epl-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version."
    ),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."
    ),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "gpl-3.0-reference": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "lgpl-3.0-reference": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "cc-by-4.0-reference": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-reference": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-reference": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}
NORMAL = re.compile(r"[a-z0-9]+")
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
SCHEMA = "doc_id long, licence string, dice double, begin long, end long, unit boolean"


def words(text: str) -> list[str]:
    return NORMAL.findall(text.lower())


def bigrams(found: list[str]) -> set[tuple[str, str]]:
    return set(zip(found, found[1:], strict=False))


def units(text: str) -> Iterator[tuple[int, int]]:
    """Distinct (begin, end) of the lines, the paragraphs and the whole."""
    spans, at = {(0, len(text))}, 0
    for line in text.split("\n"):
        spans.add((at, at + len(line)))
        at += len(line) + 1
    at = 0
    for m in PARAGRAPH.finditer(text):
        spans.add((at, m.start()))
        at = m.end()
    spans.add((at, len(text)))
    yield from sorted(spans)


class LicenceScanner:
    def __init__(self, templates: dict[str, str], least: Fraction) -> None:
        self.least = least
        self.sets = {name: bigrams(words(t)) for name, t in templates.items()}
        self.index: dict[tuple[str, str], list[str]] = {}
        for name, own in self.sets.items():
            for pair in own:
                self.index.setdefault(pair, []).append(name)
        #: By name: fewest and most bigrams of a unit that can match, and the fewest shared with the smallest such unit.
        self.bounds = {n: (len(s) * least / (2 - least), len(s) * (2 - least) / least, len(s) * least / (2 - least)) for n, s in self.sets.items() if s}

    def _candidates(self, found: list[str]) -> list[str]:
        shared: dict[str, int] = {}
        for pair in {p for p in zip(found, found[1:], strict=False) if p in self.index}:
            for name in self.index[pair]:
                shared[name] = shared.get(name, 0) + 1
        return [n for n, k in shared.items() if k >= self.bounds[n][2]]

    def scan(self, text: str) -> Iterator[tuple[str, float, int, int]]:
        """(licence, coefficient, begin, end) of each unit and each template it matches."""
        names = self._candidates(words(text))
        if names:
            yield from self._units(text, names)

    def notices(self, text: str) -> Iterator[tuple[str, float, int, int, bool]]:
        """What `scan` gives, with True; then (licence, coefficient, begin, end, False) of each window, without those
        inside a unit whose coefficient is not below theirs."""
        names = self._candidates(words(text))
        if not names:
            return
        hits = sorted(self._units(text, names), key=lambda h: h[2])
        yield from ((*h, True) for h in hits)
        pairs, spans = self._places(text)
        following, seen = [0] * len(pairs), {}
        for k in range(len(pairs) - 1, -1, -1):
            following[k] = seen.get(pairs[k], len(pairs))
            seen[pairs[k]] = k
        for name in names:
            own = iter([h for h in hits if h[0] == name])
            later, around = next(own, None), []
            for dice, a, b in self._windows(pairs, following, name):
                begin, end = spans[a][0], spans[b + 1][1]
                while later and later[2] <= begin:
                    around.append(later)
                    later = next(own, None)
                around = [h for h in around if h[3] > begin]
                if not any(h[1] >= dice and h[3] >= end for h in around):
                    yield name, dice, begin, end, False

    @staticmethod
    def _places(text: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
        """The text's bigrams in order, and (begin, end) of its words."""
        lower = text.lower()
        spans = [m.span() for m in NORMAL.finditer(lower)]
        found = [lower[a:b] for a, b in spans]
        if len(lower) != len(text):  # a letter whose lower case is longer
            at = [i for i, c in enumerate(text) for _ in c.lower()]
            spans = [(at[a], at[b - 1] + 1) for a, b in spans]
        return list(zip(found, found[1:], strict=False)), spans

    def _windows(self, pairs: list[tuple[str, str]], following: list[int], name: str) -> list[tuple[float, int, int]]:
        """(coefficient, first bigram, last bigram), in order, of the template's windows: the one with the greatest
        coefficient, among equals the shortest, then the first; and so on in the words before it and after it.

        following: for each bigram, where the same one is next. One option for each first bigram is kept; it is found
        again up to a window that was taken meanwhile.
        """
        own, most = self.sets[name], self.bounds[name][1]
        up, down = self.least.numerator, self.least.denominator

        def best(a: int, stop: int) -> tuple[float, int, int] | None:
            found, seen, shared = None, set(), 0
            for b in range(a, min(stop, following[a])):
                if pairs[b] not in seen:
                    seen.add(pairs[b])
                    total = len(seen) + len(own)
                    if len(seen) > most:
                        break
                    if pairs[b] in own:
                        shared += 1
                        if 2 * shared * down >= up * total and (found is None or 2 * shared / total > -found[0]):
                            found = -2 * shared / total, b - a, a
            return found

        options = [o for k, p in enumerate(pairs) if p in own and (o := best(k, len(pairs)))]
        heapify(options)
        taken: list[tuple[int, int, float]] = []
        while options:
            dice, length, a = heappop(options)
            i = bisect(taken, a, key=lambda t: t[0])
            if i and a <= taken[i - 1][1] + 1:
                continue
            if i < len(taken) and a + length + 1 >= taken[i][0]:
                if again := best(a, taken[i][0] - 1):
                    heappush(options, again)
                continue
            taken.insert(i, (a, a + length, -dice))
        return [(dice, a, b) for a, b, dice in taken]

    def _units(self, text: str, names: list[str]) -> Iterator[tuple[str, float, int, int]]:
        low, high = min(self.bounds[n][0] for n in names), max(self.bounds[n][1] for n in names)
        for begin, end in units(text):
            found = words(text[begin:end])
            if len(found) - 1 < low:
                continue
            own = bigrams(found)
            if not low <= len(own) <= high:
                continue
            for name in names:
                if self.bounds[name][0] <= len(own) <= self.bounds[name][1]:
                    dice = Fraction(2 * len(own & self.sets[name]), len(own) + len(self.sets[name]))
                    if dice >= self.least:
                        yield name, dice.numerator / dice.denominator, begin, end


def scan_licences(docs: DataFrame, *, least_percent: int = 80, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, licence, dice, begin, end, unit) for each unit and window of words of each row of `docs` (doc_id, text) and
    each template with a coefficient of least_percent / 100 or more; begin and end are code points of the text.

    A unit is a line, a paragraph or the whole text; units of the same place count once. Windows (unit is false) of one
    licence share no word: the best is taken first, then the best of what is left; one inside a unit of the same licence
    with at least its coefficient is left out. Null and empty texts match
    nothing. Rows with null or repeated doc_ids are scanned like any other. Other columns are ignored; an empty table
    gives no rows. The templates are a small fixed table that goes with the code.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenceScanner(chosen, Fraction(least_percent, 100))
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column(1)):
                own = text.as_py()
                if own:
                    doc_id = batch.column(0)[i].as_py()
                    out.extend((doc_id, *hit) for hit in scanner.notices(own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def oracle_sql(least_percent: int = 80) -> str:
    """DuckDB: the greatest coefficient for each document and licence."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    split = "regexp_extract_all(lower({}), '[a-z0-9]+')"
    return f"""
        WITH templates AS (SELECT licence, {grams} AS b FROM (SELECT licence, {split.format("t")} AS w FROM (VALUES {rows}) v(licence, t))),
        units AS (
            SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)) || string_split_regex(text, '\\n[ \\t\\r]*\\n') || [text])) AS u
            FROM documents WHERE text IS NOT NULL
        ),
        grams AS (SELECT doc_id, {grams} AS a FROM (SELECT doc_id, {split.format("u")} AS w FROM units) WHERE len(w) > 1),
        scored AS (
            SELECT doc_id, licence, 2 * len(list_intersect(a, b)) AS twice, len(a) + len(b) AS total
            FROM grams, templates WHERE 100 * len(a) * 3 >= 100 * len(b) * 2 AND len(a) * 2 <= len(b) * 3
        )
        SELECT doc_id, licence, max(twice::DOUBLE / total) AS dice FROM scored
        WHERE twice * 100 >= {least_percent} * total GROUP BY doc_id, licence"""
