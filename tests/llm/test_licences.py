from fractions import Fraction

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.licences import TEMPLATES, LicenceScanner, bigrams, scan_licences, units, words
from plumbline.llm.queries import ORACLE_SQL, QUERIES

LEAST = Fraction(4, 5)


def slow_scan(text, templates):
    out = set()
    for begin, end in units(text):
        a = bigrams(words(text[begin:end]))
        for name, t in templates.items():
            b = bigrams(words(t))
            if a and b and Fraction(2 * len(a & b), len(a) + len(b)) >= LEAST:
                out.add((name, 2 * len(a & b) / (len(a) + len(b)), begin, end))
    return out


PART = st.sampled_from([*" ".join(TEMPLATES.values()).split()[:60], "\n", "\n\n", "Other", "words,"]) | st.sampled_from(list(TEMPLATES.values()))


@given(st.lists(PART, max_size=30).map(" ".join))
@settings(max_examples=200, deadline=None)
def test_bounds_lose_nothing(text):
    assert set(LicenceScanner(TEMPLATES, LEAST).scan(text)) == slow_scan(text, TEMPLATES)


def test_changed_and_wrapped_notices_are_found():
    scanner = LicenceScanner(TEMPLATES, LEAST)
    wrapped = "Intro.\n\n" + TEMPLATES["mit"].replace(" software ", " program ", 1).replace(", ", ",\n") + "\n\nRest of it."
    hits = [h for h in scanner.scan(wrapped) if h[0] == "mit"]
    assert len(hits) >= 1 and 0.8 <= hits[0][1] < 1
    assert not list(scanner.scan("the software and the terms of the public at large " * 50))


def test_query_is_the_sql(spark):
    at = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in QUERIES["op2_licences"](spark, at).select("doc_id", "licence", "dice").collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    assert got == sorted(db.execute(ORACLE_SQL["op2_licences"]).fetchall())
    assert got


def test_odd_rows(spark):
    long = "word " * 100_000 + "\nAll rights reserved.\n" + "more " * 1000
    rows = [(1, None, "a"), (2, "", "a"), (None, "All rights reserved", "a"), (3, long, "a"), (3, long, "a")]
    got = scan_licences(spark.createDataFrame(rows, "doc_id long, text string, licence string")).collect()
    assert sorted((r.doc_id or 0, r.licence, r.dice, r.begin, r.end) for r in got) == [
        (0, "all-rights-reserved", 1.0, 0, 19), (3, "all-rights-reserved", 1.0, 500_001, 500_021), (3, "all-rights-reserved", 1.0, 500_001, 500_021),
    ]
    assert scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def slow_windows(text, template, lo=0, hi=None):
    """{(coefficient, first word, end word)} by trying all windows."""
    w, b = words(text), bigrams(words(template))
    hi = len(w) if hi is None else hi
    tried = [(Fraction(2 * len(a & b), len(a) + len(b)), i, j) for i in range(lo, hi) for j in range(i + 2, hi + 1) if (a := bigrams(w[i:j]))]
    good = [t for t in tried if t[0] >= LEAST]
    if not good:
        return set()
    dice, i, j = min(good, key=lambda t: (-t[0], t[2] - t[1], t[1]))
    return {(float(dice), i, j)} | slow_windows(text, template, lo, i) | slow_windows(text, template, j, hi)


@given(st.lists(st.sampled_from("a a b c d e f x".split()), max_size=24), st.sampled_from(["a b", "a b c", "a b c d e f", "a b a c a d e"]))
@settings(max_examples=300, deadline=None)
def test_windows_are_those_of_trying_all(found, template):
    scanner = LicenceScanner({"t": template}, LEAST)
    text = " ".join(found)
    hits = [h for h in scanner.notices(text) if not h[4]]
    want = {(d, 2 * i, 2 * j - 1) for d, i, j in slow_windows(text, template)}
    around = {h[1:4] for h in scanner.scan(text)}
    assert {h[1:4] for h in hits} == {t for t in want if not any(u[0] >= t[0] and u[1] <= t[1] and t[2] <= u[2] for u in around)}


BSD = """Copyright (c) 2020, Some Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_notices_over_paragraphs_and_inside_a_line(spark):
    other = " ".join(f"w{i}" for i in range(300))
    line = "\u0130: this module is released under the MIT License. See the file for details."
    rows = [(1, BSD), (2, APACHE + "\n" + other), (3, line), (4, other)]
    got = {(r.doc_id, r.licence): r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).where("NOT unit").collect()}
    assert {(1, "bsd-2-clause"), (2, "apache-2.0-header"), (3, "mit-reference")} <= set(got)
    assert all(r.doc_id < 4 and r.dice >= 0.8 for r in got.values())
    assert line[got[3, "mit-reference"].begin : got[3, "mit-reference"].end] == "released under the MIT License"


def test_the_headers_of_one_family_are_told_apart():
    scanner = LicenceScanner(TEMPLATES, LEAST)
    for name in ("gpl-2.0-header", "gpl-3.0-header", "lgpl-2.1-header", "agpl-3.0-header", "bsd-2-clause", "bsd-3-clause"):
        hits = {h[0]: h[1] for h in scanner.notices("Before it. " + TEMPLATES[name] + " After it, other words follow.")}
        assert hits[name] == max(hits.values()) == 1.0 and sum(d == 1.0 for d in hits.values()) == 1 + (name == "bsd-3-clause")


def test_many_notices_in_one_text_are_all_found():
    text = (TEMPLATES["mit"] + " ") * 100 + "All rights reserved " * 3000
    hits = [h for h in LicenceScanner(TEMPLATES, LEAST).notices(text) if not h[4]]
    assert sum(h[0] == "mit" for h in hits) >= 99 and sum(h[0] == "all-rights-reserved" for h in hits) >= 3000
