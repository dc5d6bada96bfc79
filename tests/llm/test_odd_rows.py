"""Row orders, repeated and null ids, clashing names, long texts."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from mendlist.llm import boilerplate, decontaminate, jaccard, langid, licenses, packing, rules, substrings


# --- quality rules


def _broken_lines():
    """31 documents share a line; two more have the same words, one of them without that line's break."""
    line = " ".join(f"w{k}" for k in range(24))
    rest = " ".join(f"own{k}" for k in range(6))
    rows = [(i, f"{line}\nend of {chr(97 + i % 26) * (1 + i // 26)} with some words", "h") for i in range(31)]
    return rows + [(40, f"{line}\n{rest}", "h"), (41, f"{line} {rest}", "h"), (42, f"{line} {rest}", "other")]


@pytest.mark.parametrize("seed", range(4))
def test_same_words_in_other_lines(spark, seed):
    rows = _broken_lines()
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1 + seed)
    got = {r.doc_id: (r.n_frequent_words, r.kept) for r in rules.judged(docs).collect()}
    assert (got[40], got[41], got[42]) == ((24, False), (0, True), (0, True))
    assert all(got[i] == (24, False) for i in range(31))


def test_texts_without_their_frequent_lines(spark):
    rows = _broken_lines() + [(50, None, "h"), (51, "", "h"), (52, "\n\n", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, frequent int").repartition(3)
    judged = {r.doc_id: (r.n_words, r.n_frequent_words, r.base_failed, r.kept) for r in rules.judged(docs).collect()}
    frequent = brute.frequent_words([(i, h or "", t) for i, t, h in rows], rules.LIMIT)
    for r in rules.cleaned(docs).collect():
        text = {i: t for i, t, _ in rows}[r.doc_id]
        lost = " ".join(f"w{k}" for k in range(24))
        kept = None if text is None else "\n".join(x for x in text.split("\n") if x != lost)
        assert r.text == kept
        assert (r.n_words, r.n_frequent_words, r.base_failed, r.kept) == judged[r.doc_id]
        assert r.n_frequent_words == frequent[r.doc_id] == len((text or "").split()) - len((r.text or "").split())


# --- names that operators use inside


@pytest.mark.parametrize("names", [("__drop", "__host", "__kept"), ("__DROP", "host", "drop"), ("__told", "lang_pred", "score")])
def test_clashing_names(spark, names):
    rows = [(i, f"line {i}\nshared", "s", "en", "x", "y", "z") for i in range(20)]
    schema = ", ".join(["doc_id long, text string, source string, lang string", *[f"{n} string" for n in names]])
    docs = spark.createDataFrame(rows, schema)
    lined = boilerplate.without_boilerplate(docs)
    assert all(r.n_dropped == 1 and r[names[0]] == "x" and r[names[2]] == "z" for r in lined.collect())
    predicted = langid.predict(docs, langid.learn(docs))
    assert {r.lang_pred for r in predicted.collect()} == {"en"} and predicted.columns.count("lang_pred") == 1
    items = spark.createDataFrame([(1, "line 3 shared", "a", "b")], "item_id long, text string, digest string, shift string")
    assert [r.doc_id for r in decontaminate.leaks(docs, items).collect() if r.n_matches == 3] == [3]
    assert decontaminate.without_leaks(docs, items).columns == docs.columns


# --- repeated ids


def test_jaccard_links_through_texts_of_one_id(spark):
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, "else"), (5, b), (5, None), (None, a), (None, b), (-(2**62) - 5, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(docs, 3, 90).collect()}
    assert got == {
        (1, 58): 1, (2, 58): 1, (3, 59): 1, (4, 1): 4, (5, 58): 1, (5, 0): 1, (None, 58): None, (-(2**62) - 5, 1): -(2**62) - 5,
    }


def test_passages_of_texts_that_share_an_id(spark):
    """Each row is judged by its own words: a copy goes, another text of its id stays."""
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    c = " ".join(f"c{k}" for k in range(70))
    tail = " ".join(a.split()[:55])
    rows = [(1, a), (2, a), (2, b), (3, f"x y {tail}"), (3, c), (4, f"{c} end"), (5, f"{b} z"), (None, a), (6, "short")]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    expected = [(1, 60, 0, a), (2, 60, 60, ""), (2, 60, 0, b), (3, 57, 55, "x y"), (3, 70, 0, c), (4, 71, 70, "end"), (5, 61, 60, "z"),
                (None, 60, 0, a), (6, 1, 0, "short")]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, expected))


# --- packing


def test_packing_is_fast_with_many_short_tails():
    begin = time.perf_counter()
    pieces, count = packing.place([7] * 150_000)
    assert time.perf_counter() - begin < 6  # seconds, on a busy machine
    used = [0] * count
    for _, _, n, s, at in pieces:
        assert at == used[s]
        used[s] += n
    assert sum(used) == 7 * 150_000 and all(u == 1024 or u & (u - 1) == 0 for u in used)


def test_packing_takes_the_cheapest_sequence_with_room():
    deal = random.Random(5)
    for _ in range(20):
        lengths = [deal.randint(1, 40) for _ in range(120)]
        pieces, count = packing.place(lengths, 64, 32)
        room, cost, used = [0] * count, [0.0] * count, [0] * count
        for _, _, n, s, _ in pieces:
            room[s] += n
        for i, start, n, s, _ in pieces:
            rest = lengths[i] - start
            fit = [x for x in range(count) if room[x] - used[x] >= rest] or [x for x in range(count) if room[x] > used[x]]
            assert s == min(fit, key=lambda x: (cost[x], x))
            used[s] += n
            cost[s] += n + n * n / 32


# --- decontamination


def test_long_repetitive_text(spark):
    docs = spark.createDataFrame([(1, "x " * 100_000), (2, "y z")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x x x x x x x x")], "item_id long, text string")
    begin = time.perf_counter()
    got = decontaminate.leaks(docs, items)
    assert got.count() == 100_000 - 8 + 1 + 2 * 3  # whole, and by 60 % over both ends
    assert time.perf_counter() - begin < 60


def test_null_and_repeated_ids_of_documents_and_items(spark):
    text = lambda k: " ".join(f"{k}t{n}" for n in range(10))
    docs = [(None, text("a")), (None, "free"), (1, text("a")), (1, text("b")), (1, "free"), (2, text("c")), (2, text("c")), (3, None)]
    items = [(7, text("a")), (7, text("b")), (None, text("c")), (8, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.item_id, r.n_matches) for r in decontaminate.leaks(docs, items).collect())))
    assert got == sorted(map(str, [(None, 7, 10), (1, 7, 10), (1, 7, 10), (2, None, 10)]))
    rest = decontaminate.without_leaks(docs, items).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in rest))) == ["(1, 'free')", "(3, None)", "(None, 'free')"]


@pytest.mark.parametrize("options", [{"share": 59}, {"stretch": 13, "misses": 5}])
def test_overlaps_without_seeds_are_refused(spark, options):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    with pytest.raises(ValueError, match="guarantee"):
        decontaminate.leaks(docs, items, **options)


# --- licenses

MIT_FILE = """The MIT License (MIT)

Copyright (c) 2019-2024 Jane Roe and the Example contributors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
GPL_HEADER = """/*
 * frob.c - frobs things
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */

int main(void) { return 0; }
"""
FORMS = {
    "mit/LICENSE": (MIT_FILE, "MIT", "file"),
    "mit/src/a.py": ("import os\n", "MIT", "inherited"),
    "tag/a.c": ("// SPDX-License-Identifier: Apache-2.0\nint x;\n", "Apache-2.0", "header"),
    "tag/b.c": ("# SPDX-License-Identifier: GPL-2.0-or-later\n\ncode = 1\n", "GPL-2.0", "header"),
    "tag/c.c": ("// SPDX-License-Identifier: LicenseRef-Own\nint x;\n", None, "none"),
    "gpl/frob.c": (GPL_HEADER * 3, "GPL-3.0", "header"),
    "apache/NOTICE": ("Some project\n\nApache License\nVersion 2.0\n\nmore words about it\n" * 2, "Apache-2.0", "header"),
    "bsd/x.go": ("// Copyright 2011 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n"
                 "// license that can be found in the LICENSE file.\n\npackage x\n\nfunc f() {}\n" * 2, "BSD-3-Clause", "header"),
    "readme/README": ("# Thing\n\nA thing.\n\nThis project is licensed under the terms of the MIT license.\n", "MIT", "header"),
    "none/a.txt": ("Permission to leave was given.\nNo license here; the copyright question is open.\n", None, "none"),
}


def test_usual_forms_of_licenses(spark):
    files = spark.createDataFrame([(p, t) for p, (t, _, _) in FORMS.items()], "path string, text string").repartition(3)
    got = {r.path: (r.license, r.how) for r in licenses.scan(files).collect()}
    assert got == {p: (name, how) for p, (_, name, how) in FORMS.items()}


COMMON = "/usr/share/common-licenses"
#: Whole texts as systems ship them, none of them a copy of a template.
SHIPPED = {
    "Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1",
    "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0",
}


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no license texts on this machine")
def test_whole_license_files(spark):
    rows = [(f"{n}/LICENSE", open(f"{COMMON}/{n}", encoding="utf-8").read()) for n in SHIPPED if os.path.exists(f"{COMMON}/{n}")]
    found = licenses.scan(spark.createDataFrame(rows, "path string, text string"))
    assert {r.path.split("/")[0]: (r.license, r.how) for r in found.collect()} == {p.split("/")[0]: (SHIPPED[p.split("/")[0]], "file") for p, _ in rows}


def test_license_weights_are_one_constant(spark):
    """The map of weights is made once, not per row, and no Python runs."""
    df = spark.createDataFrame([("a", "MIT License")], "path string, text string")
    plan = licenses._scored(
        df.withColumnRenamed("text", "unit").withColumn("whole", F.lit(True)), licenses.Model(licenses.TEMPLATES), 3
    )._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "ython" not in plan
