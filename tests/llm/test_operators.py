"""Each operator against brute force, on texts with copies, near copies and odd rows."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from mendlist.llm import attribution, boilerplate, decontaminate, jaccard, langid, licenses, packing, quality, rules, substrings
from mendlist.llm import graph
from mendlist.llm.graph import components
from mendlist.llm.tokens import Vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, token string, n int, part long, id long"


def _texts(seed=5, n=90):
    deal = random.Random(seed)
    vocabulary = ["".join(deal.choices("abcdeéÑ", k=deal.randint(1, 6))) for _ in range(150)] + ["###", "A!!", "7"]
    texts = [None, "", "  \t\n ", "one", "two words", "Two WORDS", "\x1cx y z", "many  blanks \n here"]
    passage = " ".join(deal.choices(vocabulary, k=70))
    while len(texts) < n:
        kind, text = deal.random(), " ".join(deal.choices(vocabulary, k=deal.randint(1, 120)))
        if kind < 0.15:
            text = deal.choice(texts) or "x"
        elif kind < 0.45:
            w = (deal.choice(texts) or "y").split(" ")
            for _ in range(deal.randint(0, 3)):
                w[deal.randrange(len(w))] = deal.choice(vocabulary)
            text = " ".join(w)
        elif kind < 0.6:
            at = deal.randint(0, 15)
            text = f"{text} {' '.join(passage.split()[at:])} {deal.choice(vocabulary)}"
        elif kind < 0.75:
            text = text.replace(" ", "\n", deal.randint(1, 5)) + "\nshared line here\n\nshared line here"
        texts.append(text)
    texts.append(" ".join(deal.choices(vocabulary, k=20_000)))
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    return [(i, texts[k], ["en", "fr", None][k % 3], f"s{k % 3}" if k % 7 else None) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Columns with names that operators use inside are there to clash."""
    return spark.createDataFrame([(*r, "t", 1, 2, 3) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_of_links(spark):
    deal = random.Random(3)
    links = [(deal.randrange(200), deal.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    got = {r["id"]: r["part"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = {x: x for p in links for x in p}
    for _ in low:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: low[x] for x in touched}


@pytest.mark.parametrize("chunk", [graph.CHUNK, 3])
def test_links_of_one_task_are_put_together_there(spark, monkeypatch, chunk):
    """A long chain takes no round if its links lie in one task, and comes out whole if they are torn."""
    rounds, relink = [], graph._relink
    monkeypatch.setattr(graph, "CHUNK", chunk)
    monkeypatch.setattr(graph, "_relink", lambda arcs: rounds.append(1) or relink(arcs))
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, i) for i in range(101, 140)], "a long, b long")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(chunk, 1000)))
    try:
        got = {r["id"]: r["part"] for r in components(links.coalesce(1)).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert bool(rounds) == (chunk == 3)


@pytest.mark.parametrize("chunk", [graph.CHUNK, 500])
def test_links_over_many_partitions_are_merged_before_rounds(spark, monkeypatch, chunk):
    """A chain dealt at random over 64 partitions takes no round if all of it is less than a task may hold."""
    rounds, relink = [], graph._relink
    monkeypatch.setattr(graph, "CHUNK", chunk)
    monkeypatch.setattr(graph, "_relink", lambda arcs: rounds.append(1) or relink(arcs))
    links = [(i + 1, i) for i in range(2000)] + [(5000, i) for i in range(5001, 5040)]
    random.Random(5).shuffle(links)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        got = {r["id"]: r["part"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(64)).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {i: 0 for i in range(2001)} | {i: 5000 for i in range(5000, 5040)}
    assert bool(rounds) == (chunk == 500)


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard(docs, rows, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, k, percent).collect()}
    assert got == brute.components([r[:2] for r in rows], k, percent)


def test_jaccard_of_a_large_group(spark):
    """Near copies of near copies: far more pairs than links."""
    deal = random.Random(2)
    group = [[f"w{i}" for i in range(60)]]
    for _ in range(150):
        new = list(deal.choice(group))
        new[deal.randrange(60)] = f"v{deal.randrange(10**6)}"
        group.append(new)
    rows = [(i, " ".join(w)) for i, w in enumerate(group)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 90).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute.components(rows, 3, 90)


def test_substrings(docs, rows):
    got = substrings.without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    expected = brute.cut([r[:2] for r in rows], 50)
    assert sum(e[1] > 0 for e in expected.values()) > 5
    assert {r[0]: tuple(r[1:]) for r in got} == expected


def test_rules(docs, rows):
    got = {r["doc_id"]: r for r in rules.judged(docs, limit=3).collect()}
    frequent = brute.frequent_words([(i, s or "", t) for i, t, _, s in rows], 3)
    assert max(frequent.values()) > 0
    for i, text, _, _ in rows:
        counts, r = brute.base_counts(text), got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert (r["n_frequent_words"], r["base_failed"]) == (frequent[i], failed)
        assert r["kept"] == (not failed and 100 * frequent[i] <= 50 * counts[0])


def test_boilerplate(docs, rows):
    pages, total = {}, {}
    for _, text, _, host in rows:
        if text is not None:
            total.setdefault(host, set()).add(text)
            for line in text.split("\n"):
                pages.setdefault((host, line.strip(" ").lower()), set()).add(text)
    drop = {k for k, v in pages.items() if k[1] and len(v) >= 3 and len(v) > 0.1 * len(total[k[0]])}
    got = {r["doc_id"]: r for r in boilerplate.without_boilerplate(docs, min_pages=3).collect()}
    assert set(got[0].asDict()) == set(docs.columns) | {"n_lines", "n_dropped"}
    assert drop
    for i, text, _, host in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if (host, x.strip(" ").lower()) not in drop]
        r = got[i]
        assert (r["text"], r["n_lines"], r["n_dropped"]) == (None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept))


def test_packing(docs, rows):
    encoder = Vocabulary().encoder()
    ids = {i: np.append(encoder.ids(t), 0).astype("<u4") for i, t, *_ in rows}
    got = packing.packed(docs).collect()
    documents, sequences = {}, {}
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == piece.tobytes() and r["doc_tokens"] == len(ids[r["doc_id"]])
        documents.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))

    def gapless(parts):
        end = 0
        for start, n in sorted(parts):
            assert start == end and n > 0
            end += n
        return end

    assert {i: gapless(p) for i, p in documents.items()} == {i: len(x) for i, x in ids.items()}
    for parts in sequences.values():
        n = gapless(parts)
        assert n == 1024 or n & (n - 1) == 0


def test_packing_balances_cost():
    deal = random.Random(4)
    lengths = [deal.randint(1, 700) for _ in range(400)]
    pieces, n = packing.place(lengths)
    cost = [0.0] * n
    for _, _, length, s, _ in pieces:
        cost[s] += length + length**2 / packing.QUADRATIC
    full = sorted(cost)[n // 10 : -n // 10]
    assert max(full) < 2 * min(full)


def test_packing_cuts_only_what_fits_nowhere():
    deal = random.Random(3)
    for low, high in ((300, 700), (400, 600), (20, 1000)):
        lengths = [deal.randint(low, high) for _ in range(2000)]
        pieces, count = packing.place(lengths)
        room = [0] * count
        for _, _, n, s, _ in pieces:
            room[s] += n
        for i, start, n, s, _ in pieces:
            rest = lengths[i] - start
            assert n == rest or max(room) < rest
            room[s] -= n


def test_encoder_equals_the_file():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    encoder = Vocabulary().encoder()
    texts = [t for t in _texts(7) if t] + [
        "a  b", " x", "x ", "a\n b", "<|endoftext|> a <|endoftext|>", "x　 y", "it's 'll 12 3a", "a\x1c b", "a\x85 b", "🙂 🙂é "
    ]
    for text in texts * 2:
        ids = encoder.ids(text)
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
        assert encoder.byte_ends(ids)[-1] == len(text.encode())


def test_section_tokens(docs, rows):
    encoder = Vocabulary().encoder()
    got = {}
    for r in attribution.token_counts(docs, ("text", "lang")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text, lang, _ in rows:
        whole = f"{text or ''}\n{lang or ''}"
        parts = [("text", x) for x in (text or "").split("\n")] + [("lang", lang or "")]
        found = sorted(got[i], key=lambda r: r["section"])
        owner = [k for k, (_, x) in enumerate(parts) for _ in (x + "\n").encode()][: len(whole.encode())]
        counts, start = [0] * len(parts), 0
        for end in encoder.byte_ends(encoder.ids(whole)):
            held = owner[start:end]
            counts[max(sorted(set(held)), key=held.count)] += 1
            start = end
        assert [r["n_tokens"] for r in found] == counts
        assert [r["field"] for r in found] == [f for f, _ in parts]
        assert "".join(whole[r["start"] : r["end"]] for r in found) == whole


def test_language_profiles(docs, rows):
    size = 60
    learnt = langid.learn(docs, size=size)
    profiles = {name: brute.profile([t for _, t, x, _ in rows if x == name], size) for name in ("en", "fr")}
    assert {k: len(v) for k, v in learnt.items()} == {k: len(v) for k, v in profiles.items()}
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.predict(docs, learnt, size=size).collect()}
    for i, text, *_ in rows:
        name, score = brute.language(text, profiles, size)
        assert got[i] == (name, round(score, 9))


def test_quality(spark):
    deal = random.Random(6)
    word = lambda: "".join(deal.choices("abcdefgh", k=deal.randint(2, 8)))
    texts = []
    for i in range(300):
        w = [word() for _ in range(deal.randint(5, 60))]
        bad = i % 4 == 0
        texts.append((i, " ".join(x + "###" if bad and deal.random() < 0.7 else x for x in w), int(not bad)))
    docs = spark.createDataFrame(texts, "doc_id long, text string, score int").repartition(3)
    labels = docs.where("doc_id < 200").select("doc_id", F.col("score").alias("quality"))
    weights = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).collect()}
    assert sum((got[i] >= 0.3) == bool(y) for i, _, y in texts if i >= 200) >= 98
    assert np.array_equal(weights, quality.fit(docs.repartition(7), labels.repartition(4)))
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "a b")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, weights).collect())


def test_decontamination(spark):
    deal = random.Random(8)
    word = lambda: "".join(deal.choices("abcdefgh", k=deal.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(deal.randint(8, 50)))) for i in range(15)] + [(15, None), (16, "")]
    docs = []
    for i in range(80):
        text = [word() for _ in range(deal.randint(0, 80))]
        if i % 2:
            passage = items[i % 15][1].split()
            passage = [word() if deal.random() < 0.03 * (i % 10) else w.title() + deal.choice(["", ".", ","]) for w in passage]
            at = deal.randint(0, len(text))
            text[at:at] = passage
        docs.append((i, " ".join(text)))
    docs += [(80, None), (None, items[0][1])]
    expected = set()
    for i, text in docs:
        for j, item in items:
            shifts, a, b = brute.seeds_hit(text, item, decontaminate.MASKS, decontaminate.SPAN)
            for s in shifts:
                equal = [a[q + s] == b[q] for q in range(len(b)) if 0 <= q + s < len(a)]
                longest = max(sum(equal[k : k + 13]) for k in range(max(1, len(equal) - 12)))
                if 100 * sum(equal) >= 60 * len(b) or longest >= 11:
                    expected.add((i, j, s, sum(equal), len(b), longest))
    got = decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    assert len(expected) > 20
    assert {tuple(r) for r in got.select("doc_id", "item_id", "shift", "n_matches", "n_item", "longest").collect()} == expected


def _every_overlap(docs, items):
    """Verified overlaps at every shift, without seeds."""
    found = set()
    for i, text in docs:
        for j, item in items:
            a, b = text.split(), item.split()
            for s in range(1 - len(b), len(a)):
                equal = [a[q + s] == b[q] for q in range(len(b)) if 0 <= q + s < len(a)]
                longest = max(sum(equal[k : k + 13]) for k in range(max(1, len(equal) - 12)))
                if 100 * sum(equal) >= 60 * len(b) or longest >= 11:
                    found.add((i, j, s, sum(equal), len(b), longest))
    return found


def _leaks(spark, docs, items):
    got = decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    return sorted(tuple(r) for r in got.select("doc_id", "item_id", "shift", "n_matches", "n_item", "longest").collect())


def test_decontamination_loses_no_overlap(spark):
    deal = random.Random(4)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (4, 5, 6, 8, 10, 11, 13, 14, 15, 20, 30, 60, 64, 65, 90)]
    docs = []

    def add(item, out, left=0, right=0, cut=slice(None)):
        w = ["z" if k in out else x for k, x in enumerate(item.split())][cut]
        docs.append((len(docs), " ".join(["a"] * left + w + ["b"] * right)))

    for out in itertools.combinations(range(13), 2):
        add(dict(items)[90], {k for k in range(90) if not 40 <= k < 53} | {40 + k for k in out}, deal.randint(0, 3))
    for n, item in items:
        for every in (3, 4):
            add(item, set(range(every - 1, n, every)), 2, 2)
        for _ in range(8):
            add(item, set(deal.sample(range(n), n * 2 // 5)), deal.choice([0, 0, 4]), deal.choice([0, 0, 4]))
        add(item, (), 3, 0, slice(0, -(-6 * n // 10)))
        add(item, (), 0, 3, slice(n - -(-6 * n // 10), n))
    expected = _every_overlap(docs, items)
    assert {e[0] for e in expected} == set(range(len(docs)))
    assert _leaks(spark, docs, items) == sorted(expected)


def test_decontamination_finds_short_items(spark):
    items = [(0, "Why?"), (1, "forty two"), (2, "one two three"), (3, "a b c d"), (4, " ".join(f"t{k}" for k in range(10)))]
    docs = [(i, f"some {text}, more why not") for i, (_, text) in enumerate(items)]
    docs += [(5, "forty"), (6, "forty x two"), (7, "why"), (8, "one two x"), (9, "forty two"), (10, "")]
    got = _leaks(spark, docs, items)
    why = [(i, 0, at, 1, 1, 1) for i, at in ((0, 1), (0, 3), (1, 4), (2, 5), (3, 6), (4, 12), (7, 0))]
    copies = [(i, i, 1, n, n, n) for i, n in ((1, 2), (2, 3), (3, 4), (4, 10))] + [(9, 1, 0, 2, 2, 2)]
    assert got == sorted(why + copies)


def test_licenses(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code here\nmore"), ("a/b/y.py", None), ("a/b/c/z.py", ""),
        ("a/b/COPYING", "Licensed under CC BY-NC 4.0."), ("a/b/COPYING2", "Licensed under CC BY-NC 4.0."),
        ("q/head.py", "text\nthis file is licensed under the apache license, version 2.0\ncode " * 3), ("q/r.py", "the license of under"),
        ("top.py", "x"), (None, "Released under the MIT License."), ("a/x.py", "code here\nmore"), ("q/long.py", "word " * 20_000),
    ]
    model = licenses.Model(licenses.TEMPLATES)

    def best(unit, forms=len(licenses.TEMPLATES)):
        if not re.search(licenses.MARKER, unit.lower()):
            return None
        found = [(round(brute.cosine(unit, t, model.idf, model.unknown), 6), -i) for i, (_, t) in enumerate(licenses.TEMPLATES[:forms])]
        top, i = max(found)
        return (top, licenses.TEMPLATES[-i][0]) if top >= licenses.THRESHOLD else None

    whole = {p: best(t, licenses.FILE_FORMS) for p, t in files if p and t and best(t, licenses.FILE_FORMS)}
    lines = {}
    for p, t in files:
        if p and t:
            found = [b for b in map(best, t.split("\n") + re.split(licenses.BLANK_LINES, t)) if b]
            if found:
                lines[p] = max(found)
    expected = []
    for p, _ in files:
        row = (None, "none", None)
        if p in whole:
            row = whole[p][1], "file", p
        elif p in lines:
            row = lines[p][1], "header", p
        elif p:
            parts = p.split("/")[:-1]
            for n in range(len(parts), -1, -1):
                near = [(whole[x][0], whole[x][1], x) for x in whole if x.split("/")[:-1] == parts[:n]]
                if near:
                    row = max(near)[1], "inherited", max(near)[2]
                    break
        expected.append((p, *row))
    got = licenses.scan(spark.createDataFrame(files, "path string, text string").repartition(3))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.select("path", "license", "how", "license_path").collect()), key=key) == sorted(expected, key=key)
    assert {"file", "header", "inherited", "none"} == {e[2] for e in expected}


def test_no_rows(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    weights = quality.fit(empty, labels)
    for result in (
        quality.score(empty, weights), rules.judged(empty), boilerplate.without_boilerplate(empty), substrings.without_repeats(empty),
        packing.packed(empty), attribution.token_counts(empty), jaccard.jaccard_components(empty, 3, 90),
        decontaminate.leaks(empty, items), langid.predict(empty, langid.learn(empty)),
        licenses.scan(empty.withColumn("path", F.col("source"))),
    ):
        assert result.count() == 0


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, text[:-4] + " x"), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    for operator in (
        rules.judged, boilerplate.without_boilerplate, substrings.without_repeats, lambda d: jaccard.jaccard_components(d, 3, 90)
    ):
        assert operator(docs).count() == len(rows)
    groups = {(r[0], r[2]) for r in jaccard.jaccard_components(docs, 3, 90).collect()}
    assert groups == {(1, 1), (2, 1), (None, None), (3, 1)}
    packed = packing.packed(docs).groupBy("doc_id").agg(F.sum("length")).collect()
    assert {r[0] for r in packed} == {1, 2, 3, None}
