"""Vector codes, collocations and the live index against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mendlist.llm import codes, collocations, live_index

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- vector codes


def _codes(rows, parts, entries, rounds):
    """{row: (code, error)} and the codebooks, number by number."""
    kept = [(i, v) for i, v, _ in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in kept if len(v) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]

    def nearest(v, book):
        gaps = [sum((x - y) ** 2 for x, y in zip(v, e)) for e in book]
        return min(gaps), gaps.index(min(gaps))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = defaultdict(list)
            for _, v in kept:
                members[nearest(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*members[e])] if members[e] else book[e] for e in range(len(book))]
    out = []
    for i, v in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    text = ",".join(str(x) for book in books for e in book for x in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def _vectors(n, dims, seed=4):
    deal = random.Random(seed)
    centres = [[deal.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [float(np.float32(x + deal.gauss(0, 0.1))) for x in deal.choice(centres)], deal.choice([1, 2, None])) for i in range(n)]
    rows[7] = (7, None, 1)
    rows[8] = (8, [None] + [0.0] * (dims - 1), 1)
    rows[9] = (9, [float("nan")] * dims, 2)
    rows[10] = (10, [float("-inf")] + [0.5] * (dims - 1), 2)
    rows[11] = (11, [], 1)
    rows[12] = (12, [1.0, 2.0], 1)  # does not divide
    rows[13] = (13, [0.25] * (2 * dims), 1)  # another length
    rows[14] = (None, rows[15][1], 1)
    rows[16] = rows[17] = (16, rows[18][1], 2)  # the same row twice
    rows[19] = (16, rows[20][1], 2)  # the same id, another vector
    return rows


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, ids string"


@pytest.mark.parametrize("n, dims, parts, entries", [(300, 32, 16, 64), (40, 8, 4, 64), (200, 6, 2, 3)])
def test_codes(spark, n, dims, parts, entries):
    rows = _vectors(n, dims)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(7)
    found = codes.compress(df, parts, entries)
    expected, digest = _codes(rows, parts, entries, 2)
    assert sorted(map(str, [tuple(r) for r in found.rows.select("vec_id", "code", "error").collect()])) == sorted(map(str, expected))
    assert found.digest() == digest
    by_label = Counter()
    for r in found.rows.collect():
        by_label[r.label] += r.error
    for r in codes.with_label_errors(found).join(found.rows.select("vec_id", "label"), "vec_id").collect():
        if r.vec_id != 16:
            assert (r.label_error, r.codebooks_sha256) == (by_label[r.label], digest)


def test_codes_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_ROWS", 16)
    rows = _vectors(150, 16)
    found = codes.compress(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).coalesce(1), 16, 8)
    expected, digest = _codes(rows, 16, 8, 2)
    assert found.digest() == digest and found.rows.count() == len(expected)


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert codes.with_label_errors(codes.compress(empty)).collect() == []
    only_bad = spark.createDataFrame([(1, None, 1, "", 1, ""), (None, [], None, "", 1, "")], VECTORS)
    assert codes.compress(only_bad).rows.collect() == []


def test_codes_refuse_what_does_not_fit():
    with pytest.raises(ValueError, match="64 bits"):
        codes._integers(pa.array([[float(1 << 20)]], pa.list_(pa.float64())))


# --- collocations


def _pieces(text):
    for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
        words = [w for w in re.split("[ \t]+", piece) if w]
        if words:
            yield words


def _phrases(rows, longest):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        for words in _pieces(text):
            for size in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return f


def _collocations(rows, longest=3, least=10, top=2000):
    out = []
    for lang, f in _phrases(rows, longest).items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 50 * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(c for p, c in f.items() if len(p) == 1)
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


DOCS = "doc_id long, text string, lang string, f long, phrase string, size int, words string, sign int"


def _prose(seed=9, n=160):
    deal = random.Random(seed)
    words = ["new", "York", "É", "straße", "x", "the", "of", "a", "日本", "B-C"] + [f"w{i}" for i in range(12)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(deal.randint(0, 60)):
            text += deal.choice([["New", "York", "City"], ["of", "the"], ["a"], [deal.choice(words)], [deal.choice(words)]])
            text.append(deal.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]))
            if not text[-1].strip(" \t"):
                continue
        rows.append((i, " ".join(text), deal.choice(["en", "de", None])))
    rows += [(None, None, "en"), (1, "", "fr"), (2, " .,\n ", "en"), (3, "!?", None), rows[0], rows[0]]
    rows.append((500, "a a a a a a a a a a a a a a", "zz"))
    rows.append((501, " ".join(deal.choices(words, k=6000)), "en"))
    return rows


def _spread(spark, rows, parts):
    return spark.createDataFrame([(*r, 1, "p", 2, "w", 3) for r in rows], DOCS).repartition(parts)


def _found(df):
    return sorted(tuple(r[c] for c in "lang rank phrase a l r n score".split()) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 6])
def test_collocations(spark, parts):
    rows = _prose()
    expected = _collocations(rows)
    assert {e[0] for e in expected} >= {"en", "de", "und", "zz"} and any(e[2].count(" ") == 2 for e in expected)
    assert _found(collocations.collocations(collocations.count_phrases(_spread(spark, rows, parts)))) == expected


def test_collocations_of_longer_phrases_and_few(spark):
    rows = _prose(seed=3)
    counts = collocations.count_phrases(_spread(spark, rows, 3), longest=4, least=4)
    assert _found(collocations.collocations(counts, top=7)) == _collocations(rows, 4, 4, 7)


def test_texts_cut_into_several_shards(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 50)
    rows = _prose(n=30)
    assert _found(collocations.collocations(collocations.count_phrases(_spread(spark, rows, 2)))) == _collocations(rows)


def test_hash_counts_are_sent_several_times_and_by_range(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HASHES_AT_ONCE", 40)
    monkeypatch.setattr(collocations, "RANGE_WORDS", 100)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 50)
    rows = [(i, text, "line\nbreak" if lang == "de" else lang) for i, text, lang in _prose(n=60)]
    assert _found(collocations.collocations(collocations.count_phrases(_spread(spark, rows, 3)))) == _collocations(rows)


def test_packed_counts_of_hashes():
    deal = np.random.default_rng(5)
    hashes = np.unique(deal.integers(0, 1 << 32, 200_000))
    counts = deal.integers(-1, 4, len(hashes))
    packed = collocations._pack_counts(hashes, counts)
    assert len(packed) < 4 * len(hashes)  # 16 bytes as two numbers
    for given in (hashes, counts), (np.array([0, (1 << 63) - 1]), np.array([1 << 40, -5])), (hashes[:0], counts[:0]):
        back = collocations._unpack_counts(collocations._pack_counts(*given))
        assert all(np.array_equal(a, b) for a, b in zip(back, given))
    twice, sums = collocations._added([(hashes, counts), (hashes[::2], counts[::2])])
    assert np.array_equal(twice, hashes) and sums.sum() == counts.sum() + counts[::2].sum()


def test_spelled_counts_are_sent_several_times_and_by_range(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SPELLED_AT_ONCE", 2000)
    monkeypatch.setattr(collocations, "RANGE_SHARDS", 1)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 50)
    rows = [(i, text, "line\nbreak" if lang == "de" else lang) for i, text, lang in _prose(n=60)]
    assert _found(collocations.collocations(collocations.count_phrases(_spread(spark, rows, 3)))) == _collocations(rows)


@pytest.mark.parametrize("at_once", [1, 64 << 20])
def test_spelled_counts_leave_a_task_packed(monkeypatch, at_once):
    """A row for each range, not for each word, in a third of the bytes of the words."""
    monkeypatch.setattr(collocations, "SPELLED_AT_ONCE", at_once)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 3000)
    deal = random.Random(4)
    texts = [" ".join(f"word{deal.randint(0, 20000)}" for _ in range(1000)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en", "line\nbreak"] * 20)], names=["text", "lang"])
    shards = list(collocations._indexer(3)([batch]))
    sent = [r for b in collocations._first_words(2)(shards) for r in b.to_pylist()]
    assert {r["range"] for r in sent} == set(range(4)) and (len(sent) == 4 if at_once > 1 else 4 < len(sent) <= 4 * len(shards))
    got = Counter()
    for r in sent:
        keys, counts = collocations._unpack_spelled(r["numbers"], r["text"])
        assert keys.to_pylist() == sorted(set(keys.to_pylist()))
        for key, n in zip(keys.to_pylist(), counts.tolist()):
            got[key] += n
    expected = {f"{lang}\n{p[0]}": n for lang, f in _phrases([(0, t, ["en", "line\nbreak"][i % 2]) for i, t in enumerate(texts)], 1).items() for p, n in f.items()}
    assert got == expected
    if at_once > 1:
        assert sum(len(r["numbers"]) + len(r["text"]) for r in sent) < sum(map(len, expected)) / 3


def test_transforms_take_less_room_than_whole_numbers():
    deal = np.random.default_rng(6)
    ids = np.minimum(deal.zipf(1.3, 200_000), 60_000).astype(np.int32)
    assert len(collocations._pack(ids)) < 0.9 * len(pa.compress(ids.tobytes(), codec="zstd", asbytes=True))
    for given in ids, ids[:1], ids[:0], np.array([-1, (1 << 31) - 1]):
        assert np.array_equal(collocations._unpack(collocations._pack(given)), given)


def test_collocations_of_nothing(spark):
    assert _found(collocations.collocations(collocations.count_phrases(_spread(spark, [], 1)))) == []
    odd = [(None, None, None), (1, "", None), (2, "...", "en")]
    assert _found(collocations.collocations(collocations.count_phrases(_spread(spark, odd, 1)))) == []


def test_interval_extension_in_both_directions():
    """Each level of the index against counted phrases, whichever side is extended."""
    deal = random.Random(8)
    texts = [" ".join(deal.choices("a b c d".split(), k=deal.randint(0, 40))) for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 30)], names=["text", "lang"])
    (shard,) = collocations._indexer(4)([batch])
    expected = _phrases([(0, t, "en") for t in texts], 4)["en"]
    for sides in (["left"] * 3, ["right"] * 3, ["left", "right", "left"], ["right", "left", "left"]):
        ((sign, index),) = collocations._open([shard])
        for size, side in enumerate(sides, 2):
            index.extend(side)
            _, phrases, n = index.spelled()
            got = dict(zip((tuple(p.split()) for p in phrases.to_pylist()), n.tolist()))
            assert sign == 1 and got == {p: c for p, c in expected.items() if len(p) == size}


def test_products_beyond_64_bits(spark):
    rows = [("en", 1, "a", 3 * 10**12), ("en", 1, "b", 4 * 10**12), ("en", 2, "a b", 2 * 10**12 + 1)]
    frequent = spark.createDataFrame(rows, "lang string, size int, phrase string, f long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    (r,) = collocations.collocations(collocations.Phrases(frequent, totals)).collect()
    assert r.score == 10**6 * (2 * 10**12 + 1) ** 2 // (12 * 10**24)


# --- live index


def _normal(text):
    return hashlib.sha256(re.sub("[ \t-\r]+", " ", text or "").encode()).hexdigest()


TEXTS = "doc_id long, text string, digest string, shard int, load int, row long, copies long"


def _copies(seed=6, n=300):
    deal = random.Random(seed)
    pool = [None, "", " ", "a b", "a  b", "a\tb ", "A b", "x" * 50_000, "a\x0b\x0cb", "a\xa0b"] + [f"text {i}" for i in range(60)]
    rows = [(i if i % 11 else None, deal.choice(pool)) for i in range(n)]
    rows += [(1000, "hot")] * 5 + [(900 + i, "hot") for i in range(200)] + [(5, "twice"), (5, "twice"), (5, "other"), (None, "no id"), (None, "no id")]
    deal.shuffle(rows)
    return rows


def _table(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "d", 1, 2, 3, 4) for r in rows], TEXTS).repartition(parts)


def _check(index, rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[_normal(text)].append(i)
    got = defaultdict(list)
    for r in live_index.members(index).collect():
        got[r.text_sha256].append(r)
    assert set(got) == set(groups)
    for digest, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        assert Counter(r.doc_id for r in got[digest]) == Counter(ids)
        assert {(r.keep_id, r.group_size) for r in got[digest]} == {(low, len(ids))}
        assert [r.doc_id for r in got[digest] if r.kept] == [low]


def test_live_index_over_several_loads(spark):
    rows, more = _copies(), _copies(seed=7, n=150)
    index = live_index.insert(None, _table(spark, rows))
    _check(index, rows)
    asked = [(1, "hot"), (2, "new text"), (3, None), (4, "twice "), (5, "never seen"), (6, "hot")]
    known = {r.doc_id: r.keep_id for r in live_index.known(index, _table(spark, asked)).collect()}
    low = {d: min((i for i, t in rows if _normal(t) == d and i is not None), default=None) for d in map(_normal, (t for _, t in rows))}
    assert known == {1: low[_normal("hot")], 3: low[_normal(None)], 6: low[_normal("hot")]}
    index = live_index.insert(index, _table(spark, more))
    _check(index, rows + more)


def test_live_index_deletes(spark):
    rows = _copies()
    index = live_index.insert(None, _table(spark, rows))
    gone = [i for i in range(0, 250)] + [900, 901, None, 77_777]
    index = live_index.delete(index, spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [r for r in rows if r[0] is None or r[0] not in gone]
    _check(index, left)
    # the filters know no digest that is gone, but for chance hits, which the content turns down
    assert live_index.known(index, _table(spark, [(1, "twice")])).collect() == []
    index = live_index.insert(index, _table(spark, [(3, "twice"), (901, "hot")]))
    _check(index, left + [(3, "twice"), (901, "hot")])


def test_more_shards_for_more_entries(spark, monkeypatch):
    monkeypatch.setattr(live_index, "SHARD_ENTRIES", 25)
    rows, more = _copies(n=200), _copies(seed=8, n=600)
    index = live_index.insert(None, _table(spark, rows))
    before = index.shards
    index = live_index.insert(index, _table(spark, more))
    assert index.shards > before
    _check(index, rows + more)


def test_live_index_of_nothing(spark):
    index = live_index.insert(None, _table(spark, [], 1))
    assert live_index.members(index).collect() == []
    _check(live_index.insert(index, _table(spark, [(1, None)], 1)), [(1, None)])


def test_equal_digests_of_a_task_are_put_together_in_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(live_index, "COMBINED", 3)
    rows = _copies(n=100)
    _check(live_index.insert(None, _table(spark, rows)), rows)


def test_shard_grows_deletes_and_verifies():
    """A small filter overflows again and again; every digest stays known, deleted ones go."""
    deal = random.Random(1)
    shard, live = live_index.Shard(buckets=2), {}
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, d in enumerate(digests):
        shard.insert(d, (False, i, 0, i), 1)
        live[d] = i
        if deal.random() < 0.3:
            gone = deal.choice(list(live)) if len(live) < 50 else deal.choice(digests[: i + 1])
            if gone in live:
                shard.delete(gone, None, 1)
                del live[gone]
    assert shard.filter.mask > 2
    assert all(shard.filter.holds(d) and shard.find(d)[1][1] == i for d, i in live.items())
    assert all(shard.find(d) is None for d in digests if d not in live)
    fakes = sum(shard.filter.holds(hashlib.sha256(f"no{i}".encode()).digest()) for i in range(20_000))
    assert fakes < 20  # 8 slots of 16 bits
    # a chance hit is turned down by the content
    forged = digests[-1][:14] + bytes(18)
    if digests[-1] in live:
        assert shard.filter.holds(forged) and shard.find(forged) is None
