"""The quality classifier against follow-the-regularised-leader over dictionaries of spelled features."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mendlist.llm import quality
from mendlist.llm.words import Hasher, Texts


def _shape(word: bytes) -> bytes:
    kinds = bytes(97 if 97 <= c < 123 or c > 127 else 65 if 65 <= c < 91 else 48 if 48 <= c < 58 else c for c in word)
    return bytes(c for i, c in enumerate(kinds) if not i or kinds[i - 1] != c)


def _features(text):
    words = (text or "").encode().split()
    out = Counter()
    for kind, tokens in (("word", words), ("shape", [_shape(w) for w in words])):
        for i, token in enumerate(tokens):
            out[kind, token] += 1
            if i + 1 == len(tokens):
                out[kind, token] += 1  # no pair begins here
            elif tokens[i + 1] == token:
                out[kind, "repeated"] += 1
            else:
                out[kind, token, tokens[i + 1]] += 1
    total = sum(out.values())
    return {f: quality.SCALE * n / total for f, n in out.items()} | {"bias": 1.0}


class Leader:
    def __init__(self):
        self.z, self.n = defaultdict(float), defaultdict(float)

    def weight(self, f):
        z, n = self.z[f], self.n[f]
        if abs(z) <= quality.L1:
            return 0.0
        return -(z - math.copysign(quality.L1, z)) / ((quality.BETA + math.sqrt(n)) / quality.ALPHA + quality.L2)

    def score(self, x):
        return 1 / (1 + math.exp(-max(-30, min(30, sum(self.weight(f) * v for f, v in x.items())))))

    def learn(self, x, label):
        error = self.score(x) - label
        for f, v in x.items():
            g, w = error * v, self.weight(f)
            root = math.sqrt(self.n[f] + g * g)
            self.z[f] += g - (root - math.sqrt(self.n[f])) / quality.ALPHA * w
            self.n[f] += g * g


def test_weights_and_scores(spark):
    deal = random.Random(12)
    words = ["The", "cat", "éa", "42", "x9", "##", "A-b", "sat", "sat", "on"]
    texts = [None, "", " ", "one", "sat sat sat"] + [" ".join(deal.choices(words, k=deal.randint(1, 40))) for _ in range(120)]
    texts.append(" ".join(deal.choices(words, k=20_000)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "another text of one id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = [(i, int(deal.random() < 0.6)) for i in range(0, 100)] + [(3, 1), (None, 1), (4, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    weights = quality.fit(docs, table, sample=70)

    known = {}
    for i, y in labels:
        if i is not None and y is not None:
            known[i] = max(y, known.get(i, 0))
    order = {r.id: r.h for r in spark.range(100).select("id", F.xxhash64("id").alias("h")).collect()}
    chosen = sorted(known, key=lambda i: (order[i], i))[:70]
    leader, by_id = Leader(), defaultdict(list)
    for i, t in rows:
        by_id[i].append(t)
    for _ in range(quality.PASSES):
        for i in chosen:
            for t in sorted(by_id[i], key=lambda t: (t is not None, t or "")):
                leader.learn(_features(t), known[i])

    got = {(r.doc_id, r.text): r.score for r in quality.score(docs, weights).collect()}
    for i, t in rows:
        assert abs(got[i, t] - leader.score(_features(t))) < 1e-5

    # feature by feature: the words of a text of one word, and the bias
    hashers = Hasher(1), Hasher(2)
    for word in set(words):
        index, _ = quality._features(Texts(pa.array([word])), hashers)
        assert np.isclose(weights[index[0]], leader.weight(("word", word.encode())), atol=1e-9)
        assert np.isclose(weights[index[2]], leader.weight(("shape", _shape(word.encode()))), atol=1e-9)
    assert np.isclose(weights[-1], leader.weight("bias"), atol=1e-9)
