"""Quality classifier: hashed word n-gram logistic regression, learnt by FTRL-proximal.

A text's tokens are its words and the words' shapes (runs of lower-case letters, capitals
and digits reduced to one character, all else unchanged). Features are token unigrams
and bigrams hashed to ``2**BITS`` weights, each worth its share of the text's features.
A score is the logistic of a sparse dot product with these weights and a bias.

Training reads a bounded sample, by hash of the id, of the labelled rows (``sample``, a parameter), in a
fixed order, in one streaming task that holds the weights alone. The model is of fixed
size (1 MB), so it may pass through the driver and be broadcast. Scoring is one pass
without a shuffle.

Null and empty texts: no features, the score is the bias alone. Repeated ids: each row
is scored. No labels: every score is 0.5. A document with both labels counts as good.
A column named as the result is replaced.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlist.llm.words import Hasher, Texts, runs

BITS = 18
SAMPLE = 8_000
PASSES = 4
#: What a feature's share of its text is multiplied by.
SCALE = 30.0
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def _shapes(t: Texts, hasher: Hasher) -> np.ndarray:
    """A hash of each word's shape."""
    kind = _SHAPE[t.data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[t.start] = True
    before = np.r_[0, np.cumsum(new)]
    return hasher.spans(hasher.codes[kind[new]], before[t.start], before[t.end])


def _features(t: Texts, hashers) -> tuple[np.ndarray, np.ndarray]:
    """(weight index of each feature occurrence, first occurrence of each text)."""
    columns = []
    for hasher, tokens in zip(hashers, (t.word_hashes(hashers[0]), _shapes(t, hashers[1]))):
        pairs = np.zeros(len(tokens), np.uint64)
        begin, found = t.windows(hasher, tokens, 2)
        # a word right after itself is one feature, whatever the word
        pairs[begin] = np.where(tokens[begin] == tokens[begin + 1], hasher.salt, found)
        columns += [tokens, np.where(pairs > 0, pairs, tokens)]
    features = np.stack(columns, 1) >> np.uint64(64 - BITS)
    return features.astype(np.int64).ravel(), t.first * len(columns)


def _trainer(alpha, beta, l1, l2):
    def train(batches):
        hashers = Hasher(1), Hasher(2)
        size = (1 << BITS) + 1  # the last one is the bias
        z, n = np.zeros(size), np.zeros(size)
        for batch in batches:
            for texts, labels in runs(batch.column(0), batch.column(1)):
                index, first = _features(Texts(texts), hashers)
                for i, label in enumerate(labels.to_pylist()):
                    of, times = np.unique(index[first[i] : first[i + 1]], return_counts=True)
                    x = np.r_[SCALE * times / max(1, times.sum()), 1.0]
                    of = np.r_[of, size - 1]
                    zi, ni = z[of], n[of]
                    w = -(zi - np.clip(zi, -l1, l1)) / ((beta + np.sqrt(ni)) / alpha + l2)
                    g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
                    root = np.sqrt(ni + g * g)
                    z[of] = zi + g - (root - np.sqrt(ni)) / alpha * w
                    n[of] = ni + g * g
        w = -(z - np.clip(z, -l1, l1)) / ((beta + np.sqrt(n)) / alpha + l2)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    return train


def fit(docs: DataFrame, labels: DataFrame, sample=SAMPLE, passes=PASSES, id="doc_id", text="text", label="quality"):
    """The weights learnt from at most ``sample`` labelled documents."""
    chosen = (
        labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
        .withColumn("deal", F.xxhash64("id")).orderBy("deal", "id").limit(sample)
    )
    # at most ``sample`` rows of three numbers
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    ordered = (
        rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(passes))))
        .repartition(1).sortWithinPartitions("turn", "deal", "id", "text")
    )
    found = ordered.select("text", "label").mapInArrow(_trainer(ALPHA, BETA, L1, L2), "weights binary").collect()
    return np.frombuffer(found[0][0]) if found else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray, text="text", into="score") -> DataFrame:
    """All rows and columns, with the probability of the good label in ``into``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def dotted(texts: pa.Array) -> pa.Array:
        w, hashers, scores = shared.value, (Hasher(1), Hasher(2)), [np.zeros(0)]
        for (part,) in runs(texts):
            index, first = _features(Texts(part), hashers)
            total = np.r_[0, np.cumsum(w[index], dtype=float)]
            size = np.diff(first)
            margin = w[-1] + SCALE * (total[first[1:]] - total[first[:-1]]) / np.maximum(size, 1)
            scores.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
        return pa.array(np.concatenate(scores))

    return docs.withColumn(into, F.arrow_udf(dotted, "double")(F.col(text).cast("string")))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
