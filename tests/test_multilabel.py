"""All labels in one pass: gradients against numpy, the best round, save and load by test_flow."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from mendlist.plans import multilabel as M

DIMS = 40
SCHEMA = T.StructType([T.StructField("features", VectorUDT()), T.StructField("labels", T.ArrayType(T.StringType()))])


def _rows(seed, n, noise=0.0):
    deal, rows = random.Random(seed), []
    for _ in range(n):
        at = sorted(deal.sample(range(DIMS), deal.randint(0, 6)))
        labels = [name for name, own in (("a", 0), ("b", 1)) if (own in at) != (deal.random() < noise)]
        rows.append((Vectors.sparse(DIMS, at, [deal.uniform(0.5, 3) for _ in at]), [*labels, "all"] if deal.random() < 0.9 else None))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    return [spark.createDataFrame(_rows(seed, n), SCHEMA).repartition(4) for seed, n in ((1, 400), (2, 120))]


def _dense(frame, labels):
    x, y = [], []
    for r in frame.collect():
        v = r.features.toArray()
        x.append(np.append(v / (np.linalg.norm(v) or 1), 1.0))
        y.append([float(name in (r.labels or ())) for name in labels])
    return np.array(x), np.array(y)


def _by_hand(x, y, positive, weights):
    """(gradient sums, losses) of all labels."""
    w = np.where(y > 0, positive, 1.0)
    score = x @ weights.T
    return ((1 / (1 + np.exp(-score)) - y) * w).T @ x, (w * (np.log1p(np.exp(score)) - y * score)).sum(0)


def test_gradients_of_all_labels(spark, frames, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 33)
    monkeypatch.setattr(M, "BLOCK", 17)
    labels, positive = ("a", "all", "b", "none"), np.array([3.0, 0.5, 1.0, 2.0])
    weights = np.random.default_rng(1).normal(size=(4, DIMS + 1))
    x, y = _dense(frames[0], labels)
    gradient, losses = _by_hand(x, y, positive, weights)
    sums = M._summed(M._rows(frames[0], labels), spark.sparkContext.broadcast((weights, positive)), True)
    found, above = sums[:-5].reshape(2, 4, DIMS + 1)
    assert np.allclose(found, gradient) and np.allclose(sums[-5:-1], losses) and sums[-1] == 400
    # the bound lies above the Hessian
    w = np.where(y > 0, positive, 1.0)
    for k in range(4):
        p = 1 / (1 + np.exp(-x @ weights[k]))
        hessian = (x * (w[:, k] * p * (1 - p))[:, None]).T @ x
        assert np.linalg.eigvalsh(np.diag(above[k]) - hessian).min() > -1e-9


def test_rounds_lead_to_the_minimum(frames):
    weights = {"a": 3.0, "b": 1.0, "all": 0.5}
    model, history = M.fit(frames[0], weights, rounds=25)
    x, y = _dense(frames[0], model.labels)
    gradient, _ = _by_hand(x, y, np.array([weights[name] for name in model.labels]), model.weights)
    start, _ = _by_hand(x, y, np.array([weights[name] for name in model.labels]), 0 * model.weights)
    assert model.labels == ("a", "all", "b") and history == []
    ridge = M.RIDGE * len(x) * model.weights
    assert (np.linalg.norm(gradient + ridge, axis=1) < 0.05 * np.linalg.norm(start, axis=1)).all()
    scores = M.logits(model, frames[1]).collect()
    x, _ = _dense(frames[1], model.labels)
    assert np.allclose([r.logits for r in scores], x @ model.weights.T)


def test_the_best_round_is_kept(spark, frames, monkeypatch):
    weights = {"a": 1.0, "b": 1.0}
    scripted, seen = iter([0.2, 0.7, 0.6, 0.7, 0.9]), []

    def f1(rows, shared, threshold):
        seen.append(shared.value.copy())
        return next(scripted)

    with monkeypatch.context() as patch:
        patch.setattr(M, "macro_f1", f1)
        model, history = M.fit(frames[0], weights, frames[1], rounds=10)
    assert history == [0.2, 0.7, 0.6, 0.7] and np.array_equal(model.weights, seen[1])
    model, history = M.fit(frames[0], weights, frames[1], rounds=12)
    assert history[0] < 0.1 and max(history) > 0.55  # labels are missing at random
    empty = frames[1].limit(0)
    assert M.fit(frames[0], weights, empty, rounds=2)[1] == []


def test_macro_f1(spark, frames):
    model, _ = M.fit(frames[0], {"a": 1.0, "b": 1.0, "none": 1.0}, rounds=3)
    x, y = _dense(frames[1], model.labels)
    guess = 1 / (1 + np.exp(-x @ model.weights.T)) >= 0.4
    expected = [2 * (guess[:, k] * y[:, k]).sum() / (guess[:, k].sum() + y[:, k].sum()) for k in (0, 1)]
    rows = M._rows(frames[1], model.labels)
    assert M.macro_f1(rows, spark.sparkContext.broadcast(model.weights), 0.4) == pytest.approx(np.mean(expected))


def test_nothing_to_learn(spark):
    model, history = M.fit(spark.createDataFrame([], SCHEMA), {"a": 1.0})
    assert model.weights.shape == (1, 1) and not model.weights.any() and history == []
