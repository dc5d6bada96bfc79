"""Logistic regression for all labels at once: one pass over the data per round.

Each round sums losses and gradients of all labels over the stored rows: in numpy inside each task, then over
groups of tasks, then by block of the weights, so no task or driver receives more than the weights
are large. The driver turns them into the next step of each label: limited-memory BFGS, begun with a
diagonal above the Hessian (taken in the first pass), shortened where the loss did not fall.

After each round the macro F1 over held-out rows is taken; the weights of the best round are kept,
and training ends after ``patience`` rounds without a better one. Without held-out rows all rounds are made.

Rows are scaled to length one. Rows without features only teach the intercepts.
"""

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendlist import fixed
from mendlist.storage import release, settle

ROUNDS = 10
PATIENCE = 2
RIDGE = 1e-4
#: Rows of a task computed at once, and numbers of one shuffled block of a gradient.
CHUNK = 2000
BLOCK = 1 << 14
#: Groups of tasks whose gradients are added up before those of all.
GROUPS = 32

_ROW = "indices array<int>, values array<double>, y array<double>"


@dataclass(frozen=True)
class LinearLabels:
    labels: tuple
    #: A row per label: a weight per feature, then the intercept.
    weights: np.ndarray


def sparse(features: Column) -> tuple[Column, Column]:
    """Indices and values of a sparse vector column."""
    vector = F.unwrap_udt(features)
    return vector["indices"], vector["values"]


def _rows(featured: DataFrame, labels) -> DataFrame:
    indices, values = sparse(F.col("features"))
    truth = F.array(*[F.coalesce(F.array_contains("labels", name), F.lit(False)).cast("double") for name in labels])
    return settle(featured.select(indices.alias("indices"), values.alias("values"), truth.alias("y")))


def _flat(indices: pa.Array, values: pa.Array, dims: int):
    """(row, column, value) of all numbers, an intercept of one per row, and the number of rows."""
    n = len(indices)
    size = np.diff(np.frombuffer(indices.buffers()[1], np.int32)[indices.offset : indices.offset + n + 1])
    row = np.repeat(np.arange(n), size)
    column = indices.flatten().to_numpy().astype(np.int64)
    value = values.flatten().to_numpy()
    length = np.sqrt(np.bincount(row, value * value, n))
    value = value / np.maximum(length, 1e-300)[row]
    return np.r_[row, np.arange(n)], np.r_[column, np.full(n, dims)], np.r_[value, np.ones(n)], n


def _scores(weights: np.ndarray, row, column, value, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, w[column] * value, n) for w in weights], axis=1)


def _chance(scores: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scores, -50, 50)))


def _chunks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            y = part.column(2).flatten().to_numpy().reshape(part.num_rows, -1)
            yield part.column(0), part.column(1), y


def _blocks_of(flat: np.ndarray, salt: int):
    for b in range(0, len(flat), BLOCK):
        yield pa.RecordBatch.from_arrays(
            [pa.array([b // BLOCK]), pa.array([salt]), pa.array([flat[b : b + BLOCK].tobytes()], pa.binary())], names=["block", "salt", "sums"]
        )


def _gradient(shared, bound: bool):
    """Sums of the gradient, of the bound if asked for, and by label the loss; and the number of rows."""

    def sums(batches):
        from pyspark import TaskContext

        weights, positive = shared.value
        labels, dims = weights.shape[0], weights.shape[1] - 1
        total, above, rows = np.zeros_like(weights), np.zeros_like(weights) if bound else None, 0
        losses = np.zeros(labels)
        for indices, values, y in _chunks(batches):
            row, column, value, n = _flat(indices, values, dims)
            rows += n
            weight = np.where(y > 0, positive, 1.0)
            score = _scores(weights, row, column, value, n)
            error = (_chance(score) - y) * weight
            losses += (weight * (np.logaddexp(0, score) - y * score)).sum(0)
            reach = np.bincount(row, np.abs(value), n)
            for k in range(labels):
                total[k] += np.bincount(column, error[row, k] * value, dims + 1)
                if bound:
                    above[k] += np.bincount(column, (0.25 * weight[:, k] * reach)[row] * np.abs(value), dims + 1)
        parts = [total.ravel(), *([above.ravel()] if bound else []), losses, np.array([float(rows)])]
        yield from _blocks_of(np.concatenate(parts), TaskContext.get().partitionId())

    return sums


def _add(batches):
    total = {}
    for batch in batches:
        for block, salt, sums in zip(*(c.to_pylist() for c in batch.columns)):
            part = np.frombuffer(sums)
            known = total.get(block)
            total[block] = (salt, part.copy()) if known is None else (salt, known[1] + part)
    for block, (salt, sums) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([salt]), pa.array([sums.tobytes()], pa.binary())], names=["block", "salt", "sums"]
        )


def _summed(rows: DataFrame, shared, bound: bool) -> np.ndarray:
    schema = "block long, salt long, sums binary"
    sums = rows.mapInArrow(_gradient(shared, bound), schema)
    sums = sums.repartition(GROUPS, F.col("salt") % GROUPS).mapInArrow(_add, schema)
    found = sums.repartition("block").mapInArrow(_add, schema).select("block", "sums").collect()
    return np.concatenate([np.frombuffer(r.sums) for r in sorted(found, key=lambda r: r.block)]) if found else np.zeros(0)


def _confusion(shared, threshold: float):
    def count(batches):
        weights = shared.value
        total = np.zeros((3, weights.shape[0]), np.int64)
        for indices, values, y in _chunks(batches):
            row, column, value, n = _flat(indices, values, weights.shape[1] - 1)
            guess, truth = _chance(_scores(weights, row, column, value, n)) >= threshold, y > 0
            total += [(guess & truth).sum(0), (guess & ~truth).sum(0), (~guess & truth).sum(0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(weights.shape[0])), *map(pa.array, total)], names=["label", "tp", "fp", "fn"]
        )

    return count


def macro_f1(rows: DataFrame, shared, threshold: float) -> float | None:
    """Over the labels that occur (all of them if none does), as the report has it; None without rows."""
    counts = rows.mapInArrow(_confusion(shared, threshold), "label long, tp long, fp long, fn long")
    found = counts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect()  # a row per label
    if not found:
        return None
    kept = [r for r in found if r.tp + r.fn] or found
    return sum(2 * r.tp / max(1, 2 * r.tp + r.fp + r.fn) for r in kept) / len(kept)


class _Descent:
    """Limited-memory BFGS of one label: the point to look at next, from loss and gradient at the last one."""

    MEMORY = 8

    def __init__(self, start: np.ndarray):
        self.point, self.ahead, self.loss, self.pairs, self.step = start, start, None, [], 1.0

    def _direction(self, scale: np.ndarray) -> np.ndarray:
        d, used = -self.gradient, []
        for s, y in reversed(self.pairs):
            a = s @ d / (s @ y)
            used.append(a)
            d = d - a * y
        s, y = self.pairs[-1] if self.pairs else (None, None)
        d = d / scale * ((s @ y) / (y @ (y / scale)) if self.pairs else 1.0)
        for (s, y), a in zip(self.pairs, reversed(used)):
            d = d + s * (a - y @ d / (s @ y))
        return d

    def take(self, loss: float, gradient: np.ndarray, scale: np.ndarray):
        """The loss and gradient at ``ahead``."""
        fell = self.loss is None or loss <= self.loss + 1e-4 * self.step * (self.gradient @ self.towards)
        if fell:
            if self.loss is not None:
                s, y = self.ahead - self.point, gradient - self.gradient
                if s @ y > 1e-12:
                    self.pairs = [*self.pairs, (s, y)][-self.MEMORY :]
            self.point, self.loss, self.gradient, self.step = self.ahead, loss, gradient, 1.0
            self.towards = self._direction(scale)
        else:
            self.step *= 0.3
        self.ahead = self.point + self.step * self.towards


def fit(train: DataFrame, pos_weights: dict[str, float], val: DataFrame | None = None, rounds=ROUNDS, patience=PATIENCE,
        threshold=fixed.DECISION_THRESHOLD, dims=None) -> tuple[LinearLabels, list]:
    """(model, macro F1 on ``val`` after each round). Both tables have ``features`` (sparse) and a ``labels`` list."""
    spark = train.sparkSession
    labels = tuple(sorted(pos_weights))
    rows = _rows(train, labels)
    held = None if val is None else _rows(val, labels)
    if held is not None and held.isEmpty():
        held = None
    first = train.select(F.unwrap_udt("features")["size"].alias("n")).first() if dims is None else None
    dims = dims or (first["n"] if first else 0)
    # 0 for a label that every record has
    positive = np.array([max(pos_weights[name], fixed.WEIGHT_EPSILON) for name in labels])
    best = np.zeros((len(labels), dims + 1))
    descents, history, since, above = [_Descent(w) for w in best], [], 0, None
    for _ in range(rounds):
        ahead = np.stack([d.ahead for d in descents])
        shared = spark.sparkContext.broadcast((ahead, positive))
        sums = _summed(rows, shared, above is None)
        shared.unpersist()
        if not len(sums) or not sums[-1]:
            break
        n, losses, parts = sums[-1], sums[-1 - len(labels) : -1], sums[: -1 - len(labels)].reshape(-1, *best.shape)
        if above is None:
            above = parts[1] / n + RIDGE
        for k, d in enumerate(descents):
            d.take(losses[k] / n + RIDGE / 2 * (ahead[k] @ ahead[k]), parts[0][k] / n + RIDGE * ahead[k], above[k])
        if held is None:
            continue
        weights = np.stack([d.ahead for d in descents])
        shared = spark.sparkContext.broadcast(weights)
        history.append(macro_f1(held, shared, threshold))
        shared.unpersist()
        if history[-1] > max(history[:-1], default=-1.0):
            best, since = weights, 0
        else:
            since += 1
            if since >= patience:
                break
    if held is None:
        best = np.stack([d.ahead if not d.pairs else d.point for d in descents])
    release(rows, *([held] if held is not None else []))
    return LinearLabels(labels, best), history


def logits(model: LinearLabels, featured: DataFrame) -> DataFrame:
    """Adds ``logits`` in the order of the labels, from ``features``."""
    shared = featured.sparkSession.sparkContext.broadcast(model.weights)

    def score(indices: pa.Array, values: pa.Array) -> pa.Array:
        weights = shared.value
        out = np.zeros((len(indices), weights.shape[0]))
        for at in range(0, len(indices), CHUNK):
            row, column, value, n = _flat(indices.slice(at, CHUNK), values.slice(at, CHUNK), weights.shape[1] - 1)
            out[at : at + CHUNK] = _scores(weights, row, column, value, n)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

    return featured.withColumn("logits", F.arrow_udf(score, "array<double>")(*sparse(F.col("features"))))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
