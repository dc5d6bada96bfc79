"""Model outputs as Columns: probabilities, labels, confidences and gates.

Inputs are ``array<double>`` columns, one element per label.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendlist import fixed
from mendlist.functions.binding import bound


def sigmoid_value(x: Column, clip=None) -> Column:
    if clip is not None:
        x = F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sigmoid(logits: Column, clip=None) -> Column:
    return F.transform(logits, lambda x: sigmoid_value(x, clip))


def softmax(logits: Column) -> Column:
    def shares(powers):
        total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
        return bound(total, lambda t: F.transform(powers, lambda x: x / t))

    def powers(top):
        return F.transform(logits, lambda x: F.exp(x - top))

    return bound(bound(F.array_max(logits), powers), shares)


def decision_confidence(probs: Column, threshold=fixed.DECISION_THRESHOLD) -> Column:
    """Per label, how far the probability is inside its side of the threshold (0.5..1)."""
    above, below = 1.0 - threshold + fixed.GATE_EPSILON, threshold + fixed.GATE_EPSILON
    half = F.lit(0.5)
    return F.transform(
        probs,
        lambda p: F.when(p >= threshold, half + half * ((p - threshold) / F.lit(above))).otherwise(
            half + half * ((F.lit(threshold) - p) / F.lit(below))
        ),
    )


def category_needs_fallback(
    probs: Column, gate=fixed.CATEGORY_GATE, threshold=fixed.DECISION_THRESHOLD
) -> Column:
    """True where the least sure positive label is below ``gate``; never without positives."""
    positive = F.filter(probs, lambda p: p >= threshold)
    weakest = F.array_min(decision_confidence(positive, threshold))
    return F.coalesce(weakest < gate, F.lit(False))


def predicted_labels(probs: Column, names: Column, threshold) -> Column:
    """Names whose probability is at or above the threshold, in label order."""
    pairs = F.arrays_zip(names.alias("name"), probs.alias("p"))
    kept = F.filter(pairs, lambda x: x["p"] >= threshold)
    return F.transform(kept, lambda x: x["name"])


def top_confidence(probs: Column) -> Column:
    return F.array_max(probs)


def sentiment_needs_fallback(probs: Column, gate=fixed.SENTIMENT_GATE) -> Column:
    return top_confidence(probs) < gate


def top_position(probs: Column) -> Column:
    """0-based position of the largest element, the first on ties."""
    return F.array_position(probs, F.array_max(probs)) - 1


def top_label(probs: Column, names: Column) -> Column:
    return F.element_at(names, (top_position(probs) + 1).cast("int"))
