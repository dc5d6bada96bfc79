"""Gold labels from annotations, and classifier metrics against them."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlist import fixed
from mendlist.functions.binding import bound
from mendlist.functions.gates import sigmoid_value, top_position
from mendlist.functions.scores import safe_ratio
from mendlist.functions.text import stripped
from mendlist.operators.common import lookup
from mendlist.operators.taxonomy import map_category


def mapped_annotations(annotations: DataFrame, mapping=None) -> DataFrame:
    """The annotations that are mapped to a feature; a table made by this before is left as it is."""
    if "outcome" in annotations.columns:
        return annotations
    return map_category(annotations, F.col("aspect_category"), mapping).where(F.col("outcome") == "mapped")


#: Labels held by one number.
WORD_BITS = 62


def gold_category_labels(
    reviews: DataFrame, annotations: DataFrame, vocabulary=fixed.LABELS, mapping=None
) -> DataFrame:
    """(review_id, review_text, gold_labels): one multi-hot row for every review."""
    mapped = mapped_annotations(annotations, mapping)
    # the labels of a review as bits of numbers, which combine within the map tasks
    names = sorted(set(vocabulary))
    words = [names[i : i + WORD_BITS] for i in range(0, len(names), WORD_BITS)]
    found = (
        mapped.where(F.col("feature_key").isin(*names))
        .groupBy("review_id")
        .agg(*[F.bit_or(_bit_of(F.col("feature_key"), word)).alias(f"_bits{i}") for i, word in enumerate(words)])
    )
    hot = [
        F.coalesce(F.col(f"_bits{i}").bitwiseAND(F.lit(1 << j)) != 0, F.lit(False)).cast("double")
        for i, word in enumerate(words)
        for j in range(len(word))
    ]
    texts = reviews.select(F.col("id").alias("review_id"), "review_text")
    return texts.join(found, "review_id", "left").select("review_id", "review_text", F.array(*hot).alias("gold_labels"))


def _bit_of(name: Column, names) -> Column:
    """A number with the bit of one of the names, 0 for others."""
    bit = F.lit(0).cast("bigint")
    for j, known in enumerate(names):
        bit = F.when(name == known, F.lit(1 << j).cast("bigint")).otherwise(bit)
    return bit


def gold_sentiment(polarity: Column) -> Column:
    """Normalised gold sentiment; null for a missing or invalid polarity."""
    neutral = lambda x: F.when(x.isin(*fixed.NEUTRAL_SPELLINGS), "neutral").when(x.isin(*fixed.SENTIMENTS), x)
    return bound(F.lower(stripped(polarity)), neutral)


def gold_sentiment_pairs(
    reviews: DataFrame, annotations: DataFrame, features: DataFrame, mapping=None
) -> DataFrame:
    """(review_id, feature_key, text_a, text_b, gold_sentiment) per usable annotation."""
    names = lookup(features.select("feature_key", F.col("display_name").alias("text_b")))
    usable = (
        mapped_annotations(annotations, mapping)
        .withColumn("gold_sentiment", gold_sentiment(F.col("polarity")))
        .where(F.col("gold_sentiment").isNotNull())
        .select("review_id", "feature_key", "gold_sentiment")
        .join(names, "feature_key")
    )
    texts = reviews.select(F.col("id").alias("review_id"), F.col("review_text").alias("text_a"))
    return usable.join(texts, "review_id").select(
        "review_id", "feature_key", "text_a", "text_b", "gold_sentiment"
    )


def gold_pair_report(annotations: DataFrame, features: DataFrame, mapping=None) -> DataFrame:
    """One row: annotations, and how many give no pair for want of a mapping, a valid sentiment or a name.

    The causes are looked for in this order; counts per feature key come first.
    """
    named = features.select("feature_key", F.lit(True).alias("_named")).distinct()
    counts = (
        map_category(annotations, F.col("aspect_category"), mapping)
        .groupBy("outcome", "feature_key")
        .agg(F.count("*").alias("n"), F.count(gold_sentiment(F.col("polarity"))).alias("valid"))
        .join(named, "feature_key", "left")
    )
    mapped, name = F.col("outcome") == "mapped", F.coalesce("_named", F.lit(False))
    total = lambda c, on: F.coalesce(F.sum(F.when(on, c)), F.lit(0))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("annotations"),
        total(F.col("n"), ~mapped).alias("not_mapped"),
        total(F.col("n") - F.col("valid"), mapped).alias("invalid_sentiment"),
        total(F.col("valid"), mapped & ~name).alias("unnamed_feature"),
        total(F.col("valid"), mapped & name).alias("kept"),
    )


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_ratio(2 * tp, 2 * tp + fp + fn)


def label_counts(outputs: DataFrame, names, threshold=fixed.DECISION_THRESHOLD) -> DataFrame:
    """(label, tp, fp, fn, support) from rows of (logits, truth) arrays.

    Rows explode into their labels, and the counts are combined within the map
    tasks, so the shuffle carries one row per label and task.
    """
    names_array = F.array(*[F.lit(n) for n in names])
    items = outputs.select(
        F.inline(F.arrays_zip(names_array.alias("label"), F.col("logits"), F.col("truth")))
    )
    p = sigmoid_value(F.col("logits"), fixed.LOGIT_CLIP) >= threshold
    t = F.col("truth") == 1
    return items.groupBy("label").agg(
        F.count_if(p & t).alias("tp"),
        F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & t).alias("fn"),
        F.count_if(t).alias("support"),
    )


def category_metrics(outputs: DataFrame, names, threshold=fixed.DECISION_THRESHOLD) -> DataFrame:
    """(metric, value) rows of multi-label metrics.

    ``threshold=None`` takes the best threshold of the sweep over the same rows.
    Averages run over the labels that have support (all of them when none has);
    F1 and support are given for every label.
    """
    if threshold is None:
        threshold = best_threshold(outputs, names).first()["threshold"]
    counts = label_counts(outputs, names, threshold)
    supported = F.max("support").over(W.partitionBy()) > 0  # one row per label
    counts = counts.withColumn("counted", (F.col("support") > 0) | ~supported)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per_label = counts.select(
        "*",
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
    )
    kept = per_label.where("counted")
    s = lambda c: F.sum(c)
    whole = kept.agg(
        safe_ratio(s("tp"), s("tp") + s("fp")).alias("precision_micro"),
        safe_ratio(s("tp"), s("tp") + s("fn")).alias("recall_micro"),
        _f1(s("tp"), s("fp"), s("fn")).alias("f1_micro"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision_macro"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall_macro"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1_macro"),
    ).withColumn("optimal_threshold", F.lit(float(threshold)))
    overall = _as_rows(whole)
    return overall.unionByName(_per_name(per_label, F.col("f1"), F.col("support")))


def _as_rows(one_row: DataFrame) -> DataFrame:
    """A one-row table of doubles as (metric, value) rows."""
    return one_row.unpivot([], one_row.columns, "metric", "value")


def _per_name(rows: DataFrame, f1: Column, support: Column) -> DataFrame:
    """F1 and support of every label as (metric, value) rows."""
    values = (("f1_", f1), ("support_", support.cast("double")))
    items = [
        F.struct(F.concat(F.lit(prefix), "label").alias("metric"), value.alias("value"))
        for prefix, value in values
    ]
    return rows.select(F.inline(F.array(*items)))


def sweep_thresholds():
    start, stop, step = fixed.SWEEP
    return [float(t) for t in np.arange(start, stop, step)]


def threshold_curve(outputs: DataFrame, names) -> DataFrame:
    """(threshold, f1_macro over all labels) for every threshold of the sweep.

    Each probability is counted once, in the bin of the highest threshold it
    reaches; counts at a threshold are sums over the bins at or above it. So
    the data is read once instead of once per threshold.
    """
    steps = sweep_thresholds()
    names_array = F.array(*[F.lit(n) for n in names])
    items = outputs.select(
        F.inline(F.arrays_zip(names_array.alias("label"), F.col("logits"), F.col("truth")))
    ).withColumn("p", sigmoid_value(F.col("logits"), fixed.LOGIT_CLIP))
    reached = F.lit(0)
    for t in steps:
        reached = reached + (F.col("p") >= t).cast("int")
    bins = items.groupBy("label", reached.alias("bin")).agg(
        F.count_if(F.col("truth") == 1).alias("pos"),
        F.count_if(F.col("truth") != 1).alias("neg"),
    )
    # at most labels x 18 rows from here on
    marks = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(t).alias("threshold")) for i, t in enumerate(steps)])
    counts = (
        bins.select("*", F.inline(marks))
        .groupBy("label", "threshold")
        .agg(
            F.sum(F.when(F.col("bin") >= F.col("step"), F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("bin") >= F.col("step"), F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(F.col("bin") < F.col("step"), F.col("pos")).otherwise(0)).alias("fn"),
        )
    )
    f1 = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.groupBy("threshold").agg(F.avg(f1).alias("f1_macro"))


def best_threshold(outputs: DataFrame, names) -> DataFrame:
    """One row: the threshold with the best macro F1, the lowest on ties, 2 decimals."""
    curve = threshold_curve(outputs, names)
    # sums of a few doubles in varying order: equal scores are told from 1e-12 up
    best = curve.orderBy(F.desc(F.round("f1_macro", 12)), "threshold").limit(1)
    return best.select(F.round("threshold", 2).alias("threshold"), "f1_macro")


def sentiment_metrics(outputs: DataFrame) -> DataFrame:
    """(metric, value) rows of 3-class metrics from (logits array, truth index) rows."""
    confusion = (
        outputs.select("truth", top_position(F.col("logits")).cast("int").alias("guess"))
        .groupBy("truth", "guess")
        .agg(F.count("*").alias("n"))
    )
    # nine rows at most from here on
    n, hit = F.col("n"), F.col("truth") == F.col("guess")
    zero, one_if = F.lit(0), lambda on: on.cast("int")
    as_truth = (F.col("truth"), one_if(hit), zero, one_if(~hit))
    as_guess = (F.col("guess"), zero, one_if(~hit), zero)
    sides = confusion.select(
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(*[v.alias(name) for v, name in zip(side, ("c", "tp", "fp", "fn"))])
                    for side in (as_truth, as_guess)
                ]
            )
        ),
    )
    spark = outputs.sparkSession
    classes = spark.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in fixed.SENTIMENTS])).alias("c", "label"))
    count = lambda c: F.coalesce(F.sum(F.col(c) * n), F.lit(0))
    per_class = (
        sides.join(F.broadcast(classes), "c", "right")
        .groupBy("c", "label")
        .agg(count("tp").alias("tp"), count("fp").alias("fp"), count("fn").alias("fn"))
        .withColumn("support", F.col("tp") + F.col("fn"))
        .withColumn("_counted", (F.col("support") > 0) | (F.max("support").over(W.partitionBy()) == 0))
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    over = lambda value: F.coalesce(F.avg(F.when(F.col("_counted"), value)), F.lit(0.0))
    whole = per_class.agg(
        safe_ratio(F.sum(tp), F.sum(tp + fn)).alias("accuracy"),
        over(safe_ratio(tp, tp + fp)).alias("precision_macro"),
        over(safe_ratio(tp, tp + fn)).alias("recall_macro"),
        over(_f1(tp, fp, fn)).alias("f1_macro"),
    )
    each = _per_name(per_class, _f1(tp, fp, fn), F.col("support"))
    return _as_rows(whole).unionByName(each)
