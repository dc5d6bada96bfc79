"""From review text to aspects: keyword rules, model routing, resolved rows."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendlist import fixed
from mendlist.functions import gates
from mendlist.functions.binding import bound
from mendlist.functions.scores import safe_ratio
from mendlist.functions.text import has_text
from mendlist.operators.common import lookup
from mendlist.operators.ingest import stable_id
from mendlist.operators.taxonomy import with_display_name

_TAG = "struct<feature_key:string,sentiment:string,confidence:double>"


def keyword_tags(text: Column) -> Column:
    """Aspects found by case-insensitive substring rules; a default when none hits."""

    def found(lower):
        tags = []
        for feature, words, sentiment, confidence in fixed.KEYWORD_RULES:
            hit = F.lit(False)
            for word in words:
                hit = hit | F.contains(lower, F.lit(word))
            mood = F.lit(sentiment)
            if fixed.UPLIFT_WORD in words:
                mood = F.when(F.contains(lower, F.lit(fixed.UPLIFT_WORD)), "positive").otherwise(mood)
            tag = F.struct(F.lit(feature), mood, F.lit(confidence)).cast(_TAG)
            tags.append(F.when(hit, tag))
        return F.array_compact(F.array(*tags))

    default = F.array(F.struct(*[F.lit(v) for v in fixed.NO_KEYWORD]).cast(_TAG))
    return bound(
        bound(F.lower(text), found), lambda tags: F.when(F.size(tags) > 0, tags).otherwise(default)
    )


def tag_reviews(reviews: DataFrame, text="review") -> DataFrame:
    """One row per (review, aspect) by the keyword rules; blank reviews give none."""
    rest = [c for c in reviews.columns if c != text]
    return reviews.where(has_text(F.col(text))).select(
        *rest, F.col(text).alias("original_review"), F.inline(keyword_tags(F.col(text)))
    )


def scorer(load: Callable[[], Callable[..., np.ndarray]]):
    """A vectorised model as a function of Columns giving ``array<double>``.

    ``load`` runs once per Python worker and returns ``score(*texts)``: pandas
    Series in, an array of shape (rows, labels) out, one Arrow batch at a time.
    """

    def run(batches):
        score = load()
        for batch in batches:
            texts = batch if isinstance(batch, tuple) else (batch,)
            yield pd.Series(list(np.asarray(score(*texts), dtype="float64")))

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        yield from run(batches)

    def apply(*columns: Column) -> Column:
        return F.pandas_udf(one if len(columns) == 1 else many, T.ArrayType(T.DoubleType()))(*columns)

    return apply


def found_categories(
    scored: DataFrame, features: DataFrame, labels=fixed.LABELS, threshold=fixed.DECISION_THRESHOLD, keep=()
) -> DataFrame:
    """(review_id, review_text, feature_key, display_name) per category at or above ``threshold``.

    ``scored`` has id, review_text and ``probs``, one probability per label; columns named by ``keep`` stay.
    """
    names = F.array(*[F.lit(v) for v in labels])
    found = gates.predicted_labels(F.col("probs"), names, threshold)
    rows = scored.select(F.col("id").alias("review_id"), "review_text", *keep, F.explode(found).alias("feature_key"))
    return with_display_name(rows, features)


def rated_aspects(scored: DataFrame, sentiments=fixed.SENTIMENTS) -> DataFrame:
    """(review_id, feature_key, sentiment, confidence, source) from sentiment ``probs``."""
    names = F.array(*[F.lit(s) for s in sentiments])
    return scored.select(
        "review_id",
        "feature_key",
        gates.top_label(F.col("probs"), names).alias("sentiment"),
        gates.top_confidence(F.col("probs")).alias("confidence"),
        F.lit(fixed.ASPECT_SOURCES[0]).alias("source"),
    )


def route_reviews(
    reviews: DataFrame,
    features: DataFrame,
    category_probs: Callable[[Column], Column],
    sentiment_probs: Callable[[Column, Column], Column],
    labels=fixed.LABELS,
    threshold=fixed.DECISION_THRESHOLD,
    sentiments=fixed.SENTIMENTS,
) -> DataFrame:
    """(review_id, feature_key, sentiment, confidence, source) for every found aspect.

    Categories at or above ``threshold`` first, then one sentiment per (review,
    category) from the text and the feature's display name. The two scorers are
    functions of Columns (see ``scorer``), so any model fits.
    """
    text = F.col("review_text")
    scored = reviews.where(text.isNotNull()).select("id", text, category_probs(text).alias("probs"))
    found = found_categories(scored, features, labels, threshold)
    return rated_aspects(found.withColumn("probs", sentiment_probs(text, F.col("display_name"))), sentiments)


def _checked(value: Column, allowed, what: str) -> Column:
    wrong = F.raise_error(F.concat(F.lit(f"invalid {what}: "), F.coalesce(value, F.lit("null"))))
    return F.when(value.isin(*allowed), value).otherwise(wrong.cast("string"))


def resolve_aspects(routed: DataFrame, features: DataFrame) -> DataFrame:
    """Rows for ``review_aspects``: feature ids for keys, unknown keys dropped.

    A missing confidence counts as 1; an invalid sentiment or source is an error.
    """
    ids = lookup(features.select("feature_key", F.col("id").alias("feature_id")))
    return routed.join(ids, "feature_key").select(
        stable_id(F.col("review_id"), F.col("feature_id"), F.col("source")).alias("id"),
        "review_id",
        "feature_id",
        _checked(F.col("sentiment"), fixed.SENTIMENTS, "sentiment").alias("sentiment"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        _checked(F.col("source"), fixed.ASPECT_SOURCES, "source").alias("source"),
    )


def unresolved_aspects(routed: DataFrame, features: DataFrame) -> DataFrame:
    """Feature keys the taxonomy lacks and how many routed rows they cost."""
    counts = routed.groupBy("feature_key").agg(F.count("*").alias("rows"))
    return counts.join(features.select("feature_key"), "feature_key", "left_anti")


def source_rates(aspects: DataFrame) -> DataFrame:
    """One row: aspects in all and the share of each source; zeros over no rows."""
    total = F.count("*")
    shares = [
        safe_ratio(F.count_if(F.col("source") == name), total).alias(f"{name}_rate")
        for name in fixed.ASPECT_SOURCES
    ]
    return aspects.agg(total.alias("total"), *shares)


def run_statistics(reviews: DataFrame, routed: DataFrame, features: DataFrame) -> DataFrame:
    """One row on an inference run: reviews read, aspects by source, and what the taxonomy lacks.

    ``unresolved`` counts the routed rows of keys without a feature, which are not
    stored; ``unknown_keys`` lists these keys (no more than the labels there are).
    """
    lost = unresolved_aspects(routed, features).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("unresolved"), F.sort_array(F.collect_set("feature_key")).alias("unknown_keys")
    )
    known = lookup(features.select("feature_key"))
    rates = source_rates(routed.join(known, "feature_key", "left_semi")).withColumnRenamed("total", "aspects")
    read = reviews.agg(F.count("*").alias("reviews_processed"))
    one = F.lit(1).alias("_one")
    return (
        read.select("*", one).join(rates.select("*", one), "_one").join(lost.select("*", one), "_one").drop("_one")
    )
