"""Evaluation of scorers against gold annotations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendlist import fixed
from mendlist.operators import evaluation as E
from mendlist.operators.common import short_id
from mendlist.operators.training import sentiment_index
from mendlist.sources.readers import require_rows
from mendlist.sources.writers import write_report
from mendlist.storage import release, settle


def evaluate(
    spark: SparkSession,
    reviews: DataFrame,
    annotations: DataFrame,
    features: DataFrame,
    category_logits,
    sentiment_logits,
    path: str,
    vocabulary=fixed.LABELS,
    threshold=fixed.DECISION_THRESHOLD,
    mapping=None,
) -> DataFrame:
    """Write and return (task, metric, value) rows.

    The two scorers are functions of Columns giving logits: of the text, and of
    the text and the feature's display name.
    """
    # both tables are read twice below, and may be long jobs; ids only bring rows together here
    reviews = settle(reviews.select(short_id(F.col("id")).alias("id"), "review_text"))
    require_rows(reviews, "evaluation reviews")
    notes = annotations.select(short_id(F.col("review_id")).alias("review_id"), "aspect_category", "polarity")
    notes = settle(E.mapped_annotations(notes, mapping).select("review_id", "feature_key", "outcome", "polarity"))
    names = sorted(set(vocabulary))
    gold = E.gold_category_labels(reviews, notes, names, mapping)
    category = E.category_metrics(
        gold.select(
            category_logits(F.col("review_text")).alias("logits"), F.col("gold_labels").alias("truth")
        ),
        names,
        threshold,
    )
    pairs = E.gold_sentiment_pairs(reviews, notes, features, mapping)
    sentiment = E.sentiment_metrics(
        pairs.select(
            sentiment_logits(F.col("text_a"), F.col("text_b")).alias("logits"),
            sentiment_index(F.col("gold_sentiment")).alias("truth"),
        )
    )
    report = category.select(F.lit("category").alias("task"), "*").unionByName(
        sentiment.select(F.lit("sentiment").alias("task"), "*")
    )
    # checked before anything is left behind
    report = settle(report)
    release(reviews, notes)
    n_pairs = report.where("task = 'sentiment' AND metric LIKE 'support_%'").agg(F.sum("value")).first()[0]
    if not n_pairs:
        raise ValueError("no usable gold sentiment pair")
    write_report(report, path)
    return spark.read.schema(report.schema).json(path)
