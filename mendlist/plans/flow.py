"""Batch flow: ingest -> seed -> preprocess -> inference -> score."""

from pyspark.sql import DataFrame, SparkSession

from mendlist import fixed
from mendlist.operators import aspects as A
from mendlist.plans.baseline import Models, route_with_models
from mendlist.plans.increments import refresh
from mendlist.plans.ingest import Tables, ingest_csv, seed_features
from mendlist.plans.preprocess import preprocess
from mendlist.sources.readers import active_features, read_split, require_rows
from mendlist.sources.writers import write_aspects
from mendlist.storage import settle


def infer(
    spark: SparkSession,
    tables: Tables,
    category_probs,
    sentiment_probs,
    split="test",
    limit=None,
    run_id=None,
    threshold=fixed.DECISION_THRESHOLD,
) -> dict:
    """Find the aspects of a split's reviews and store them as run ``run_id``.

    The run is named after the split unless told otherwise, so the runs of
    two splits stand side by side. Returns the run's statistics.
    """
    reviews = read_split(spark, tables.splits, split, limit)
    features = tables.features(spark)
    routed = A.route_reviews(
        reviews, active_features(features), category_probs, sentiment_probs, threshold=threshold
    )
    return store_run(reviews, routed, features, tables, run_id or split)


def infer_with_models(spark: SparkSession, tables: Tables, models: Models, split="test", limit=None, run_id=None) -> dict:
    """``infer`` by fitted baseline models."""
    reviews = read_split(spark, tables.splits, split, limit)
    features = tables.features(spark)
    routed = route_with_models(reviews, active_features(features), models)
    return store_run(reviews, routed, features, tables, run_id or split)


def store_run(reviews: DataFrame, routed: DataFrame, features: DataFrame, tables: Tables, run_id: str) -> dict:
    """Store one run's aspects; returns counts, source rates and unknown feature keys."""
    routed = settle(routed)
    written = write_aspects(A.resolve_aspects(routed, features), tables.store(reviews.sparkSession), run_id)
    stats = A.run_statistics(reviews, routed, features).first().asDict()
    return stats | {"aspects_written": written}


def score(spark: SparkSession, tables: Tables, half_life_days=fixed.HALF_LIFE_DAYS) -> int:
    """Bring the score table up to date with all stored aspects; returns the rows stored."""
    require_rows(tables.aspects(spark), "review_aspects")
    refresh(spark, tables, half_life_days)
    return tables.scores(spark).count()


def run(
    spark: SparkSession,
    root: str,
    category_probs,
    sentiment_probs,
    csv_path=None,
    inference_split="test",
    inference_limit=None,
    half_life_days=fixed.HALF_LIFE_DAYS,
) -> dict:
    """The whole batch flow over the tables under ``root``; returns row counts."""
    tables = Tables(root)
    if csv_path:
        ingest_csv(spark, csv_path, tables)
    seed_features(spark, tables)
    return {
        "features": tables.features(spark).count(),
        "preprocessing": preprocess(spark, tables),
        **infer(spark, tables, category_probs, sentiment_probs, inference_split, inference_limit),
        "scores_written": score(spark, tables, half_life_days),
    }


def analyse(reviews: DataFrame) -> dict[str, DataFrame]:
    """Ad-hoc analysis of (review) rows by keyword rules, as the dashboard shows it."""
    from mendlist.operators import priorities as P

    found = A.tag_reviews(reviews).withColumnRenamed("feature_key", "feature")
    return {
        "aspects": found,
        "priorities": P.feature_priorities(found),
        "summary": P.insight_text(P.kpi_summary(found)),
        "feature_mentions": P.feature_mentions(found),
        "sentiment_distribution": P.sentiment_distribution(found),
        "top_negative_features": P.top_negative_features(found),
    }
