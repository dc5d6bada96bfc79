"""Monthly criticality per feature, with its trend."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlist import fixed
from mendlist.functions import scores as S
from mendlist.sources.readers import require_columns

SCORING_COLUMNS = ("feature_id", "sentiment", "review_date")


def dated_aspects(aspects: DataFrame, reviews: DataFrame) -> DataFrame:
    """(feature_id, sentiment, review_date): aspects with their review's date.

    A plain equi-join: Spark broadcasts a small review table by its size and
    splits the partition of a review with very many aspects (AQE skew join).
    """
    dates = reviews.select(F.col("id").alias("review_id"), "review_date")
    return aspects.select("review_id", "feature_id", "sentiment").join(dates, "review_id").drop("review_id")


def windowed_scores(aspects: DataFrame, half_life_days=fixed.HALF_LIFE_DAYS) -> DataFrame:
    """Score per (feature, calendar month), plus one undated bucket per feature.

    Null dates group together as the undated bucket, so one hash aggregation
    does it all; its counts and sums are combined within the map tasks. The
    trend compares months of the (small) aggregated table: the step from the
    previous month that has data, null for the first one and for undated rows.
    """
    require_columns(aspects, SCORING_COLUMNS, "scoring input")
    day = F.col("review_date")
    start, end = S.month_start(day), S.month_end(day)
    weight = S.recency_weight(day, end, half_life_days)
    grouped = aspects.groupBy(
        "feature_id", start.alias("window_start"), end.alias("window_end")
    ).agg(
        F.count("*").alias("mention_count"),
        S.negative_ratio(F.col("sentiment")).alias("negative_ratio"),
        F.avg(weight).alias("mean_weight"),
        F.avg(day.isNull().cast("double")).alias("undated_ratio"),
    )
    score = S.criticality(F.col("negative_ratio"), F.col("mention_count"), F.col("mean_weight"))
    undated = F.col("window_start").isNull()
    timeline = W.partitionBy("feature_id", "_undated").orderBy("window_start")
    return (
        grouped.withColumn("score", score)
        .withColumn("_undated", undated)
        .withColumn("trend_delta", F.when(~undated, F.col("score") - F.lag("score").over(timeline)))
        .select(
            "feature_id",
            "window_start",
            "window_end",
            "score",
            "mention_count",
            "negative_ratio",
            "undated_ratio",
            "trend_delta",
        )
    )


def day_counts(aspects: DataFrame) -> DataFrame:
    """(feature_id, review_date, mentions, negatives): what scores need of dated aspects.

    Counts of two sets of aspects add up, so they can be kept and added to; undated aspects have no place in them.
    """
    require_columns(aspects, SCORING_COLUMNS, "scoring input")
    return (
        aspects.where(F.col("review_date").isNotNull())
        .groupBy("feature_id", "review_date")
        .agg(F.count("*").alias("mentions"), F.count_if(F.col("sentiment") == "negative").alias("negatives"))
    )


def added(counts: DataFrame) -> DataFrame:
    """Counts of the same feature and day as one row; days without mentions go."""
    sums = counts.groupBy("feature_id", "review_date").agg(*[F.sum(c).alias(c) for c in ("mentions", "negatives")])
    return sums.where(F.col("mentions") != 0)


def scores_of_days(counts: DataFrame, half_life_days=fixed.HALF_LIFE_DAYS) -> DataFrame:
    """Score per (feature, calendar month) from day counts, without the trend."""
    day, n = F.col("review_date"), F.col("mentions")
    start, end = S.month_start(day), S.month_end(day)
    total = F.sum("mentions")
    grouped = counts.groupBy("feature_id", start.alias("window_start"), end.alias("window_end")).agg(
        total.alias("mention_count"),
        (F.sum("negatives") / total).alias("negative_ratio"),
        (F.sum(n * S.recency_weight(day, end, half_life_days)) / total).alias("_weight"),
    )
    score = S.criticality(F.col("negative_ratio"), F.col("mention_count"), F.col("_weight"))
    return grouped.withColumn("score", score).drop("_weight")


def with_trend(scores: DataFrame) -> DataFrame:
    """Adds the step from each feature's previous month that has data."""
    timeline = W.partitionBy("feature_id").orderBy("window_start")
    return scores.withColumn("trend_delta", F.col("score") - F.lag("score").over(timeline))


def undated_report(scores: DataFrame) -> DataFrame:
    """One row: features with an undated bucket, and rows mostly without dates."""
    return scores.agg(
        F.count_if(F.col("window_start").isNull()).alias("undated_features"),
        F.count_if(F.col("undated_ratio") > 0.5).alias("mostly_undated_rows"),
    )
