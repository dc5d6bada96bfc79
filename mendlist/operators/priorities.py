"""Priorities, KPIs and insight sentences over aspect rows of one analysis.

Input rows are (original_review, feature, sentiment).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlist import fixed
from mendlist.functions.scores import priority_tier, safe_ratio
from mendlist.functions.text import fingerprint


def feature_counts(aspects: DataFrame) -> DataFrame:
    return aspects.groupBy("feature").agg(
        F.count("*").alias("mentions"),
        F.count_if(F.col("sentiment") == "positive").alias("positive"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
    )


def feature_priorities(aspects: DataFrame) -> DataFrame:
    """Mentions and tier per feature, most negative mentions first."""
    tier = priority_tier(F.col("negative"), F.col("mentions"))
    return feature_counts(aspects).withColumn("priority", tier).orderBy(
        F.desc("negative"), F.desc("mentions"), "feature"
    )


def kpi_summary(aspects: DataFrame) -> DataFrame:
    """One row of totals, shares and the top complaint and praise; zeros for no rows.

    Reviews are told apart by a hash of their text, so texts are not shuffled.
    Praise ties go to the feature ranked first by priority.
    """
    n = F.coalesce(F.sum("mentions"), F.lit(0))
    counts = feature_counts(aspects)
    worst = F.min(F.struct(-F.col("negative"), -F.col("mentions"), "feature", "negative"))
    best = F.min(
        F.struct(-F.col("positive"), -F.col("negative"), -F.col("mentions"), "feature", "positive")
    )
    reviews = aspects.select(fingerprint(F.col("original_review")).alias("r")).agg(
        F.countDistinct("r").alias("n")
    )
    totals = counts.agg(
        n.alias("total_aspects"),
        F.coalesce(F.sum("positive"), F.lit(0)).alias("positive"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative"),
        worst.alias("worst"),
        best.alias("best"),
    ).withColumn("reviews", reviews.scalar())
    complained, praised = F.col("worst.negative") > 0, F.col("best.positive") > 0
    return totals.select(
        "total_aspects",
        (safe_ratio(F.col("positive"), F.col("total_aspects")) * 100).alias("positive_pct"),
        (safe_ratio(F.col("negative"), F.col("total_aspects")) * 100).alias("negative_pct"),
        safe_ratio(F.col("total_aspects"), F.col("reviews")).alias("average_aspects"),
        F.when(complained, F.col("worst.feature")).alias("top_complaint"),
        F.when(complained, F.col("worst.negative")).alias("top_complaint_mentions"),
        F.when(praised, F.col("best.feature")).alias("top_praise"),
        F.when(praised, F.col("best.positive")).alias("top_praise_mentions"),
    )


def insight_text(kpis: DataFrame) -> DataFrame:
    """The KPI row with its summary sentences."""
    complaint, praise = F.col("top_complaint"), F.col("top_praise")
    first = F.when(
        complaint.isNotNull(), F.format_string(fixed.COMPLAINT_TEXT, complaint, "top_complaint_mentions")
    ).otherwise(fixed.NO_COMPLAINT_TEXT)
    second = F.when(praise.isNotNull(), F.format_string(fixed.PRAISE_TEXT, praise, "top_praise_mentions"))
    advice = F.when(complaint.isNotNull(), F.format_string(fixed.FIX_TEXT, complaint)).otherwise(fixed.NO_FIX_TEXT)
    text = F.concat(
        F.lit(fixed.INSIGHTS_HEADING),
        F.concat_ws("\n", first, second),
        F.lit(fixed.RECOMMENDATION_HEADING),
        advice,
    )
    shown = F.when(F.col("total_aspects") == 0, fixed.NO_ASPECTS_TEXT).otherwise(text)
    return kpis.withColumn("summary_text", shown)


def sentiment_distribution(aspects: DataFrame) -> DataFrame:
    return aspects.groupBy("sentiment").agg(F.count("*").alias("mentions"))


def feature_mentions(aspects: DataFrame) -> DataFrame:
    """Features by mentions, fewest first."""
    return feature_counts(aspects).select("feature", "mentions").orderBy("mentions", "feature")


def top_negative_features(aspects: DataFrame, limit=fixed.TOP_FEATURES) -> DataFrame:
    """Features with negative mentions, most first."""
    return (
        feature_counts(aspects)
        .where("negative > 0")
        .select("feature", "negative", "mentions")
        .orderBy(F.desc("negative"), F.desc("mentions"), "feature")
        .limit(limit)
    )
