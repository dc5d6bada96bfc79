"""The feature taxonomy and the mapping of source categories onto it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendlist.functions.text import stripped
from mendlist.operators.common import lookup
from mendlist.sources.literals import category_features


def list_features(features: DataFrame, active_only=True) -> DataFrame:
    """Features by display name."""
    if active_only:
        features = features.where("is_active")
    return features.select(
        "id", "feature_key", "display_name", "description", "is_active"
    ).orderBy("display_name", "feature_key")


def missing_features(seed: DataFrame, stored: DataFrame) -> DataFrame:
    """Seed features whose key is not stored yet."""
    return seed.join(stored.select("feature_key"), "feature_key", "left_anti")


def with_display_name(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Adds ``display_name``, the key itself where the taxonomy lacks it."""
    names = lookup(features.select("feature_key", "display_name"))
    joined = rows.join(names, "feature_key", "left")
    return joined.withColumn("display_name", F.coalesce("display_name", "feature_key"))


def map_category(rows: DataFrame, category: Column, mapping=None) -> DataFrame:
    """Adds ``feature_key`` and ``outcome`` (mapped / ignored / unmapped) to rows.

    Categories are compared trimmed and in lower case. The mapping is program
    text, so it is broadcast.
    """
    table = category_features(rows.sparkSession, mapping).withColumn("_matched", F.lit(True))
    keyed = rows.withColumn("category_key", F.lower(stripped(category)))
    joined = keyed.join(F.broadcast(table), "category_key", "left")
    outcome = (
        F.when(F.col("feature_key").isNotNull(), "mapped")
        .when(F.col("_matched"), "ignored")
        .otherwise("unmapped")
    )
    return joined.withColumn("outcome", outcome).drop("_matched", "category_key")


def mapping_coverage(rows: DataFrame, category="aspect_category", mapping=None) -> DataFrame:
    """(outcome, category): every distinct raw category and what becomes of it."""
    seen = rows.select(category).where(F.coalesce(F.col(category), F.lit("")) != "").distinct()
    return map_category(seen, F.col(category), mapping).select("outcome", F.col(category).alias("category"))


def coverage_report(rows: DataFrame, category="aspect_category", mapping=None) -> DataFrame:
    """Distinct raw categories per outcome."""
    return mapping_coverage(rows, category, mapping).groupBy("outcome").agg(F.count("*").alias("categories"))
