"""Cleaning and deduplication of reviews."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlist.functions.text import clean_text, fingerprint, has_near_text, is_stable, near_text
from mendlist.operators.common import keep_first


def clean_reviews(reviews: DataFrame, text="review_text") -> DataFrame:
    """Clean the text and drop reviews that have none left.

    Only texts that NFKC can change pass through Python.
    """
    return _cleaned(reviews, text).where(F.length(text) > 0)


def _cleaned(reviews: DataFrame, text: str) -> DataFrame:
    stable = is_stable(F.col(text).cast("string"))
    plain = reviews.where(stable).withColumn(text, clean_text(F.col(text), stable=True))
    return plain.unionByName(reviews.where(~stable).withColumn(text, clean_text(F.col(text))))


def cleaning_report(reviews: DataFrame, text="review_text") -> DataFrame:
    """One row: reviews before, emptied by cleaning, and left."""
    return _cleaned(reviews.select(text), text).select(F.length(text).alias("n")).agg(
        F.count("*").alias("rows_before"),
        F.count_if(F.col("n") == 0).alias("dropped_empty"),
        F.count_if(F.col("n") > 0).alias("rows_after"),
    )


def dedup_reviews(
    reviews: DataFrame, order_by, text="review_text", app="app_id", near=True
) -> DataFrame:
    """Keep the first review of each text within an app.

    With ``near`` texts are equal when their letters and digits are. The near
    key is a function of the text, so one pass gives the same rows as an exact
    pass followed by a near pass. Texts enter the shuffle key as 32-byte hashes.
    """
    key = fingerprint(near_text(F.col(text)) if near else F.col(text))
    marked = reviews.withColumn("_key", key)
    return keep_first(marked, [app, "_key"], order_by).drop("_key")


def dedup_report(reviews: DataFrame, text="review_text", app="app_id") -> DataFrame:
    """One row: reviews before, dropped as exact and as near copies, and left.

    Counts go up level by level (text, near key, total), so each shuffle
    carries hashes already counted within the map tasks.
    """
    texts = (
        reviews.select(
            app,
            fingerprint(near_text(F.col(text))).alias("near"),
            fingerprint(F.col(text)).alias("exact"),
        )
        .groupBy(app, "near", "exact")
        .agg(F.count("*").alias("n"))
    )
    groups = texts.groupBy(app, "near").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    totals = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"),
        F.count("*").alias("rows_after"),
    )
    return totals.select(
        "rows_before",
        (F.col("rows_before") - F.col("texts")).alias("exact_dropped"),
        (F.col("texts") - F.col("rows_after")).alias("near_dropped"),
        "rows_after",
    )


def blank_near_keys(reviews: DataFrame, text="review_text", app="app_id") -> DataFrame:
    """Per app, how many reviews share the empty near key (other scripts, symbols)."""
    return (
        reviews.where(~has_near_text(F.col(text)))
        .groupBy(app)
        .agg(F.count("*").alias("blank_near_keys"))
    )


def in_language(reviews: DataFrame, language="en", column="lang") -> DataFrame:
    """Reviews in one language, where the source gives it."""
    return reviews.where(F.col(column) == language)
