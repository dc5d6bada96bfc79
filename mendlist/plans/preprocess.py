"""Preprocess: clean -> dedup -> split -> training records."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendlist import fixed, schemas
from mendlist.operators import training
from mendlist.operators.cleaning import clean_reviews, dedup_reviews
from mendlist.operators.split import assign_splits, group_key
from mendlist.plans.ingest import Tables
from mendlist.sources.readers import raw_reviews, read_records
from mendlist.sources.writers import write_records, write_splits
from mendlist.storage import settle


def prepared_reviews(
    reviews: DataFrame,
    test=fixed.TEST_SHARE,
    val=fixed.VAL_SHARE,
    seed=fixed.SPLIT_SEED,
    store_at=None,
) -> DataFrame:
    """Cleaned, deduplicated reviews with their split.

    Of equal texts in an app the first by (domain, text, id) stays, which is the
    order in which an annotated CSV is loaded. The clean rows are written once
    (at ``store_at``, else in the shared folder), as the split reads them twice.
    """
    kept = dedup_reviews(clean_reviews(reviews), ["domain", "review_text", "id"])
    kept = settle(kept.withColumn("group_key", group_key()), store_at)
    return assign_splits(kept, test=test, val=val, seed=seed).drop("group_key")


def training_tables(prepared: DataFrame, annotations: DataFrame) -> dict[str, DataFrame]:
    """The three record sets, each with its split."""
    master = training.master_records(prepared, training.aspect_pairs(annotations))
    return {
        "master": master,
        "aspect_category": training.category_records(master),
        "aspect_sentiment": training.sentiment_records(master),
    }


def preprocess(spark: SparkSession, tables: Tables, **split_options) -> dict[str, int]:
    """Write splits and training records; returns rows per split."""
    raw = raw_reviews(tables.reviews(spark))
    write_splits(prepared_reviews(raw, store_at=tables.clean, **split_options), tables.splits)
    prepared = spark.read.parquet(tables.splits)
    annotations = tables.annotations(spark)
    records = training_tables(prepared, annotations)
    write_records(records["master"], tables.records("master"))
    # the other two sets follow from the stored master records, row by row
    master = read_records(spark, tables.records("master"), schemas.MASTER_RECORD, with_split=True)
    write_records(training.category_records(master), tables.records("aspect_category"))
    write_records(training.sentiment_records(master), tables.records("aspect_sentiment"))
    counts = prepared.groupBy("split").agg(F.count("*").alias("n")).collect()  # three rows
    return {r["split"]: r["n"] for r in counts}
