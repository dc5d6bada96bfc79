"""Small tables written out in the program, as local relations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendlist import fixed


def literal_table(spark: SparkSession, rows, columns) -> DataFrame:
    """A table of Python literals. ``columns`` maps name -> Spark type.

    Its size is that of the program text, so a broadcast hint on it is safe.
    """
    names = list(columns)
    structs = [
        F.struct(*[F.lit(v).cast(columns[n]).alias(n) for n, v in zip(names, row)]) for row in rows
    ]
    one = spark.range(1)
    if not structs:
        return one.limit(0).select(*[F.lit(None).cast(columns[n]).alias(n) for n in names])
    return one.select(F.inline(F.array(*structs)))


def taxonomy(spark: SparkSession) -> DataFrame:
    """The taxonomy seed, every feature active, ids derived from the key."""
    seed = literal_table(
        spark,
        fixed.TAXONOMY,
        {"feature_key": "string", "display_name": "string", "description": "string"},
    )
    return seed.select(
        F.sha2("feature_key", 256).alias("id"),
        "feature_key",
        "display_name",
        "description",
        F.lit(True).alias("is_active"),
    )


def category_features(spark: SparkSession, mapping=None) -> DataFrame:
    """Category -> feature key; a null feature key marks an ignored category."""
    mapping = fixed.CATEGORY_FEATURES if mapping is None else mapping
    return literal_table(
        spark, mapping.items(), {"category_key": "string", "feature_key": T.StringType()}
    )


def labels(spark: SparkSession, vocabulary=fixed.LABELS) -> DataFrame:
    """(label, label_index) of a fixed vocabulary."""
    return literal_table(
        spark,
        [(label, i) for i, label in enumerate(sorted(set(vocabulary)))],
        {"label": "string", "label_index": "int"},
    )
