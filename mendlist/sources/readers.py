"""Scans: annotated CSV, ad-hoc reviews, stored tables, splits and record files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendlist import fixed, schemas
from mendlist.functions.text import has_text, stripped
from mendlist.sources import csv_records


class InputError(ValueError):
    """The input lacks something the operator cannot do without."""


def require_columns(df: DataFrame, names, what="input") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise InputError(f"{what} is missing columns {missing}; found {df.columns}")
    return df


def require_rows(df: DataFrame, what="input") -> DataFrame:
    """Checks for one row (a limit-1 job)."""
    if df.isEmpty():
        raise InputError(f"{what} is empty")
    return df


def read_csv(spark: SparkSession, path: str, multi_line=True, derive=lambda rows: rows) -> DataFrame:
    """A header CSV as strings, blank cells as ``""``. Every file is read by many tasks.

    ``multi_line`` accepts quoted line breaks and reads the files twice for it; turn it off
    (``--one-line`` on the command line) for files without them.
    Adds ``_file`` and ``_row``, which together give the order of the rows: by path,
    by block of the file, and by row within the block. With ``multi_line`` ``_row`` does so alone, and the rows are
    stored, with the columns that ``derive`` works out from each (by ``withColumns``).
    """
    if multi_line:
        filled = lambda rows: rows.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in rows.columns if not n.startswith("_csv_")})
        raw = csv_records.parsed(spark, path, lambda rows: derive(filled(rows)))
        path, start, line = csv_records.PLACE
        names = [F.col(f"`{n}`") for n in raw.columns if n not in csv_records.PLACE]
        return raw.select(*names, F.struct(F.col(path).alias("path"), F.col(start).alias("start")).alias("_file"), F.col(line).alias("_row"))
    # only the header is looked at: every column is a string
    raw = spark.read.csv(path, header=True, escape='"', inferSchema=False)
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    cells = [F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in raw.columns]
    return derive(raw.select(*cells, place.alias("_file"), F.monotonically_increasing_id().alias("_row")))


def read_annotated_csv(spark: SparkSession, path: str, multi_line=True, derive=lambda rows: rows) -> DataFrame:
    """The annotated-review CSV, checked for its columns and for having rows; ``derive`` as in ``read_csv``."""
    checked = lambda rows: derive(require_columns(rows, fixed.CSV_COLUMNS, "annotated CSV"))
    return require_rows(read_csv(spark, path, multi_line, checked), "annotated CSV")


def read_reviews_csv(spark: SparkSession, path: str, multi_line=True) -> DataFrame:
    """An uploaded CSV with a ``review`` column; its other columns are ignored."""
    df = require_columns(read_csv(spark, path, multi_line), ["review"], "uploaded CSV")
    return require_rows(df.select("review", "_file", "_row"), "uploaded CSV")


def lines_as_reviews(texts: DataFrame, text="text") -> DataFrame:
    """One ``review`` row per non-blank line of ``text``, stripped."""
    rest = [c for c in texts.columns if c != text]
    lines = texts.select(*rest, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "review"))
    return lines.where(has_text(F.col("review"))).withColumn("review", stripped(F.col("review")))


def raw_reviews(stored: DataFrame) -> DataFrame:
    """The review table without its load time; an empty table is an error."""
    return require_rows(stored.drop("ingested_at"), "raw_reviews")


def read_split(spark: SparkSession, path: str, split: str, limit=None) -> DataFrame:
    """One split of a split dataset (reads only that partition), or its first ``limit`` rows by its first columns."""
    df = spark.read.parquet(path).where(F.col("split") == split)
    return df if limit is None else df.orderBy(*[c for c in df.columns if c != "split"][:2]).limit(limit)


def first_reviews(reviews: DataFrame, limit: int) -> DataFrame:
    """(id, review_text) of the first ``limit`` reviews by id."""
    return reviews.select("id", "review_text").orderBy("id").limit(limit)


def read_records(spark: SparkSession, path: str, schema: T.StructType, split=None, with_split=False) -> DataFrame:
    """A JSONL record dataset; blank lines are skipped.

    ``split`` reads one split only, ``with_split`` all of them and their name.
    """
    if split is None and not with_split:
        return spark.read.schema(schema).json(path)
    named = T.StructType([*schema.fields, T.StructField("split", T.StringType())])
    df = spark.read.schema(named).json(path)
    return df if split is None else df.where(F.col("split") == split)


def active_features(features: DataFrame) -> DataFrame:
    return features.where("is_active").select("feature_key", "display_name")


def review_metadata(metadata_json: Column) -> Column:
    """Stored metadata JSON as a struct; anything malformed gives nulls and no annotations."""
    schema = T.StructType(
        [
            T.StructField(fixed.META_DOMAIN, T.StringType()),
            T.StructField(fixed.META_REVIEW_ID, T.StringType()),
            T.StructField(fixed.META_ANNOTATIONS, T.ArrayType(schemas.ANNOTATION)),
        ]
    )
    parsed = F.from_json(metadata_json, schema, {"mode": "PERMISSIVE"})
    review_id = parsed[fixed.META_REVIEW_ID]
    return F.struct(
        parsed[fixed.META_DOMAIN].alias("domain"),
        F.when(review_id != "", review_id).alias("source_review_id"),
        F.filter(
            F.coalesce(parsed[fixed.META_ANNOTATIONS], F.array().cast(T.ArrayType(schemas.ANNOTATION))),
            lambda a: a.isNotNull(),
        ).alias("annotations"),
    )
