"""Annotation rows -> reviews and their annotations.

Reviews and annotations are two tables keyed by a hash of (app, domain,
sentence). The annotation table needs no grouping at all, and however often one
sentence occurs, no single row or task has to hold all of its annotations.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendlist import fixed
from mendlist.operators.common import BROADCAST_ROWS, LIST_ROWS, keep_first, nest, numbered
from mendlist.sources.readers import require_columns
from mendlist.storage import settle


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def stable_id(*parts: Column) -> Column:
    """The same id for the same parts on every run."""
    return F.sha2(_joined(*parts), 256)


def _present(value: Column) -> Column:
    """Null for the markers that mean no value."""
    return F.when(~value.isin(*fixed.NO_VALUE), value)


def safe_int(value: Column) -> Column:
    """Whole part of a number, or null for markers and anything that is none."""
    return _present(value).try_cast("double").try_cast("int")


#: Columns of ``with_keys``: the review's id as bytes, and a short hash that is the same for the same annotation.
REVIEW_KEY, SHORT = "_review_key", "_short"


def _review_id() -> Column:
    return stable_id(F.col("app"), F.col("domain"), F.col("sentence"))


def _offset(rows: DataFrame, name: str) -> Column:
    spans = "from" in rows.columns and "to" in rows.columns
    return safe_int(F.col(f"`{name}`")) if spans else F.lit(None).cast("int")


def with_keys(rows: DataFrame) -> DataFrame:
    """Annotation rows with the keys their reviews and annotations are found by, for rows that are stored and read several times."""
    what = [F.col("term"), F.col("category"), F.col("sentiment"), _offset(rows, "from"), _offset(rows, "to")]
    return rows.withColumn(REVIEW_KEY, F.unhex(_review_id())).withColumn(SHORT, F.xxhash64(REVIEW_KEY, _joined(*what)))


def _with_id(rows: DataFrame) -> DataFrame:
    require_columns(rows, fixed.CSV_COLUMNS, "annotation rows")
    return rows.withColumn("id", F.lower(F.hex(REVIEW_KEY)) if REVIEW_KEY in rows.columns else _review_id())


def review_records(rows: DataFrame, order_by, source=fixed.ANNOTATED_SOURCE) -> DataFrame:
    """One review per (app, domain, sentence), with its first rating and review id.

    ``order_by`` lists the columns that give the order of the input rows.
    """
    has_id = "review_id" in rows.columns
    review_id = F.when(F.col("review_id") != "", _present(F.col("review_id"))) if has_id else F.lit(None)
    order_by = list(order_by)
    narrow = _with_id(rows).select(
        "id",
        F.col("app").alias("app_id"),
        F.col("sentence").alias("review_text"),
        F.col("rating"),
        "domain",
        review_id.cast("string").alias("source_review_id"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)],
    )
    marks = [f"_o{i}" for i in range(len(order_by))]
    # what is the same in every row, or worked out from the row, is added to the first rows only
    return keep_first(narrow, ["id"], marks).select(
        "id",
        F.lit(source).alias("source"),
        "app_id",
        "review_text",
        safe_int(F.col("rating")).alias("rating"),
        F.lit(None).cast("date").alias("review_date"),
        "domain",
        "source_review_id",
    )


def annotation_rows(rows: DataFrame, seq: Column) -> DataFrame:
    """The annotations as rows of their own; ``seq`` orders them within a review."""
    term, category, polarity = F.col("term"), F.col("category"), F.col("sentiment")
    return (
        _with_id(rows)
        .where(term.isNotNull() | category.isNotNull() | polarity.isNotNull())
        .select(
            F.col("id").alias("review_id"),
            seq.alias("seq"),
            term.alias("aspect_term"),
            category.alias("aspect_category"),
            polarity.alias("polarity"),
            _offset(rows, "from").alias("offset_from"),
            _offset(rows, "to").alias("offset_to"),
            *([SHORT] if SHORT in rows.columns else []),
        )
    )


def with_annotation_ids(annotations: DataFrame, few=BROADCAST_ROWS) -> DataFrame:
    """``annotation_id``: a hash of the review, the annotation and its n-th occurrence there.

    It stands for the same annotation whenever a file with it is loaded. Short hashes are counted
    first: an annotation whose hash occurs once is the first of its kind, and if at most ``few`` hashes
    occur more often, only their rows get places.
    """
    what = [F.col(c) for c in ("review_id", "aspect_term", "aspect_category", "polarity", "offset_from", "offset_to")]
    nth_id = lambda alike, nth: F.sha2(F.concat_ws("\x1f", alike, nth.cast("string")), 256)

    def placed(rows: DataFrame) -> DataFrame:
        rows = numbered(rows.withColumn("_alike", F.unhex(stable_id(*what))), "_alike", ["seq"], "_nth")
        return rows.withColumn("annotation_id", nth_id(F.hex("_alike"), F.col("_nth"))).drop("_alike", "_nth")

    short = F.col(SHORT) if SHORT in annotations.columns else F.xxhash64(_joined(*what))
    again = settle(annotations.groupBy(short.alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again"))
    n = again.count()
    if n > few:
        return placed(annotations).drop(SHORT)
    first = lambda rows: rows.withColumn("annotation_id", nth_id(F.upper(stable_id(*what)), F.lit(0)))
    if not n:
        return first(annotations).drop(SHORT)
    same, marked = short == F.col("_again"), F.broadcast(again)
    # stored, so that dealing them does not go through all rows twice
    repeated = settle(annotations.join(marked, same, "left_semi"))
    return first(annotations.join(marked, same, "left_anti")).unionByName(placed(repeated)).drop(SHORT)


def bad_ratings(rows: DataFrame) -> DataFrame:
    """One row: how many ratings are not integers (they are stored as null)."""
    bad = F.col("rating").isNotNull() & safe_int(F.col("rating")).isNull()
    return rows.agg(F.count_if(bad).alias("bad_ratings"))


def nest_annotations(annotations: DataFrame, per_list=LIST_ROWS) -> DataFrame:
    """(review_id, part, annotations): ordered annotation lists per review, in parts."""
    item = F.struct(
        "aspect_term",
        "aspect_category",
        "polarity",
        F.col("offset_from").alias("from"),
        F.col("offset_to").alias("to"),
    )
    return nest(annotations, "review_id", "seq", item, "annotations", per_list)


def annotations_of(reviews: DataFrame, annotations="annotations", per_list=LIST_ROWS) -> DataFrame:
    """Annotation rows of reviews that carry them as a nested list, whole or in parts."""
    item = F.col("_item")
    part = F.col("part") if "part" in reviews.columns else F.lit(0)
    return reviews.select(
        F.col("id").alias("review_id"), part.alias("_part"), F.posexplode(annotations).alias("seq", "_item")
    ).select(
        "review_id",
        (F.col("_part") * per_list + F.col("seq")).cast("bigint").alias("seq"),
        item["aspect_term"].alias("aspect_term"),
        item["aspect_category"].alias("aspect_category"),
        item["polarity"].alias("polarity"),
        item["from"].alias("offset_from"),
        item["to"].alias("offset_to"),
    )
