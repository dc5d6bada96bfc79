"""Reads over the stored tables: ranked backlog, trend and review browser."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlist import fixed
from mendlist.operators.common import LIST_ROWS, lookup, nest
from mendlist.storage import settle


def check_page(limit: int, offset=0) -> None:
    if not 1 <= limit <= fixed.PAGE_MAX:
        raise ValueError(f"limit must be between 1 and {fixed.PAGE_MAX}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def latest_scores(scores: DataFrame) -> DataFrame:
    """The rows of each feature's latest window."""
    newest = W.partitionBy("feature_id").orderBy(F.desc("window_end"))
    ranked = scores.where(F.col("window_end").isNotNull()).withColumn("_r", F.rank().over(newest))
    return ranked.where("_r = 1").drop("_r")


def backlog(scores: DataFrame, features: DataFrame, priority=None, limit=fixed.PAGE_DEFAULT) -> DataFrame:
    """Latest score per feature, most critical first (least critical for ``low``)."""
    if priority not in (None, "high", "low"):
        raise ValueError("priority must be 'high', 'low' or None")
    check_page(limit)
    names = features.select(F.col("id").alias("feature_id"), "feature_key", "display_name")
    order = F.asc("score") if priority == "low" else F.desc("score")
    return (
        latest_scores(scores)
        .join(names, "feature_id")
        .select(
            "feature_key",
            "display_name",
            "window_start",
            "window_end",
            "score",
            "mention_count",
            "negative_ratio",
            "trend_delta",
        )
        .orderBy(order, "feature_key", "window_start")
        .limit(limit)
    )


def trend_points(scores: DataFrame, features: DataFrame, feature_key: str) -> DataFrame:
    """The windowed scores of one feature, oldest first."""
    wanted = features.where(F.col("feature_key") == feature_key).select(
        F.col("id").alias("feature_id"), "feature_key", "display_name"
    )
    return (
        scores.join(wanted, "feature_id")
        .select(
            "feature_key",
            "display_name",
            "window_start",
            "window_end",
            "score",
            "mention_count",
            "negative_ratio",
        )
        .orderBy("window_start")
    )


def feature_trend(scores: DataFrame, features: DataFrame, feature_key: str) -> DataFrame:
    """One row (feature_key, display_name, points); no row for an unknown key.

    A feature has one point per calendar month, so the list stays short.
    """
    wanted = features.where(F.col("feature_key") == feature_key).select(
        F.col("id").alias("feature_id"), "feature_key", "display_name"
    )
    point = F.struct("window_start", "window_end", "score", "mention_count", "negative_ratio")
    joined = wanted.join(scores, "feature_id", "left")
    points = F.collect_list(F.when(F.col("window_start").isNotNull(), point))
    return joined.groupBy("feature_key", "display_name").agg(F.array_sort(points).alias("points"))


def matching_reviews(
    reviews: DataFrame,
    aspects: DataFrame,
    features: DataFrame,
    feature_key=None,
    sentiment=None,
    source=None,
    require_aspects=True,
) -> DataFrame:
    """Reviews with an aspect that satisfies both aspect filters, from ``source``.

    Any filter, even ``source`` alone, also demands that the review has an
    aspect; ``require_aspects=False`` lifts that for ``source`` alone.
    """
    if source:
        reviews = reviews.where(F.col("source") == source)
    if not (feature_key or sentiment or (source and require_aspects)):
        return reviews
    hits = aspects
    if sentiment:
        hits = hits.where(F.col("sentiment") == sentiment)
    if feature_key:
        wanted = lookup(features.where(F.col("feature_key") == feature_key).select(F.col("id").alias("feature_id")))
        hits = hits.join(wanted, "feature_id", "left_semi")
    # one row per review before the shuffle, however many aspects it has
    ids = hits.select(F.col("review_id").alias("id")).distinct()
    return reviews.join(ids, "id", "left_semi")


def total_reviews(matching: DataFrame) -> DataFrame:
    return matching.agg(F.count("*").alias("total"))


def newest_page(matching: DataFrame, limit=fixed.PAGE_DEFAULT, offset=0) -> DataFrame:
    """One page, newest load first, ties by id.

    Every task sorts out its first ``offset + limit`` rows, so far pages cost more: ``page_after``
    goes on from a page at the price of the first one.
    """
    check_page(limit, offset)
    return matching.orderBy(F.desc("ingested_at"), "id").offset(offset).limit(limit)


def cursor_of(page: DataFrame):
    """(ingested_at, id) of a page's last row, from which ``page_after`` goes on; None for an empty page."""
    last = page.orderBy(F.asc_nulls_first("ingested_at"), F.desc("id")).select("ingested_at", "id").first()
    return None if last is None else tuple(last)


def page_after(matching: DataFrame, cursor=None, limit=fixed.PAGE_DEFAULT) -> DataFrame:
    """The page that follows a cursor, in the order of ``newest_page``; the first one without a cursor.

    The cursor is a filter that reaches the scan: files and row groups of later loads are skipped by
    their statistics. Rows loaded meanwhile do not shift the pages that follow.
    """
    check_page(limit)
    if cursor is not None:
        loaded, id = cursor
        at, undated = F.col("ingested_at"), F.col("ingested_at").isNull()
        if loaded is None:  # rows without a load time come last
            matching = matching.where(undated & (F.col("id") > id))
        else:
            loaded = F.lit(loaded)
            matching = matching.where(undated | (at <= loaded)).where(undated | (at < loaded) | (F.col("id") > id))
    return matching.orderBy(F.desc("ingested_at"), "id").limit(limit)


def one_of(column: str, values: list) -> Column:
    """The column equals one of a few values, as a tree of equalities.

    Unlike a long IN list, which a scan only knows by its least and greatest value, each equality is
    held against statistics, Bloom filters and page indexes.
    """
    terms = [F.col(column) == v for v in values] or [F.lit(False)]
    while len(terms) > 1:
        terms = [terms[i] | terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def aspect_rows(aspects: DataFrame, features: DataFrame) -> DataFrame:
    """Aspects with their feature key, as shown beside a review."""
    keys = lookup(features.select(F.col("id").alias("feature_id"), "feature_key"))
    return aspects.join(keys, "feature_id").select(
        "id", "review_id", "feature_key", "sentiment", "confidence", "source"
    )


def reviews_with_aspects(reviews: DataFrame, aspects: DataFrame, features: DataFrame) -> DataFrame:
    """One row per (review, aspect), and one for a review without aspects.

    An aspect whose feature is not in ``features`` is not shown; its review is.
    The flat form for whole tables: nothing is collected per review. Written
    as an inner join plus the reviews without shown aspects, because AQE can split a
    review with very many aspects in an inner join but not in an outer one. The
    narrow aspect rows are stored once for both.
    """
    shown = settle(
        aspect_rows(aspects, features).select(
            F.col("review_id").alias("id"),
            "feature_key",
            "sentiment",
            "confidence",
            F.col("source").alias("aspect_source"),
        )
    )
    bare = reviews.join(shown.select("id").distinct(), "id", "left_anti")
    return reviews.join(shown, "id").unionByName(bare, allowMissingColumns=True)


def page_with_aspects(page: DataFrame, aspects: DataFrame, features: DataFrame, per_list=LIST_ROWS) -> DataFrame:
    """A page of reviews, each with the list of all its aspects.

    ``page`` comes from ``newest_page`` or ``page_after`` (at most 200 rows). It is stored first;
    its ids become a filter of the aspect table, which reaches the scan and skips what is clustered
    elsewhere. A list comes in parts of ``per_list`` aspects, numbered by ``part``.
    """
    page = settle(page)
    ids = [r["id"] for r in page.select("id").limit(fixed.PAGE_MAX + 1).collect()]
    if len(ids) > fixed.PAGE_MAX:
        raise ValueError(f"a page holds {fixed.PAGE_MAX} reviews at most")
    shown = settle(aspect_rows(aspects.where(one_of("review_id", ids)), features))
    item = F.struct("feature_key", "sentiment", "confidence", "source")
    lists = nest(shown, "review_id", "id", item, "aspects", per_list).withColumnRenamed("review_id", "id")
    empty = F.array().cast("array<struct<feature_key:string,sentiment:string,confidence:double,source:string>>")
    return page.join(lists, "id", "left").select(
        *page.columns,
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("aspects", empty).alias("aspects"),
    )
