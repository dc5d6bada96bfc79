"""Training records, targets and class weights."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlist import fixed
from mendlist.functions.scores import safe_ratio
from mendlist.functions.text import has_text, stripped, title_words
from mendlist.operators.common import lookup, numbered
from mendlist.sources.literals import labels as label_table
from mendlist.sources.literals import literal_table
from mendlist.sources.readers import require_rows

MAX_CLASSES = 10_000

_ASPECTS = "array<struct<category:string,sentiment:string>>"


def _no_value(value: Column) -> Column:
    return value.isNull() | value.isin("", *fixed.NO_VALUE)


def parse_aspects(annotations: Column, vocabulary=fixed.LABELS) -> Column:
    """Nested annotations -> distinct (category, sentiment) pairs, first seen first.

    Categories outside the vocabulary go; a missing polarity stays as null.
    """
    known = F.filter(annotations, lambda a: a["aspect_category"].isin(*vocabulary))
    pairs = F.transform(
        known,
        lambda a: F.struct(
            a["aspect_category"].alias("category"),
            F.when(~_no_value(a["polarity"]), a["polarity"]).alias("sentiment"),
        ),
    )
    return F.coalesce(F.array_distinct(pairs), F.array().cast(_ASPECTS))


def aspect_pairs(annotations: DataFrame, vocabulary=fixed.LABELS) -> DataFrame:
    """Annotation rows -> (review_id, category, sentiment, first_seq), each pair once.

    Copies of a pair are merged within the map tasks already, so a review with
    very many annotations shrinks before the shuffle.
    """
    polarity = F.col("polarity")
    return (
        annotations.where(F.col("aspect_category").isin(*vocabulary))
        .groupBy(
            "review_id",
            F.col("aspect_category").alias("category"),
            F.when(~_no_value(polarity), polarity).alias("sentiment"),
        )
        .agg(F.min("seq").alias("first_seq"))
    )


def master_records(reviews: DataFrame, pairs: DataFrame, keep=("split",)) -> DataFrame:
    """(review_id, text, aspects) for every review that has text."""
    keep = [c for c in keep if c in reviews.columns]
    lists = pairs.groupBy("review_id").agg(
        F.array_sort(F.collect_list(F.struct("first_seq", "category", "sentiment"))).alias("_found")
    )
    text = stripped(F.col("review_text"))
    texts = reviews.where(has_text(F.col("review_text"))).select(
        F.col("id").alias("review_id"), text.alias("text"), *keep
    )
    aspects = F.transform("_found", lambda x: F.struct(x["category"].alias("category"), x["sentiment"].alias("sentiment")))
    return (
        texts.join(lists, "review_id", "left")
        .select("review_id", "text", F.coalesce(aspects, F.array().cast(_ASPECTS)).alias("aspects"), *keep)
    )


def category_records(master: DataFrame) -> DataFrame:
    """(review_id, text, labels): sorted distinct categories, unlabelled reviews kept."""
    names = F.array_sort(F.array_distinct(F.transform("aspects", lambda a: a["category"])))
    return master.withColumn("labels", names).drop("aspects")


def sentiment_records(master: DataFrame) -> DataFrame:
    """One (review_id, aspect, text, label) row per aspect with a known sentiment."""
    rest = [c for c in master.columns if c not in ("aspects", "review_id", "text")]
    known = F.filter("aspects", lambda a: a["sentiment"].isNotNull())
    return master.select(
        "review_id", "text", *rest, F.inline(known).alias("aspect", "label")
    ).select("review_id", "aspect", "text", "label", *rest)


def _label_entries(labels, vocabulary) -> Column:
    """The known labels of a record, each once, and ``""`` for the record itself."""
    labels = F.coalesce(labels, F.array().cast("array<string>"))
    known = F.filter(labels, lambda x: x.isin(*vocabulary))
    return F.array_distinct(F.concat(F.array(F.lit("")), known))


def label_histogram(records: DataFrame, vocabulary=fixed.LABELS) -> DataFrame:
    """Records per (split, label), 0 for labels a split lacks.

    One scan, one shuffle of counts; a split's counts then form a map of at
    most the vocabulary, from which every label is read.
    """
    counts = (
        records.select("split", F.explode(_label_entries(F.col("labels"), vocabulary)).alias("label"))
        .groupBy("split", "label")
        .agg(F.count("*").alias("n"))
    )
    per_split = counts.groupBy("split").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("_n")
    )
    rows = per_split.select("split", "_n", F.explode(F.array(*[F.lit(v) for v in vocabulary])).alias("label"))
    return rows.select("split", "label", F.coalesce(F.try_element_at("_n", "label"), F.lit(0)).alias("n"))


def sentiment_histogram(records: DataFrame) -> DataFrame:
    return records.groupBy("split", "label").agg(F.count("*").alias("n"))


def label_index(labels: DataFrame, label="label") -> DataFrame:
    """Alphabetical 0-based index of the distinct labels, however many there are."""
    distinct = labels.select(F.col(label).alias("label")).where(F.col(label).isNotNull()).distinct()
    return numbered(distinct.withColumn("_all", F.lit(0)), "_all", ["label"], "label_index").drop("_all")


def vocabulary_of(records: DataFrame, given=None):
    """The given label vocabulary, else the sorted labels found in the records.

    The outputs of a classifier, so its labels must fit the driver: more than
    ``MAX_CLASSES`` distinct ones are an error and need a vocabulary from the caller.
    """
    if given is not None:
        return tuple(sorted(set(given)))
    found = records.select(F.explode("labels").alias("label")).where("label is not null").distinct()
    found = found.limit(MAX_CLASSES + 1).collect()  # one more than allowed leads to the error
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels; give a vocabulary")
    return tuple(sorted(r["label"] for r in found))


def multi_hot(labels: Column, vocabulary=fixed.LABELS) -> Column:
    """1.0 where the label list holds the vocabulary entry, else 0.0, in index order."""
    present = [F.coalesce(F.array_contains(labels, v), F.lit(False)) for v in sorted(set(vocabulary))]
    return F.array(*[p.cast("double") for p in present])


def category_examples(labels: DataFrame, progress: DataFrame, vocabulary=fixed.LABELS) -> DataFrame:
    """(review_id, review_text, labels) with a multi-hot target per labelled review.

    ``labels`` holds (review_id, feature_key), ``progress`` (review_id,
    review_text, status). Unknown features are ignored; labelled reviews without
    any known feature get all zeros. Copies of a progress row keep the
    alphabetically first text.
    """
    reviews = (
        progress.where(F.col("status") == fixed.STATUS_LABELED)
        .groupBy("review_id")
        .agg(F.min("review_text").alias("review_text"))
    )
    found = (
        labels.where(F.col("feature_key").isin(*vocabulary))
        .groupBy("review_id")
        .agg(F.collect_set("feature_key").alias("_features"))
    )
    return reviews.join(found, "review_id", "left").select(
        "review_id", "review_text", multi_hot(F.col("_features"), vocabulary).alias("labels")
    )


def checked_category_examples(labels: DataFrame, progress: DataFrame, vocabulary=fixed.LABELS) -> DataFrame:
    """``category_examples``, an error without progress rows or without a labelled review."""
    require_rows(progress, "labelling progress")
    return require_rows(category_examples(labels, progress, vocabulary), "labelled reviews")


def category_pos_weights(records: DataFrame, vocabulary=fixed.LABELS, labels="labels") -> DataFrame:
    """(label, positives, total, weight): negatives over positives, capped.

    One scan: an extra entry ``""`` added to every label list counts the
    records. Counts are combined within the map tasks, so the shuffle carries
    at most one row per label and task.
    """
    entries = _label_entries(F.col(labels), vocabulary)
    counts = records.select(F.explode(entries).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    vocab = F.broadcast(label_table(records.sparkSession, ("", *vocabulary)).select("label"))
    n = F.coalesce("n", F.lit(0))
    # one row per vocabulary entry from here on
    joined = counts.join(vocab, "label", "right").select(
        "label",
        n.alias("positives"),
        F.max(F.when(F.col("label") == "", n)).over(W.partitionBy()).alias("total"),
    )
    positives = F.col("positives")
    ratio = (F.col("total") - positives).cast("double") / (positives.cast("double") + fixed.WEIGHT_EPSILON)
    return joined.where("label <> ''").select(
        "label", "positives", "total", F.least(ratio, F.lit(fixed.POS_WEIGHT_CAP)).alias("weight")
    )


def sentiment_class_weights(records: DataFrame, label="label") -> DataFrame:
    """(label, label_index, n, weight) for the three classes, absent ones included."""
    classes = literal_table(
        records.sparkSession,
        [(s, i) for i, s in enumerate(fixed.SENTIMENTS)],
        {"label": "string", "label_index": "int"},
    )
    counts = (
        records.where(F.col(label).isin(*fixed.SENTIMENTS))
        .groupBy(F.col(label).alias("label"))
        .agg(F.count("*").alias("n"))
    )
    n = F.coalesce("n", F.lit(0))
    total = F.sum(n).over(W.partitionBy())  # three rows
    weight = total.cast("double") / (len(fixed.SENTIMENTS) * (n.cast("double") + fixed.WEIGHT_EPSILON))
    return counts.join(F.broadcast(classes), "label", "right").select(
        "label",
        "label_index",
        n.alias("n"),
        F.least(weight, F.lit(fixed.CLASS_WEIGHT_CAP)).alias("weight"),
    )


def sentiment_index(label: Column) -> Column:
    """Class index of a sentiment, null for anything else."""
    position = F.array_position(F.array(*[F.lit(s) for s in fixed.SENTIMENTS]), label)
    return F.when(position > 0, (position - 1).cast("int"))


def sentiment_pairs(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Sentence pairs (review text, feature name) with a class index.

    Rows with an unknown feature or sentiment are dropped; see
    ``sentiment_pair_report`` for how many.
    """
    names = lookup(features.select("feature_key", "display_name"))
    return (
        labels.where(F.col("sentiment").isin(*fixed.SENTIMENTS))
        .join(names, "feature_key")
        .select(
            "review_id",
            "feature_key",
            F.col("review_text").alias("text_a"),
            F.col("display_name").alias("text_b"),
            sentiment_index(F.col("sentiment")).alias("label"),
        )
    )


def checked_sentiment_pairs(labels: DataFrame, features: DataFrame) -> DataFrame:
    """``sentiment_pairs``, an error when no row is left."""
    return require_rows(sentiment_pairs(labels, features), "valid (review, feature, sentiment) rows")


def sentiment_pair_report(labels: DataFrame, features: DataFrame) -> DataFrame:
    """One row: label rows, with unknown feature, with invalid sentiment, and kept."""
    known = features.select("feature_key", F.lit(True).alias("_known"))
    per_key = labels.groupBy("feature_key").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("sentiment").isin(*fixed.SENTIMENTS)).alias("valid"),
    )
    joined = per_key.join(known, "feature_key", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    total = lambda c, on: F.coalesce(F.sum(F.when(on, c)), F.lit(0))
    k = F.col("_known")
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        total(F.col("n"), ~k).alias("unknown_feature"),
        total(F.col("n") - F.col("valid"), k).alias("invalid_sentiment"),
        total(F.col("valid"), k).alias("kept"),
    )


def trainer_pairs(records: DataFrame) -> DataFrame:
    """Sentiment records as pairs; the feature name is made from its key."""
    return records.where(F.col("label").isin(*fixed.SENTIMENTS)).select(
        "review_id",
        F.col("text").alias("text_a"),
        title_words(F.col("aspect")).alias("text_b"),
        sentiment_index(F.col("label")).alias("label"),
    )


def unknown_features(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Feature keys in use that the taxonomy lacks."""
    return labels.select("feature_key").distinct().join(
        features.select("feature_key"), "feature_key", "left_anti"
    )
