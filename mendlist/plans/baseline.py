"""Distributed text classifiers: a baseline in place of transformer fine-tuning.

Hashed TF-IDF features with logistic regression, one model of all labels (``multilabel``) and
one 3-class model, weighted like the loss functions they stand in for. Training
runs over the stored record sets; scoring adds columns to a DataFrame.

Splitting and hashing a text is most of the work, so it is done once: training stores the counts
of each record, and routing takes both models' scores from the same features.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendlist import fixed, schemas
from mendlist.functions.gates import sigmoid, softmax
from mendlist.operators import evaluation as E
from mendlist.operators import training as T
from mendlist.operators.aspects import found_categories, rated_aspects
from mendlist.plans import multilabel
from mendlist.plans.ingest import Tables
from mendlist.sources.readers import read_records, require_rows
from mendlist.storage import release, settle

HASH_SIZE = 1 << 14
ROUNDS = 10


@dataclass(frozen=True)
class Models:
    texts: PipelineModel
    categories: multilabel.LinearLabels
    sentiment: LogisticRegressionModel
    threshold: float = fixed.DECISION_THRESHOLD

    @property
    def labels(self):
        return self.categories.labels


def _counting(hash_size: int):
    words = RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    return words, HashingTF(inputCol="_words", outputCol="_tf", numFeatures=hash_size)


def counted(df: DataFrame, hash_size=HASH_SIZE) -> DataFrame:
    """Stored once, with the hashed word counts ``_tf`` in place of ``text``."""
    words, counts = _counting(hash_size)
    return settle(counts.transform(words.transform(df)).drop("text", "_words"))


def fit_texts(texts: DataFrame, hash_size=HASH_SIZE) -> PipelineModel:
    """``text`` -> ``features``; ``texts`` may be ``counted``."""
    words, counts = _counting(hash_size)
    df = texts if "_tf" in texts.columns else counts.transform(words.transform(texts))
    return PipelineModel([words, counts, IDF(inputCol="_tf", outputCol="features").fit(df)])


def featured(texts: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``features``, from ``text`` or from the counts of a ``counted`` table."""
    last = texts.stages[-1] if "_tf" in df.columns else texts
    return last.transform(df).drop("_words", "_tf")


def _by_value(weights: dict, value: Column) -> Column:
    chosen = F.lit(1.0)
    for key, weight in weights.items():
        chosen = F.when(value == key, float(weight)).otherwise(chosen)
    return chosen


def weights_by(df: DataFrame, key: str) -> dict:
    """A weight table (one row per label) as a dict."""
    return {r[key]: r["weight"] for r in df.select(key, "weight").collect()}


def fit_categories(featured: DataFrame, pos_weights: dict[str, float], rounds=ROUNDS, val=None) -> multilabel.LinearLabels:
    """One model for all labels; of its rounds the best on ``val``. Tables have ``features`` and a ``labels`` list."""
    return multilabel.fit(featured, pos_weights, val, rounds)[0]


def fit_sentiment(featured: DataFrame, class_weights: dict[int, float], rounds=ROUNDS) -> LogisticRegressionModel:
    """3-class model over ``features`` and a class index ``label``."""
    y = F.col("label").cast("double")
    # read twice
    data = settle(featured.select("features", y.alias("y"), _by_value(class_weights, F.col("label")).alias("w")))
    model = LogisticRegression(
        labelCol="y", weightCol="w", maxIter=rounds, regParam=0.01, family="multinomial"
    ).fit(data)
    release(data)
    return model


def _raw(model, df: DataFrame, name: str) -> DataFrame:
    model.setRawPredictionCol(name).setProbabilityCol("").setPredictionCol("")
    return model.transform(df)


def _category_logits(models: Models, df: DataFrame) -> DataFrame:
    return multilabel.logits(models.categories, df)


def _sentiment_logits(models: Models, df: DataFrame, name="logits") -> DataFrame:
    return _raw(models.sentiment, df, "_raw").withColumn(name, vector_to_array("_raw")).drop("_raw")


def category_logits(models: Models, texts: DataFrame) -> DataFrame:
    """Adds ``logits``, one per label in alphabetical order, from ``text`` or its counts."""
    return _category_logits(models, featured(models.texts, texts)).drop("features")


def sentiment_logits(models: Models, texts: DataFrame) -> DataFrame:
    """Adds ``logits`` in class-index order, from ``text`` or its counts."""
    return _sentiment_logits(models, featured(models.texts, texts)).drop("features")


def pair_text(text: Column, feature: Column) -> Column:
    """Review and feature name as one text."""
    return F.concat_ws(" ", feature, text)


def pair_logits(models: Models, pairs: DataFrame, feature: str, of_text: str) -> DataFrame:
    """Adds the sentiment ``logits`` of ``pair_text``, from the feature name and the text's own logits.

    Words do not reach over the space between the two, so their counts add up, and so do the scores of a
    linear model; its intercept is in both parts.
    """
    names = sentiment_logits(models, pairs.withColumn("text", F.col(feature))).drop("text")
    twice = F.array(*[F.lit(float(x)) for x in models.sentiment.interceptVector])
    both = F.zip_with(of_text, "logits", lambda a, b: a + b)
    return names.withColumn("logits", F.zip_with(both, twice, lambda x, i: x - i)).drop(of_text)


def train(spark: SparkSession, tables: Tables, vocabulary=fixed.LABELS, limit=None, rounds=ROUNDS):
    """Fit on the stored train records and measure on the val records.

    Returns the models, whose threshold is the best one on val, and a DataFrame
    of (task, metric, value). ``limit`` caps the records, as for a trial run;
    weights are counted after the cut.
    """

    def records(name, schema, split):
        df = read_records(spark, tables.records(name), schema, split=split)
        return df if limit is None or split != "train" else df.orderBy("review_id").limit(limit)

    def stored(split):
        return records("aspect_category", schemas.CATEGORY_RECORD, split)

    labelled = counted(require_rows(stored("train"), "training records").select("text", "labels"))
    texts = fit_texts(labelled)
    names = T.vocabulary_of(labelled, vocabulary)
    weights = weights_by(T.category_pos_weights(labelled, names), "label")
    held = counted(stored("val").select("text", "labels"))
    categories = fit_categories(featured(texts, labelled), weights, rounds, featured(texts, held))
    release(labelled)

    def pairs(split):
        prepared = T.trainer_pairs(records("aspect_sentiment", schemas.SENTIMENT_RECORD, split))
        return prepared.select(pair_text(F.col("text_a"), F.col("text_b")).alias("text"), "label")

    moods = require_rows(pairs("train"), "sentiment training records")
    named = moods.withColumn("label", F.element_at(F.array(*[F.lit(s) for s in fixed.SENTIMENTS]), F.col("label") + 1))
    classes = weights_by(T.sentiment_class_weights(named), "label_index")
    models = Models(texts, categories, fit_sentiment(featured(texts, moods), classes, rounds))

    truth = F.transform(T.multi_hot(F.col("labels"), names), lambda x: x.cast("int"))
    outputs = category_logits(models, held.select("_tf", truth.alias("truth")))
    best = E.best_threshold(outputs, names).first()
    if best is not None:
        models = Models(texts, categories, models.sentiment, best["threshold"])
    category = E.category_metrics(outputs, names, models.threshold)
    sentiment = E.sentiment_metrics(sentiment_logits(models, pairs("val").withColumnRenamed("label", "truth")))
    report = category.select(F.lit("category").alias("task"), "*").unionByName(
        sentiment.select(F.lit("sentiment").alias("task"), "*")
    )
    return models, report


def route_with_models(reviews: DataFrame, features: DataFrame, models: Models) -> DataFrame:
    """``route_reviews`` by the fitted models."""
    texts = reviews.where(F.col("review_text").isNotNull()).select("id", "review_text", F.col("review_text").alias("text"))
    scored = _category_logits(models, _sentiment_logits(models, featured(models.texts, texts), "_mood"))
    scored = scored.withColumn("probs", sigmoid(F.col("logits")))
    found = found_categories(scored, features, models.labels, models.threshold, keep=("_mood",))
    rated = pair_logits(models, found, "display_name", "_mood")
    return rated_aspects(rated.withColumn("probs", softmax(F.col("logits"))))


def save(models: Models, path: str) -> None:
    models.texts.write().overwrite().save(f"{path}/texts")
    models.sentiment.write().overwrite().save(f"{path}/sentiment")
    spark = SparkSession.active()
    rows = [(i, row.tolist()) for i, row in enumerate(models.categories.weights)]  # one per label
    spark.createDataFrame(rows, "label int, weights array<double>").write.mode("overwrite").parquet(f"{path}/categories")
    facts = spark.range(1).select(
        F.array(*[F.lit(v) for v in models.labels]).alias("labels"), F.lit(models.threshold).alias("threshold")
    )
    facts.write.mode("overwrite").json(f"{path}/facts")


def load(spark: SparkSession, path: str) -> Models:
    facts = spark.read.schema("labels array<string>, threshold double").json(f"{path}/facts").first()
    rows = spark.read.parquet(f"{path}/categories").orderBy("label").collect()
    return Models(
        PipelineModel.load(f"{path}/texts"),
        multilabel.LinearLabels(tuple(facts["labels"]), np.array([r.weights for r in rows])),
        LogisticRegressionModel.load(f"{path}/sentiment"),
        facts["threshold"],
    )
