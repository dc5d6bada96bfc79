"""The baseline models split and hash each text once."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendlist.plans import baseline

TEXTS = ["Good cost, GOOD price", "bad cost 12", "", "Ünïcode straße ΣΑΣ.", "safety ... bad", "x y z cost safety"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(str(i), text, ["cost"] if "cost" in text else [], i % 3) for i, text in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id string, text string, labels array<string>, label int")


@pytest.fixture(scope="module")
def models(docs):
    counts = baseline.counted(docs)
    texts = baseline.fit_texts(counts)
    rows = baseline.featured(texts, counts)
    categories = baseline.fit_categories(rows, {"cost": 1.0, "safety": 1.0}, rounds=3)
    return baseline.Models(texts, categories, baseline.fit_sentiment(rows, {0: 1.0, 1: 2.0, 2: 1.0}, 3), 0.0)


def test_counts_stand_for_the_texts(docs, models):
    counts = baseline.counted(docs)
    assert "text" not in counts.columns
    plain = baseline.fit_texts(docs.select("text"))
    assert np.array_equal(plain.stages[-1].idf.toArray(), models.texts.stages[-1].idf.toArray())
    of = lambda df: {r.id: r.features for r in baseline.featured(plain, df).collect()}
    assert of(docs) == of(counts) and len(of(docs)) == len(TEXTS)


def test_pair_logits_are_those_of_the_pair_text(docs, models):
    names = F.array(*[F.lit(n) for n in ("Cost", "ΣΑ Good price", "", "!!")])
    pairs = docs.select("id", "text", F.explode(names).alias("name"))
    whole = baseline.sentiment_logits(models, pairs.withColumn("text", baseline.pair_text(F.col("text"), F.col("name"))))
    of_text = baseline.sentiment_logits(models, docs.select("id", "text")).select("id", F.col("logits").alias("own"))
    parts = baseline.pair_logits(models, pairs.select("id", "name").join(of_text, "id"), "name", "own")
    found = lambda df: {(r.id, r.name): r.logits for r in df.collect()}
    whole, parts = found(whole), found(parts)
    assert whole.keys() == parts.keys() and len(whole) == 4 * len(TEXTS)
    assert all(np.allclose(parts[key], logits, rtol=0, atol=1e-12) for key, logits in whole.items())


def test_routing_reads_each_text_once(spark, docs, models):
    reviews = docs.select("id", F.col("text").alias("review_text"))
    features = spark.createDataFrame([("cost", "Cost")], "feature_key string, display_name string")
    routed = baseline.route_with_models(reviews, features, models)
    assert routed.count() == 2 * len(TEXTS)
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert len([call for call in re.findall(r"UDF\((?!UDF).*?\) AS", plan) if "text#" in call]) == 1
