"""The whole batch flow, evaluation and the baseline models on a small CSV."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendlist import schemas
from mendlist.operators import aspects as A
from mendlist.plans import flow
from mendlist.plans.gold import evaluate
from mendlist.plans.ingest import Tables
from mendlist.plans.preprocess import preprocess
from mendlist.sources import readers, writers


def first_letter_model():
    def load():
        def score(texts):
            hit = texts.str.contains("cost").to_numpy()
            return np.stack([hit if i == 2 else hit * 0 for i in range(12)], axis=1) * 0.9

        return score

    return load


def mood_model():
    def load():
        def score(texts, names):
            bad = texts.str.contains("bad").to_numpy()
            return np.stack([bad, ~bad, ~bad & False], axis=1) * 1.0

        return score

    return load


@pytest.fixture(scope="module")
def csv_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "annotated.csv"
    lines = ["domain,app,sentence,category,term,sentiment,rating,review_id"]
    for i in range(40):
        mood = "bad" if i % 2 else "good"
        for s in range(2):
            text = f"<p>{mood} cost {i} part {s}</p>"
            lines.append(f"{'games' if i % 4 else 'social'},app{i % 3},{text},cost,price,{'negative' if i % 2 else 'positive'},{1 + i % 5},r{i}")
            lines.append(f"{'games' if i % 4 else 'social'},app{i % 3},{text},general,,N/A,{1 + i % 5},r{i}")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_flow_and_evaluation(spark, csv_path, tmp_path):
    tables = Tables(str(tmp_path / "store"))
    scorers = A.scorer(first_letter_model()), A.scorer(mood_model())
    summary = flow.run(spark, tables.root, *scorers, csv_path=csv_path, inference_split="train")
    assert summary["features"] == 12
    assert summary["preprocessing"] == {"train": 64, "val": 8, "test": 8}
    assert summary["aspects_written"] == 64
    assert summary["scores_written"] == 0  # the CSV carries no dates
    train = readers.read_split(spark, tables.splits, "train")
    assert train.where("review_text LIKE '%<%'").count() == 0
    assert len(readers.read_split(spark, tables.splits, "test", 3).collect()) == 3
    straddling = spark.read.parquet(tables.splits).groupBy("source_review_id").agg(F.countDistinct("split").alias("n"))
    assert straddling.where("n > 1").isEmpty()
    master = readers.read_records(spark, tables.records("master"), schemas.MASTER_RECORD, split="train")
    assert {tuple(map(tuple, r.aspects)) for r in master.collect()} <= {
        (("cost", "negative"), ("general", None)), (("cost", "positive"), ("general", None))}
    sentiment = readers.read_records(spark, tables.records("aspect_sentiment"), schemas.SENTIMENT_RECORD, with_split=True)
    assert sentiment.count() == 80 and {r.aspect for r in sentiment.collect()} == {"cost"}

    # a second run over the same input changes nothing
    again = flow.run(spark, tables.root, *scorers, csv_path=csv_path, inference_split="train")
    assert again == summary

    report = evaluate(
        spark, spark.read.parquet(tables.splits).where("split = 'test'"), tables.annotations(spark),
        tables.features(spark), lambda t: F.transform(scorers[0](t), lambda p: p * 10 - 5), scorers[1],
        str(tmp_path / "report"), mapping={"cost": "cost", "general": None},
    )
    got = {(r.task, r.metric): r.value for r in report.collect()}
    assert got[("category", "f1_cost")] == 1.0 and got[("category", "support_cost")] == 8
    assert got[("sentiment", "support_negative")] + got[("sentiment", "support_positive")] == 8
    with pytest.raises(ValueError, match="no usable gold"):
        evaluate(spark, spark.read.parquet(tables.splits), tables.annotations(spark), tables.features(spark),
                 lambda t: F.transform(scorers[0](t), lambda p: p * 10 - 5), scorers[1], str(tmp_path / "none"), mapping={})


def test_baseline_learns_and_is_stored(spark, csv_path, tmp_path):
    from mendlist.plans import baseline
    from mendlist.plans.ingest import ingest_csv, seed_features

    tables = Tables(str(tmp_path / "store"))
    ingest_csv(spark, csv_path, tables)
    seed_features(spark, tables)
    preprocess(spark, tables)
    models, report = baseline.train(spark, tables, vocabulary=("cost", "general", "safety"), rounds=4)
    got = {(r.task, r.metric): r.value for r in report.collect()}
    assert got[("category", "f1_cost")] == 1.0 and got[("sentiment", "accuracy")] == 1.0
    baseline.save(models, str(tmp_path / "models"))
    again = baseline.load(spark, str(tmp_path / "models"))
    assert (again.labels, again.threshold) == (models.labels, models.threshold)
    reviews = readers.read_split(spark, tables.splits, "test")
    routed = baseline.route_with_models(reviews, tables.features(spark), again).collect()
    moods = {r.review_id: r.sentiment for r in routed if r.feature_key == "cost"}
    assert len(moods) == reviews.count()
    for r in reviews.collect():
        assert moods[r.id] == ("negative" if r.review_text.startswith("bad") else "positive")


def test_command_line(spark, csv_path, tmp_path, capsys):
    from mendlist.__main__ import main

    store = str(tmp_path / "store")
    for step in (["ingest", "--csv", csv_path], ["seed"], ["preprocess", "--test", "0.2"], ["features"]):
        assert main([step[0], "--store", store, *step[1:]]) == 0
    out = capsys.readouterr().out
    assert '{"reviews": 80}' in out and '{"features": 12}' in out and '"test": 16' in out and "Usability" in out
    upload = tmp_path / "u.csv"
    upload.write_text("review\nIt crashed\n")
    assert main(["analyse", "--csv", str(upload)]) == 0
    assert "**reliability** is the most complained-about" in capsys.readouterr().out


def test_scores_are_replaced_and_undated_rows_not_stored(spark, table, tmp_path):
    import datetime as dt

    tables = Tables(str(tmp_path / "store"))
    row = ("f", dt.date(2024, 1, 1), dt.date(2024, 1, 31), 1.0, 2, 0.5, 0.0, None)
    undated = ("f", None, None, 1.0, 2, 0.5, 1.0, None)
    schema = ("feature_id string, window_start date, window_end date, score double, mention_count bigint, "
              "negative_ratio double, undated_ratio double, trend_delta double")
    for _ in range(2):
        assert writers.write_scores(table([row, undated], schema), tables.store(spark)) == 1
    assert tables.scores(spark).columns == schemas.CRITICALITY_SCORES.fieldNames()


def test_empty_tables_are_errors(spark, table, tmp_path):
    tables = Tables(str(tmp_path / "empty"))
    with pytest.raises(readers.InputError, match="raw_reviews is not stored"):
        preprocess(spark, tables)
    with tables.store(spark).begin() as change:
        change.append(writers.REVIEWS, spark.createDataFrame([], schemas.RAW_REVIEWS))
        change.append(writers.ASPECTS, spark.createDataFrame([], schemas.REVIEW_ASPECTS))
    with pytest.raises(readers.InputError, match="raw_reviews is empty"):
        preprocess(spark, tables)
    with pytest.raises(readers.InputError, match="review_aspects is empty"):
        flow.score(spark, tables)


def test_report_file_is_json(spark, table, tmp_path):
    path = tmp_path / "r"
    writers.write_report(table([("a", 1.5)], "metric string, value double"), str(path))
    [part] = path.glob("part-*.json")
    assert json.loads(part.read_text()) == {"metric": "a", "value": 1.5}


def test_checkpoint_setting_is_used(spark, monkeypatch):
    from mendlist import storage

    class Conf:
        @staticmethod
        def get(key, default=None):
            assert key == "spark.checkpoint.dir"
            return "/shared/folder/"

    class Session:
        conf = Conf

    assert storage.fresh_path(Session, "x").startswith("/shared/folder/x-")
