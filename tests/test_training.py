import pytest
from pyspark.sql import functions as F

from mendlist import fixed
from mendlist.operators import training as T
from mendlist.sources import literals
from mendlist.sources.readers import InputError

ANNOTATION = "array<struct<aspect_term:string,aspect_category:string,polarity:string,`from`:int,`to`:int>>"


def test_parse_aspects(table):
    notes = [(None, c, p, None, None) for c, p in (
        ("usability", "positive"), ("Usability", "positive"), ("cost", "N/A"), ("usability", "positive"),
        ("nonsense", "negative"), ("cost", ""), ("cost", None), ("usability", "odd"), (None, "negative"))]
    df = table([(notes,), (None,), ([],)], f"a {ANNOTATION}")
    got = [[tuple(x) for x in r[0]] for r in df.select(T.parse_aspects(F.col("a"))).collect()]
    assert got == [[("usability", "positive"), ("cost", None), ("usability", "odd")], [], []]


def test_records_from_rows(table):
    notes = table(
        [("1", 0, "usability", "positive"), ("1", 1, "cost", "NA"), ("1", 2, "usability", "positive"),
         ("1", 3, "aesthetics", "negative"), ("1", 4, "other", "negative")],
        "review_id string, seq bigint, aspect_category string, polarity string",
    )
    reviews = table([("1", " one "), ("2", "two"), ("3", " \t")], "id string, review_text string")
    master = T.master_records(reviews, T.aspect_pairs(notes))
    got = {r.review_id: (r.text, [tuple(a) for a in r.aspects]) for r in master.collect()}
    assert got == {
        "1": ("one", [("usability", "positive"), ("cost", None), ("aesthetics", "negative")]),
        "2": ("two", []),
    }
    assert {r.review_id: r.labels for r in T.category_records(master).collect()} == {
        "1": ["aesthetics", "cost", "usability"], "2": []}
    sentiment = T.sentiment_records(master)
    assert sentiment.columns == ["review_id", "aspect", "text", "label"]
    assert {(r.aspect, r.label) for r in sentiment.collect()} == {("usability", "positive"), ("aesthetics", "negative")}


def test_pos_weights(table):
    df = table([([["a", "a", "x"], []][i > 0],) for i in range(10)], "labels array<string>")
    got = {r.label: (r.positives, r.total, r.weight) for r in T.category_pos_weights(df, ("a", "b")).collect()}
    assert got["a"][:2] == (1, 10) and got["a"][2] == pytest.approx(9, abs=1e-3)
    assert got["b"] == (0, 10, 15.0)
    none = {r.label: r.weight for r in T.category_pos_weights(df.limit(0), ("a",)).collect()}
    assert none == {"a": 0.0}


def test_class_weights(table):
    df = table([(s,) for s in ["negative"] * 6 + ["positive"] * 3 + ["odd"]], "label string")
    got = {r.label: (r.label_index, r.n, r.weight) for r in T.sentiment_class_weights(df).collect()}
    assert got["negative"] == (0, 6, pytest.approx(0.5, abs=1e-4))
    assert got["neutral"] == (1, 0, 10.0)
    assert got["positive"] == (2, 3, pytest.approx(1, abs=1e-4))


def test_category_examples(table):
    labels = table([("1", "cost"), ("1", "cost"), ("1", "zzz"), ("3", "safety")], "review_id string, feature_key string")
    progress = table([("1", "t1", "labeled"), ("1", "t1", "labeled"), ("2", "t2", "labeled"), ("3", "t3", "failed")],
                     "review_id string, review_text string, status string")
    got = {r.review_id: r.labels for r in T.category_examples(labels, progress, ("safety", "cost")).collect()}
    assert got == {"1": [1.0, 0.0], "2": [0.0, 0.0]}


def test_sentiment_pairs_and_report(spark, table):
    labels = table(
        [("1", "t", "cost", "negative"), ("1", "t", "gone", "negative"), ("2", "u", "cost", "odd"), ("2", "u", "cost", "positive")],
        "review_id string, review_text string, feature_key string, sentiment string")
    features = literals.taxonomy(spark)
    got = {(r.review_id, r.text_a, r.text_b, r.label) for r in T.sentiment_pairs(labels, features).collect()}
    assert got == {("1", "t", "Cost", 0), ("2", "u", "Cost", 2)}
    assert tuple(T.sentiment_pair_report(labels, features).first()) == (4, 1, 1, 2)
    assert [r[0] for r in T.unknown_features(labels, features).collect()] == ["gone"]
    with pytest.raises(InputError):
        T.checked_sentiment_pairs(labels.where("feature_key = 'gone'"), features)


def test_trainer_pairs(table):
    df = table([("1", "ui_ux", "t", "neutral"), ("1", "cost", "t", "odd")], "review_id string, aspect string, text string, label string")
    assert [tuple(r) for r in T.trainer_pairs(df).collect()] == [("1", "t", "Ui Ux", 1)]


def test_label_index_and_vocabulary(table):
    df = table([(["b", "a"],), (["b"],), ([],)], "labels array<string>")
    assert T.vocabulary_of(df) == ("a", "b")
    assert T.vocabulary_of(df, ("z", "y", "z")) == ("y", "z")
    assert list(fixed.LABELS) == sorted(fixed.LABELS) and len(fixed.LABELS) == 12
    many = table([(f"{i * 7919 % 12000:05}",) for i in range(24000)], "label string")
    got = {r.label: r.label_index for r in T.label_index(many).collect()}
    assert got == {f"{i:05}": i for i in range(12000)}
    with pytest.raises(ValueError, match="more than"):
        T.vocabulary_of(many.select(F.array("label").alias("labels")))


def test_label_histogram(table):
    df = table([("train", ["a", "a"]), ("train", ["b"]), ("val", [])], "split string, labels array<string>")
    got = {(r.split, r.label): r.n for r in T.label_histogram(df, ("a", "b")).collect()}
    assert got == {("train", "a"): 1, ("train", "b"): 1, ("val", "a"): 0, ("val", "b"): 0}
