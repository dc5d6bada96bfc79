"""Gates, routing, gold labels and metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendlist import fixed
from mendlist.functions import gates
from mendlist.operators import aspects as A
from mendlist.operators import evaluation as E
from mendlist.operators.common import short_id
from mendlist.plans.gold import evaluate
from mendlist.sources import literals


def one(table, values, expression):
    return table([(values,)], "x array<double>").select(expression(F.col("x"))).first()[0]


def test_gates(table):
    assert one(table, [0.9, 0.1], gates.decision_confidence) == pytest.approx([0.9, 0.9], abs=1e-6)
    assert one(table, [0.4, 0.1], gates.category_needs_fallback) is False  # nothing positive
    assert one(table, [0.6, 0.99], gates.category_needs_fallback) is True
    assert one(table, [0.7, 0.99], gates.category_needs_fallback) is False
    assert one(table, [0.4, 0.3, 0.3], gates.sentiment_needs_fallback) is True
    assert one(table, [0.4, 0.4, 0.2], lambda p: gates.top_label(p, F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a"
    x = [1.0, -2.0, 700.0]
    assert one(table, x, gates.softmax) == pytest.approx([0, 0, 1])
    assert one(table, [1.0, 2.0], gates.softmax) == pytest.approx(np.exp([1, 2]) / np.exp([1, 2]).sum())
    assert one(table, [0.0, 2.0], gates.sigmoid) == pytest.approx([0.5, 1 / (1 + np.exp(-2))])


def test_routing_and_resolving(spark, table):
    def categories():
        return lambda texts: np.stack([texts.str.contains("a"), texts.str.contains("b")], axis=1) * 0.8

    def sentiments():
        return lambda texts, names: np.stack([names.str.len(), texts.str.len(), names.str.len() * 0], axis=1) / 100

    reviews = table([("1", "ab"), ("2", "b......"), ("3", "zz")], "id string, review_text string")
    features = table([("f", "cost", "Cost")], "id string, feature_key string, display_name string")
    routed = A.route_reviews(reviews, features, A.scorer(categories), A.scorer(sentiments), labels=("cost", "other"))
    got = {tuple(r) for r in routed.collect()}
    assert got == {("1", "cost", "negative", 0.04, "finetuned"), ("1", "other", "negative", 0.05, "finetuned"),
                   ("2", "other", "neutral", 0.07, "finetuned")}
    resolved = A.resolve_aspects(routed.withColumn("confidence", F.lit(None).cast("double")), features).collect()
    assert [(r.review_id, r.feature_id, r.confidence) for r in resolved] == [("1", "f", 1.0)]
    assert [tuple(r) for r in A.unresolved_aspects(routed, features).collect()] == [("other", 2)]
    with pytest.raises(Exception, match="invalid sentiment: odd"):
        A.resolve_aspects(routed.withColumn("sentiment", F.lit("odd")), features).collect()
    with pytest.raises(Exception, match="invalid source: null"):
        A.resolve_aspects(routed.withColumn("source", F.lit(None).cast("string")), features).collect()


def test_source_rates(table):
    df = table([("finetuned",)] * 3 + [("llm_fallback",)], "source string")
    assert tuple(A.source_rates(df).first()) == (4, 0.75, 0.25)
    assert tuple(A.source_rates(df.limit(0)).first()) == (0, 0.0, 0.0)


@pytest.fixture()
def gold(table):
    reviews = table([("1", "one"), ("2", "two"), ("3", "three")], "id string, review_text string")
    notes = table(
        [("1", 0, "Login ", "Negative"), ("1", 1, "login", " NONE "), ("1", 2, "general", "negative"), ("2", 0, "price", ""),
         ("2", 1, "price", None), ("2", 2, "sync", "positive"), ("2", 3, "martian", "positive")],
        "review_id string, seq bigint, aspect_category string, polarity string")
    features = table([("login_auth", "Login"), ("billing_subscription", "Billing")], "feature_key string, display_name string")
    return reviews, notes, features


def test_gold_labels(gold):
    reviews, notes, features = gold
    labels = E.gold_category_labels(reviews, notes, ("sync_speed", "login_auth")).collect()
    assert {r.review_id: r.gold_labels for r in labels} == {"1": [1.0, 0.0], "2": [0.0, 1.0], "3": [0.0, 0.0]}
    pairs = E.gold_sentiment_pairs(reviews, notes, features).collect()
    assert sorted((r.review_id, r.text_a, r.text_b, r.gold_sentiment) for r in pairs) == [
        ("1", "one", "Login", "negative"), ("1", "one", "Login", "neutral")]


def metrics(df):
    return {r.metric: r.value for r in df.collect()}


def test_published_category_figures(table):
    """Precision 0.25 and recall 0.775 over the one label with support give F1 0.378049."""
    rows = [([5.0, -5.0], [1, 0])] * 31 + [([-5.0, -5.0], [1, 0])] * 9 + [([5.0, -5.0], [0, 0])] * 93
    got = metrics(E.category_metrics(table(rows, "logits array<double>, truth array<int>"), ["compatibility", "cost"], 0.6))
    for average in ("micro", "macro"):
        assert got[f"precision_{average}"] == pytest.approx(0.25)
        assert got[f"recall_{average}"] == pytest.approx(0.775)
        assert got[f"f1_{average}"] == pytest.approx(0.3780487804878049)
    assert (got["support_compatibility"], got["support_cost"], got["f1_cost"], got["optimal_threshold"]) == (40, 0, 0, 0.6)


def test_published_sentiment_figures(table):
    """589 of 764 right, by the two classes with support."""
    cells = {(0, 0): 285, (0, 1): 3, (0, 2): 99, (2, 0): 73, (2, 1): 0, (2, 2): 304}
    rows = [([1.0 * (g == k) for k in range(3)], t) for (t, g), n in cells.items() for _ in range(n)]
    got = metrics(E.sentiment_metrics(table(rows, "logits array<double>, truth int")))
    assert got["accuracy"] == pytest.approx(0.7709424083769634)
    assert got["f1_negative"] == pytest.approx(0.7651006711409396)
    assert got["f1_positive"] == pytest.approx(0.7794871794871795)
    assert got["precision_macro"] == pytest.approx(0.7752159086183235)
    assert got["recall_macro"] == pytest.approx(0.7714000781362449)
    assert got["f1_macro"] == pytest.approx(0.7722939253140595)
    assert (got["support_negative"], got["support_neutral"], got["support_positive"]) == (387, 0, 377)


def f1_of(truth, guess):
    tp, fp, fn = (truth & guess).sum(), (~truth & guess).sum(), (truth & ~guess).sum()
    return 0.0 if tp == 0 else 2 * tp / (2 * tp + fp + fn)


def test_sweep_against_brute_force(table):
    rng = np.random.default_rng(3)
    truth = rng.random((300, 4)) < [0.5, 0.2, 0.05, 0.0]
    logits = rng.normal(size=(300, 4)) * 2 + truth * 1.5
    df = table([(list(map(float, x)), [int(v) for v in t]) for x, t in zip(logits, truth)], "logits array<double>, truth array<int>")
    names = list("abcd")
    p = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
    curve = {round(t, 2): np.mean([f1_of(truth[:, i], p[:, i] >= t) for i in range(4)]) for t in np.arange(0.1, 0.95, 0.05)}
    got = {round(r.threshold, 2): r.f1_macro for r in E.threshold_curve(df, names).collect()}
    assert got == pytest.approx(curve) and len(got) == 17
    best = E.best_threshold(df, names).first()
    assert best.threshold == max(curve, key=lambda t: (round(curve[t], 12), -t))
    m = metrics(E.category_metrics(df, names, 0.5))
    assert m["f1_macro"] == pytest.approx(np.mean([f1_of(truth[:, i], p[:, i] >= 0.5) for i in range(3)]))  # d has no support
    flat = table([([0.0], [0])], "logits array<double>, truth array<int>")
    assert E.best_threshold(flat, ["a"]).first().threshold == 0.1  # the lowest of equals
    assert metrics(E.category_metrics(flat, ["a"]))["f1_macro"] == 0.0  # no label has support


def test_fixed_tables(spark):
    assert set(fixed.LABELS) == {r.feature_key for r in literals.taxonomy(spark).collect()}
    mapping = literals.category_features(spark)
    assert mapping.count() == len(fixed.CATEGORY_FEATURES)
    assert mapping.where("feature_key IS NULL").count() == 4


def test_labels_beyond_one_number(table):
    """A vocabulary of more labels than a number has bits; a label may come first, last or twice."""
    names = [f"f{i:03}" for i in range(2 * E.WORD_BITS + 3)]
    given = {"1": [0, E.WORD_BITS - 1], "2": [E.WORD_BITS, 2 * E.WORD_BITS, 2 * E.WORD_BITS + 2], "3": []}
    notes = table([(k, names[i]) for k, own in given.items() for i in [*own, *own]] + [("1", "martian")], "review_id string, aspect_category string")
    reviews = table([(k, k) for k in given], "id string, review_text string")
    gold = E.gold_category_labels(reviews, notes, [*reversed(names), names[0]], {n: n for n in names})
    assert {r.review_id: [i for i, x in enumerate(r.gold_labels) if x == 1.0] for r in gold.collect()} == given
    assert {len(r.gold_labels) for r in gold.collect()} == {len(names)}


def test_short_ids_stand_for_one_id_each(table):
    ids = ["", "00", "0", "ab", "AB", "aB", "\x00", "\x01", "\xab", "ab" * 32, "g" * 64, "é", None]
    rows = table([(x,) for x in ids], "id string").select("id", short_id(F.col("id")).alias("code")).collect()
    assert {r.id is None for r in rows if r.code is None} == {True}
    codes = {r.id: bytes(r.code) for r in rows if r.code is not None}
    assert len(codes) == len(ids) - 1 == len(set(codes.values())) and len(codes["ab" * 32]) == 33


def test_evaluation_works_its_inputs_out_once(spark, gold, tmp_path):
    reviews, notes, features = gold
    seen = spark.sparkContext.accumulator(0)
    looked = F.udf(lambda x: (seen.add(1), x)[1], "string").asNondeterministic()
    logits = lambda *texts: F.array(*[F.lit(float(i)) for i in range(3)])
    report = evaluate(
        spark, reviews.withColumn("review_text", looked("review_text")), notes.withColumn("polarity", looked("polarity")), features,
        logits, logits, str(tmp_path / "report"), ("billing_subscription", "login_auth", "sync_speed"),
    )
    got = {(r.task, r.metric): r.value for r in report.collect()}
    assert got[("category", "support_login_auth")] == 1 and got[("sentiment", "support_neutral")] == 1
    assert seen.value == reviews.count() + notes.count()
