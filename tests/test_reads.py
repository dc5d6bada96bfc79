"""Backlog, review browser, priorities and KPIs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mendlist.operators import backlog as B
from mendlist.operators import priorities as P
from mendlist.operators import taxonomy as X
from mendlist.plans.flow import analyse
from mendlist.sources import literals


@pytest.fixture()
def store(table):
    reviews = table(
        [(str(i), "ab"[i % 2], "app", f"text {i}", None, None, dt.datetime(2024, 1, 1 + i // 3)) for i in range(9)],
        "id string, source string, app_id string, review_text string, rating int, review_date date, ingested_at timestamp")
    features = table([("f1", "cost", "Cost", None, True), ("f2", "ads", "Ads", None, False)],
                     "id string, feature_key string, display_name string, description string, is_active boolean")
    aspects = table(
        [("x1", "0", "f1", "negative", 0.9, "finetuned"), ("x2", "0", "f2", "positive", 0.8, "finetuned"),
         ("x3", "1", "f1", "positive", 0.7, "llm_fallback"), ("x4", "4", "f2", "negative", 0.6, "finetuned"),
         ("x5", "8", "f1", "negative", 0.5, "finetuned"), ("x6", "8", "f1", "negative", 0.4, "finetuned")],
        "id string, review_id string, feature_id string, sentiment string, confidence double, source string")
    return reviews, aspects, features


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    "filters, expected",
    [
        ({}, list("012345678")),
        ({"feature_key": "cost"}, ["0", "1", "8"]),
        ({"sentiment": "negative"}, ["0", "4", "8"]),
        ({"feature_key": "ads", "sentiment": "negative"}, ["4"]),  # both in one aspect
        ({"feature_key": "cost", "sentiment": "negative", "source": "a"}, ["0", "8"]),
        ({"source": "b"}, ["1"]),  # only reviews with aspects
        ({"source": "b", "require_aspects": False}, ["1", "3", "5", "7"]),
        ({"feature_key": "unknown"}, []),
    ],
)
def test_filters(store, filters, expected):
    found = B.matching_reviews(*store, **filters)
    assert ids(found) == expected
    assert B.total_reviews(found).first().total == len(expected)


def test_page_shows_all_aspects_of_its_reviews(store):
    reviews, aspects, features = store
    page = B.newest_page(B.matching_reviews(*store, sentiment="negative"), limit=2)
    rows = B.page_with_aspects(page, aspects, features).collect()
    got = {r.id: [(a.feature_key, a.sentiment) for a in r.aspects] for r in rows}
    assert got == {"8": [("cost", "negative")] * 2, "4": [("ads", "negative")]}
    everything = B.page_with_aspects(B.newest_page(reviews), aspects, features).collect()
    assert {r.id: len(r.aspects) for r in everything} == {str(i): {0: 2, 1: 1, 4: 1, 8: 2}.get(i, 0) for i in range(9)}
    split = B.page_with_aspects(page, aspects, features, per_list=1).collect()
    assert sum(len(r.aspects) for r in split if r.id == "8") == 2


def test_reviews_stay_without_known_features(store):
    reviews, aspects, features = store
    rows = B.reviews_with_aspects(reviews, aspects, features.where("feature_key = 'ads'")).collect()
    assert {(r.id, r.feature_key) for r in rows if r.feature_key} == {("0", "ads"), ("4", "ads")}
    assert {r.id for r in rows} == {r.id for r in reviews.collect()}


def test_paging(store):
    order = [r.id for r in B.newest_page(store[0], limit=4, offset=2).collect()]
    assert order == ["8", "3", "4", "5"]
    for bad in ((0, 0), (201, 0), (5, -1)):
        with pytest.raises(ValueError):
            B.newest_page(store[0], *bad)


@pytest.fixture()
def scores(table):
    d = dt.date
    return table(
        [("f1", d(2024, 1, 1), d(2024, 1, 31), 3.0, 1, 1.0, None), ("f1", d(2024, 2, 1), d(2024, 2, 29), 0.5, 1, 1.0, -2.5),
         ("f2", d(2024, 1, 1), d(2024, 1, 31), 0.7, 1, 1.0, None), ("f9", d(2024, 1, 1), d(2024, 1, 31), 9.0, 1, 1.0, None)],
        "feature_id string, window_start date, window_end date, score double, mention_count bigint, negative_ratio double, trend_delta double")


def test_backlog_takes_latest_window(store, scores):
    features = store[2]
    assert [(r.feature_key, r.score) for r in B.backlog(scores, features).collect()] == [("ads", 0.7), ("cost", 0.5)]
    assert [r.feature_key for r in B.backlog(scores, features, "low", 1).collect()] == ["cost"]
    with pytest.raises(ValueError):
        B.backlog(scores, features, "urgent")


def test_trend(store, scores):
    features = store[2]
    one = B.feature_trend(scores, features, "cost").collect()
    assert [p.score for p in one[0].points] == [3.0, 0.5]
    assert B.feature_trend(scores.limit(0), features, "cost").first().points == []
    assert B.feature_trend(scores, features, "nope").isEmpty()


def test_features(spark, store, table):
    assert [r.feature_key for r in X.list_features(store[2]).collect()] == ["cost"]
    assert [r.feature_key for r in X.list_features(store[2], False).collect()] == ["ads", "cost"]
    seed = literals.taxonomy(spark)
    assert seed.count() == 12 and X.missing_features(seed, store[2]).count() == 11
    named = X.with_display_name(table([("cost",), ("new_key",)], "feature_key string"), seed)
    assert {(r.feature_key, r.display_name) for r in named.collect()} == {("cost", "Cost"), ("new_key", "new_key")}


def test_mapping_outcomes(table):
    rows = table([(c,) for c in (" Login ", "GENERAL", "unheard", "", None, "n/a")], "aspect_category string")
    got = {r.aspect_category: (r.feature_key, r.outcome) for r in X.map_category(rows, F.col("aspect_category")).collect()}
    assert got[" Login "] == ("login_auth", "mapped")
    assert got["GENERAL"] == (None, "ignored") and got["n/a"] == (None, "ignored")
    assert got["unheard"] == (None, "unmapped")
    assert {r.category: r.outcome for r in X.mapping_coverage(rows).collect()} == {
        " Login ": "mapped", "GENERAL": "ignored", "unheard": "unmapped", "n/a": "ignored"}
    assert {r.outcome: r.categories for r in X.coverage_report(rows).collect()} == {"mapped": 1, "ignored": 2, "unmapped": 1}


# fifteen sample reviews: expected aspects and sentiments
SAMPLE = [
    ("Reliability", "n"), ("Usability", "p"), ("Cost", "n"), ("Security;Reliability", "n;n"), ("Efficiency", "p"),
    ("Reliability", "n"), ("Efficiency", "n"), ("Aesthetics", "p"), ("Effectiveness", "p"), ("Reliability", "n"),
    ("Security", "n"), ("General", "p"), ("Effectiveness;Efficiency", "p;n"), ("General", "p"),
    ("Reliability;Efficiency;Cost", "n;n;n"),
]


@pytest.fixture()
def sample(table):
    names = {"n": "negative", "p": "positive"}
    rows = [
        (f"review {i}", feature, names[mood])
        for i, (features, moods) in enumerate(SAMPLE)
        for feature, mood in zip(features.split(";"), moods.split(";"))
    ]
    return table(rows, "original_review string, feature string, sentiment string")


def test_sample_priorities(sample):
    assert [tuple(r) for r in P.feature_priorities(sample).collect()] == [
        ("Reliability", 5, 0, 5, "Critical"), ("Efficiency", 4, 1, 3, "High"), ("Cost", 2, 0, 2, "Medium"),
        ("Security", 2, 0, 2, "Medium"), ("Effectiveness", 2, 2, 0, "Low"), ("General", 2, 2, 0, "Low"),
        ("Aesthetics", 1, 1, 0, "Low"), ("Usability", 1, 1, 0, "Low")]


def test_sample_kpis(sample):
    k = P.kpi_summary(sample).first()
    assert (k.total_aspects, round(k.positive_pct, 2), round(k.negative_pct, 2), round(k.average_aspects, 4)) == (19, 36.84, 63.16, 1.2667)
    assert (k.top_complaint, k.top_complaint_mentions, k.top_praise, k.top_praise_mentions) == ("Reliability", 5, "Effectiveness", 2)
    assert P.insight_text(P.kpi_summary(sample)).first().summary_text == (
        "### Top Insights\n• **Reliability** is the most complained-about feature (5 negative mentions).\n"
        "• Users highly appreciate **Effectiveness** (2 positive mentions).\n\n### Recommendation\n"
        "Prioritize fixing issues related to **Reliability** before introducing new features.")
    assert [r.feature for r in P.top_negative_features(sample).collect()] == ["Reliability", "Efficiency", "Cost", "Security"]
    assert [r.mentions for r in P.feature_mentions(sample).collect()] == [1, 1, 2, 2, 2, 2, 4, 5]


def test_kpis_without_rows_or_extremes(sample):
    empty = P.insight_text(P.kpi_summary(sample.limit(0))).first()
    assert (empty.total_aspects, empty.positive_pct, empty.average_aspects) == (0, 0.0, 0.0)
    assert empty.summary_text.startswith("No aspects detected")
    neutral = P.insight_text(P.kpi_summary(sample.withColumn("sentiment", F.lit("neutral")))).first()
    assert neutral.top_complaint is None and neutral.top_praise is None
    assert neutral.summary_text == ("### Top Insights\n• No major negative complaints detected.\n\n### Recommendation\n"
                                    "Maintain current stability and monitor for new issues.")


@pytest.mark.parametrize("negative, mentions, tier", [
    (5, 10, "Critical"), (5, 11, "High"), (3, 10, "High"), (3, 11, "Medium"), (1, 100, "Medium"), (0, 5, "Low"), (0, 0, "Low")])
def test_tiers(table, negative, mentions, tier):
    from mendlist.functions.scores import priority_tier

    df = table([(negative, mentions)], "n bigint, m bigint")
    assert df.select(priority_tier(F.col("n"), F.col("m"))).first()[0] == tier


def test_ad_hoc_analysis(table):
    reviews = table([("It CRASHED",), ("  ",), ("nice",), ("Beautiful, but expensive",)], "review string")
    out = analyse(reviews)
    tags = {(r.original_review, r.feature, r.sentiment, r.confidence) for r in out["aspects"].collect()}
    assert tags == {
        ("It CRASHED", "reliability", "negative", 0.95), ("nice", "general", "neutral", 0.5),
        ("Beautiful, but expensive", "ui_ux", "positive", 0.88), ("Beautiful, but expensive", "pricing", "negative", 0.92)}
    assert out["summary"].first().total_aspects == 4
    assert {r.sentiment: r.mentions for r in out["sentiment_distribution"].collect()} == {"negative": 2, "neutral": 1, "positive": 1}


def test_pages_after_a_cursor(spark):
    """Joined they are the offset pages: ties in the load time, rows without one, and rows loaded in between."""
    import datetime as dt

    rows = [(f"r{i:03d}", dt.datetime(2024, 1, 1 + i % 4) if i % 7 else None) for i in range(95)]
    reviews = spark.createDataFrame(rows, "id string, ingested_at timestamp").repartition(5)
    expected = [r.id for r in B.newest_page(reviews, 200).collect()]
    got, cursor = [], None
    for _ in range(20):
        page = B.page_after(reviews, cursor, 10)
        got += [r.id for r in page.collect()]
        cursor = B.cursor_of(page)
        if cursor is None:
            break
        later = spark.createDataFrame([(f"n{len(got)}", dt.datetime(2025, 1, 1))], reviews.schema)
        reviews = reviews.union(later)
    assert got == expected
    with pytest.raises(ValueError):
        B.page_after(reviews, None, 201)


def test_a_list_of_values_as_a_filter(spark):
    df = spark.range(50).selectExpr("cast(id as string) as k")
    assert sorted(int(r.k) for r in df.where(B.one_of("k", [str(i) for i in (3, 7, 9, 40, 99)])).collect()) == [3, 7, 9, 40]
    assert df.where(B.one_of("k", [])).isEmpty()
