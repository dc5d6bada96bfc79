import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from mendlist.functions import scores as S
from mendlist.operators import criticality as K
from mendlist.sources.readers import InputError

SCHEMA = "feature_id string, sentiment string, review_date date"


def day(text):
    return dt.date.fromisoformat(text) if text else None


def scored(table, rows, **options):
    df = table([(f, s, day(d)) for f, s, d in rows], SCHEMA)
    return {(r.feature_id, r.window_start): r for r in K.windowed_scores(df, **options).collect()}


@pytest.mark.parametrize("age, weight", [(0, 1), (90, 0.5), (180, 0.25), (360, 0.0625), (-5, 1)])
def test_recency(table, age, weight):
    until = dt.date(2024, 6, 30)
    df = table([(until - dt.timedelta(days=age), until)], "d date, u date")
    assert df.select(S.recency_weight(F.col("d"), F.col("u"))).first()[0] == pytest.approx(weight)


def test_missing_date_weighs_one(table):
    df = table([(None, dt.date(2024, 1, 31))], "d date, u date")
    assert df.select(S.recency_weight(F.col("d"), F.col("u"))).first()[0] == 1.0


def test_golden_score(table):
    rows = [("f", s, "2024-01-31") for s in ("negative", "positive", "neutral", "positive")]
    r = scored(table, rows)[("f", dt.date(2024, 1, 1))]
    assert r.score == pytest.approx(0.402359, abs=1e-6)
    assert (r.mention_count, r.negative_ratio, r.window_end) == (4, 0.25, dt.date(2024, 1, 31))


def test_trend_skips_missing_months_and_undated(table):
    rows = [("f", "negative", "2024-01-31"), ("f", "negative", "2024-03-31"), ("f", "negative", "2024-03-31"),
            ("f", "negative", None), ("g", "negative", None)]
    got = scored(table, rows)
    jan, mar, undated = (got[("f", k)] for k in (day("2024-01-01"), day("2024-03-01"), None))
    assert jan.trend_delta is None and undated.trend_delta is None
    assert mar.trend_delta == pytest.approx(math.log(3) - math.log(2))
    assert undated.window_end is None and undated.undated_ratio == 1.0
    assert got[("g", None)].score == pytest.approx(math.log(2))
    report = K.undated_report(K.windowed_scores(table([("f", "negative", None)], SCHEMA))).first()
    assert (report.undated_features, report.mostly_undated_rows) == (1, 1)


def test_required_columns(table):
    with pytest.raises(InputError, match="review_date"):
        K.windowed_scores(table([("f", "negative")], "feature_id string, sentiment string"))


def test_brute_force_and_row_order(table):
    rng = random.Random(7)
    start = dt.date(2023, 1, 1)
    rows = [
        (rng.choice("abc"), rng.choice(["negative", "neutral", "positive"]),
         None if rng.random() < 0.1 else str(start + dt.timedelta(days=rng.randrange(500))))
        for _ in range(600)
    ]
    got = scored(table, rows, half_life_days=30)
    groups = {}
    for f, s, d in rows:
        d = day(d)
        groups.setdefault((f, d and d.replace(day=1)), []).append((s, d))
    assert set(got) == set(groups)
    scores = {}
    for key, members in groups.items():
        first = key[1]
        last = first and (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
        weights = [1.0 if d is None else 0.5 ** ((last - d).days / 30) for _, d in members]
        share = sum(s == "negative" for s, _ in members) / len(members)
        scores[key] = share * math.log1p(len(members)) * sum(weights) / len(weights)
        assert got[key].score == pytest.approx(scores[key], rel=1e-12)
        assert 0 <= got[key].negative_ratio <= 1
    for f in "abc":
        months = sorted(k for k in groups if k[0] == f and k[1])
        for before, after in zip(months, months[1:]):
            assert got[after].trend_delta == pytest.approx(scores[after] - scores[before])
    rng.shuffle(rows)
    assert {k: round(r.score, 9) for k, r in scored(table, rows, half_life_days=30).items()} == {
        k: round(r.score, 9) for k, r in got.items()
    }


def test_aggregation_is_partial_and_needs_no_python(table):
    df = table([("f", "negative", dt.date(2024, 1, 1))], SCHEMA)
    plan = K.windowed_scores(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan and "EvalPython" not in plan
