import datetime as dt
import random

import pytest

from mendlist import schemas
from mendlist.operators import criticality as K
from mendlist.plans import flow, increments
from mendlist.plans.ingest import Tables
from mendlist.sources import writers
from mendlist.sources.store import Change

ASPECT = "id string, review_id string, feature_id string, sentiment string, confidence double, source string"


@pytest.fixture()
def tables(spark, tmp_path):
    tables = Tables(str(tmp_path / "store"))
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=9 * i) for i in range(40)]
    rows = [(f"r{i}", "s", "a", "text", 1, days[i] if i % 10 else None, "d", None, dt.datetime(2024, 1, 1)) for i in range(40)]
    with tables.store(spark).begin() as change:
        change.append(writers.REVIEWS, spark.createDataFrame(rows, schemas.RAW_REVIEWS))
    return tables


def _load(spark, tables, run, seed, reviews, n=120):
    deal = random.Random(seed)
    rows = [
        (f"{run}{seed}-{i}", f"r{deal.choice(reviews)}", f"f{deal.randrange(4)}", deal.choice(["negative", "positive", None]), 1.0, "x")
        for i in range(n)
    ]
    writers.write_aspects(spark.createDataFrame(rows, ASPECT), tables.store(spark), run)


def _rows(df):
    return sorted((r.feature_id, str(r.window_start), r.mention_count, round(r.negative_ratio, 9), round(r.score, 9),
                   None if r.trend_delta is None else round(r.trend_delta, 9)) for r in df.collect())


def _expected(spark, tables, half_life=90):
    dated = K.dated_aspects(tables.aspects(spark), tables.reviews(spark))
    return _rows(K.windowed_scores(dated, half_life).where("window_start is not null"))


def test_loads_add_up(spark, tables):
    assert increments.refresh(spark, tables) == [] and tables.scores(spark).isEmpty()
    _load(spark, tables, "a", 1, range(40))
    all_months = increments.refresh(spark, tables)
    assert _rows(tables.scores(spark)) == _expected(spark, tables) and len(all_months) > 8
    before = {r.window_start: r.computed_at for r in tables.scores(spark).collect()}

    # one month gets more: it is written again, and the next one of each feature for its trend, nothing else
    _load(spark, tables, "b", 2, [14, 15])
    months = increments.refresh(spark, tables)
    assert _rows(tables.scores(spark)) == _expected(spark, tables)
    touched = {day.strftime("%Y-%m") for day in (dt.date(2024, 1, 1) + dt.timedelta(days=9 * i) for i in (14, 15))}
    assert min(months) in touched and touched < set(months) and len(months) <= len(touched) + 4 < len(all_months)
    for r in tables.scores(spark).collect():
        assert (r.computed_at != before[r.window_start]) == (r.window_start.strftime("%Y-%m") in months)

    # a replaced run takes its mentions with it; months without any go
    _load(spark, tables, "a", 3, [15, 16, 17])
    increments.refresh(spark, tables)
    assert _rows(tables.scores(spark)) == _expected(spark, tables)
    assert increments.refresh(spark, tables) == []


def test_another_half_life_scores_all_months(spark, tables):
    _load(spark, tables, "a", 1, range(40))
    increments.refresh(spark, tables)
    months = increments.refresh(spark, tables, half_life_days=7)
    assert _rows(tables.scores(spark)) == _expected(spark, tables, 7) and len(months) > 8
    assert flow.score(spark, tables, 7) == len(_expected(spark, tables, 7))


def test_an_update_cut_short_counts_nothing_twice(spark, tables, monkeypatch):
    _load(spark, tables, "a", 1, range(40))
    with monkeypatch.context() as patch:
        patch.setattr(Change, "commit", lambda _: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            increments.refresh(spark, tables)
    assert tables.scores(spark).isEmpty()
    increments.refresh(spark, tables)
    assert _rows(tables.scores(spark)) == _expected(spark, tables)


def test_stream_of_commits(spark, tables, tmp_path):
    """Two micro-batches, a run with nothing new and a replay from the start give the scores of one full run."""
    checkpoint = str(tmp_path / "stream")
    for run, seed in (("a", 1), ("b", 2)):
        _load(spark, tables, run, seed, range(40))
        increments.follow(spark, tables, checkpoint).awaitTermination()
        assert _rows(tables.scores(spark)) == _expected(spark, tables)
    version = tables.store(spark).version()
    increments.follow(spark, tables, checkpoint).awaitTermination()
    increments.follow(spark, tables, str(tmp_path / "again")).awaitTermination()
    assert tables.store(spark).version() == version
