import math

import pytest
from pyspark.sql import functions as F

from mendlist.operators import split as L


def rows_of(spark, groups, per_group=3):
    """groups: list of (key, domain)."""
    data = [(f"{k}-{i}", k, d) for k, d in groups for i in range(per_group)]
    return spark.createDataFrame(data, "id string, group_key string, domain string")


def outcome(df):
    return {(r.group_key): r.split for r in df.select("group_key", "split").distinct().collect()}


@pytest.mark.parametrize(
    "sizes, test, val",
    [((34, 66), 0.1, 0.1), ((5, 7, 88), 0.2, 0.1), ((2, 2, 2, 2), 0.1, 0.1), ((1000,), 0.2, 0.1)],
)
def test_sizes_and_atomicity(spark, sizes, test, val):
    groups = [(f"g{s}-{i}", f"d{s}") for s, n in enumerate(sizes) for i in range(n)]
    df = L.assign_splits(rows_of(spark, groups), test=test, val=val)
    assert df.count() == 3 * len(groups)
    check = L.straddling_groups(df).first()
    assert (check.n_groups, check.n_straddling) == (len(groups), 0)
    got = outcome(df)
    n = len(groups)
    n_test = math.ceil(test * n)
    n_val = math.ceil(val / (1 - test) * (n - n_test))
    counts = {s: sum(v == s for v in got.values()) for s in ("test", "val", "train")}
    assert (counts["test"], counts["val"], counts["train"]) == (n_test, n_val, n - n_test - n_val)
    if len(sizes) > 1:
        for s, size in enumerate(sizes):
            in_test = sum(v == "test" for k, v in got.items() if k.startswith(f"g{s}-"))
            assert abs(in_test - size * n_test / n) < 1


def test_same_split_for_any_row_order_and_other_for_other_seed(spark):
    df = rows_of(spark, [(f"g{i}", "ab"[i % 2]) for i in range(60)])
    first = outcome(L.assign_splits(df))
    assert outcome(L.assign_splits(df.orderBy(F.rand(3)).repartition(5))) == first
    assert outcome(L.assign_splits(df, seed=1)) != first


@pytest.mark.parametrize(
    "groups, usable",
    [
        ([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], True),
        ([("a", "x"), ("b", "x"), ("c", "y")], False),  # one group in y
        ([("a", "x"), ("b", "x")], False),  # one domain
        ([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", None)], False),  # unknown
    ],
)
def test_strata_check(spark, groups, usable):
    assert L.strata_check(L.group_domains(rows_of(spark, groups))).first().usable is usable


def test_group_domain_is_the_first_known(spark):
    df = spark.createDataFrame(
        [(1, "g", None), (2, "g", "b"), (3, "g", "a"), (4, "h", "c")], "id int, group_key string, domain string"
    )
    got = {r.group_key: (r.domain, r.agreed) for r in L.group_domains(df).collect()}
    assert got == {"g": ("b", False), "h": ("c", True)}


def test_rows_stay_in_place_when_groups_agree(spark):
    groups = [(f"g{i}", "xy"[i % 2]) for i in range(40)]
    plan = L.assign_splits(rows_of(spark, groups))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_group_holding_a_third_of_the_rows(spark):
    hot = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("id"), F.lit("hot").alias("group_key"), F.lit("x").alias("domain"))
    rest = spark.range(10_000).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("g"), "id").alias("group_key"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("domain"),
    )
    df = L.assign_splits(hot.unionByName(rest))
    assert df.count() == 15_000
    assert L.straddling_groups(df).first().n_straddling == 0
    assert sum(r.rows for r in L.split_report(df).collect()) == 15_000


def test_shares_must_leave_train(spark):
    with pytest.raises(ValueError, match="below 1"):
        L.assign_splits(rows_of(spark, [("a", "x"), ("b", "x")]), test=0.5, val=0.5)


def test_group_key(spark):
    df = spark.createDataFrame([("1", "r"), ("2", None), ("3", "")], "id string, source_review_id string")
    assert [r[0] for r in df.select(L.group_key()).collect()] == ["r", "2", "3"]
