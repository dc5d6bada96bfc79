"""Leak-free, stratified train/val/test split of whole groups.

A group (all sentences of one source review) goes to one split. Within a
stratum groups are ordered by ``md5(seed:key)``; the first ones are test, the
next ones val, the rest train. Instead of ranking all groups of a stratum in
one task, the hash at each border is found by counting groups per hash prefix
(65,536 near-equal buckets) and ranking inside the border bucket only. After
that a row's split follows from its own hash and its stratum's two borders.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlist import fixed
from mendlist.functions.scores import safe_ratio
from mendlist.operators.common import broadcast_if_few
from mendlist.storage import settle

PREFIX = 4  # hex digits of the hash that form a bucket


def group_key(source_review_id="source_review_id", own_id="id"):
    """The source review a row belongs to, else the row itself."""
    given = F.col(source_review_id).cast("string")
    return F.coalesce(F.when(given != "", given), F.col(own_id).cast("string"))


def group_domains(
    rows: DataFrame, order_by="id", key="group_key", domain="domain", present=None
) -> DataFrame:
    """Per group: the domain of its first row that has one, and whether all rows agree.

    ``present`` (a boolean Column) tells rows with metadata from rows without,
    where that is not the same as having a domain.
    """
    d = F.col(domain)
    present = d.isNotNull() if present is None else present
    found = rows.groupBy(key).agg(
        F.min_by(d, F.when(present, F.col(order_by))).alias("domain"),
        ((F.count(d) == F.count("*")) & (F.min(d) == F.max(d))).alias("agreed"),
    )
    return found.withColumn("agreed", F.coalesce("agreed", F.lit(False)))


def strata_check(groups: DataFrame) -> DataFrame:
    """One row: can the groups be stratified by domain?

    Needs every domain known, more than one of them, and two groups in each.
    ``n_mixed`` counts the groups whose rows do not agree on the domain.
    """
    sizes = groups.groupBy("domain").agg(
        F.count("*").alias("n"), F.count_if(~F.col("agreed")).alias("mixed")
    )
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_groups"),
        F.coalesce(F.sum("mixed"), F.lit(0)).alias("n_mixed"),
        F.coalesce(F.sum(F.when(F.col("domain").isNull(), F.col("n"))), F.lit(0)).alias("n_unknown"),
        F.count("domain").alias("n_domains"),
        F.min(F.when(F.col("domain").isNotNull(), F.col("n"))).alias("smallest"),
    ).withColumn(
        "usable",
        (F.col("n_unknown") == 0)
        & (F.col("n_domains") > 1)
        & (F.coalesce("smallest", F.lit(0)) >= 2),
    )


def _largest_remainder(strata: DataFrame, size: str, wanted, name: str) -> DataFrame:
    """``wanted`` groups shared out over strata in proportion to ``size``.

    Whole shares first, then one more for the largest remainders, ties by
    stratum. The table has one row per domain.
    """
    everything = W.partitionBy()
    product = F.col(size).cast("decimal(18,0)") * wanted.cast("decimal(18,0)")
    total = F.sum(size).over(everything)
    shares = strata.withColumn("_total", total).withColumn("_wanted", wanted)
    shares = shares.withColumn(
        "_floor", F.floor(product / F.greatest("_total", F.lit(1)).cast("decimal(18,0)")).cast("bigint")
    ).withColumn("_rest", product - (F.col("_floor") * F.col("_total")).cast("decimal(36,0)"))
    shares = shares.withColumn(
        "_rank", F.row_number().over(W.orderBy(F.desc("_rest"), "stratum"))
    ).withColumn("_extra", F.col("_wanted") - F.sum("_floor").over(everything))
    return shares.withColumn(
        name, F.col("_floor") + (F.col("_rank") <= F.col("_extra")).cast("bigint")
    ).drop("_total", "_wanted", "_floor", "_rest", "_rank", "_extra")


def quotas(strata: DataFrame, test=fixed.TEST_SHARE, val=fixed.VAL_SHARE) -> DataFrame:
    """(stratum, n, n_test, n_val); ``strata`` holds (stratum, n)."""
    if test + val >= 1.0:
        raise ValueError(f"test + val must be below 1, got {test + val}")
    n = F.sum("n").over(W.partitionBy())
    sized = strata.withColumn("_test", F.ceil(F.lit(test) * n))
    sized = sized.withColumn("_val", F.ceil(F.lit(val / (1.0 - test)) * (n - F.col("_test"))))
    sized = _largest_remainder(sized, "n", F.col("_test"), "n_test")
    sized = sized.withColumn("_left", F.col("n") - F.col("n_test"))
    sized = _largest_remainder(sized, "_left", F.col("_val"), "n_val")
    return sized.select("stratum", "n", "n_test", "n_val")


def _borders(groups: DataFrame, test: float, val: float) -> DataFrame:
    """(stratum, test_to, val_to): last hash of the test and of the val groups."""
    buckets = groups.groupBy("stratum", F.substring("h", 1, PREFIX).alias("bucket")).agg(
        F.count("*").alias("n")
    )
    shares = quotas(buckets.groupBy("stratum").agg(F.sum("n").alias("n")), test, val)
    reach = buckets.withColumn(
        "upto", F.sum("n").over(W.partitionBy("stratum").orderBy("bucket"))
    )
    marks = shares.select(
        "stratum",
        F.inline(
            F.array(
                F.struct(F.lit("test_to").alias("border"), F.col("n_test").alias("rank")),
                F.struct(F.lit("val_to").alias("border"), (F.col("n_test") + F.col("n_val")).alias("rank")),
            )
        ),
    )
    hit = reach.join(marks, "stratum").where(
        (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))
    ).select("stratum", "bucket", "border", (F.col("rank") - F.col("upto") + F.col("n")).alias("nth"))
    inside = groups.withColumn("bucket", F.substring("h", 1, PREFIX)).join(
        hit, ["stratum", "bucket"]
    )
    place = W.partitionBy("stratum", "bucket", "border").orderBy("h")
    found = inside.withColumn("_at", F.row_number().over(place)).where(F.col("_at") == F.col("nth"))
    last = found.groupBy("stratum").agg(
        F.max(F.when(F.col("border") == "test_to", F.col("h"))).alias("test_to"),
        F.max(F.when(F.col("border") == "val_to", F.col("h"))).alias("val_to"),
    )
    # strata that get no test or val groups have no border: nothing is below ''
    return shares.select("stratum").join(last, "stratum", "left").na.fill("", ["test_to", "val_to"])


def _split(h, test_to, val_to):
    return F.when(h <= test_to, "test").when(h <= val_to, "val").otherwise("train")


def assign_splits(
    rows: DataFrame,
    order_by="id",
    test=fixed.TEST_SHARE,
    val=fixed.VAL_SHARE,
    seed=fixed.SPLIT_SEED,
    key="group_key",
    domain="domain",
) -> DataFrame:
    """``rows`` with a ``split`` column (train / val / test).

    The narrow group table is written once to the shared folder, and the one
    row of ``strata_check`` is read on the driver (as is the one border row
    where there is a single stratum). Only where some group's rows
    disagree on the domain are the rows joined with their group; otherwise the
    split is decided row by row, without moving the rows.
    """
    groups = settle(group_domains(rows, order_by, key, domain))
    facts = strata_check(groups).first()
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    stratum = F.col("domain") if facts["usable"] else F.lit("")
    borders = settle(_borders(groups.select(stratum.alias("stratum"), hashed.alias("h")), test, val))
    if not facts["usable"]:  # one stratum: its borders are two constants
        ends = borders.first() or {"test_to": "", "val_to": ""}
        return rows.withColumn("split", _split(hashed, F.lit(ends["test_to"]), F.lit(ends["val_to"])))
    borders = broadcast_if_few(borders, facts["n_domains"])
    if facts["n_mixed"] == 0:
        placed = rows.withColumn("_stratum", F.col(domain))
    else:
        placed = rows.join(groups.select(key, F.col("domain").alias("_stratum")), key)
    placed = placed.join(borders.withColumnRenamed("stratum", "_stratum"), "_stratum")
    split = _split(hashed, F.col("test_to"), F.col("val_to"))
    return placed.withColumn("split", split).select(*rows.columns, "split")


def split_report(rows: DataFrame) -> DataFrame:
    """Rows per split and their share of all."""
    counts = rows.groupBy("split").agg(F.count("*").alias("rows"))
    return counts.withColumn("share", safe_ratio(F.col("rows"), F.sum("rows").over(W.partitionBy())))


def straddling_groups(rows: DataFrame, key="group_key") -> DataFrame:
    """One row: groups, and how many of them lie in more than one split (0 when right)."""
    code = F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2).otherwise(4)
    per_group = rows.groupBy(key).agg((F.bit_count(F.bit_or(code)) > 1).alias("straddles"))
    return per_group.agg(
        F.count("*").alias("n_groups"), F.count_if("straddles").alias("n_straddling")
    )
