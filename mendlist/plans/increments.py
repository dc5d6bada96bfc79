"""Scores kept up to date: what each load of aspects changes, instead of all months anew.

The store keeps, by month, how often each feature was mentioned on each day, and which aspect
folders these counts stand for. An update reads the folders added since, and those that a
replaced run has left (they count with sign -1), adds their counts to the months they touch,
and rewrites the scores of these months and of the month that follows each in some feature's
timeline, whose trend changes. Counts, folders and scores change in one commit, so an update that
is cut short or repeated, by a stream or by hand, counts nothing twice.

The aspects' reviews must be stored before them, as the flow does: their dates are taken then.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendlist import fixed
from mendlist.operators import criticality as K
from mendlist.plans.ingest import Tables
from mendlist.sources import store as st
from mendlist.sources.writers import ASPECTS, DAY_COUNTS, REVIEWS, SCORED, SCORES, month, score_rows
from mendlist.storage import release, settle

_COUNTS = "feature_id string, review_date date, mentions long, negatives long"


def _names(months: DataFrame) -> list[str]:
    """The distinct months of a column ``m``: a few."""
    return sorted(r["m"] for r in months.select("m").distinct().collect())


def _changes(store: st.Store, base: st.Version, reviews: DataFrame) -> tuple[DataFrame | None, list[str]]:
    """Day counts to add (some below zero) and the folders they lead to."""
    have, want = base.of(SCORED), base.of(ASPECTS)
    signed = []
    for folders, sign in ((sorted(set(want) - set(have)), 1), (sorted(set(have) - set(want)), -1)):
        found = store.files(folders)
        if found is not None:
            counts = K.day_counts(K.dated_aspects(found, reviews))
            signed.append(counts.withColumns({c: F.col(c) * sign for c in ("mentions", "negatives")}))
    if not signed:
        return None, want
    return settle(K.added(signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1]))), want


def refresh(spark: SparkSession, tables: Tables, half_life_days=fixed.HALF_LIFE_DAYS) -> list[str]:
    """Brings the stored scores up to date; returns the months written (yyyy-MM).

    Another half-life than before scores every month anew, from the day counts.
    """
    store = tables.store(spark)
    change = store.begin()
    base, label = change.base, f"half life {half_life_days}"
    changes, folders = _changes(store, base, tables.reviews(spark) if base.of(REVIEWS) else spark.createDataFrame([], "id string, review_date date"))
    other_half_life = base.parts(SCORED) - {label}
    if changes is None and not other_half_life:
        return []
    if changes is None:
        changes = spark.createDataFrame([], _COUNTS)
    of_day, of_window = month(F.col("review_date")), month(F.col("window_start"))
    touched = _names(changes.select(of_day.alias("m")))
    rescored = sorted(set(touched) | (base.parts(DAY_COUNTS) if other_half_life else set()))
    kept = [f for m in rescored for f in base.folders.get((DAY_COUNTS, m), ())]
    known = store.files(kept)
    counts = K.added(changes if known is None else changes.unionByName(known.select(*changes.columns)))
    counts = settle(counts)
    change.replace_parts(DAY_COUNTS, counts.where(of_day.isin(touched)), of_day, touched)

    # the score table is small: a row per feature and month
    fresh = K.scores_of_days(counts, half_life_days)
    before = store.read(SCORES, version=base)
    if before is None:
        scores = K.with_trend(fresh).withColumn("_moved", F.lit(True))
    else:
        rest = before.where(~of_window.isin(rescored)).select(*fresh.columns, F.col("trend_delta").alias("_before"))
        scores = K.with_trend(rest.unionByName(fresh.withColumn("_before", F.lit(None).cast("double"))))
        scores = scores.withColumn("_moved", ~F.col("trend_delta").eqNullSafe(F.col("_before")))
    scores = settle(scores.withColumn("m", of_window))
    moved = sorted(set(rescored) | set(_names(scores.where("_moved"))))
    change.replace_parts(SCORES, score_rows(scores.where(F.col("m").isin(moved))), of_window, moved)
    for part in base.parts(SCORED):
        change.note(SCORED, [], part)
    change.note(SCORED, folders, label)
    change.commit()
    release(changes, counts, scores)
    return moved


def follow(spark: SparkSession, tables: Tables, checkpoint: str, half_life_days=fixed.HALF_LIFE_DAYS):
    """A streaming query that handles all commits so far, then ends (Trigger.AvailableNow).

    The stream is that of the store's versions: one small file per commit, so it never sees data
    of a commit that was not made. Each micro-batch brings the scores up to date; its own commit is a version
    too, which the next run finds to hold nothing new. ``checkpoint`` lies in the shared folder.
    """
    versions = spark.readStream.schema("number long, id string").json(tables.store(spark).versions)

    def handle(_, batch):
        refresh(spark, tables, half_life_days)

    return versions.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
