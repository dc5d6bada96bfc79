"""Line deduplication by site-relative frequency.

For each host: the pages that hold a line, divided by all pages of the host. Lines above
``ratio`` on at least ``min_pages`` pages are boilerplate and dropped from every page.
Lines compare lower-cased and trimmed; blank lines stay. Pages of a host with the same
text count once, as copies are no sign of boilerplate.

A host has at most (distinct lines a page) / ratio such lines, so its list is short
however many pages it has; lists are joined by host, which Spark broadcasts if their file
is small and else joins by shuffle, where AQE splits a hot host. Counts combine in the map tasks.

Null text: stays null, no lines. Null host: one host of its own. Repeated ids: each row
is a page. All columns are kept; helper columns are named so that they do not clash.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendlist.storage import settle

RATIO = 0.1
MIN_PAGES = 5


def _key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(line)))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, made longer until no column (in any case) has them."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, ratio=RATIO, min_pages=MIN_PAGES, text="text", host="source") -> DataFrame:
    """(host, drop): the hashes of the lines above the ratio, for hosts that have any."""
    pages = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("page"),
        F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""), _key)).alias("lines"),
    )
    held = pages.select("host", "page", F.explode("lines").alias("line")).distinct()
    held = held.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    return (
        held.join(totals, "host").where(F.col("pages") > ratio * F.col("total"))
        .groupBy("host").agg(F.collect_list("line").alias("drop"))
    )


def without_boilerplate(docs: DataFrame, ratio=RATIO, min_pages=MIN_PAGES, text="text", host="source") -> DataFrame:
    """All rows and columns with the lines dropped from ``text``, and n_lines, n_dropped."""
    of, drop, rest = unused(docs.columns, "__host", "__drop", "__kept")
    dropped = settle(boilerplate(docs, ratio, min_pages, text, host)).select(F.col("host").alias(of), F.col("drop").alias(drop))
    key = F.coalesce(F.col(host).cast("string"), F.lit(""))
    kept = F.filter(
        _lines(F.col(text)), lambda x: (F.trim(x) == "") | ~F.array_contains(drop, _key(x))
    )
    n = lambda lines: F.coalesce(F.size(lines), F.lit(0)).cast("long")
    shown = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    return (
        docs.join(dropped, key == F.col(of), "left")
        .withColumn(rest, F.when(F.col(drop).isNotNull(), kept))
        .select(
            *shown,
            F.when(F.col(rest).isNull(), F.col(text)).otherwise(F.array_join(rest, "\n")).alias(text),
            F.when(F.col(text).isNull(), 0).otherwise(n(_lines(F.col(text)))).cast("long").alias("n_lines"),
            F.when(F.col(rest).isNull(), 0).otherwise(n(_lines(F.col(text))) - n(F.col(rest))).cast("long").alias("n_dropped"),
        )
    )
