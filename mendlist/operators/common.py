"""Building blocks shared by the operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlist.storage import settle

BROADCAST_ROWS = 100_000  # narrow rows counted before they are broadcast
LIST_ROWS = 10_000  # elements of one part of a nested list


def short_id(value: Column) -> Column:
    """Bytes that stand for an id in joins, others for every other id: hashes in lower hex take half the room."""
    value = value.cast("string")
    code = F.unhex(value)
    marked = lambda mark, rest: F.concat(F.lit(bytearray([mark])), rest)
    return F.when(F.lower(F.hex(code)) == value, marked(0, code)).otherwise(marked(1, value.cast("binary")))


def keep_first(df: DataFrame, keys, order_by) -> DataFrame:
    """The first row of each key in ``order_by`` order.

    Filtering the row number to 1 lets Spark keep one row per key in every map
    task (WindowGroupLimit) before the shuffle, so a key with very many rows
    arrives as one row per task.
    """
    order_by = order_by if isinstance(order_by, (list, tuple)) else [order_by]
    numbered = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order_by)))
    return numbered.where("_n = 1").drop("_n")


def broadcast_if_few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only where ``rows``, a count made before, is small.

    ``df`` should be stored already, so that no long job runs inside the
    broadcast and its time limit.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def lookup(df: DataFrame, rows=BROADCAST_ROWS) -> DataFrame:
    """A lookup table for a join with many rows: broadcast if a count finds it small.

    Otherwise the join shuffles, and a key with very many rows would fill one
    partition until AQE splits it. Pass a stored table, so that the count reads
    file footers and the broadcast is a plain scan; beyond ``rows`` rows the
    table is left as it is.
    """
    return broadcast_if_few(df, df.limit(rows + 1).count())


def numbered(df: DataFrame, key: str, order_by, name="position") -> DataFrame:
    """0-based places of the rows of each key in ``order_by`` order (unique within the key).

    Rows are range-partitioned by key and order, so a key with very many rows lies in
    several consecutive partitions. A place is the row number within key and
    partition, plus the key's rows in the partitions before. Only the first key of a
    partition can have any, so that table has at most a row per partition.
    """
    order_by = list(order_by)
    dealt = settle(df.repartitionByRange(key, *order_by).withColumn("_deal", F.spark_partition_id()))
    counts = dealt.groupBy(key, "_deal").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(key).orderBy("_deal").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(key, "_deal", F.sum("_rows").over(before).alias("_before")).where("_before > 0")
    inside = F.row_number().over(W.partitionBy(key, "_deal").orderBy(*order_by)) - 1
    return (
        dealt.join(F.broadcast(offsets.withColumnsRenamed({key: "_key", "_deal": "_from"})),
                   F.col(key).eqNullSafe(F.col("_key")) & (F.col("_deal") == F.col("_from")), "left")
        .withColumn(name, (inside + F.coalesce("_before", F.lit(0))).cast("bigint"))
        .drop("_deal", "_key", "_from", "_before")
    )


def nest(df: DataFrame, key: str, row_id: str, element: Column, name: str, per_list=LIST_ROWS) -> DataFrame:
    """Lists of ``element`` per key, ordered by ``row_id``, rows alike in it by element.

    Every list comes in parts of ``per_list`` consecutive elements, numbered by
    ``part``; the parts of a key in order are its list, and no task ever holds more of it.
    Keys are counted first: those with one part, mostly all, are grouped as they are, and only
    the rows of longer lists get places.
    """
    rows = df.select(key, F.col(row_id).alias("_at"), element.alias("_item"))
    long = settle(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > per_list).select(F.col(key).alias("_long")))
    whole = F.array_sort(F.collect_list(F.struct("_at", "_item")))
    items = lambda ordered: F.transform(ordered, lambda x: x["_item"]).alias(name)
    one = F.lit(0).cast("bigint").alias("part")
    if long.isEmpty():
        return rows.groupBy(key).agg(items(whole)).select(key, one, name)
    same = F.col(key).eqNullSafe(F.col("_long"))
    few = lookup(long)
    placed = numbered(rows.join(few, same, "left_semi"), key, ["_at", "_item"], "_place")
    part = F.expr(f"_place div {per_list}").alias("part")
    in_parts = placed.groupBy(key, part).agg(items(F.array_sort(F.collect_list(F.struct("_place", "_item")))))
    short = rows.join(few, same, "left_anti").groupBy(key).agg(items(whole)).select(key, one, name)
    return in_parts.unionByName(short)
