"""Connected components of links, by rounds of joins and aggregations."""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlist.storage import release, settle

#: Links that a task puts together at once.
CHUNK = 1 << 20


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _relink(arcs: DataFrame) -> DataFrame:
    """Every arc u -> v becomes v -> the least of u and the far ends of its arcs."""
    low = arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    moved = arcs.join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b")).union(
        low.select(F.col("u").alias("a"), F.col("low").alias("b"))
    )
    return moved.where("a != b").distinct()


def _forest(batches):
    """Links of a task, taken together by ``CHUNK``: each id is tied to the smallest one they reach from it."""

    def tied(a, b):
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        part = np.arange(len(ids))
        while (part[x] != part[y]).any():
            np.minimum.at(part, np.maximum(part[x], part[y]), np.minimum(part[x], part[y]))
            while (part != part[part]).any():
                part = part[part]
        moved = part != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[part[moved]])], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(2)])
        n += batch.num_rows
        if n >= CHUNK:
            yield tied(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield tied(*map(np.concatenate, zip(*held)))


def _tied(links: DataFrame) -> DataFrame:
    return settle(links.mapInArrow(_forest, "a long, b long"))


def _stored(links: DataFrame):
    """(links, tasks): what is left to tie, in as few tasks as ``CHUNK`` allows; with one, nothing is."""
    before = _tied(links)
    tasks = max(1, -(-before.count() // CHUNK))
    edges = _tied(before.coalesce(tasks))
    release(before)
    return edges, tasks


def _done(edges: DataFrame) -> bool:
    """Whether every id is tied to one other, which is tied to none."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("tied")).union(edges.select("b", F.lit(0)))
    ties = ends.groupBy("id").agg(F.sum("tied").alias("ties"), F.min("tied").alias("least"))
    return ties.where("ties > 1 OR ties > 0 AND least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, part): for each id on a link (a, b), the smallest id in reach.

    Links that lie in one task are put together there; tasks of few links are merged up to ``CHUNK``, however
    many partitions the session has, so no more than that is left of most inputs. Then
    two steps alternate until nothing is left to tie, in about the logarithm of the longest
    chain: tie the larger neighbours of each id to its smallest neighbour, then its
    smaller ones. Neighbours are aggregated, never listed, so a hub costs no more than
    its links. Links in any direction, repeated or to itself are fine.
    """
    ends = [F.col(c).cast("long") for c in ("a", "b")]
    edges, tasks = _stored(links.select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b")).where("a != b"))
    while tasks > 1 and not _done(edges):
        arcs = _directed(edges)
        low = arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        wide = arcs.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        wide = wide.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
        before, (edges, tasks) = edges, _stored(_relink(wide))
        release(before)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("part")).union(edges.select("b", "b").distinct())


cloudpickle.register_pickle_by_value(sys.modules[__name__])
