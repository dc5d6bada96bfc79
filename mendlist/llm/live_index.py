"""Exact dedup over a live index: sharded cuckoo filters before bucketed content.

The index holds the digest of every live text. A digest belongs to one shard, and there to
two buckets of a cuckoo filter of 16-bit fingerprints. A text that the filter does not
know is new, without a look at the content. A hit is verified against the records of the digest's
first bucket: whole digest, row that stays, number of copies. If an insertion finds no
free slot, the shard's filter is doubled and filled again from its stored keys. A deletion
lowers the copies of a record; with the last copy the record and its fingerprint go.

Tasks put equal digests together before rows are shuffled by shard, so that a text of a third
of all rows reaches its shard as a few rows per task. Shards grow in number with the entries;
a task holds one shard at a time. Records and filters are rows of one table, made anew by each change.

Of equal texts (equal after runs of space and tab..carriage return become one
space; null is empty) the row with the smallest id stays; null ids come last, and of rows
that share the smallest id the first loaded one stays. Columns other than the two named are
neither read nor kept. An empty table gives no rows.
"""

import sys
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendlist.storage import settle

SLOTS = 4
KICKS = 100
FIRST_BUCKETS = 1 << 8
#: Entries of a shard, on average, beyond which an index takes more shards.
SHARD_ENTRIES = 1 << 17
LEAST_SHARDS = 16
#: Distinct digests that a task puts together at once.
COMBINED = 1 << 16

_CHANGE = "digest binary, id long, load int, row long, copies long"
_STATE = f"shard int, {_CHANGE}, buckets int, cells binary"


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints of digests."""

    def __init__(self, buckets: int, cells: bytes | None = None):
        self.mask = buckets - 1
        self.cells = memoryview(bytearray(cells or bytes(2 * SLOTS * buckets))).cast("H")

    @staticmethod
    def _mark(digest: bytes) -> int:
        return int.from_bytes(digest[8:10]) or 1

    def first(self, digest: bytes) -> int:
        return int.from_bytes(digest[10:14]) & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 >> 3) & self.mask

    def _slot(self, bucket: int, mark: int) -> int:
        """The place of a mark in a bucket, or -1."""
        for at in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if self.cells[at] == mark:
                return at
        return -1

    def _find(self, digest: bytes) -> int:
        mark, bucket = self._mark(digest), self.first(digest)
        at = self._slot(bucket, mark)
        return at if at >= 0 else self._slot(self._other(bucket, mark), mark)

    def holds(self, digest: bytes) -> bool:
        return self._find(digest) >= 0

    def add(self, digest: bytes) -> bool:
        """False if the filter is too full; it has then lost a fingerprint and must be made anew."""
        mark, bucket = self._mark(digest), self.first(digest)
        for turn in range(KICKS):
            for b in (bucket, self._other(bucket, mark)):
                at = self._slot(b, 0)
                if at >= 0:
                    self.cells[at] = mark
                    return True
            # the turn chooses who moves, so that runs repeat
            bucket = self._other(bucket, mark)
            at = SLOTS * bucket + turn % SLOTS
            mark, self.cells[at] = self.cells[at], mark
            bucket = self._other(bucket, mark)
        return False

    def remove(self, digest: bytes):
        self.cells[self._find(digest)] = 0


class Shard:
    """Live digests of one shard. A record: digest, (null id, id, load, row) of the row that stays, copies."""

    def __init__(self, buckets: int = FIRST_BUCKETS, cells: bytes | None = None):
        self.filter = Cuckoo(buckets, cells)
        self.content = defaultdict(list)

    def find(self, digest: bytes):
        if self.filter.holds(digest):
            for record in self.content[self.filter.first(digest)]:
                if record[0] == digest:
                    return record
        return None

    def restore(self, record: list):
        """A stored record whose fingerprint the filter has already."""
        self.content[self.filter.first(record[0])].append(record)

    def insert(self, digest: bytes, stays: tuple, copies: int):
        record = self.find(digest)
        if record:
            record[1] = min(record[1], stays)
            record[2] += copies
        else:
            self.restore([digest, stays, copies])
            if not self.filter.add(digest):
                self._resize()

    def delete(self, digest: bytes, stays: tuple, copies: int):
        """Takes copies away; ``stays`` is the row that stays of those left."""
        record = self.find(digest)
        if record and record[2] > copies:
            record[1], record[2] = stays, record[2] - copies
        elif record:
            self.content[self.filter.first(digest)].remove(record)
            self.filter.remove(digest)

    def _resize(self):
        records, buckets = self.records(), self.filter.mask + 1
        full = True
        while full:
            buckets *= 2
            self.filter = Cuckoo(buckets)
            full = not all(self.filter.add(r[0]) for r in records)
        self.content.clear()
        for r in records:
            self.restore(r)

    def records(self) -> list:
        return [r for bucket in self.content.values() for r in bucket]


def _combine(batches):
    """Changes of a task with equal digests put together."""
    found = {}

    def flush():
        rows = [(d, k[1], k[2], k[3], n) for d, (k, n) in found.items()]
        found.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
            names=["digest", "id", "load", "row", "copies"],
        )

    for batch in batches:
        for digest, id, load, row in zip(*(c.to_pylist() for c in batch.columns)):
            key = (id is None, id, load, row)
            known = found.get(digest)
            if known:
                found[digest] = (min(known[0], key), known[1] + 1)
            else:
                if len(found) >= COMBINED:
                    yield flush()
                found[digest] = (key, 1)
    if found:
        yield flush()


def _dump(number: int, shard: Shard):
    rows = [(d, k[1], k[2], k[3], n, None, None) for d, k, n in shard.records()]
    rows.append((None, None, None, None, None, shard.filter.mask + 1, shard.filter.cells.tobytes()))
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([number] * len(rows), pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))],
        names=["shard", "digest", "id", "load", "row", "copies", "buckets", "cells"],
    )


def _update(batches):
    """Rows sorted by shard: its filter, its records, its changes."""
    shard, number = None, None
    for batch in batches:
        for at, digest, id, load, row, copies, buckets, cells, stored in zip(*(c.to_pylist() for c in batch.columns)):
            if at != number:
                if shard:
                    yield _dump(number, shard)
                shard, number = Shard(), at
                filtered = cells is not None
            key = (id is None, id, load, row)
            if cells is not None:
                shard = Shard(buckets, cells)
            elif stored and filtered:
                shard.restore([digest, key, copies])
            elif copies > 0:
                shard.insert(digest, key, copies)
            else:
                shard.delete(digest, key, -copies)
    if shard:
        yield _dump(number, shard)


def normal_digest(text: Column) -> Column:
    """SHA-256 of a text whose white space is normalised, as 32 bytes."""
    one_space = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[ \x09-\x0D]+", " ")
    return F.unhex(F.sha2(one_space, 256))


def _shard_of(digest: Column, shards: int) -> Column:
    # the filter takes other bytes of the digest
    return (F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long") % shards).cast("int")


@dataclass
class Index:
    #: One stored table per load: digest, id, load, row.
    entries: list[DataFrame]
    #: Records and filters by shard.
    state: DataFrame
    shards: int
    loads: int

    def live(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.entries)

    def records(self) -> DataFrame:
        return self.state.where("digest is not null")


def _changed(state: DataFrame | None, changes: DataFrame, shards: int, resharded: bool) -> DataFrame:
    rows = changes.select(
        _shard_of(F.col("digest"), shards).alias("shard"), "*", F.lit(None).cast("int").alias("buckets"),
        F.lit(None).cast("binary").alias("cells"), F.lit(False).alias("stored"),
    )
    if state is not None:
        stored = state.withColumn("stored", F.lit(True))
        if resharded:  # filters are made anew from the stored keys
            stored = stored.where("digest is not null").withColumn("shard", _shard_of(F.col("digest"), shards))
        rows = stored.unionByName(rows)
    order = ("shard", F.col("cells").isNull(), (~F.col("stored")))
    return settle(rows.repartition("shard").sortWithinPartitions(*order).mapInArrow(_update, _STATE))


def _shards_for(entries: int) -> int:
    shards = LEAST_SHARDS
    while shards * SHARD_ENTRIES < entries:
        shards *= 2
    return shards


def insert(index: Index | None, docs: DataFrame, id="doc_id", text="text") -> Index:
    """The index after every row of ``docs`` has gone in; None: a new one."""
    load = index.loads if index else 0
    fresh = settle(docs.select(
        normal_digest(F.col(text)).alias("digest"), F.col(id).cast("long").alias("id"), F.lit(load).alias("load"),
        F.monotonically_increasing_id().alias("row"),
    ))
    entries = [*index.entries, fresh] if index else [fresh]
    shards = max(_shards_for(sum(e.count() for e in entries)), index.shards if index else 0)
    changes = fresh.mapInArrow(_combine, _CHANGE)
    state = _changed(index and index.state, changes, shards, bool(index) and shards != index.shards)
    return Index(entries, state, shards, load + 1)


def delete(index: Index, ids: DataFrame, id="doc_id") -> Index:
    """The index without the entries that have one of these ids; null deletes nothing."""
    ids = ids.select(F.col(id).cast("long").alias("id")).distinct()
    live = index.live()
    gone = settle(live.join(ids, "id", "left_semi").groupBy("digest").agg(F.count("*").alias("n")))
    left = settle(live.join(ids, "id", "left_anti").select("digest", "id", "load", "row"))
    stays = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "load", "row")).alias("s")
    heirs = left.join(gone.select("digest"), "digest", "left_semi").groupBy("digest").agg(stays)
    changes = gone.join(heirs, "digest", "left").select(
        "digest", F.col("s.id").alias("id"), F.col("s.load").alias("load"), F.col("s.row").alias("row"), (-F.col("n")).alias("copies")
    )
    return Index([left], _changed(index.state, changes, index.shards, False), index.shards, index.loads)


def known(index: Index, docs: DataFrame, id="doc_id", text="text") -> DataFrame:
    """(doc_id, keep_id) of the rows of ``docs`` whose text is live; the index stays as it is.

    The filters drop new texts first, one question per digest; only hits are joined with the content.
    """
    rows = settle(docs.select(F.col(id).alias("doc_id"), normal_digest(F.col(text)).alias("digest")))
    asked = rows.select("digest").distinct().withColumn("shard", _shard_of(F.col("digest"), index.shards))
    asked = asked.withColumns({"buckets": F.lit(None).cast("int"), "cells": F.lit(None).cast("binary")})
    filters = index.state.where("cells is not null").select("digest", "shard", "buckets", "cells")
    hits = filters.unionByName(asked).repartition("shard").sortWithinPartitions("shard", F.col("cells").isNull())
    hits = hits.mapInArrow(_hits, "digest binary")
    found = settle(hits.join(index.records().select("digest", F.col("id").alias("keep_id")), "digest"))
    return rows.join(found, "digest").select("doc_id", "keep_id")


def _hits(batches):
    filter, number = None, None
    for batch in batches:
        stays = []
        for digest, shard, buckets, cells in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "buckets", "cells"))):
            if shard != number:
                filter, number = None, shard
            if cells is not None:
                filter = Cuckoo(buckets, cells)
            stays.append(digest is not None and filter is not None and filter.holds(digest))
        yield batch.select(["digest"]).filter(pa.array(stays, pa.bool_()))


def members(index: Index) -> DataFrame:
    """One row per live entry: doc_id, keep_id, group_size, kept, text_sha256."""
    records = index.records().select(
        "digest", F.col("id").alias("keep_id"), F.col("load").alias("of_load"), F.col("row").alias("of_row"),
        F.col("copies").alias("group_size"),
    )
    return index.live().join(records, "digest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        (F.expr("load = of_load and row = of_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
