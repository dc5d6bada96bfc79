"""Exact n-gram Jaccard join with adaptive multi-match prefixes, and its components.

Documents are sets of distinct word shingles. The shingles of each set are ordered from
rare to frequent by a count sketch of the whole corpus (ties by hash), one order for all.
Two sets that reach the threshold then share at least L of their first
``n - ceil(t * n) + L`` shingles, for every L: the longer the prefix, the more matches
can be demanded of a pair before it is compared in full. Each document takes the L of
least estimated cost; a pair uses the smaller L of its two documents.

The overlap a pair needs follows from its two sizes, and with it how early in both orders
its first L shared shingles must lie; later matches do not count.

Only what can change a component is compared. Identical sets are one class. Members of
a posting list are first compared with a few neighbours in it, which joins most of a
group of near copies by a number of comparisons in proportion to its size; then every
candidate pair that still lies in two components is compared. No pair is skipped otherwise,
so the components are exact.

Nulls, empty texts: no shingles, a component of their own. Null ids: linked with nothing,
their component is null. Fewer than k words: the whole
sequence is one shingle. Rows with the same id are texts of one document: links of any of them
are its links, so they fall into one component. Where such texts differ, each gets a number
of its own for the join. Columns other than the two named are neither read nor kept.
"""

import sys
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlist.llm.graph import components
from mendlist.llm.words import Hasher, Texts, mix, runs, signed
from mendlist.operators.common import numbered
from mendlist.storage import release, settle

#: Counters of the corpus sketch, which is 8 MB whatever the corpus, sent in blocks.
SKETCH = 1 << 21
BLOCK = 1 << 16
MAX_MATCHES = 16
#: Rounds of neighbour comparisons, each over another order of the posting lists, and how
#: many neighbours a round compares.
ROUNDS = 3
NEIGHBOURS = 3

_PROFILE = "id long, n int, d1 long, d2 long, block int, counts binary"
_PREFIX = "id long, n int, matches int, prefix array<long>"
_POSTING = "token long, id long, n int, rank int, matches int"
_SET = "id long, shingles array<long>"


def _sets(texts: pa.Array, hasher: Hasher, k: int):
    """The sorted distinct shingle hashes of each text."""
    t = Texts(texts, lower=True)
    words = t.word_hashes(hasher)
    begin, shingles = t.windows(hasher, words, k)
    first = np.searchsorted(begin, t.first)
    whole = t.whole(hasher, words)
    for i, n in enumerate(t.counts):
        if n >= k:
            part = np.sort(shingles[first[i] : first[i + 1]])
            yield part[np.r_[True, part[1:] != part[:-1]]]
        else:
            yield whole[i : i + 1] if n else whole[:0]


def _digests(s: np.ndarray):
    """Two digests of a set of shingle hashes."""
    return (np.bitwise_xor.reduce(mix(s)), np.add.reduce(s)) if len(s) else (np.uint64(0), np.uint64(0))


def _profiler(k: int):
    def profile(batches):
        hasher, counts, seen = Hasher(), np.zeros(SKETCH, np.int32), False
        for batch in batches:
            for texts, ids in runs(batch.column(1), batch.column(0)):
                n, d1, d2 = [], [], []
                for s in _sets(texts, hasher, k):
                    np.add.at(counts, (s & np.uint64(SKETCH - 1)).astype(np.int64), 1)
                    n.append(len(s))
                    for digests, d in zip((d1, d2), _digests(s)):
                        digests.append(d)
                seen = True
                none = pa.nulls(len(n))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int32()), signed(np.array(d1, np.uint64)), signed(np.array(d2, np.uint64)),
                     none.cast(pa.int32()), none.cast(pa.binary())],
                    names=["id", "n", "d1", "d2", "block", "counts"],
                )
        if seen:
            blocks = [zlib.compress(counts[a : a + BLOCK].tobytes(), 1) for a in range(0, SKETCH, BLOCK)]
            none = pa.nulls(len(blocks))
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()),
                 pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())],
                names=["id", "n", "d1", "d2", "block", "counts"],
            )

    return profile


def _add_blocks(batches):
    total = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(counts), np.int32)
            total[block] = total.get(block, 0) + part.astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
        names=["block", "counts"],
    )


def _sketch(profile: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each counter; of fixed size, so it may be broadcast."""
    blocks = SKETCH // BLOCK
    rows = (
        profile.where("block is not null").select("block", "counts").repartition(blocks, "block")
        .mapInArrow(_add_blocks, "block int, counts binary").collect()
    )
    total = np.zeros((blocks, BLOCK), np.int64)
    for block, counts in rows:
        total[block] += np.frombuffer(counts, np.int64)
    return np.minimum(total.reshape(-1), 2**31 - 1).astype(np.int32)


def _prefixes(k: int, percent: int, sketch):
    def matches_of(n: int, slack: int, others: np.ndarray) -> int:
        """The number of matches to demand: others is, by rank, how many more sets hold a shingle."""
        lists = np.cumsum(others)
        choices = range(1, max(1, min(MAX_MATCHES, n - slack)) + 1)
        # in rows sorted: the prefix, its lists, and sets of n for fewer candidates with each match more
        return min(choices, key=lambda m: slack + m + lists[slack + m - 1] * (0.1 + n / m**2 / 100))

    def prefixes(batches):
        hasher, counts = Hasher(), sketch.value
        noise = counts.mean()
        unsure = np.sqrt(noise)
        for batch in batches:
            for texts, ids in runs(batch.column(1), batch.column(0)):
                of, size, matches, prefix = [], [], [], []
                for i, s in zip(ids.to_numpy(), _sets(texts, hasher, k)):
                    n = len(s)
                    if not n:
                        continue
                    df = counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                    slack = n - -(-percent * n // 100)
                    most = slack + max(1, min(MAX_MATCHES, n - slack))
                    order = np.lexsort((s, df))[:most]
                    m = matches_of(n, slack, np.maximum(df[order] - 1 - noise, unsure))
                    of.append(i), size.append(n), matches.append(m), prefix.append(s[order[: slack + m]])
                if prefix:
                    at = np.r_[0, np.cumsum([len(p) for p in prefix])].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(of, pa.int64()), pa.array(size, pa.int32()), pa.array(matches, pa.int32()),
                         pa.ListArray.from_arrays(pa.array(at), signed(np.concatenate(prefix)))],
                        names=["id", "n", "matches", "prefix"],
                    )

    return prefixes


def _shared(percent: int):
    """Rows of posting lists, sorted by (token, n, id), that may be matches of some pair.

    A row's rank bounds the overlap, and with it the sizes a partner can have. ``lead``
    marks the rows that may be the first match of a pair. Short lists are tested pair by
    pair. The first and last list of a batch may go on in another and always stay.
    """
    span = 8

    def fitting(list_of, n, most):
        """Rows with another in their list for which the pair's need is within both bounds."""
        fits = np.zeros(len(n), bool)
        for lag in range(1, min(span, len(n) - 1) + 1):
            x, y = slice(None, -lag), slice(lag, None)
            need = -(-percent * (n[x] + n[y]) // (100 + percent))
            hit = (list_of[x] == list_of[y]) & (need <= np.minimum(most[x], most[y]))
            fits[x] |= hit
            fits[y] |= hit
        # longer lists: is there any other size from the smallest to the largest that fits
        key = list_of * (1 << 32) + n
        low = np.searchsorted(key, list_of * (1 << 32) + -(-percent * n // 100))
        top = np.minimum(most * (100 + percent) // percent - n, 100 * n // percent)
        high = np.searchsorted(key, list_of * (1 << 32) + np.maximum(top, 0), "right")
        length = np.searchsorted(list_of, list_of, "right") - np.searchsorted(list_of, list_of)
        return fits | ((length > span + 1) & (high - low - (top >= n) > 0))

    def sweep(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            token, n, rank, matches = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 2, 3, 4))
            list_of = np.cumsum(np.r_[False, token[1:] != token[:-1]])
            edge = (token == token[0]) | (token == token[-1])
            # at the l-th match the overlap cannot be more than n - rank + l
            lead = (rank <= n + 1 - -(-percent * n // 100)) & (edge | fitting(list_of, n, n - rank + 1))
            stays = edge | lead | fitting(list_of, n, n - rank + matches)
            named = pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead)], names=[*batch.schema.names, "lead"])
            yield named.filter(pa.array(stays))

    return sweep


def _neighbours(percent: int):
    """Pairs near each other in one posting list that lie in two components and may link."""

    def near(batches):
        for batch in batches:
            token, ids, part, n, rank = (batch.column(i).to_numpy() for i in range(5))
            pairs = []
            for lag in range(1, min(NEIGHBOURS, len(ids) - 1) + 1):
                x, y = slice(None, -lag), slice(lag, None)
                spare = -(-percent * (n[x].astype(np.int64) + n[y]) // (100 + percent)) - 1
                hit = (token[x] == token[y]) & (part[x] != part[y]) & (rank[x] <= n[x] - spare) & (rank[y] <= n[y] - spare)
                pairs.append(np.stack([ids[x][hit], ids[y][hit]], 1))
            if pairs:
                pairs = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return near


def _shingler(k: int):
    def shingles(batches):
        hasher = Hasher()
        for batch in batches:
            for texts, ids in runs(batch.column(1), batch.column(0)):
                sets = list(_sets(texts, hasher, k))
                at = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                flat = signed(np.concatenate(sets)) if sets else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(at), flat)], names=["id", "shingles"])

    return shingles


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b), stored, whose sets, made from the texts of these documents alone, link."""
    ids = settle(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = settle(docs.join(ids, "id", "left_semi").mapInArrow(_shingler(k), _SET))
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right")).cast("long")
    either = F.size("left") + F.size("right") - both
    found = settle(pairs.join(a, "a").join(b, "b").where(100 * both >= percent * either).select("a", "b"))
    release(ids, sets)
    return found


class _Links:
    """Verified links, and all pairs compared so far: none is compared twice."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent = docs, k, percent
        self.links, self.compared = [], []

    def _known(self, parts) -> DataFrame:
        return reduce(DataFrame.union, parts)

    def add(self, pairs: DataFrame) -> bool:
        """Compares the pairs (a, b) not compared yet; whether there were new links."""
        if self.compared:
            pairs = pairs.join(self._known(self.compared), ["a", "b"], "left_anti")
        pairs = settle(pairs)
        if not pairs.count():
            release(pairs)
            return False
        self.compared.append(pairs)
        self.links.append(_verified(pairs, self.docs, self.k, self.percent))
        return self.links[-1].count() > 0

    def all(self) -> DataFrame:
        return self._known(self.links) if self.links else self.docs.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)

    def release(self):
        release(*self.links, *self.compared)


_DEMAND = "least(matches_x, matches_y)"


def _need(percent: int) -> str:
    """The overlap that a pair needs, rounded up."""
    return f"(({percent} * (n_x + n_y) + {99 + percent}) div {100 + percent})"


def _early(percent: int):
    """The tokens shared by both prefixes, as far as the demanded first ones can lie."""
    sides = [
        f"slice(prefix_{s}, 1, size(filter(ranks_{s}, r -> r <= n_{s} - {_need(percent)} + {_DEMAND})))" for s in "xy"
    ]
    return F.expr(f"array_intersect({', '.join(sides)})")


def _with_part(lists: DataFrame, parts: DataFrame) -> DataFrame:
    return lists.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))


def _across(lists: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Every candidate pair whose documents lie in two components, once.

    lists: token, id, part, rank. In each posting list the largest component is not joined with
    itself, so a list costs its length times what lies outside of it. A pair is made at its
    first shared token, if it shares as many as demanded early enough.
    """
    sizes = lists.groupBy("token", "part").agg(F.count("*").alias("rows"))
    main = sizes.groupBy("token").agg(
        F.max_by("part", F.struct("rows", "part")).alias("main"), F.min("part").alias("low"), F.max("part").alias("high")
    ).where("low < high").select("token", "main")
    mixed = lists.select("token", "id", "part", "rank").join(main, "token").join(prefixes, "id")
    fields = ("id", "n", "matches", "ranks", "prefix", "part", "rank")
    x = mixed.where("part != main").select("token", *[F.col(c).alias(f"{c}_x") for c in fields])
    y = mixed.withColumnsRenamed({c: f"{c}_y" for c in fields})
    # the cheap conditions come first
    meets = F.expr(
        f"part_x != part_y AND (part_y = main OR id_x < id_y) AND {_need(percent)} <= least(n_x, n_y)"
        f" AND rank_x <= n_x - {_need(percent)} + 1 AND rank_y <= n_y - {_need(percent)} + 1"
    )
    first = F.exists(
        F.array(_early(percent)), lambda shared: (F.size(shared) >= F.expr(_DEMAND)) & (shared[0] == x["token"])
    )
    return x.join(y, (x["token"] == y["token"]) & meets & first).select(
        F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")
    )


def _promising(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share as many tokens of their prefixes as demanded, early enough."""
    sides = [
        prefixes.select(F.col("id").alias(c), *[F.col(f).alias(f"{f}_{s}") for f in ("n", "matches", "ranks", "prefix")])
        for c, s in (("a", "x"), ("b", "y"))
    ]
    return pairs.join(sides[0], "a").join(sides[1], "b").where(F.size(_early(percent)) >= F.expr(_DEMAND)).select("a", "b")


def _marked(k: int):
    """Texts with the size and digests of their sets."""

    def mark(batches):
        hasher = Hasher()
        for batch in batches:
            for texts, ids in runs(batch.column(1), batch.column(0)):
                sets = list(_sets(texts, hasher, k))
                yield pa.RecordBatch.from_arrays(
                    [ids, texts.cast(pa.string()), pa.array([len(s) for s in sets], pa.int32()),
                     *(signed(np.array(d, np.uint64)) for d in zip(*map(_digests, sets)))],
                    names=["id", "text", "n", "d1", "d2"],
                )

    return mark


def _numbered_apart(docs: DataFrame, profile: DataFrame, k: int):
    """(docs, profile, other): ids that have texts with different sets get a number for each of these.

    other: number, id; None if there are no such ids. Numbers are below (above, if there is no room) all ids.
    """
    digests = F.struct("n", "d1", "d2")
    texts = profile.where("n > 0 and id is not null")
    several = settle(
        texts.groupBy("id").agg(F.min(digests).alias("low"), F.max(digests).alias("high")).where("low != high").select("id")
    )
    if not several.count():
        release(several)
        return docs, profile, None
    edge = profile.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    other = settle(texts.join(several, "id", "left_semi").select("id", "n", "d1", "d2").distinct())
    # consecutive numbers, whatever the partitions
    other = numbered(other.withColumn("all", F.lit(0)), "all", ["id", "n", "d1", "d2"], "place").drop("all")
    below = edge.low > -(1 << 62)
    other = settle(other.withColumn("number", F.lit(edge.low - 1) - F.col("place") if below else F.lit(edge.high + 1) + F.col("place")).drop("place"))
    apart = docs.join(several, "id", "left_semi").mapInArrow(_marked(k), "id long, text string, n int, d1 long, d2 long")
    apart = apart.join(other, ["id", "n", "d1", "d2"]).select(F.col("number").alias("id"), "text")
    docs = docs.join(several, "id", "left_anti").union(apart)
    renamed = profile.join(other, ["id", "n", "d1", "d2"], "left").withColumn("id", F.coalesce("number", "id")).drop("number")
    return settle(docs), settle(renamed.select(*profile.columns)), other


def jaccard_components(docs: DataFrame, k: int, percent: int, id="doc_id", text="text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents linked at ``percent`` % or more.

    component_id is the smallest id that links reach from a document, itself included.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    profile = settle(docs.mapInArrow(_profiler(k), _PROFILE))
    sketch = spark.sparkContext.broadcast(_sketch(profile))
    docs, profile, other = _numbered_apart(docs, profile.where("block is null").select("id", "n", "d1", "d2"), k)
    sets = profile.where("n > 0 and id is not null")
    classes = settle(sets.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1"))
    # identical sets: all but the first of each class
    copies = settle(sets.join(classes, ["n", "d1", "d2"]).where("id != rep").select("id", "rep"))
    release(classes)
    gone = settle(copies.select("id").distinct())
    firsts = docs.where("id is not null").join(gone, "id", "left_anti")
    full = settle(firsts.mapInArrow(_prefixes(k, percent, sketch), _PREFIX))
    lists = full.select("id", "n", "matches", F.posexplode("prefix").alias("pos", "token")).select(
        "token", "id", "n", (F.col("pos") + 1).alias("rank"), "matches"
    )
    lists = lists.repartitionByRange("token", "n", "id").sortWithinPartitions("token", "n", "id")
    rows = settle(lists.mapInArrow(_shared(percent), f"{_POSTING}, lead boolean"))
    release(full)
    # what is left of each prefix, a few shared tokens, in order of rank
    left = rows.groupBy("id").agg(
        F.first("n").alias("n"), F.first("matches").alias("matches"),
        F.array_sort(F.collect_set(F.struct("rank", "token", "lead"))).alias("rows"),
    )
    shared = settle(left.where("exists(rows, r -> r.lead)").select(
        "id", "n", "matches", F.col("rows.rank").alias("ranks"), F.col("rows.token").alias("prefix"), F.col("rows.lead").alias("leads")
    ))
    release(rows)
    lists = shared.select("id", "n", "ranks", "prefix", "leads", F.posexplode("prefix").alias("pos", "token")).where("leads[pos]")
    lists = settle(lists.select(
        "token", "id", "n", F.expr("ranks[pos]").alias("rank"),
        # what follows in the prefix: rows of a list that agree on it are the most alike
        F.xxhash64(F.slice("prefix", F.col("pos") + 2, 3)).alias("tail"),
    ))
    prefixes = shared.drop("leads")

    found, parts = _Links(firsts, k, percent), None
    for turn in range(ROUNDS):
        if turn:
            near = _with_part(lists, parts).withColumn("deal", F.xxhash64("id", F.lit(turn)))
            near = near.repartitionByRange("token", "tail", "deal").sortWithinPartitions("token", "tail", "deal")
        else:
            near = lists.withColumn("part", F.col("id")).repartitionByRange("token", "n", "id").sortWithinPartitions("token", "n", "id")
        near = near.select("token", "id", "part", "n", "rank").mapInArrow(_neighbours(percent), "a long, b long")
        more = found.add(_promising(near.distinct(), prefixes, percent))
        if more or parts is None:
            parts = settle(components(found.all()))
        if not more:
            break
    if found.add(_across(_with_part(lists, parts), prefixes, percent)):
        parts = settle(components(found.all()))
    release(lists, shared)

    links = parts.select(F.col("id").alias("rep"), F.col("part").alias("component"))
    # all copies of a set share its first document's component
    same = copies.join(links, "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    known = same.union(links.select(F.col("rep").alias("id"), "component"))
    if other is None:
        known = settle(known.groupBy("id").agg(F.min("component").alias("component")))
    else:
        known = _joined_again(known, other)
        numbers = other.select(F.col("number").alias("id"), F.col("id").alias("own"))
        profile = profile.join(numbers, "id", "left").withColumn("id", F.coalesce("own", "id"))
    found.release()
    release(copies, gone)
    return profile.select("id", "n").join(known, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
    )


def _joined_again(known: DataFrame, other: DataFrame) -> DataFrame:
    """(id, component) by ids proper, where the texts of an id are linked with each other."""
    links = known
    for column in ("id", "component"):
        own = other.select(F.col("number").alias(column), F.col("id").alias("own"))
        links = links.join(own, column, "left").withColumn(column, F.coalesce("own", column)).drop("own")
    return settle(components(links.select(F.col("id").alias("a"), F.col("component").alias("b"))).withColumnRenamed("part", "component"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
