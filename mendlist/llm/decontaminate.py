"""Benchmark decontamination by spaced seeds, with DataFrame functions alone.

Tokens are the lower-cased runs of letters and digits. A mask picks three of ``SPAN``
consecutive tokens and ignores the rest, so a seed survives substitutions in ignored
places. Seeds of all test items and of all documents, at every position, are joined by
hash. A hit gives an alignment of item and document; its overlap is verified token by
token: the item leaks if at least ``share`` percent of its tokens stand in place, or if some
``stretch`` aligned tokens hold at most ``misses`` substitutions.

No such overlap is lost: of five aligned tokens on average three or more stand in place where
60 % of an item do, so somewhere three of five do, and every choice of three of five is a mask.
A stretch of 13 with 2 substitutions has four equal tokens in a row. What seeds do not guarantee
(``share`` under 60, or stretches that need not hold three of five) is refused. Masks that differ by a shift alone give
one seed, and a seed may end with its text, so edges lose nothing. An overlap that is a leak has
at least ``needed`` seeds; alignments with fewer are dropped before any text is read again.

The seeds of all documents are never shuffled: a bitmap of the items' seeds, which grows with
their number up to ``MOST_WORDS`` longs and therefore is broadcast, lets by those that may match; then the
exact join, by Spark's choice of strategy. Only documents with enough hits are read again, and all
alignments of a document and an item are verified in one row, each over the item's length.

Items of one or two tokens have one seed, their whole sequence, and documents get seeds of that
length only if there are such items. Of items of up to three tokens just exact copies are found.

Null and empty texts: no seeds, never a hit. Repeated and null item
ids: each row is an item. Repeated and null document ids: each text is searched on its own, and
gives rows under its id; equal texts of one id give them once.
"""

from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendlist.storage import settle

SPAN = 5
MASKS = tuple("".join("01"[k in c] for k in range(SPAN)) for c in combinations(range(SPAN), 3))
# without the shifts: 111, 1101, 1011, 11001, 10101, 10011
SEEDS = tuple(sorted({m.strip("0") for m in MASKS}, key=lambda m: (len(m), m)))
SHARE = 60
#: Under it, an overlap may have no three of five aligned tokens in place.
LEAST_SHARE = 60
STRETCH = 13
MISSES = 2

#: Longs of the bitmap: 32 bits or more a seed, within these bounds.
LEAST_WORDS = 1 << 15
MOST_WORDS = 1 << 18


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text."""
    split = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(split, lambda t: t != ""), lambda t: F.xxhash64(t))


def _fewest(top: int) -> dict[tuple[int, int], int]:
    """{(length, matches): fewest seeds} of an overlap, for lengths up to ``top``."""
    # by the last SPAN - 1 places; a match ends as many seeds as there are pairs of matches among them
    state, found = {(0, 0): 0}, {}
    for length in range(1, top + 1):
        after = {}
        for (last, n), seeds in state.items():
            for x in (0, 1):
                key = (last << 1 | x) & ((1 << (SPAN - 1)) - 1), n + x
                total = seeds + x * comb(last.bit_count(), 2)
                after[key] = min(total, after.get(key, total))
        state = after
        for (_, n), seeds in state.items():
            found[length, n] = min(seeds, found.get((length, n), seeds))
    return found


def needed(share: int, stretch: int, misses: int, top: int = 64) -> list[int]:
    """Place n: the fewest seeds of a leak of an item of n tokens; the last place holds for longer items too."""
    fewest = _fewest(max(top, stretch))

    def least(lengths, matches):
        return min((s for (m, n), s in fewest.items() if m in lengths and n >= matches), default=0)

    run = least(range(1, stretch + 1), stretch - misses)
    rows = [least(range(1, n + 1), ceil(share * n / 100)) for n in range(top + 1)]
    # the overlap of a longer item falls into pieces of top / 2 to top tokens, one of them with its share,
    # or is itself shorter than that
    pieces = [least(range(m, m + 1), ceil(share * m / 100)) for m in range(top // 2, top + 1)]
    short = least(range(1, top // 2), ceil(share * top / 100))
    rows[top] = min(rows[top], *pieces, *([short] if share * top < 50 * top else []))
    return [max(1, min(n, run)) for n in rows]


def _seeds(rows: DataFrame, keys: list[str], masks: list[str]) -> DataFrame:
    """(*keys, at, s0, s1, ...): a seed per mask for each place of ``tokens``; null where the mask does not fit."""
    shifted = F.arrays_zip(*[
        F.slice("tokens", F.lit(k + 1), F.greatest(F.size("tokens") - k, F.lit(0))).alias(f"t{k}") for k in range(SPAN)
    ])
    places = rows.select(*keys, F.posexplode(shifted).alias("at", "t"))
    places = places.select(*keys, "at", "t.*")
    seeds = [
        F.when(F.col(f"t{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(j), *[f"t{k}" for k, c in enumerate(m) if c == "1"]))
        for j, m in enumerate(masks)
    ]
    return places.select(*keys, "at", *[s.alias(f"s{j}") for j, s in enumerate(seeds)])


def _word(seed: Column, words: int) -> Column:
    return F.shiftrightunsigned(seed, 6).bitwiseAND(words - 1)


def _unpivoted(seeds: list[Column]) -> Column:
    """A row per seed that is not null."""
    return F.explode(F.filter(F.array(*seeds), lambda s: s.isNotNull())).alias("seed")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, digest, item, shift, n_seeds): document place less item place of shared seeds, and their number.

    docs: id, digest (of the text), tokens; items: item (unique), tokens.
    """
    # at most two rows: the lengths of items too short for a seed
    sizes = items.select(F.size("tokens").alias("n")).where("n between 1 and 2").distinct().collect()
    used = [*SEEDS, *("1" * n for n in sorted(r.n for r in sizes))]
    masks = range(len(used))
    own = [F.col(f"s{j}") for j in masks]
    known = _seeds(items.where(F.size("tokens") > 2), ["item"], used).select("item", "at", _unpivoted(own[: len(SEEDS)]))
    for j in masks[len(SEEDS):]:
        short = items.where(F.size("tokens") == len(used[j]))
        known = known.union(_seeds(short, ["item"], used).where("at = 0").select("item", "at", own[j]))
    known = settle(known)
    words, seeds = LEAST_WORDS, known.count()
    while words < MOST_WORDS and 2 * words < seeds:
        words *= 2
    bitmap = known.groupBy(_word(F.col("seed"), words).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("bits")
    )
    places, may = _seeds(docs, ["id", "digest"], used), []
    for j in masks:
        # at most MOST_WORDS rows of two numbers
        part = F.broadcast(bitmap.select(F.col("word").alias(f"w{j}"), F.col("bits").alias(f"b{j}")))
        places = places.join(part, _word(F.col(f"s{j}"), words) == F.col(f"w{j}"), "left")
        bit = F.getbit(F.coalesce(f"b{j}", F.lit(0).cast("long")), F.col(f"s{j}").bitwiseAND(63).cast("int"))
        may.append(F.when(bit == 1, F.col(f"s{j}")))
    passed = places.where(F.coalesce(*may).isNotNull()).select("id", "digest", "at", _unpivoted(may))
    at = known.select("seed", "item", F.col("at").alias("item_at"))
    found = passed.join(at, "seed").select("id", "digest", "item", (F.col("at") - F.col("item_at")).alias("shift"))
    return found.groupBy("id", "digest", "item", "shift").agg(F.count("*").alias("n_seeds"))


def _digest(text: Column) -> Column:
    """Tells the texts of one id apart; where it does not, more is verified, and nothing lost."""
    return F.xxhash64(text)


def _found(docs: DataFrame, items: DataFrame, share: int, stretch: int, misses: int) -> DataFrame:
    """(id, digest, item, shift, n_matches, n_item, longest) of documents (id, digest, text) and items (item, tokens)."""
    # misses leave one run of equal tokens at least this long
    run = -(-(stretch - misses) // (misses + 1))
    if share < LEAST_SHARE or run < 3:
        raise ValueError(f"seeds do not guarantee overlaps of {share} %, or of {stretch - misses} in {stretch} tokens")
    least = needed(share, stretch, misses)
    enough = F.element_at(F.array(*map(F.lit, least)), F.least(F.size("tokens"), F.lit(len(least) - 1)) + 1)
    bounds = items.select("item", enough.alias("enough"))
    found = hits(docs.select("id", "digest", tokens(F.col("text")).alias("tokens")), items)
    found = found.join(bounds, "item").where(F.col("n_seeds") >= F.col("enough"))
    # as many alignments as a document has places, at most
    found = settle(found.groupBy("id", "digest", "item").agg(F.collect_list("shift").alias("shifts")))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["digest"] == b["digest"])
    some = settle(found.select("id", "digest").distinct())
    again = docs.join(some, same(docs, some), "left_semi").dropDuplicates(["id", "digest"])
    again = settle(again.select("id", "digest", tokens(F.col("text")).alias("tokens")))
    pairs = found.join(again, same(found, again)).select(found["id"], found["digest"], "item", "shifts", "tokens")
    pairs = pairs.join(items.withColumnRenamed("tokens", "asked"), "item")
    low, high = "greatest(0, -s)", "least(size(asked), size(tokens) - s)"
    equal = (
        f"zip_with(slice(asked, {low} + 1, greatest(0, {high} - {low})), slice(tokens, s + {low} + 1, greatest(0, {high} - {low})),"
        " (a, b) -> int(a = b))"
    )
    aligned = F.explode(F.expr(f"transform(shifts, s -> named_struct('shift', s, 'equal', {equal}))")).alias("a")
    best = F.expr(
        f"array_max(transform(sequence(1, greatest(1, size(equal) - {stretch - 1})),"
        f" i -> aggregate(slice(equal, i, {stretch}), 0, (n, x) -> n + x)))"
    )
    rows = pairs.select("id", "digest", "item", F.size("asked").alias("n_item"), aligned).select("id", "digest", "item", "n_item", "a.*")
    return (
        rows.select(
            "id", "digest", "item",
            *[c.cast("long").alias(n) for n, c in (
                ("shift", F.col("shift")), ("n_matches", F.expr("aggregate(equal, 0, (n, x) -> n + x)")),
                ("n_item", F.col("n_item")), ("longest", best),
            )],
        )
        .where((100 * F.col("n_matches") >= share * F.col("n_item")) | (F.col("longest") >= stretch - misses))
    )


def _items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """item: a number of the row's own; item_id; tokens."""
    items = items.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text).cast("string")).alias("tokens"))
    return settle(items.where(F.size("tokens") > 0).withColumn("item", F.monotonically_increasing_id()))


def _docs(docs: DataFrame, id: str, text: str) -> DataFrame:
    docs = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return docs.where(F.col("text").isNotNull()).withColumn("digest", _digest(F.col("text")))


def leaks(docs: DataFrame, items: DataFrame, share=SHARE, stretch=STRETCH, misses=MISSES,
          id="doc_id", text="text", item_id="item_id", item_text="text") -> DataFrame:
    """(doc_id, item_id, shift, n_matches, n_item, longest): each verified overlap.

    shift: token of the document at which the item would begin; n_matches: its tokens in
    place; longest: the most matches among ``stretch`` aligned tokens.
    """
    items = _items(items, item_id, item_text)
    found = _found(_docs(docs, id, text), items.select("item", "tokens"), share, stretch, misses)
    return found.join(items.select("item", "item_id"), "item").select(
        F.col("id").alias("doc_id"), "item_id", "shift", "n_matches", "n_item", "longest"
    )


def without_leaks(docs: DataFrame, items: DataFrame, share=SHARE, stretch=STRETCH, misses=MISSES,
                  id="doc_id", text="text", item_id="item_id", item_text="text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; rows are told apart by id (null too) and text."""
    items = _items(items, item_id, item_text)
    found = _found(_docs(docs, id, text), items.select("item", "tokens"), share, stretch, misses)
    gone = settle(found.select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct())
    same = F.col(id).eqNullSafe(gone["gone_id"]) & (_digest(F.col(text).cast("string")) == gone["gone_digest"])
    return docs.join(gone, same, "left_anti")
