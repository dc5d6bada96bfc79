"""Collocations from an FM-index per shard: word ids, bidirectional interval extension, sums across shards.

Each run of documents becomes a shard: the sequence of its word ids, pieces set apart by the id 0,
and the Burrows-Wheeler transforms of that sequence (``left``: the word before
each suffix) and of its reverse (``right``: the word after each prefix). Suffixes are
ordered by as many words as the longest phrase has, which is all that intervals of such depth need.
A phrase is a pair of intervals of one size, its count in the shard; extending it to
one side reads that side's transform and keeps both intervals in step. Levels are extended alternately
to the right and to the left, all phrases of a level at once.

Counts are summed across shards. What cannot reach the limit is left out early and
without loss: a phrase is only extended if its words, and all its shorter phrases,
may reach the limit in the whole corpus. That is known from bitmaps of a fixed
largest size, made from sums of phrase hashes, which travel packed by range of hashes; a false positive costs a row. Last, the
phrases that pass are counted by their spelling, so results are exact. Spelled counts are added up by task and travel
packed as well, sorted, by range of the hashes of what is spelled.

Words, pieces: lower-cased A-Z; pieces end at ``[.,;:!?\\x0A-\\x0D]``, words at space and tab.
A text of more than ``SHARD_WORDS`` words is cut into several shards; each reaches over the next one's first
words, and what lies in the overlap is counted once more with sign -1. Null texts are
empty; null groups are named ``und``. Repeated rows count each time. An empty table has no phrases.
Columns other than the two named are neither read nor kept.
"""

import sys
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendlist.llm.words import mix, signed
from mendlist.storage import release, settle

#: Bytes of text and words of a shard: about 80 MB of task memory.
SHARD_BYTES = 2 << 20
SHARD_WORDS = 1 << 19
#: Largest size of a bitmap, and bits for each phrase known to pass as long as it is smaller.
BITMAP = 1 << 27
BITS_EACH = 16
#: Rows sent to Python at once: texts, and shards, which are large.
TEXTS_AT_ONCE = 1000
SHARDS_AT_ONCE = 1
#: Hashes a task adds up before it sends them, and words of the corpus for each range of hashes, about 100 MB of task memory.
HASHES_AT_ONCE = 3 << 19
RANGE_WORDS = 1 << 21
#: Bytes of spelled counts a task adds up before it sends them, about 150 MB of task memory, and shards of the corpus for each range.
SPELLED_AT_ONCE = 48 << 20
RANGE_SHARDS = 16
_DEALS = 8  # of ranges, added up one after the other
_BUCKET = 32768  # bits of one value of bitmap_construct_agg

_U = np.uint64
_SHARD = "sign int, langs array<string>, words binary, lang_of binary, first binary, left binary, right binary"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _ENDS.copy()
_GAPS[[9, 32]] = True


def _pack(values: np.ndarray, kind=np.int32) -> bytes:
    """Numbers, byte by byte of all of them, as most bytes but the lowest are zero."""
    planes = values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) + len(values).to_bytes(8, "little")


def _unpack(data: bytes, kind=np.int32) -> np.ndarray:
    size, width = int.from_bytes(data[-8:], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[:-8], decompressed_size=width * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, size).T).view(kind).ravel()


def _order(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes, sorted by their first ``depth`` words or more, else in any order."""
    rank, width = sequence, 1
    while True:
        # as many neighbours in one number as 62 bits hold
        bits = max(1, int(rank.max()).bit_length())
        joined = min(62 // bits, -(-depth // width))
        key = rank
        for j in range(1, joined):
            key = (key << bits) | np.roll(rank, -j * width)
        width *= joined
        if width >= depth:
            return np.argsort(key)
        rank = np.unique(key, return_inverse=True)[1]


def _sequences(texts: pa.Array, langs: pa.Array):
    """(word ids from 1 and 0 between pieces, words, language names, language of each word) of a run of texts."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _LOWER[np.frombuffer(raw, np.uint8)[at[0] : at[-1]]] if raw is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    gap = _GAPS[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = gap[:-1]
    after[:-1] = gap[1:]
    inner = at[(at > 0) & (at < len(data))]
    before[inner] = True
    after[inner - 1] = True
    start = np.flatnonzero(~gap & before)
    if not len(start):
        return None
    length = np.flatnonzero(~gap & after) + 1 - start
    piece = np.searchsorted(np.flatnonzero(_ENDS[data]), start)
    doc = np.searchsorted(at, start, "right") - 1
    # the bytes of all words, one after the other
    cuts, flat = pa.py_buffer(np.r_[0, np.cumsum(length)]), pa.py_buffer(data[~gap])
    encoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, cuts, flat]).dictionary_encode()
    del gap, before, after
    lang = langs.dictionary_encode()
    code = encoded.indices.to_numpy().astype(np.int64)
    lang_of = lang.indices.to_numpy().astype(np.int64)[doc]
    keys, ids = np.unique(lang_of * len(encoded.dictionary) + code, return_inverse=True)
    new = np.r_[False, (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])]
    sequence = np.zeros(len(ids) + int(new.sum()), np.int64)
    sequence[np.arange(len(ids)) + np.cumsum(new)] = ids + 1
    lang_of, code = np.divmod(keys, len(encoded.dictionary))
    return sequence, encoded.dictionary.take(pa.array(code)), lang.dictionary, lang_of


def _shard(sequence, words, langs, lang_of, sign: int, depth: int):
    """One stored row. Only words that occur in the sequence are kept."""
    seen = np.bincount(sequence, minlength=len(words) + 1) > 0
    seen[0] = False
    used = np.flatnonzero(seen)
    if len(used) < len(words):
        sequence = np.cumsum(seen)[sequence] * seen[sequence]
        words, lang_of = words.take(pa.array(used - 1)), lang_of[used - 1]
    sequence = np.r_[0, sequence, 0].astype(np.int64)
    counts = np.bincount(sequence, minlength=len(used) + 1)
    # read in turn: sequence[i - 1] stands before suffix i, and before it in the reverse what follows
    left = np.roll(sequence, 1)[_order(sequence, depth)]
    back = sequence[::-1]
    right = np.roll(back, 1)[_order(back, depth)]
    text = b"\n".join(words.to_pylist())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([sign], pa.int32()),
            pa.array([langs.to_pylist()], pa.list_(pa.string())),
            pa.array([pa.compress(text, codec="zstd", asbytes=True) + len(text).to_bytes(8, "little")], pa.binary()),
            *(pa.array([_pack(x)], pa.binary()) for x in (lang_of, counts, left, right)),
        ],
        names=["sign", "langs", "words", "lang_of", "first", "left", "right"],
    )


def _indexer(depth: int):
    def index(batches):
        for batch in batches:
            texts, langs = batch.columns
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))]
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SHARD_BYTES, "right")) - 1)
                # only the run is copied
                run = texts.slice(at, to - at).cast(pa.large_string()).fill_null("")
                found = _sequences(run, langs.slice(at, to - at).fill_null("und"))
                at = to
                if found is None:
                    continue
                sequence, *rest = found
                for a in range(0, len(sequence), SHARD_WORDS):
                    part = sequence[a : a + SHARD_WORDS + depth - 1]
                    if part.any():
                        yield _shard(part, *rest, 1, depth)
                    over = part[SHARD_WORDS:]
                    if over.any():
                        yield _shard(over, *rest, -1, depth)

    return index


class _Index:
    """A shard as read back. Phrases of a level: ids (one row each), low ends of both intervals, sizes."""

    def __init__(self, langs, words, lang_of, first, left, right):
        text = pa.decompress(words[:-8], decompressed_size=int.from_bytes(words[-8:], "little"), codec="zstd", asbytes=True)
        self.words = pa.array([b"", *text.split(b"\n")], pa.binary()).cast(pa.string())
        self.lang_of = np.r_[0, _unpack(lang_of)]
        self.langs = pa.array(langs, pa.string())
        self.counts = _unpack(first).astype(np.int64)
        # read when a level first needs them
        self.packed = {"left": left, "right": right}
        self.sides, self.steps = {}, {}
        starts = np.r_[0, np.cumsum(self.counts)[:-1]]
        ids = np.arange(1, len(self.counts))
        self.level = ids[:, None], {"left": starts[1:], "right": starts[1:]}, self.counts[1:]

    def side(self, to: str) -> np.ndarray:
        if to not in self.sides:
            self.sides[to] = _unpack(self.packed.pop(to))
        return self.sides[to]

    def _step(self, to: str) -> np.ndarray:
        """Where the row that begins with the word before (after) a row's phrase lies."""
        if to not in self.steps:
            order = np.argsort(self.side(to), kind="stable")
            step = np.empty(len(order), np.int32)
            step[order] = np.arange(len(order))
            self.steps[to] = step
        return self.steps[to]

    def keep(self, chosen: np.ndarray):
        ids, low, size = self.level
        self.level = ids[chosen], {s: x[chosen] for s, x in low.items()}, size[chosen]

    def extend(self, to: str):
        """All phrases of the level, longer by one word on one side."""
        ids, low, size = self.level
        away = "right" if to == "left" else "left"
        begin = np.r_[0, np.cumsum(size)]
        of = np.repeat(np.arange(len(size)), size)
        row = np.arange(begin[-1]) - begin[of] + low[to][of]
        word = self.side(to)[row]
        key = of * len(self.counts) + word
        del word
        order = np.argsort(key)
        key, row = key[order], row[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(key)))
        of, word = np.divmod(key[new], len(self.counts))
        first = np.minimum.reduceat(row, new) if len(new) else new
        # the rows of smaller words come first on the other side
        lows = {to: self._step(to)[first], away: low[away][of] + new - begin[of]}
        added = word[:, None]
        grown = np.hstack([added, ids[of]] if to == "left" else [ids[of], added])
        self.level = grown, lows, count
        self.keep(word > 0)

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        return _phrase_hashes(self.known, ids)

    @property
    def known(self):
        if not hasattr(self, "_known"):
            self._known = _word_hashes(self.words) ^ _word_hashes(self.langs)[self.lang_of]
        return self._known

    def spelled(self):
        """(group, phrase, count) of the level."""
        ids, _, size = self.level
        parts = [self.words.take(pa.array(column)) for column in ids.T]
        phrase = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
        return self.langs.take(pa.array(self.lang_of[ids[:, 0]])), phrase, size


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings: sums of byte codes by place, mixed."""
    words = words.cast(pa.large_string())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    length = np.diff(at)
    place = np.arange(len(data)) - np.repeat(at[:-1], length)
    with np.errstate(over="ignore"):
        codes = mix(data.astype(_U) * _U(0x9E3779B97F4A7C15) + place.astype(_U))
        total = np.r_[_U(0), np.cumsum(codes, dtype=_U)]
        return mix(total[at[1:]] - total[at[:-1]] + length.astype(_U))


def _phrase_hashes(known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A hash of each row of word ids; known: the hash of each id."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(ids), _U)
        for j, column in enumerate(ids.T):
            total += mix(known[column] + _U(j + 1))
    return mix(total)


def _hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may pass."""
    place = hashes & _U(8 * len(bitmap) - 1)
    return (bitmap[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1


def _bitmap(spark, hashes: DataFrame):
    """A broadcast bitmap of a column ``h`` of hashes, collected in blocks of fixed number and size."""
    bits = _BUCKET
    count = hashes.count()
    while bits < BITMAP and bits < count * BITS_EACH:
        bits *= 2
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    # bit positions of the aggregate start at 0 in bucket 1
    blocks = hashes.select(place.alias("p")).groupBy((F.expr(f"p div {_BUCKET}")).alias("block")).agg(
        F.bitmap_construct_agg(F.col("p") % _BUCKET).alias("cells")
    )
    found = {r.block: bytes(r.cells) for r in blocks.collect()}
    whole = b"".join(found.get(b, bytes(_BUCKET // 8)) for b in range(bits // _BUCKET))
    return spark.sparkContext.broadcast(np.frombuffer(whole, np.uint8))


def _side(size: int) -> str:
    """The side on which phrases of this many words get another."""
    return "right" if size % 2 else "left"


def _levels(index: _Index, longest: int, passing: list):
    """Levels 1 to longest, extended only where bitmaps of the shorter ones let pass.

    passing: bitmaps by size, from 1; a level that has one keeps what may pass.
    """
    for size in range(1, longest + 1):
        if size > 1:
            index.extend(_side(size - 1))
            ids = index.level[0]
            # the shorter phrase without the outermost word on the other side
            other = ids[:, :-1] if _side(size - 1) == "left" else ids[:, 1:]
            index.keep(_hold(passing[size - 2].value, index.hashes(other)))
        if size <= len(passing):
            index.keep(_hold(passing[size - 1].value, index.hashes(index.level[0])))
        yield size


def _open(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            sign, *parts = (c[i].as_py() for c in batch.columns)
            yield sign, _Index(*parts)
            pa.default_memory_pool().release_unused()


#: Group and phrase are counted as one text; a phrase holds no line break.
_SPELLED = "key string, f long"
_SPELLED_RANGES = "range int, numbers binary, text binary"


def _spelled(index, sign, bits: int) -> pa.Table:
    group, phrase, count = index.spelled()
    key = pc.binary_join_element_wise(group, phrase, "\n")
    of = (index.hashes(index.level[0]) & _U((1 << bits) - 1)).astype(np.int32)
    return pa.table({"range": of, "key": key, "f": sign * count})


def _added_spelled(parts: list) -> list:
    """Counts by range and spelling, of some ranges in each table, since adding up takes memory."""
    table = pa.concat_tables(parts)
    deal = pc.bit_wise_and(table["range"], _DEALS - 1)
    added = []
    for j in range(_DEALS):
        some = table.filter(pc.equal(deal, j))
        if some.num_rows:
            some = some.group_by(["range", "key"], use_threads=False).aggregate([("f", "sum")])
            added.append(some.rename_columns({"f_sum": "f"}).select(["range", "key", "f"]))
        pa.default_memory_pool().release_unused()
    return added


def _pack_spelled(keys: pa.Array, counts: np.ndarray):
    """(lengths and counts, text) of spelled counts; sorted ones take the least room."""
    at = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
    text = keys.buffers()[2].slice(int(at[0]), int(at[-1] - at[0]))
    return _pack(np.concatenate([np.diff(at), counts]), np.int64), pa.compress(text, codec="zstd", asbytes=True)


def _unpack_spelled(numbers: bytes, text: bytes):
    numbers = _unpack(numbers, np.int64)
    size = len(numbers) // 2
    at = np.r_[0, np.cumsum(numbers[:size])].astype(np.int32)
    text = pa.decompress(text, decompressed_size=int(at[-1]), codec="zstd")
    return pa.StringArray.from_buffers(size, pa.py_buffer(at), text), numbers[size:]


def _send_spelled(tables):
    """Packed counts by range: of a task's tables, added up as long as that makes little of them."""

    def emit(table):
        table = table.sort_by([("range", "ascending"), ("key", "ascending")]).combine_chunks()
        of, counts = table["range"].to_numpy(), table["f"].to_numpy()
        keys = table["key"].combine_chunks()
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        packed = [_pack_spelled(keys.slice(a, b - a), counts[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(of)))]
        numbers, texts = (pa.array(x, pa.binary()) for x in zip(*packed))
        return pa.RecordBatch.from_arrays([pa.array(of[cuts]), numbers, texts], names=["range", "numbers", "text"])

    parts = []
    for table in tables:
        if table.num_rows:
            parts.append(table)
        if sum(t.nbytes for t in parts) > SPELLED_AT_ONCE:
            parts = _added_spelled(parts)
            # sent if adding up made little of it
            if 3 * sum(t.nbytes for t in parts) > 2 * SPELLED_AT_ONCE:
                while parts:
                    yield emit(parts.pop())
    if parts:
        parts = _added_spelled(parts)
        while parts:
            yield emit(parts.pop())


def _sums_spelled(least: int | None):
    """The spelled counts of a range, from all its packed ones; those that reach the limit if there is one."""

    def add(batches):
        for batch in batches:
            for packed in batch.column(0):
                parts = [_unpack_spelled(*(x.as_py() for x in row)) for row in zip(*packed.values.flatten())]
                parts = [pa.table({"range": np.zeros(len(f), np.int32), "key": key, "f": f}) for key, f in parts]
                for table in _added_spelled(parts):
                    if least is not None:
                        table = table.filter(pc.greater_equal(table["f"], least))
                    yield from table.select(["key", "f"]).to_batches()

    return add


def _apart(counts: DataFrame) -> DataFrame:
    """lang, size, phrase, f."""
    phrase = F.substring_index("key", "\n", -1)
    parts = counts.select("key", phrase.alias("phrase"), "f")
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1
    return parts.select(F.expr("substring(key, 1, length(key) - length(phrase) - 1)").alias("lang"), size.alias("size"), "phrase", "f")


def _first_words(bits: int):
    def count(batches):
        yield from _send_spelled(_spelled(index, sign, bits) for sign, index in _open(batches))

    return count


def _added(parts: list):
    """Sorted hashes and the sums of their counts."""
    hashes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(hashes)
    hashes = hashes[order]
    new = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])[: len(hashes)]
    return hashes[new], np.add.reduceat(counts[order], new) if len(new) else counts


def _pack_counts(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as steps, and counts."""
    return _pack(np.concatenate([np.diff(hashes, prepend=0), counts]), np.int64)


def _unpack_counts(data: bytes):
    both = _unpack(data, np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


_RANGES = "range long, counts binary"


def _hash_counts(size: int, passing: list, bits: int, shift: int):
    """Counts of the hashes of a level, packed by range: hashes alike but for the lowest ``shift`` bits."""

    def emit(hashes, counts):
        of = hashes >> shift
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])[: len(of)]
        packed = [_pack_counts(hashes[a:b], counts[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(of)))]
        return pa.RecordBatch.from_arrays([pa.array(of[cuts]), pa.array(packed, pa.binary())], names=["range", "counts"])

    def count(batches):
        parts = []
        for sign, index in _open(batches):
            for at in _levels(index, size, passing):
                if at == size:
                    ids, _, n = index.level
                    parts.append(((index.hashes(ids) & _U((1 << bits) - 1)).astype(np.int64), sign * n))
            if sum(len(h) for h, _ in parts) > HASHES_AT_ONCE:
                parts = [_added(parts)]
                # sent if adding up made little of it
                if 2 * len(parts[0][0]) > HASHES_AT_ONCE:
                    yield emit(*parts.pop())
        if parts:
            yield emit(*_added(parts))

    return count


def _frequent_hashes(least: int):
    """The hashes of a range that reach the limit, from all its packed counts."""

    def choose(batches):
        for batch in batches:
            for packed in batch.column(0):
                hashes, counts = _added([_unpack_counts(x.as_py()) for x in packed.values])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[counts >= least])], names=["h"])

    return choose


def _phrase_counts(longest: int, passing: list, bits: int):
    def levels(batches):
        for sign, index in _open(batches):
            for size in _levels(index, longest, passing):
                if size > 1:
                    yield _spelled(index, sign, bits)

    def count(batches):
        yield from _send_spelled(levels(batches))

    return count


def _hash_words(batches):
    for batch in batches:
        known = _word_hashes(batch.column(1)) ^ _word_hashes(batch.column(0))
        yield pa.RecordBatch.from_arrays([signed(_phrase_hashes(known, np.arange(len(known))[:, None]))], names=["h"])


@contextmanager
def _rows_at_once(spark, rows: int):
    """Jobs run inside send so many rows to Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Phrases:
    """frequent: lang, size, phrase, f of all phrases (single words too) that reach the limit. totals: lang, n."""

    def __init__(self, frequent: DataFrame, totals: DataFrame):
        self.frequent, self.totals = frequent, totals


def count_phrases(docs: DataFrame, longest=3, least=10, text="text", lang="lang") -> Phrases:
    """Counts of all phrases of 1 to ``longest`` words that occur ``least`` times or more in their group."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    with _rows_at_once(spark, TEXTS_AT_ONCE):
        shards = settle(texts.mapInArrow(_indexer(longest), _SHARD))

    def summed(task, least=None) -> DataFrame:
        packed = shards.mapInArrow(task, _SPELLED_RANGES)
        ranges = packed.groupBy("range").agg(F.collect_list(F.struct("numbers", "text")).alias("parts")).select("parts")
        return _apart(ranges.mapInArrow(_sums_spelled(least), _SPELLED))

    spelled_bits = (shards.count() // RANGE_SHARDS).bit_length()
    with _rows_at_once(spark, SHARDS_AT_ONCE):
        words = settle(summed(_first_words(spelled_bits)))
    totals = settle(words.groupBy("lang").agg(F.sum("f").alias("n")))
    words = words.where(F.col("f") >= least)
    passing = [_bitmap(spark, settle(words.select("lang", "phrase").mapInArrow(_hash_words, "h long")))]
    # as many bits as keep most phrases apart, since those that share a hash are counted as one here
    n_words = totals.agg(F.sum("n")).first()[0] or 1
    bits = max(BITMAP.bit_length(), min(63, 5 + n_words.bit_length()))
    shift = bits - max(0, int(n_words // RANGE_WORDS).bit_length())
    for size in range(2, longest + 1):
        with _rows_at_once(spark, SHARDS_AT_ONCE):
            packed = shards.mapInArrow(_hash_counts(size, list(passing), bits, shift), _RANGES)
            ranges = packed.groupBy("range").agg(F.collect_list("counts").alias("parts")).select("parts")
            hashes = settle(ranges.mapInArrow(_frequent_hashes(least), "h long"))
        passing.append(_bitmap(spark, hashes))
    with _rows_at_once(spark, SHARDS_AT_ONCE):
        longer = settle(summed(_phrase_counts(longest, passing, spelled_bits), least))
    found = Phrases(settle(words.select("lang", "size", "phrase", "f").union(longer)), totals)
    release(shards, longer)
    return found


def _inner(phrase: Column, size: Column, least: int) -> Column:
    """All shorter phrases of ``least`` words or more that lie contiguously in a phrase."""
    words = F.split(phrase, " ")
    lengths = F.sequence(F.lit(least), size - 1)
    return F.flatten(F.transform(lengths, lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")
    )))


def collocations(phrases: Phrases, shortest=2, top=2000, covered_percent=50, scale=1000000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each group.

    score: the least of floor(scale * a * a / (l * r)) over all cuts of a phrase in two.
    A phrase goes if a longer one that holds it reaches ``covered_percent`` of its count.
    """
    frequent = phrases.frequent
    candidates = frequent.where(F.col("size") >= shortest)
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    # head and tail are the phrase, which is put together again when both are counted
    cuts = cuts.select(
        "lang", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"),
        F.expr("substring(phrase, length(substring_index(phrase, ' ', k)) + 2)").alias("tail"),
    )
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    # products of three counts: decimals of 38 digits
    exact = F.expr(f"cast((cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * {scale}) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", exact)
    scored = scored.withColumn("phrase", F.concat_ws(" ", "head", "tail"))
    least = F.min(F.struct("score", "k", "l", "r", "a")).alias("c")
    scored = scored.groupBy("lang", "phrase").agg(least).select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    covers = candidates.where(F.col("size") > shortest).select(
        "lang", F.explode(_inner(F.col("phrase"), F.col("size"), shortest)).alias("phrase"), "f"
    ).groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    free = scored.join(covers, ["lang", "phrase"], "left").where(
        F.col("cover").isNull() | (F.col("cover") * 100 < F.col("a") * covered_percent)
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(phrases.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
