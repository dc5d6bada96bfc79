"""Vector code compression: product codes by per-dimension value dictionaries.

Each component becomes the integer floor(256 * x), and each vector is cut into equal parts.
Vectors are stored once in blocks: per dimension the block's distinct integers (its
dictionary) and each row's place in it. To assign the parts of a block, the squared
differences of every distinct integer to all codebook entries are tabulated; the distances
of a part are then rows gathered from these tables by dictionary code, and added. All of it
is exact integer arithmetic. Blocks have a fixed number of rows, so a task's memory
depends neither on the data nor on how many integers occur.

Codebooks (parts * entries * width integers) are all that reaches the driver. A round sums
members by entry inside each task; what is shuffled does not grow with the rows of a task.

Dropped: vectors that are null, empty, hold null or non-finite components, do not divide into equal
parts, or are of another length than the first kept one (smallest id). A kept component of 2**20 or
more in size raises an error, since distances would leave 64 bits. Null ids come last
where ids are ordered; rows with the same id count one by one, ordered by their vectors.
Fewer kept rows than entries: shorter codebooks. No kept rows: no result rows. Columns
other than the three named are neither read nor kept.
"""

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlist.storage import settle

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Rows of a block; a place in a dictionary then fits 16 bits.
BLOCK_ROWS = 4096
#: Largest size of an integer: sums of squared differences stay within 64 bits.
LARGEST = 1 << 28


def _finite(vector):
    # NaN is not below infinity either
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def _integers(column: pa.Array) -> np.ndarray:
    """Rows of floor(SCALE * x)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component of {LARGEST // SCALE} or more: its distances do not fit 64 bits")
    return scaled.astype(np.int64).reshape(len(column), -1)


def _encode(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            ids, vectors, labels = batch.slice(at, BLOCK_ROWS).columns
            integers = _integers(vectors)
            found = [np.unique(column, return_inverse=True) for column in integers.T]
            one = pa.array([0, len(ids)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(one, ids),
                    pa.ListArray.from_arrays(one, labels),
                    pa.array([[len(values) for values, _ in found]], pa.list_(pa.int32())),
                    pa.array([np.concatenate([values for values, _ in found]).tobytes()], pa.binary()),
                    pa.array([np.concatenate([codes for _, codes in found]).astype(np.uint16).tobytes()], pa.binary()),
                ],
                names=["ids", "labels", "sizes", "dictionary", "codes"],
            )


def _dimensions(sizes, dictionary: bytes, codes: bytes):
    """(distinct integers, code of each row) by dimension."""
    values = np.split(np.frombuffer(dictionary, np.int64), np.cumsum(sizes)[:-1])
    return list(zip(values, np.frombuffer(codes, np.uint16).reshape(len(sizes), -1)))


def _nearest(dimensions, book: np.ndarray):
    """(entry, squared distance) of each row for one part; book: entries by dimension of the part."""
    total = 0
    for (values, codes), entry in zip(dimensions, book.T):
        table = (values[:, None] - entry[None, :]) ** 2
        total = total + table[codes]
    best = total.argmin(axis=1)  # the first of equal ones
    return best, np.take_along_axis(total, best[:, None], axis=1)[:, 0]


def _members(books: np.ndarray):
    parts, entries, width = books.shape

    def sums(batches):
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for sizes, dictionary, codes in zip(*(c.to_pylist() for c in batch.columns)):
                dimensions = _dimensions(sizes, dictionary, codes)
                for p in range(parts):
                    mine = dimensions[p * width : (p + 1) * width]
                    best, _ = _nearest(mine, books[p])
                    count[p] += np.bincount(best, minlength=entries)
                    for j, (values, at) in enumerate(mine):
                        # whole numbers below 2**53, so doubles hold the sums of a block
                        total[p, :, j] += np.bincount(best, weights=values[at], minlength=entries).astype(np.int64)
        p, e = np.nonzero(count)
        for j in range(width):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (p, e, np.full(len(p), j), count[p, e], total[p, e, j])],
                names=["part", "entry", "place", "members", "total"],
            )

    return sums


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry at the mean of its members, rounded down; entries without members stay."""
    sums = blocks.select("sizes", "dictionary", "codes").mapInArrow(
        _members(books), "part long, entry long, place long, members long, total long"
    )
    # one row per number of the codebooks
    rows = sums.groupBy("part", "entry", "place").agg(
        F.sum("members").alias("members"), F.sum(F.col("total").cast("decimal(19,0)")).alias("total")
    ).collect()
    books = books.copy()
    for r in rows:
        books[r.part, r.entry, r.place] = int(r.total) // r.members
    return books


def _coder(books: np.ndarray):
    parts, _, width = books.shape

    def code(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                dimensions = _dimensions(*(batch.column(c)[i].as_py() for c in (2, 3, 4)))
                found = [_nearest(dimensions[p * width : (p + 1) * width], books[p]) for p in range(parts)]
                text = np.stack([best for best, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([text[a : a + step] for a in range(0, len(text), step)], pa.string()),
                     pa.array(sum(error for _, error in found))],
                    names=["vec_id", "label", "code", "error"],
                )

    return code


class Codes:
    """Codes of all kept vectors, and the codebooks they refer to (part, entry, place)."""

    def __init__(self, rows: DataFrame, books: np.ndarray):
        #: vec_id, label, code, error
        self.rows = rows
        self.books = books

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, id="vec_id", vector="embedding", label="label"
) -> Codes:
    """Codebooks after ``rounds`` rounds over all kept vectors, and every vector's code and error."""
    if not 1 <= entries <= 256:
        raise ValueError("a code holds two hex digits per part: 1 to 256 entries")
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    rows = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0) & _finite(F.col("vector")))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector")
    start = [r.vector for r in first.collect()]
    if len({len(v) for v in start}) > 1:
        rows = rows.where(F.size("vector") == len(start[0]))
        first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector")
        start = [r.vector for r in first.collect()]
    elif start:
        rows = rows.where(F.size("vector") == len(start[0]))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    blocks = settle(rows.mapInArrow(
        _encode, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, sizes array<int>, dictionary binary, codes binary"
    ))
    width = len(start[0]) // parts if start else 1
    books = np.zeros((parts, 0, width), np.int64)
    if start:
        cut = _integers(pa.array(start, pa.list_(pa.float64()))).reshape(len(start), parts, width)
        books = np.ascontiguousarray(cut.transpose(1, 0, 2))
        for _ in range(rounds):
            books = _moved(blocks, books)
    coded = blocks.mapInArrow(_coder(books), f"vec_id {kinds['id']}, label {kinds['label']}, code string, error long")
    return Codes(settle(coded), books)


def with_label_errors(codes: Codes) -> DataFrame:
    """vec_id, code, error, label_error and the digest of the codebooks, one row per kept vector."""
    # stored, so that a label of a third of all rows can be split in the join
    totals = settle(codes.rows.groupBy("label").agg(F.sum("error").alias("label_error")))
    same = codes.rows["label"].eqNullSafe(totals["label"])
    return codes.rows.join(totals, same).select(
        "vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256")
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
