"""Cost-balanced packing of documents into token sequences of fixed capacity.

The cost of a piece of n tokens is estimated as ``n + n * n / quadratic``: work in
proportion to its tokens, and attention within the piece that grows with its square.
Documents are packed in blocks of about ``BLOCK_TOKENS`` as they are read, so nothing is
gathered: memory is bounded by a block (or one document), and a skewed source is no issue.
In a block:

* every ``capacity`` tokens of a longer document fill a sequence of their own;
* the tails, in order of descending cost, go to the sequence of least cost with room for them;
* a tail that fits nowhere whole is cut over the sequences of least cost with any room;
* what is left in the end beyond full sequences is cut into lengths that are powers of two.

There are exactly as many sequences as full ones are needed, so no sequence holds padding:
each is full, or as long as a power of two.

Null and empty texts: the end token alone. Each row is a document of its own, whatever
its id. Sequence ids are unique within a result: partition number and count; the same
files read in the same partitions give the same result.
"""

import heapq
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlist.llm.tokens import Vocabulary

CAPACITY = 1024
QUADRATIC = 512
BLOCK_TOKENS = 1 << 20
END = 0

_PIECE = (
    "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


class _LeastByRoom:
    """Entries by free room, and the least of all with at least some room, in logarithmic time.

    A tree over the amounts of room: each node holds the least entry below it.
    """

    def __init__(self, most: int):
        self.half = 1 << most.bit_length()
        self.tree = [None] * (2 * self.half)
        self.heaps = [[] for _ in range(self.half)]

    def _renew(self, room: int):
        at = room + self.half
        top = self.heaps[room][0] if self.heaps[room] else None
        while self.tree[at] != top:
            self.tree[at] = top
            if at == 1:
                break
            other = self.tree[at ^ 1]
            if other is not None and (top is None or other < top):
                top = other
            at >>= 1

    def push(self, room: int, entry):
        heap = self.heaps[room]
        heapq.heappush(heap, (*entry, room))
        if heap[0][1] == entry[1]:
            self._renew(room)

    def pop(self, room: int):
        """The least entry with this much room or more, or None."""
        a, b, best = room + self.half, 2 * self.half, None
        while a < b:
            if a & 1:
                top = self.tree[a]
                if top is not None and (best is None or top < best):
                    best = top
                a += 1
            a >>= 1
            b >>= 1
        if best is not None:
            heapq.heappop(self.heaps[best[2]])
            self._renew(best[2])
        return best


def place(lengths: list[int], capacity: int = CAPACITY, quadratic: int = QUADRATIC):
    """(document index, start, length, sequence, offset) of each piece of one block."""
    pieces, tails, sequence = [], [], 0
    for i, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((i, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            tails.append((n % capacity, i, n - n % capacity))
    total = sum(n for n, _, _ in tails)
    # full sequences, then powers of two for the rest
    room = [capacity] * (total // capacity)
    room += [1 << b for b in range(capacity.bit_length()) if total % capacity >> b & 1]
    used, cost = [0] * len(room), [0.0] * len(room)
    least = _LeastByRoom(capacity)
    for s, free in enumerate(room):
        least.push(free, (0.0, s))
    queue = [(-n, i, start) for n, i, start in tails]
    heapq.heapify(queue)
    while queue:
        n, i, start = heapq.heappop(queue)
        # of all with room for it the one of least cost; if there is none, the document is cut
        entry = least.pop(-n) or least.pop(1)
        s = entry[1]
        free = room[s] - used[s]
        part = min(-n, free)
        pieces.append((i, start, part, sequence + s, used[s]))
        used[s] += part
        cost[s] += part + part * part / quadratic
        if part < free:
            least.push(free - part, (cost[s], s))
        if part < -n:
            heapq.heappush(queue, (part + n, i, start + part))
    return pieces, sequence + len(room)


def _packer(vocabulary: Vocabulary, capacity: int, quadratic: int):
    def pack(batches):
        encoder, begun = vocabulary.encoder(), TaskContext.get().partitionId() << 33
        ids, encoded, held = [], [], 0

        def flush():
            nonlocal begun
            pieces, count = place([len(e) for e in encoded], capacity, quadratic)
            rows = [
                (ids[i], start, n, encoded[i][start : start + n].tobytes(), len(encoded[i]), begun + s, at)
                for i, start, n, s, at in pieces
            ]
            begun += count
            ids.clear(), encoded.clear()
            columns = zip(*rows) if rows else [[]] * 7
            names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                encoded.append(np.append(encoder.ids(text.as_py()), np.uint32(END)).astype("<u4"))
                held += len(encoded[-1])
                if held >= BLOCK_TOKENS:
                    held = 0
                    yield flush()
        if ids:
            yield flush()

    return pack


def packed(docs: DataFrame, capacity=CAPACITY, quadratic=QUADRATIC, vocabulary=None, id="doc_id", text="text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its token ids.

    ids: little-endian unsigned 32-bit numbers, one after the other.
    """
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    pieces = docs.mapInArrow(_packer(vocabulary or Vocabulary(), capacity, quadratic), _PIECE)
    return pieces.withColumnRenamed("id", "doc_id")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
