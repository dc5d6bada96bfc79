"""Words, lines and rolling hashes of whole Arrow text columns, as flat numpy arrays.

Task-side helpers of the llm operators. A word is a maximal run of bytes other than
space and tab..carriage return, so no text is ever decoded. Everything is vectorised
over runs of texts of about ``RUN_BYTES``, which bounds the memory of a task whatever
the batch size; a longer text is a run of its own.

Hashes are 64 bits wide: a sum of byte (or word) codes times powers of an odd base,
modulo 2**64, then mixed. ``seed`` gives independent functions.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

RUN_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (SplitMix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def runs(*columns: pa.Array):
    """Slices of equally long columns, the first of texts, of about RUN_BYTES of text."""
    texts = columns[0]
    if isinstance(texts, pa.ChunkedArray):
        columns = [c.combine_chunks() for c in columns]
        texts = columns[0]
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN_BYTES, "right")) - 1)
        yield (texts.slice(at, to - at), *(c.slice(at, to - at) for c in columns[1:]))
        at = to


class Hasher:
    """Rolling hashes with tables of powers that grow with the longest run seen."""

    def __init__(self, seed: int = 0):
        with np.errstate(over="ignore"):
            codes = mix(np.arange(1, 261, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed * 1000003))
            self.codes = codes[:256]
            self.bases = [codes[256] | _U(1), codes[257] | _U(1)]
        self.salt = codes[258]
        self.tables = {}

    def _powers(self, which: int, n: int):
        known = self.tables.get(which)
        if known is None or len(known[0]) < n:
            base = int(self.bases[which])
            back = pow(base, -1, 1 << 64)
            tables = []
            for b in (base, back):
                t = np.full(n, b, np.uint64)
                t[:1] = 1
                tables.append(np.multiply.accumulate(t))
            known = self.tables[which] = tuple(tables)
        return known

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """A hash of values[start:end] for each pair; which: 0 for bytes, 1 for words."""
        with np.errstate(over="ignore"):
            up, down = self._powers(which, len(values) + 1)
            total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * up[: len(values)], out=total[1:])
            return mix((total[end] - total[start]) * down[start] + self.salt)


class Texts:
    """The words of a run of texts.

    data: all bytes; at: where each text begins in it (one more entry than texts);
    start, end: byte span of each word; first: index of each text's first word (one
    more entry than texts).
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        data, self.at = raw[at[0] : at[-1]], at - at[0]
        self.data = _LOWER[data] if lower else data
        n = len(data)
        space = _SPACE[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:] = space[:-1]
        after[:-1] = space[1:]
        inner = self.at[(self.at > 0) & (self.at < n)]
        before[inner] = True
        after[inner - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def word_hashes(self, hasher: Hasher) -> np.ndarray:
        return hasher.spans(hasher.codes[self.data], self.start, self.end)

    def windows(self, hasher: Hasher, hashes: np.ndarray, k: int):
        """(index of first word, hash) of every k consecutive words of one text."""
        begin = np.flatnonzero(np.arange(len(hashes)) + k <= self.first[1:][self.doc])
        return begin, hasher.spans(hashes, begin, begin + k, 1)

    def whole(self, hasher: Hasher, hashes: np.ndarray) -> np.ndarray:
        """A hash of each text's sequence of words."""
        return hasher.spans(hashes, self.first[:-1], self.first[1:], 1)

    def words_of(self, i: int) -> list[bytes]:
        return self.data[self.at[i] : self.at[i + 1]].tobytes().split()


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# shipped to the executors whole, which then need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
