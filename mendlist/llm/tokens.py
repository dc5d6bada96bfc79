"""Task-side tokenisation with the byte-level BPE of a public vocabulary file.

Ids equal those of the ``tokenizers`` library for the file named. The rank form of the
same vocabulary encodes faster, and a bounded cache keeps the ids of pieces seen before:
a blank between two non-blank characters always begins a new piece, so text without
other white space next to a blank is the sum of its pieces. Any other text, and text with
the spelling of a special token, is encoded whole.
"""

import array
import base64
import re
import sys

import numpy as np
from pyspark import cloudpickle

#: Pieces kept per worker, about 60 MB; the bound has no influence on results.
CACHE = 300_000

_ODD_BLANKS = re.compile(r" \s|\s | \Z|\A ")


class Encoder:
    """ids(text) as an unsigned 32-bit array; made once in each task from file paths."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.sizes = np.zeros(max(known.values()) + 2, np.int64)
        for piece, rank in known.items():
            self.sizes[rank] = len(piece)
        self.rank_form = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.vocabulary, self.file_form = vocabulary, None
        self.specials = {}
        self._load = Tokenizer.from_file
        self._read_specials()
        self.cache = {}

    def _read_specials(self):
        import json

        with open(self.vocabulary, encoding="utf-8") as file:
            for token in json.load(file)["added_tokens"]:
                self.specials[token["content"]] = token["id"]
        top = max([len(self.sizes) - 1, *self.specials.values()])
        self.sizes = np.r_[self.sizes, np.zeros(top + 1 - len(self.sizes), np.int64)]
        for content, at in self.specials.items():
            self.sizes[at] = len(content.encode())

    def _piece(self, piece: str) -> bytes:
        found = array.array("I", self.rank_form.encode_ordinary(piece)).tobytes()
        if len(self.cache) < CACHE:
            self.cache[piece] = found
        return found

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if any(s in text for s in self.specials):
            self.file_form = self.file_form or self._load(self.vocabulary)
            return np.array(self.file_form.encode(text, add_special_tokens=False).ids, np.uint32)
        if _ODD_BLANKS.search(text):
            return np.array(self.rank_form.encode_ordinary(text), np.uint32)
        first, *rest = text.split(" ")
        known, make = self.cache.get, self._piece
        head = array.array("I", self.rank_form.encode_ordinary(first)).tobytes()
        return np.frombuffer(head + b"".join([known(p) or make(p) for p in [" " + w for w in rest]]), np.uint32)

    def byte_ends(self, ids: np.ndarray) -> np.ndarray:
        """The end of each token in the text's UTF-8 bytes."""
        return np.cumsum(self.sizes[ids])


class Vocabulary:
    """Where the two files of one vocabulary lie on every machine, and its pattern."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None, pattern: str | None = None):
        self.given = vocabulary, ranks, pattern

    def encoder(self) -> Encoder:
        import public_tokenizers as public

        vocabulary, ranks, pattern = self.given
        return Encoder(
            vocabulary or public.path("byte_bpe_50k.json"),
            ranks or public.path("byte_bpe_50k.tiktoken"),
            pattern or public.PATTERN,
        )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
