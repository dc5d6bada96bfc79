"""Token counts of fields and sections, by the offsets of one encoding of the whole document.

A document is its text fields joined by a newline. It is encoded once; the byte
spans of its tokens are joined by interval to the spans of its sections: each field, cut
into lines unless ``lines`` is off. A section owns its text and the newline after it.

A token over a boundary counts for the section that holds most of its bytes, the earlier
one in a tie. So the counts of a document's sections add up to its tokens.

Spans are given in characters of the document. A null field is empty; a null or empty document has one
empty section for each field and no tokens. Repeated ids: each row is a document. One pass,
no shuffle, memory bounded by a batch of Arrow rows.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlist.llm.tokens import Vocabulary
from mendlist.llm.words import RUN_BYTES

_ROW = "id long, field string, section int, start long, end long, n_tokens long, doc_tokens long"


def allocate(ends: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many of the tokens that end at ``ends`` each section, from edge to edge, holds."""
    starts = np.r_[0, ends[:-1]]
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, ends, "left") - 1
    owner = first.copy()
    for i in np.flatnonzero(first < last):
        cuts = np.r_[starts[i], edges[first[i] + 1 : last[i] + 1], ends[i]]
        owner[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return np.bincount(owner, minlength=len(edges) - 1)


def _counter(vocabulary: Vocabulary, fields: list[str], lines: bool):
    def count(batches):
        encoder = vocabulary.encoder()
        names = [f.split()[0] for f in _ROW.split(", ")]
        for batch in batches:
            out, held = [[] for _ in names], 0
            for row in range(batch.num_rows):
                i, *texts = (c[row].as_py() for c in batch.columns)
                texts = [t or "" for t in texts]
                whole = "\n".join(texts)
                data = np.frombuffer(whole.encode(), np.uint8)
                ids = encoder.ids(whole)
                edges, field = [0], []
                for name, text in zip(fields, texts):
                    for part in text.split("\n") if lines else [text]:
                        edges.append(edges[-1] + len(part.encode()) + 1)
                        field.append(name)
                edges[-1] -= 1  # no newline after the last
                edges = np.array(edges)
                n = len(field)
                chars = np.r_[0, np.cumsum(data & 0xC0 != 0x80)][edges]
                tokens = allocate(encoder.byte_ends(ids), edges) if len(ids) else np.zeros(n, int)
                for column, values in zip(out, ([i] * n, field, range(n), chars[:-1], chars[1:], tokens, [len(ids)] * n)):
                    column.extend(values)
                held += len(data)
                if held > 4 * RUN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
                    out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    types = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
    return count


def token_counts(docs: DataFrame, fields=("text",), lines=True, vocabulary=None, id="doc_id") -> DataFrame:
    """One row per section: its field, number in the document, span, tokens, and the document's tokens."""
    shown = [F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]
    docs = docs.select(F.col(id).cast("long").alias("id"), *shown)
    counts = docs.mapInArrow(_counter(vocabulary or Vocabulary(), list(fields), lines), _ROW)
    return counts.withColumnRenamed("id", "doc_id")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
