"""Quality rules: base counts of each text, and cross-document line frequency by host.

Lines are normalised (ASCII lower case, digits to 0, words apart by one blank) and hashed.
For each host the distinct documents that hold a line are counted; documents with the
same words count once, since copies are a matter of deduplication. A line in more than
``limit`` documents of its host is removed (``cleaned``); a document that so loses more than
``depleted`` percent of its words is rejected, as are those that fail the base rule. What a document
loses follows from its own lines: the same words may be broken into lines differently.

Null text: no words, fails. Null host: one host of its own. Lines without a word are
never counted. Repeated ids: each row is judged. No columns other than id, text, host are read.
Counts are hash aggregations that combine in the map tasks; the frequent lines are
joined back by (host, line), where AQE may split a hot one.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlist.llm.words import Hasher, Texts, mix, runs, signed
from mendlist.storage import settle

LIMIT = 20
DEPLETED = 50
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[48:58] = 48
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

_FACTS = (
    "id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, d1 long, d2 long, d3 long, lines array<long>, sizes array<int>"
)


def _per_text(t: Texts, flags: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return total[t.at[1:]] - total[t.at[:-1]]


def _repeats(group: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of keys found again in their group, mask of those found before in it)."""
    with np.errstate(over="ignore"):
        keys = mix(keys + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order] = same
    again[order] = same | np.r_[same[1:], False][: len(same)]
    return again, before


def _lines(t: Texts):
    """(text, first byte, end byte, first word, end word) of each line with a word."""
    breaks = np.flatnonzero(t.data == 10)
    start = np.union1d(t.at[:-1], breaks + 1)
    start = start[start < len(t.data)]
    text = np.searchsorted(t.at, start, "right") - 1
    stop = np.r_[breaks, len(t.data)]
    end = np.minimum(stop[np.searchsorted(breaks, start)], t.at[text + 1])
    a, b = np.searchsorted(t.start, start), np.searchsorted(t.start, end)
    full = b > a
    return text[full], start[full], end[full], a[full], b[full]


def _facts(batches):
    hasher, other = Hasher(3), Hasher(4)
    for batch in batches:
        for texts, ids, hosts in runs(batch.column(2), batch.column(0), batch.column(1)):
            t = Texts(texts)
            n = len(t.counts)
            words = t.word_hashes(hasher)
            # whole texts, by words as they are
            d1, d2 = t.whole(hasher, words), t.whole(other, t.word_hashes(other))
            chars = _per_text(t, (t.data & 0xC0 != 0x80) & ~np.isin(t.data, [9, 10, 11, 12, 13, 32]))
            begin, found = t.windows(hasher, words, WINDOW)
            again, _ = _repeats(t.doc[begin], found)
            edge = np.zeros(len(words) + 1, int)
            edge[begin[again]] += 1
            edge[begin[again] + WINDOW] -= 1
            covered = np.r_[0, np.cumsum(np.cumsum(edge)[:-1] > 0)]
            text, start, end, a, b = _lines(t)
            raw = hasher.spans(hasher.codes[t.data], start, end)
            _, before = _repeats(text, raw)
            normal = hasher.spans(hasher.codes[_NORMAL[t.data]], t.start, t.end)
            line = hasher.spans(normal, a, b, 1)
            # each distinct line of a text with the words of all its copies
            order = np.lexsort((line, text))
            new = np.ones(len(order), bool)
            new[1:] = (line[order][1:] != line[order][:-1]) | (text[order][1:] != text[order][:-1])
            heads = np.flatnonzero(new)
            sizes = np.add.reduceat((b - a)[order], heads) if len(heads) else np.zeros(0, int)
            at = np.searchsorted(text[order][heads], np.arange(n + 1)).astype(np.int32)
            # the lines of a text and how often it has each
            with np.errstate(over="ignore"):
                total = np.r_[np.uint64(0), np.cumsum(mix(line[order][heads] ^ mix(sizes.astype(np.uint64))), dtype=np.uint64)]
                d3 = mix(total[at[1:]] - total[at[:-1]])
            lists = [
                pa.ListArray.from_arrays(pa.array(at), signed(line[order][heads])),
                pa.ListArray.from_arrays(pa.array(at), pa.array(sizes.astype(np.int32))),
            ]
            counts = (t.counts, chars, _per_text(t, _SYMBOL[t.data]),
                      np.bincount(text[before], minlength=n), covered[t.first[1:]] - covered[t.first[:-1]])
            yield pa.RecordBatch.from_arrays(
                [ids, hosts, *(pa.array(c.astype(np.int64)) for c in counts), signed(d1), signed(d2), signed(d3), *lists],
                names=[f.split()[0] for f in _FACTS.split(", ")],
            )


#: What tells documents of a host apart: their words, and how these are broken into lines.
_WORDS = ["host", "d1", "d2", "n_words"]
_LINES = [*_WORDS, "d3"]


def _source(docs: DataFrame, id: str, text: str, host: str) -> DataFrame:
    return docs.select(
        F.col(id).cast("long").alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.col(text).cast("string").alias("text"),
    )


def _lost(facts: DataFrame, limit: int) -> DataFrame:
    """By host, words and lines: the words in frequent lines, and these lines' hashes. Only where there are any."""
    # copies are alike in their lines too: one of them stands for all
    some = facts.groupBy(*_LINES).agg(F.first("lines").alias("lines"), F.first("sizes").alias("sizes"))
    lines = some.select(*_LINES, F.inline(F.arrays_zip("lines", "sizes")))
    held = lines.select(*_WORDS, "lines").distinct().groupBy("host", "lines").agg(F.count("*").alias("held"))
    frequent = settle(held.where(F.col("held") > limit).select("host", "lines"))
    return settle(
        lines.join(frequent, ["host", "lines"]).groupBy(*_LINES)
        .agg(F.sum("sizes").alias("n_frequent_words"), F.collect_list("lines").alias("frequent"))
    )


def _verdict(rows: DataFrame, depleted: int) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return (
        rows.withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * F.col("n_frequent_words") <= depleted * F.col("n_words")))
    )


def judged(docs: DataFrame, limit=LIMIT, depleted=DEPLETED, id="doc_id", text="text", host="source") -> DataFrame:
    """Per row its base counts, its words in frequent lines, base_failed and kept."""
    facts = settle(_source(docs, id, text, host).mapInArrow(_facts, _FACTS))
    lost = _lost(facts, limit).drop("frequent")
    return _verdict(facts.drop("lines", "sizes").join(lost, _LINES, "left"), depleted).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_frequent_words", "base_failed", "kept",
    )


def _with_facts(batches):
    for batch in batches:
        for facts in _facts([batch]):
            texts = batch.column(2).slice(0, facts.num_rows)
            batch = batch.slice(facts.num_rows)
            columns = [c for c, name in zip(facts.columns, facts.schema.names) if name not in ("lines", "sizes")]
            names = [n for n in facts.schema.names if n not in ("lines", "sizes")]
            yield pa.RecordBatch.from_arrays([*columns, texts], names=[*names, "text"])


def _drop(batches):
    """Rows (text, hashes of lines to drop, ...): the text without these lines."""
    hasher = Hasher(3)
    for batch in batches:
        out = []
        for text, frequent in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            if frequent.is_valid and text:
                t = Texts(pa.array([text]))
                normal = hasher.spans(hasher.codes[_NORMAL[t.data]], t.start, t.end)
                _, start, end, a, b = _lines(t)
                gone = np.isin(hasher.spans(normal, a, b, 1), frequent.values.to_numpy().view(np.uint64))
                gone = set(start[gone].tolist())
                # the start of every line, blank ones too
                kept, at = [], 0
                for line in text.encode().split(b"\n"):
                    if at not in gone:
                        kept.append(line)
                    at += len(line) + 1
                text = b"\n".join(kept).decode()
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=["text", *batch.schema.names[2:]])


def cleaned(docs: DataFrame, limit=LIMIT, depleted=DEPLETED, id="doc_id", text="text", host="source") -> DataFrame:
    """(doc_id, text, n_words, n_frequent_words, base_failed, kept): each row without its frequent lines.

    n_words and n_frequent_words are those of the whole text: the text returned has their difference.
    Null texts stay null.
    """
    source = _source(docs, id, text, host)
    lost = _lost(source.mapInArrow(_facts, _FACTS), limit)
    schema = ", ".join([f for f in _FACTS.split(", ") if f.split()[0] not in ("lines", "sizes")] + ["text string"])
    rows = _verdict(source.mapInArrow(_with_facts, schema).join(lost, _LINES, "left"), depleted)
    rows = rows.select("text", "frequent", F.col("id").alias("doc_id"), "n_words", "n_frequent_words", "base_failed", "kept")
    return rows.mapInArrow(
        _drop, "text string, doc_id long, n_words long, n_frequent_words long, base_failed boolean, kept boolean"
    ).select("doc_id", "text", "n_words", "n_frequent_words", "base_failed", "kept")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
