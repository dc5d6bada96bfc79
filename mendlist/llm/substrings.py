"""Removal of long repeated passages: repeated-phrase automata over all documents.

A window is ``window`` consecutive words of one document. Words covered by a window whose
word sequence also starts in a document with a smaller id are removed; windows are judged
on the input.

1. Each window is represented by the place of its short phrase of least hash, so equal windows
   are represented by the same phrase. A phrase that represents windows of two documents is
   confirmed as recurring.
2. Confirmed phrases are compiled, as they are spelled at their places, into Aho-Corasick automata, one
   shard for about a megabyte of documents with the phrases confirmed for these. All of its
   documents are streamed through it; what it finds, and nothing else, are the occurrences.
3. Windows whose representing phrase was found are compared exactly, by 96-bit hashes
   aggregated over the corpus, and those that start in an earlier document are removed.

Documents with the same words are compared once: later ones lose all words if they have
a window's length, since the first one has the same windows.

Null text: no words. Texts shorter than a window keep everything. Null id: keeps everything
and removes nothing elsewhere. Repeated ids: rows are removed against other ids only; rows of one id with
different words are judged each by its own. No columns other than the two named are kept.
"""

import sys

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlist.llm.words import Hasher, Texts, runs, signed
from mendlist.storage import release, settle

WINDOW = 50
PHRASE = 5

_NONE = np.uint64(2**64 - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each value and the width - 1 after it."""
    reach, low = 1, values
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low, np.r_[low[step:], np.full(step, _NONE)][: len(low)])
        reach += step
    return low


def _phrases(t: Texts, hasher: Hasher, words: np.ndarray, phrase: int) -> np.ndarray:
    """The hash of the phrase that starts at each word, if its text is long enough."""
    out = np.full(len(words), _NONE)
    begin, found = t.windows(hasher, words, phrase)
    out[begin] = found
    return out


_PROFILE = "id long, n int, d1 long, d2 long, phrase long, at int"


def _profiler(window: int, phrase: int):
    def profile(batches):
        hasher, other = Hasher(), Hasher(1)
        for batch in batches:
            for texts, ids in runs(batch.column(1), batch.column(0)):
                t = Texts(texts)
                words = t.word_hashes(hasher)
                d1, d2 = t.whole(hasher, words), t.whole(other, t.word_hashes(other))
                hashes = _phrases(t, hasher, words, phrase)
                low = _least(hashes, window - phrase + 1)
                begin = np.flatnonzero(np.arange(len(words)) + window <= t.first[1:][t.doc])
                doc, low = t.doc[begin], low[begin]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                # the first place of the representing phrase at or after the window's start
                begin, doc, low = begin[new], doc[new], low[new]
                at = _place(hashes, begin, low, window - phrase + 1)
                n, m, ids = len(t.counts), len(low), ids.to_numpy()
                whole = np.arange(n + m) < n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[ids, ids[doc]]),
                        pa.array(np.r_[t.counts, np.zeros(m, int)].astype(np.int32)),
                        signed(np.r_[d1, np.zeros(m, np.uint64)]),
                        signed(np.r_[d2, np.zeros(m, np.uint64)]),
                        pa.array(np.r_[np.zeros(n, np.uint64), low].view(np.int64), mask=whole),
                        pa.array(np.r_[np.zeros(n, int), at - t.first[doc]].astype(np.int32), mask=whole),
                    ],
                    names=["id", "n", "d1", "d2", "phrase", "at"],
                )

    return profile


def _place(hashes: np.ndarray, begin: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """The first place from each begin on, within width, that has the hash low."""
    at = np.full(len(begin), -1)
    for step in range(width):
        here = np.minimum(begin + step, len(hashes) - 1)
        at = np.where((at < 0) & (hashes[here] == low), here, at)
    return at


def _automaton(t: Texts, spelled: list[str], starts: list[np.ndarray], places: pa.Array, phrase: int):
    """The phrases at these places of each text, and where they end; None if there are none."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
    for i, found in enumerate(places.to_pylist()):
        for at in found or ():
            if at + phrase < len(starts[i]):
                automaton.add_word(spelled[i][starts[i][at] - 1 : starts[i][at + phrase]], None)
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def _finder(window: int, phrase: int):
    def found(batches):
        hasher, other = Hasher(), Hasher(1)
        for batch in batches:
            columns = [batch.column(c) for c in ("text", "id", "places", "apart")]
            for texts, ids, places, apart in runs(*columns):
                t = Texts(texts)
                # one byte a character, words apart by single spaces
                spelled, starts = [], []
                for i, n in enumerate(t.counts):
                    parts = t.words_of(i)
                    spelled.append(f" {b' '.join(parts).decode('latin-1')} ")
                    starts.append(np.r_[1, 1 + np.cumsum(np.fromiter(map(len, parts), int, n) + 1)])
                automaton = _automaton(t, spelled, starts, places, phrase)
                if automaton is None:
                    continue
                words = t.word_hashes(hasher)
                hashes = _phrases(t, hasher, words, phrase)
                located = np.full(len(words), _NONE)
                for i, text in enumerate(spelled):
                    ends = np.fromiter((e for e, _ in automaton.iter(text)), int) + 1
                    at = t.first[i] + np.searchsorted(starts[i], ends) - phrase
                    located[at] = hashes[at]
                width = window - phrase + 1
                low = _least(hashes, width)
                fits = np.arange(len(words)) + window <= t.first[1:][t.doc]
                begin = np.flatnonzero(fits & (low == _least(located, width)) & (low != _NONE))
                second = t.word_hashes(other)
                h1 = hasher.spans(words, begin, begin + window, 1)
                h2 = other.spans(second, begin, begin + window, 1)
                doc = t.doc[begin]
                # only rows of an id with several texts are told apart
                row = pa.array(_row_digest(t, hasher, words).view(np.int64)[doc], mask=~apart.to_numpy(zero_copy_only=False)[doc])
                yield pa.RecordBatch.from_arrays(
                    [signed(h1), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(ids.to_numpy()[doc]),
                     pa.array((begin - t.first[doc]).astype(np.int32)), row],
                    names=["h1", "h2", "id", "at", "row"],
                )

    return found


def _row_digest(t: Texts, hasher: Hasher, words: np.ndarray) -> np.ndarray:
    return t.whole(hasher, words)


def _cutter(window: int):
    def cut(batches):
        hasher = Hasher()
        for batch in batches:
            ids, n_words, n_removed, digest = batch.column("id"), [], [], []
            columns = [batch.column(c).to_pylist() for c in ("starts", "apart", "copied")]
            for text, starts, apart, copied in zip(batch.column("text"), *columns):
                text = text.as_py() or ""
                parts = text.encode().split()
                keep = np.ones(len(parts), bool)
                own = None
                if apart or copied:
                    t = Texts(pa.array([text]))
                    own = int(_row_digest(t, hasher, t.word_hashes(hasher)).view(np.int64)[0])
                starts = [*(starts or ()), *(a["at"] for a in apart or () if a["row"] == own)]
                if copied and own in copied and len(parts) >= window:
                    keep[:] = False
                elif starts:
                    edge = np.zeros(len(parts) + 1, int)
                    starts = np.unique(starts)
                    starts = starts[starts + window <= len(parts)]
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                n_words.append(len(parts))
                n_removed.append(len(parts) - int(keep.sum()))
                kept = parts if keep.all() else [p for p, k in zip(parts, keep) if k]
                digest.append((b" ".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([d.decode() for d in digest], pa.string())],
                names=["id", "n_words", "n_removed", "kept"],
            )

    return cut


def without_repeats(docs: DataFrame, window=WINDOW, phrase=PHRASE, id="doc_id", text="text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words of each document, apart by one space."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    profile = settle(docs.where("id is not null").mapInArrow(_profiler(window, phrase), _PROFILE))
    whole = profile.where(F.col("phrase").isNull() & (F.col("n") >= window)).select("id", "n", "d1", "d2")
    # aggregates are stored before they are joined: a join can then split a key of very many rows
    firsts = settle(whole.groupBy("n", "d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last"))
    copy = whole.join(firsts, ["n", "d1", "d2"], "left").select("id", "d1", (F.col("id") > F.coalesce("first", "id")).alias("copy"))
    facts = copy.groupBy("id").agg(
        F.bool_and("copy").alias("all"), F.collect_set(F.when(F.col("copy"), F.col("d1"))).alias("copied"),
        (F.min("d1") != F.max("d1")).alias("apart"),
    )
    facts = settle(facts.where((F.size("copied") > 0) | F.col("apart")))
    copies = facts.where("all").select("id")

    phrases = profile.where(F.col("phrase").isNotNull()).select("id", "phrase", "at").join(copies, "id", "left_anti")
    confirmed = phrases.groupBy("phrase").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    confirmed = settle(confirmed.where("low < high").select("phrase"))
    places = phrases.join(confirmed, "phrase", "left_semi").groupBy("id").agg(F.collect_set("at").alias("places"))
    wanted = settle(places.join(facts.where("apart").select("id", "apart"), "id", "left").withColumn("apart", F.coalesce("apart", F.lit(False))))
    release(profile, firsts, confirmed)
    windows = settle(docs.join(wanted, "id").mapInArrow(_finder(window, phrase), "h1 long, h2 int, id long, at int, row long"))
    owners = windows.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    owners = settle(owners.where("low < high").drop("high"))
    late = windows.join(owners, ["h1", "h2"]).where("id > low")
    marks = late.groupBy("id").agg(
        F.collect_list(F.when(F.col("row").isNull(), F.col("at"))).alias("starts"),
        F.collect_list(F.when(F.col("row").isNotNull(), F.struct("row", "at"))).alias("apart"),
    )
    marks = settle(marks.join(facts.where(F.size("copied") > 0).select("id", "copied"), "id", "full"))
    release(wanted, windows, owners, facts)
    return docs.join(marks, "id", "left").mapInArrow(
        _cutter(window), "id long, n_words long, n_removed long, kept string"
    ).withColumnRenamed("id", "doc_id")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
