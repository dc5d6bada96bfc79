"""Language identification by rank-order profiles of character n-grams.

A profile is the most frequent n-grams (1 to 3 characters) of a language's texts in order
of descending count, ties by n-gram. A document is compared to each profile by the
out-of-place distance of its own most frequent n-grams: the difference of ranks, or the
profile length where the profile lacks it. The least distance wins, ties by name.

Words are runs of letters, lower-cased, with a blank on both sides; n-grams do not span words.
A character is coded in 21 bits, so an n-gram is an exact 63-bit number, not a hash.
Counts of the training texts cover all of them and combine in each task before they are
shuffled. A profile set holds ``size`` rows for each language named; with the fixed
set of languages of a label column it is small, and is checked against
``MAX_LANGUAGES`` before it is shared with the tasks.

Null texts and those without a letter: ``und``, score 0. No training texts: ``und``.
Null languages are never learnt. Columns named as the results are replaced. Repeated ids: each row is predicted.
"""

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendlist.llm.boilerplate import unused

SIZE = 400
MAX_LANGUAGES = 1_000
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def _grams(text: str) -> np.ndarray:
    """All n-grams of a text with a letter as numbers, in any order."""
    spread = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    code = np.frombuffer(spread.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    blank = code == 32
    two = (code[:-1] << 21) + code[1:]
    # no n-gram has a blank inside
    return np.concatenate([code[~blank], two, ((two[:-1] << 21) + code[2:])[~blank[1:-1]]])


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams.sort()
    new = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[new], np.diff(np.r_[new, len(grams)])


def _top(grams: np.ndarray, size: int) -> np.ndarray:
    grams, counts = _counted(grams)
    if len(grams) > 4 * size:
        cut = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= cut], counts[counts >= cut]
    return grams[np.argsort(-counts, kind="stable")[:size]]


def _count(batches):
    """Counts by language of up to some megabytes of text at a time."""
    held, size = {}, 0

    def flush():
        languages, grams, counts = [], [], []
        for lang, parts in held.items():
            g, c = _counted(np.concatenate(parts))
            languages += [lang] * len(g)
            grams.append(g), counts.append(c)
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(languages, pa.string()), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts))],
            names=["lang", "gram", "n"],
        )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if text and _LETTER.search(text):
                grams = _grams(text)
                held.setdefault(lang, []).append(grams)
                size += len(grams)
                if size > 4_000_000:
                    size = 0
                    yield flush()
    if held:
        yield flush()


def learn(docs: DataFrame, size=SIZE, text="text", lang="lang") -> dict[str, np.ndarray]:
    """The n-grams of each language's profile, in order."""
    grams = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    ).mapInArrow(_count, "lang string, gram long, n long")
    totals = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.struct((-F.col("n")).alias("n"), "gram")
    ranked = totals.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(rank)))
    rows = ranked.where(F.col("place") <= size).select("lang", "gram", "place").limit(size * MAX_LANGUAGES + 1).collect()
    if len(rows) > size * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles = {}
    for name, gram, place in sorted(rows, key=lambda r: (r[0], r[2])):
        profiles.setdefault(name, []).append(gram)
    return {name: np.array(grams) for name, grams in profiles.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size=SIZE, text="text") -> DataFrame:
    """All rows and columns, with lang_pred and score: 1 for a distance of zero, 0 for the largest."""
    names = sorted(profiles)
    # one table for all profiles: every n-gram and its rank in each, the length where it lacks one
    grams = np.unique(np.concatenate([profiles[n] for n in names])) if names else np.zeros(0, np.int64)
    ranks = np.full((len(grams) + 1, len(names)), size, np.int32)
    for j, name in enumerate(names):
        ranks[np.searchsorted(grams, profiles[name]), j] = np.arange(len(profiles[name]))
    shared = docs.sparkSession.sparkContext.broadcast((names, grams, ranks))

    def place(texts: pa.Array) -> pa.Array:
        names, grams, ranks = shared.value
        found, scores = [], []
        for text in texts:
            text = text.as_py()
            if not names or not text or not _LETTER.search(text):
                found.append(UNKNOWN), scores.append(0.0)
                continue
            top = _top(_grams(text), size)
            at = np.searchsorted(grams, top)
            at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != top)] = len(grams)
            rank = ranks[at]
            gap = np.where(rank == size, size, np.abs(rank - np.arange(len(top))[:, None])).sum(0)
            best = int(np.argmin(gap))
            found.append(names[best]), scores.append(1 - float(gap[best]) / (size * len(top)))
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    told = F.arrow_udf(place, "lang_pred string, score double")(F.col(text).cast("string"))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    (into,) = unused(docs.columns, "__told")
    return docs.withColumn(into, told).select(*[F.col(f"`{c}`") for c in kept], f"{into}.lang_pred", f"{into}.score")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
