"""License scan with DataFrame functions alone: sparse TF-IDF cosine, and inheritance by path.

What is compared to the templates of a file that names a license (``MARKER``): every line and every
block of adjacent lines that do so, and the whole file, this to the forms alone that make
license files (no tags, no headers of source files). A line or block at or
above ``threshold`` is a license header of its file; a file that as a whole reaches it is
a license file of its directory, and its own license too. Files with neither inherit from the nearest
ancestor directory with a license file.

Terms are lower-cased runs of letters and digits. Weights are tf * idf with
``idf = ln((1 + T) / (1 + df)) + 1`` over the T templates; a term of no template has df 0.
Each unit is scored in its own row: the templates' weights are one literal map of
fixed size, terms of no template only add to the norm. Nothing but one license
per file is stored or shuffled.

Ties: of one unit the earlier template; of a file's units the later license name; between license
files of one directory the later license, then path. Null and empty texts: no license of their own, may inherit. Null
path: no directory, may have a header. Repeated paths: each row is scanned and gets the best of
all rows of its path. Only path and text are read.
"""

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendlist.llm.license_texts import FILE_FORMS, templates
from mendlist.storage import settle

THRESHOLD = 0.7
TEMPLATES = templates()
#: A unit is compared if it matches, in lower case: licenses name themselves or one of their terms.
MARKER = "licen[cs]|copyright|spdx|public domain|warrant|permission|redistribut"
BLANK_LINES = "\n[ \t\r\n]*\n"


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


class Model:
    """Template weights, fitted on the templates alone; of their size."""

    def __init__(self, templates):
        counts = [Counter(_words(text)) for _, text in templates]
        df = Counter(t for c in counts for t in c)
        self.names = [name for name, _ in templates]
        self.idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
        self.unknown = math.log(1 + len(counts)) + 1
        norms = [math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items())) for c in counts]
        #: by term, its part of the unit vector of each template
        self.weights = {t: [c[t] * idf / norm for c, norm in zip(counts, norms)] for t, idf in self.idf.items()}

    def literal(self) -> Column:
        """term -> (idf, weight in each template)."""
        entries = {t: {"idf": self.idf[t], "weights": self.weights[t]} for t in sorted(self.idf)}
        return F.from_json(F.lit(json.dumps(entries, ensure_ascii=False)), "map<string, struct<idf: double, weights: array<double>>>")


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _squares(terms: Column) -> Column:
    """The sum of the squared counts of the distinct terms: equal ones follow each other when sorted."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def add(s, t):
        run = F.when(t == s["last"], s["run"]).otherwise(F.lit(0).cast("long"))
        # (run + 1)^2 - run^2
        return F.struct(t.alias("last"), (run + 1).alias("run"), (s["total"] + 2 * run + 1).alias("total"))

    return F.aggregate(F.array_sort(terms), start, add, lambda s: s["total"])


def _scored(units: DataFrame, model: Model, file_forms: int) -> DataFrame:
    """license and cosine: the best template of each row's ``unit``; of a ``whole`` file's among the first ones."""
    vocabulary = sorted(model.idf)
    units = units.withColumn("terms", _terms(F.col("unit")))
    units = units.select(
        "*", F.filter("terms", lambda t: t.isin(vocabulary)).alias("known"),
        _squares(F.filter("terms", lambda t: ~t.isin(vocabulary))).alias("unknown"),
    ).drop("terms", "unit")
    table = model.literal()
    units = units.withColumn("counts", F.transform(F.array_distinct("known"), lambda t: F.struct(
        F.size(F.filter("known", lambda x: x == t)).alias("tf"), F.element_at(table, t).alias("m")
    ))).drop("known")
    zeros = F.array_repeat(F.lit(0.0), len(model.names))
    dots = F.aggregate("counts", zeros, lambda acc, c: F.zip_with(
        acc, c["m"]["weights"], lambda a, w: a + c["tf"] * c["m"]["idf"] * w
    ))
    own = F.aggregate("counts", F.lit(0.0), lambda a, c: a + F.pow(c["tf"] * c["m"]["idf"], F.lit(2.0)))
    dots = F.slice(dots, F.lit(1), F.when(F.col("whole"), file_forms).otherwise(len(model.names)))
    units = units.withColumns({"dots": dots, "norm": F.sqrt(own + F.col("unknown") * F.lit(model.unknown**2))}).drop("counts", "unknown")
    units = units.where("norm > 0").withColumn("dot", F.array_max("dots"))
    name = F.element_at(F.array(*[F.lit(n) for n in model.names]), F.array_position("dots", F.col("dot")).cast("int"))
    return units.withColumns({"license": name, "cosine": F.round(F.col("dot") / F.col("norm"), 6)}).drop("dots", "dot", "norm")


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )


def scan(files: DataFrame, templates=TEMPLATES, file_forms=FILE_FORMS, threshold=THRESHOLD, path="path", text="text") -> DataFrame:
    """(path, license, cosine, how, license_path) of each file.

    The first ``file_forms`` templates may be a whole file.
    how: 'file', 'header', 'inherited' or 'none'; license_path: the file it comes from.
    """
    files = files.select(F.col(path).alias("path"), F.col(text).cast("string").alias("text"))
    named = files.where(F.col("path").isNotNull() & F.lower("text").rlike(MARKER))
    parts = F.concat(F.split("text", "\n"), F.split("text", BLANK_LINES))
    marked = F.filter(parts, lambda u: F.lower(u).rlike(MARKER))
    units = named.select("path", "text", F.explode(F.array_distinct(F.concat(marked, F.array("text")))).alias("unit"))
    units = units.select("path", (F.col("unit") == F.col("text")).alias("whole"), "unit")
    found = _scored(units, Model(templates), file_forms).where(F.col("cosine") >= threshold)
    best = F.struct("cosine", "license")
    own = settle(found.groupBy("path").agg(F.max(F.when(F.col("whole"), best)).alias("f"), F.max(best).alias("h")))

    at = F.struct("f.cosine", "f.license", "path")
    shelves = settle(
        own.where("f is not null").withColumn("directory", ancestors(F.col("path"))[0])
        .groupBy("directory").agg(F.max_by(F.struct("path", "f.license", "f.cosine"), at).alias("d"))
    )
    rows = files.select("path").join(own, "path", "left")
    bare = rows.where("f is null and h is null").select("path").distinct()
    climbed = bare.select("path", F.posexplode(ancestors(F.col("path"))).alias("steps", "directory"))
    inherited = climbed.join(shelves, "directory").groupBy("path").agg(F.min_by("d", "steps").alias("d"))
    how = F.expr("case when f is not null then 'file' when h is not null then 'header' when d is not null then 'inherited' else 'none' end")
    return rows.join(inherited, "path", "left").select(
        "path",
        F.coalesce("f.license", "h.license", "d.license").alias("license"),
        F.coalesce("f.cosine", "h.cosine", "d.cosine").alias("cosine"),
        how.alias("how"),
        F.when(how == "inherited", F.col("d.path")).when(how != "none", F.col("path")).alias("license_path"),
    )
