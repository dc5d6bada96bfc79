"""From raw documents to packed training sequences: STAGES in order, or run() for all.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept.
All but the last return the columns of documents. Between stages the rows are written to the shared
folder and read again, so a lost executor costs its running tasks only.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendlist.llm import boilerplate, decontaminate, jaccard, packing, quality
from mendlist.operators.common import keep_first
from mendlist.storage import settle

#: A document with a lower score is rejected.
MIN_SCORE = 0.3
#: Words of a shingle, and the similarity in percent from which documents are near duplicates.
SHINGLE = 5
SIMILAR = 80


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose score reaches MIN_SCORE; nulls and empty texts score the bias."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    scored = quality.score(docs, quality.fit(docs, labels), into="__score")
    return scored.where(F.col("__score") >= MIN_SCORE).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines by source; n_chars follows the text. No document goes."""
    kept = boilerplate.without_boilerplate(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Of several rows with one id the first by text stays. Empty texts are linked with nothing,
    and rows without an id stay.
    """
    groups = settle(jaccard.jaccard_components(docs, k=SHINGLE, percent=SIMILAR))
    others = settle(groups.where("doc_id != component_id").select("doc_id").distinct())
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    several = settle(groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if not several.count():
        return kept
    repeated = keep_first(kept.join(several, "doc_id", "left_semi"), ["doc_id"], ["text", *docs.columns])
    return kept.join(several, "doc_id", "left_anti").unionByName(repeated)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a long stretch of one, go; so do rows and items without an id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_leaks(docs, items).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training sequence, with its token ids."""
    return packing.packed(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near),
    ("benchmark decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: Learnt scores and token ids are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
