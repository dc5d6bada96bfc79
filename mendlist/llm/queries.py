"""Every operator of this package as a query over whole tables, some beside their SQL twin."""

from pyspark.sql import functions as F

from mendlist.llm import (
    attribution,
    boilerplate,
    codes,
    collocations,
    decontaminate,
    jaccard,
    langid,
    licenses,
    live_index,
    packing,
    quality,
    rules,
    substrings,
    twins,
)

QUERIES = {}
SQL = {}


def _documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op8_jaccard_join(spark, folder):
    return jaccard.jaccard_components(_documents(spark, folder), k=3, percent=90)


@query
def op4_repeated_passages(spark, folder):
    return substrings.without_repeats(_documents(spark, folder)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def _remainder(n):
    return F.crc32(F.col("doc_id").cast("string")) % n


@query
def op1_quality_classifier(spark, folder):
    docs = _documents(spark, folder)
    seen = spark.read.parquet(f"{folder}/labels.parquet").where(_remainder(5) != 0)
    weights = quality.fit(docs, seen)
    return quality.score(docs.select("doc_id", "text"), weights).select(
        "doc_id",
        (_remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op2_quality_rules(spark, folder):
    return rules.judged(_documents(spark, folder))


@query
def op5_cost_balanced_packing(spark, folder):
    return packing.packed(_documents(spark, folder)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op10_language_profiles(spark, folder):
    docs = _documents(spark, folder)
    profiles = langid.learn(docs.where(_remainder(3) != 1))
    return langid.predict(docs.select("doc_id", "text"), profiles).select(
        "doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score"
    )


@query
def op3_line_frequency(spark, folder):
    return boilerplate.without_boilerplate(_documents(spark, folder)).select("doc_id", "n_lines", "n_dropped", "text")


@query
def op6_license_scan(spark, folder):
    """Documents as files at source/language/thousand/id."""
    path = F.concat_ws("/", "source", "lang", F.expr("doc_id div 1000"), "doc_id")
    return licenses.scan(_documents(spark, folder).select(path.alias("path"), "text"))


@query
def op7_section_tokens(spark, folder):
    return attribution.token_counts(_documents(spark, folder))


@query
def op9_spaced_seeds(spark, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate.leaks(_documents(spark, folder), items)


@query
def op11_value_dictionaries(spark, folder):
    return codes.with_label_errors(codes.compress(spark.read.parquet(f"{folder}/embeddings.parquet")))


@query
def op12_phrase_collocations(spark, folder):
    return collocations.collocations(collocations.count_phrases(_documents(spark, folder)))


@query
def op13_live_exact_dedup(spark, folder):
    return live_index.members(live_index.insert(None, _documents(spark, folder)))


SQL |= {
    "op2_quality_rules": twins.BASE_RULES,
    "op3_line_frequency": twins.LINE_FREQUENCY,
    "op4_repeated_passages": twins.REPEATED_PASSAGES,
    "op6_license_scan": twins.LICENSES,
    "op8_jaccard_join": twins.JACCARD,
    "op9_spaced_seeds": twins.SPACED_SEEDS,
    "op11_value_dictionaries": twins.VALUE_DICTIONARIES,
    "op12_phrase_collocations": twins.COLLOCATIONS,
    "op13_live_exact_dedup": twins.EXACT_DEDUP,
}
