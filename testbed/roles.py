"""Roles the generated tables play (reviews, aspects, annotations, logits, ...).

Each role is given twice: as a DataFrame and as a SQL common table expression.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendlist.operators.ingest import stable_id
from mendlist.storage import settle


class Data:
    """The generated tables of one folder, read as needed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- aspects of reviews: order lines, the feature being the brand ---------

    @property
    def aspects(self) -> DataFrame:
        parts = self.part.select("p_partkey", "p_brand")
        lines = self.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        flag = F.col("l_returnflag")
        return lines.select(
            stable_id(*[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")]).alias("id"),
            F.col("l_orderkey").cast("string").alias("review_id"),
            F.col("p_brand").alias("feature_id"),
            F.when(flag == "R", "negative").when(flag == "A", "neutral").otherwise("positive").alias("sentiment"),
            (1.0 - F.col("l_discount")).alias("confidence"),
            F.when(F.col("l_linestatus") == "O", "finetuned").otherwise("llm_fallback").alias("source"),
            "l_linenumber",
            F.col("l_shipdate").cast("date").alias("ship_date"),
        )

    @property
    def partly_dated(self) -> DataFrame:
        """Aspects carrying their own date, none on first lines."""
        date = F.when(F.col("l_linenumber") != 1, F.col("ship_date"))
        return self.aspects.select("feature_id", "sentiment", date.alias("review_date"))

    @property
    def reviews(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").cast("string").alias("id"),
            F.col("o_orderstatus").alias("source"),
            F.concat(F.lit("app-"), F.col("o_custkey")).alias("app_id"),
            F.concat(F.col("o_orderpriority"), F.lit(" order "), F.col("o_orderkey")).alias("review_text"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
            F.col("o_orderdate").cast("date").alias("review_date"),
            F.col("o_orderdate").alias("ingested_at"),
        )

    @cached_property
    def features(self) -> DataFrame:
        """The taxonomy, stored as a table of its own."""
        brand = F.col("p_brand")
        features = self.part.select(brand).distinct().select(
            brand.alias("id"),
            F.lower(brand).alias("feature_key"),
            F.concat(F.lit("The "), brand).alias("display_name"),
            F.lit(None).cast("string").alias("description"),
            (brand != "Brand#13").alias("is_active"),
        )
        return settle(features)

    # -- annotated CSV rows: order lines under their order --------------------

    @property
    def annotated(self) -> DataFrame:
        parts = self.part.select("p_partkey", "p_name", "p_type")
        orders = self.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        lines = self.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
            orders, F.col("l_orderkey") == F.col("o_orderkey")
        )
        flag = F.col("l_returnflag")
        text = lambda c: F.col(c).cast("string")
        return lines.select(
            F.col("o_orderstatus").alias("domain"),
            F.concat(F.lit("app-"), F.col("o_custkey")).alias("app"),
            F.concat(F.lit("order, number "), F.col("l_orderkey")).alias("sentence"),
            F.lower("p_type").alias("category"),
            F.col("p_name").alias("term"),
            F.when(flag == "R", "negative").when(flag == "A", "N/A").otherwise("positive").alias("sentiment"),
            F.substring("o_orderpriority", 1, 1).alias("rating"),
            F.when(F.col("o_orderstatus") == "F", text("o_orderkey")).otherwise("N/A").alias("review_id"),
            text("l_linenumber").alias("from"),
            F.when(F.col("l_linestatus") == "O", "N/A").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("to"),
            (
                F.col("l_linenumber").cast("bigint") * 1_000_000_000_000
                + F.col("l_partkey") * 1_000_000
                + F.col("l_suppkey")
            ).alias("row_no"),
        )

    # -- one analysis: events, the feature being the event type ---------------

    @property
    def found_aspects(self) -> DataFrame:
        value = F.col("value")
        mood = (
            F.when(F.col("event_type") == "error", "negative")
            .when(value > 60, "negative")
            .when(value > 20, "neutral")
            .otherwise("positive")
        )
        return self.events.select(
            F.concat(F.lit("review of user "), F.col("user_id")).alias("original_review"),
            F.col("event_type").alias("feature"),
            mood.alias("sentiment"),
        )

    # -- reviews with text ----------------------------------------------------

    @property
    def documents_as_reviews(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").cast("string").alias("id"),
            F.col("source").alias("app_id"),
            F.col("text").alias("review_text"),
            F.col("lang").alias("domain"),
            "doc_id",
        )

    @property
    def turns(self) -> DataFrame:
        """Sentences grouped by conversation; the domain is the first turn's role."""
        return self.conversations.select(
            F.col("conv_id").cast("string").alias("group_key"), "conv_id", "turn", F.col("role").alias("domain")
        )

    # -- model outputs --------------------------------------------------------

    def logits(self, first: int, last: int, scale: float):
        """Embedding elements ``first``..``last`` (0-based, inclusive), scaled."""
        part = F.slice("embedding", first + 1, last - first + 1)
        return F.transform(part, lambda x: x.cast("double") * scale)

    @property
    def category_outputs(self) -> DataFrame:
        truth = F.array(*[(F.col("label") == i).cast("int") for i in range(10)])
        return self.embeddings.select("vec_id", self.logits(0, 9, 12.0).alias("logits"), truth.alias("truth"))

    @property
    def sentiment_outputs(self) -> DataFrame:
        label = F.col("label")
        truth = F.when(label < 3, 0).when(label < 6, 1).otherwise(2)
        return self.embeddings.select("vec_id", self.logits(10, 12, 8.0).alias("logits"), truth.alias("truth"))


ASPECTS = """aspects AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS review_id, p_brand AS feature_id,
         CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'neutral' ELSE 'positive' END AS sentiment,
         CAST(1.0 AS DOUBLE) - l_discount AS confidence,
         CASE l_linestatus WHEN 'O' THEN 'finetuned' ELSE 'llm_fallback' END AS source,
         l_linenumber, CAST(l_shipdate AS DATE) AS ship_date
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

REVIEWS = """reviews AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS source, 'app-' || o_custkey AS app_id,
         o_orderpriority || ' order ' || o_orderkey AS review_text,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS rating,
         CAST(o_orderdate AS DATE) AS review_date, o_orderdate AS ingested_at
  FROM orders)"""

FEATURES = """features AS (
  SELECT DISTINCT p_brand AS id, lower(p_brand) AS feature_key, 'The ' || p_brand AS display_name,
         p_brand <> 'Brand#13' AS is_active
  FROM part)"""

ANNOTATED = """annotated AS (
  SELECT o_orderstatus AS domain, 'app-' || o_custkey AS app, 'order, number ' || l_orderkey AS sentence,
         lower(p_type) AS category, p_name AS term,
         CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'N/A' ELSE 'positive' END AS sentiment,
         substr(o_orderpriority, 1, 1) AS rating,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) ELSE 'N/A' END AS review_id,
         l_linenumber AS span_from,
         CASE WHEN l_linestatus = 'O' THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS span_to,
         CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS row_no,
         sha256('app-' || o_custkey || chr(31) || o_orderstatus || chr(31) || 'order, number ' || l_orderkey) AS id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""

FOUND = """found AS (
  SELECT 'review of user ' || user_id AS original_review, event_type AS feature,
         CASE WHEN event_type = 'error' OR value > 60 THEN 'negative'
              WHEN value > 20 THEN 'neutral' ELSE 'positive' END AS sentiment
  FROM events)"""

COUNTS = """counts AS (
  SELECT feature, count(*) AS mentions,
         count(*) FILTER (sentiment = 'positive') AS positive,
         count(*) FILTER (sentiment = 'negative') AS negative
  FROM found GROUP BY feature)"""


def logits_sql(first: int, last: int, scale: float) -> str:
    """The SQL twin of ``Data.logits``."""
    return (
        f"list_transform(embedding[{first + 1}:{last + 1}], lambda x: CAST(x AS DOUBLE) * CAST({scale} AS DOUBLE))"
    )


def scores_sql(dated: str, name: str = "scores") -> str:
    """Windowed scores over a CTE with (feature_id, sentiment, review_date)."""
    return f"""grouped AS (
  SELECT feature_id, CAST(date_trunc('month', review_date) AS DATE) AS window_start,
         last_day(review_date) AS window_end, count(*) AS mention_count,
         avg(CASE WHEN sentiment = 'negative' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS negative_ratio,
         avg(CASE WHEN review_date IS NULL THEN CAST(1 AS DOUBLE)
             ELSE pow(CAST(0.5 AS DOUBLE),
                      greatest(date_diff('day', review_date, last_day(review_date)), 0) / CAST(90 AS DOUBLE)) END) AS mean_weight,
         avg(CASE WHEN review_date IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) AS undated_ratio
  FROM {dated} GROUP BY 1, 2, 3),
scored AS (SELECT *, negative_ratio * ln(1 + mention_count) * mean_weight AS score FROM grouped),
{name} AS (
  SELECT *, CASE WHEN window_start IS NOT NULL THEN
      score - lag(score) OVER (PARTITION BY feature_id, window_start IS NULL ORDER BY window_start) END AS trend_delta
  FROM scored)"""


SCORE_COLUMNS = """feature_id, CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end,
  round(score, 6) AS score, mention_count, round(negative_ratio, 6) AS negative_ratio,
  round(undated_ratio, 6) AS undated_ratio, round(trend_delta, 6) AS trend_delta"""

DATED = """dated AS (
  SELECT feature_id, sentiment, review_date FROM aspects JOIN reviews ON review_id = reviews.id)"""

PARTLY_DATED = """dated AS (
  SELECT feature_id, sentiment, CASE WHEN l_linenumber <> 1 THEN ship_date END AS review_date FROM aspects)"""


def split_sql(groups: str, test: float = 0.1, val: float = 0.1, seed: int = 42) -> str:
    """CTEs from ``groups`` (group_key, domain) to ``assigned`` (group_key, split)."""
    left = f"(CAST({test} AS DOUBLE))"
    return f"""{groups},
sizes AS (SELECT domain, count(*) AS n FROM groups GROUP BY domain),
facts AS (SELECT count(domain) > 1 AND bool_and(domain IS NOT NULL) AND min(n) >= 2 AS usable FROM sizes),
ranked AS (SELECT group_key, md5('{seed}:' || group_key) AS h,
                  CASE WHEN (SELECT usable FROM facts) THEN domain ELSE '' END AS stratum FROM groups),
strata AS (SELECT stratum, CAST(count(*) AS BIGINT) AS n FROM ranked GROUP BY stratum),
want_test AS (SELECT CAST(ceil({left} * sum(n)) AS BIGINT) AS w, CAST(sum(n) AS BIGINT) AS total FROM strata),
share_test AS (SELECT stratum, n, w, (n * w) // total AS whole, (n * w) % total AS rest FROM strata, want_test),
q_test AS (SELECT stratum, n, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum)
                  <= w - sum(whole) OVER () THEN 1 ELSE 0 END AS n_test FROM share_test),
want_val AS (SELECT CAST(ceil((CAST({val} AS DOUBLE) / (CAST(1 AS DOUBLE) - {left})) * sum(n - n_test)) AS BIGINT) AS w,
                    CAST(sum(n - n_test) AS BIGINT) AS total FROM q_test),
share_val AS (SELECT stratum, n, n_test, w, ((n - n_test) * w) // total AS whole, ((n - n_test) * w) % total AS rest
              FROM q_test, want_val),
q AS (SELECT stratum, n_test, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum)
             <= w - sum(whole) OVER () THEN 1 ELSE 0 END AS n_val FROM share_val),
placed AS (SELECT group_key, stratum, row_number() OVER (PARTITION BY stratum ORDER BY h) AS place FROM ranked),
assigned AS (SELECT group_key, CASE WHEN place <= n_test THEN 'test' WHEN place <= n_test + n_val THEN 'val'
             ELSE 'train' END AS split FROM placed JOIN q USING (stratum))"""


TURN_GROUPS = """groups AS (
  SELECT CAST(conv_id AS VARCHAR) AS group_key, arg_min(role, turn) AS domain FROM conversations GROUP BY conv_id)"""

DOCUMENT_GROUPS = """groups AS (SELECT CAST(doc_id AS VARCHAR) AS group_key, lang AS domain FROM documents)"""
