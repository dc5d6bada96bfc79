"""Every operator as a query over the generated tables, beside its SQL twin.

Dates are shown as text and derived numbers are rounded to six digits on both
sides, since sums of doubles depend on their order in the last digits.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlist import fixed, schemas
from mendlist.functions import gates, scores as S
from mendlist.operators import aspects as A
from mendlist.operators import backlog as B
from mendlist.operators import cleaning as C
from mendlist.operators import criticality as K
from mendlist.operators import evaluation as E
from mendlist.operators import ingest as I
from mendlist.operators import priorities as P
from mendlist.operators import split as L
from mendlist.operators import taxonomy as X
from mendlist.operators import training as T
from mendlist.operators.common import nest
from mendlist.plans import baseline, increments
from mendlist.plans.flow import analyse
from mendlist.plans.gold import evaluate
from mendlist.plans.ingest import Tables, ingest_csv
from mendlist.sources import literals, readers, writers
from mendlist.storage import fresh_path, settle
from testbed import roles as R
from testbed.roles import Data

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(Data(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def r6(name: str, alias=None):
    return F.round(name, 6).alias(alias or name)


def shown_scores(scores: DataFrame) -> DataFrame:
    return scores.select(
        "feature_id",
        F.col("window_start").cast("string").alias("window_start"),
        F.col("window_end").cast("string").alias("window_end"),
        r6("score"),
        "mention_count",
        r6("negative_ratio"),
        *([r6("undated_ratio")] if "undated_ratio" in scores.columns else []),
        r6("trend_delta"),
    )


# -- criticality ---------------------------------------------------------------


def flagship_scores(d: Data) -> DataFrame:
    return K.windowed_scores(K.dated_aspects(d.aspects, d.reviews))


@query(
    "criticality_windowed",
    f"WITH {R.ASPECTS}, {R.REVIEWS}, {R.DATED}, {R.scores_sql('dated')} SELECT {R.SCORE_COLUMNS} FROM scores",
)
def criticality_windowed(d):
    return shown_scores(flagship_scores(d))


@query(
    "criticality_with_undated",
    f"WITH {R.ASPECTS}, {R.PARTLY_DATED}, {R.scores_sql('dated')} SELECT {R.SCORE_COLUMNS} FROM scores",
)
def criticality_with_undated(d):
    return shown_scores(K.windowed_scores(d.partly_dated))


@query(
    "undated_report",
    f"""WITH {R.ASPECTS}, {R.PARTLY_DATED}, {R.scores_sql('dated')}
    SELECT count(*) FILTER (window_start IS NULL) AS undated_features,
           count(*) FILTER (undated_ratio > 0.5) AS mostly_undated_rows FROM scores""",
)
def undated_report(d):
    return K.undated_report(K.windowed_scores(d.partly_dated))


@query(
    "month_windows",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE)::VARCHAR AS window_start,
    last_day(CAST(o_orderdate AS DATE))::VARCHAR AS window_end FROM orders""",
)
def month_windows(d):
    day = F.col("o_orderdate").cast("date")
    return d.orders.select(
        "o_orderkey",
        S.month_start(day).cast("string").alias("window_start"),
        S.month_end(day).cast("string").alias("window_end"),
    )


# -- backlog reads -------------------------------------------------------------

_SCORES = f"{R.ASPECTS}, {R.REVIEWS}, {R.FEATURES}, {R.DATED}, {R.scores_sql('dated')}"
_LATEST = f"""{_SCORES}, latest AS (
  SELECT s.*, feature_key, display_name FROM scores s JOIN features f ON s.feature_id = f.id
  JOIN (SELECT feature_id, max(window_end) AS newest FROM scores GROUP BY feature_id) m
    ON s.feature_id = m.feature_id AND s.window_end = m.newest)"""
_BACKLOG = """SELECT feature_key, display_name, CAST(window_start AS VARCHAR) AS window_start,
  CAST(window_end AS VARCHAR) AS window_end, round(score, 6) AS score, mention_count,
  round(negative_ratio, 6) AS negative_ratio, round(trend_delta, 6) AS trend_delta"""


def _shown_backlog(rows):
    return rows.select(
        "feature_key",
        "display_name",
        F.col("window_start").cast("string").alias("window_start"),
        F.col("window_end").cast("string").alias("window_end"),
        r6("score"),
        "mention_count",
        r6("negative_ratio"),
        r6("trend_delta"),
    )


@query(
    "backlog_latest_high",
    f"WITH {_LATEST} {_BACKLOG} FROM latest ORDER BY latest.score DESC, feature_key LIMIT 10",
)
def backlog_latest_high(d):
    return _shown_backlog(B.backlog(flagship_scores(d), d.features, "high", 10))


@query(
    "backlog_latest_low",
    f"WITH {_LATEST} {_BACKLOG} FROM latest ORDER BY latest.score ASC, feature_key LIMIT 10",
)
def backlog_latest_low(d):
    return _shown_backlog(B.backlog(flagship_scores(d), d.features, "low", 10))


@query(
    "feature_trend_points",
    f"""WITH {_SCORES} SELECT feature_key, display_name, CAST(window_start AS VARCHAR) AS window_start,
    CAST(window_end AS VARCHAR) AS window_end, round(score, 6) AS score, mention_count,
    round(negative_ratio, 6) AS negative_ratio
    FROM scores JOIN features ON feature_id = features.id WHERE feature_key = 'brand#7'""",
)
def feature_trend_points(d):
    points = B.trend_points(flagship_scores(d), d.features, "brand#7")
    return points.select(
        "feature_key",
        "display_name",
        F.col("window_start").cast("string").alias("window_start"),
        F.col("window_end").cast("string").alias("window_end"),
        r6("score"),
        "mention_count",
        r6("negative_ratio"),
    )


@query(
    "feature_trend",
    f"""WITH {_SCORES} SELECT feature_key, display_name, count(*) AS n_points,
    string_agg(CAST(window_start AS VARCHAR) || ':' || mention_count, '|' ORDER BY window_start) AS points
    FROM scores JOIN features ON feature_id = features.id WHERE feature_key = 'brand#7' GROUP BY ALL""",
)
def feature_trend(d):
    trend = B.feature_trend(flagship_scores(d), d.features, "brand#7")
    point = lambda p: F.concat_ws(":", p["window_start"], p["mention_count"])
    return trend.select(
        "feature_key",
        "display_name",
        F.size("points").cast("bigint").alias("n_points"),
        F.array_join(F.transform("points", point), "|").alias("points"),
    )


@query(
    "features_active",
    f"WITH {R.FEATURES} SELECT id, feature_key, display_name FROM features WHERE is_active",
)
def features_active(d):
    return X.list_features(d.features).select("id", "feature_key", "display_name")


_HITS = """(SELECT review_id FROM aspects JOIN features f ON feature_id = f.id
  WHERE feature_key = 'brand#7' AND sentiment = 'negative')"""


def _filtered(d):
    return B.matching_reviews(d.reviews, d.aspects, d.features, "brand#7", "negative", "O")


@query(
    "reviews_filtered_page",
    f"""WITH {R.ASPECTS}, {R.REVIEWS}, {R.FEATURES},
    page AS (SELECT * FROM reviews WHERE source = 'O' AND id IN {_HITS}
             ORDER BY ingested_at DESC, id LIMIT 50 OFFSET 20)
    SELECT page.id, app_id, review_text, rating, CAST(review_date AS VARCHAR) AS review_date,
      coalesce(string_agg(feature_key || ':' || sentiment || ':' || CAST(round(confidence * 100) AS BIGINT) || ':' || a.source, '|'
        ORDER BY feature_key || ':' || sentiment || ':' || CAST(round(confidence * 100) AS BIGINT) || ':' || a.source), '') AS aspects
    FROM page LEFT JOIN (aspects a JOIN features f ON a.feature_id = f.id) ON a.review_id = page.id
    GROUP BY 1, 2, 3, 4, 5""",
)
def reviews_filtered_page(d):
    page = B.page_with_aspects(B.newest_page(_filtered(d), 50, 20), d.aspects, d.features)
    item = lambda a: F.concat_ws(
        ":", a["feature_key"], a["sentiment"], F.round(a["confidence"] * 100).cast("bigint"), a["source"]
    )
    return page.select(
        "id",
        "app_id",
        "review_text",
        F.col("rating").cast("bigint").alias("rating"),
        F.col("review_date").cast("string").alias("review_date"),
        F.array_join(F.array_sort(F.transform("aspects", item)), "|").alias("aspects"),
    )


@query(
    "reviews_after_cursor",
    f"""WITH {R.ASPECTS}, {R.REVIEWS}, {R.FEATURES} SELECT id, app_id, CAST(review_date AS VARCHAR) AS review_date,
    (row_number() OVER (ORDER BY ingested_at DESC, id) - 1) // 30 AS page
    FROM reviews WHERE source = 'O' AND id IN {_HITS} ORDER BY ingested_at DESC, id LIMIT 150""",
)
def reviews_after_cursor(d):
    """Five pages, each from the last row of the one before: the first 150 rows."""
    matching, cursor, pages = settle(_filtered(d)), None, []
    for n in range(5):
        pages.append(settle(B.page_after(matching, cursor, 30)))
        cursor = B.cursor_of(pages[-1])
        if cursor is None:
            break
    rows = [p.select("id", "app_id", F.col("review_date").cast("string").alias("review_date"), F.lit(n).cast("bigint").alias("page"))
            for n, p in enumerate(pages)]
    return reduce(DataFrame.union, rows)


@query(
    "reviews_filtered_total",
    f"""WITH {R.ASPECTS}, {R.REVIEWS}, {R.FEATURES}
    SELECT count(*) AS total FROM reviews WHERE source = 'O' AND id IN {_HITS}""",
)
def reviews_filtered_total(d):
    return B.total_reviews(_filtered(d))


@query(
    "reviews_by_source_total",
    f"""WITH {R.ASPECTS}, {R.REVIEWS}
    SELECT count(*) AS total FROM reviews WHERE source = 'P' AND id IN (SELECT review_id FROM aspects)""",
)
def reviews_by_source_total(d):
    return B.total_reviews(B.matching_reviews(d.reviews, d.aspects, d.features, source="P"))


@query(
    "reviews_with_aspects",
    f"""WITH {R.ASPECTS}, {R.REVIEWS}, {R.FEATURES}
    SELECT reviews.id, app_id, rating, feature_key, sentiment, round(confidence, 6) AS confidence, a.source AS aspect_source
    FROM reviews LEFT JOIN (aspects a JOIN features f ON a.feature_id = f.id) ON a.review_id = reviews.id""",
)
def reviews_with_aspects(d):
    rows = B.reviews_with_aspects(d.reviews, d.aspects, d.features)
    return rows.select(
        "id",
        "app_id",
        F.col("rating").cast("bigint").alias("rating"),
        "feature_key",
        "sentiment",
        r6("confidence"),
        "aspect_source",
    )


@query(
    "reviews_with_active_aspects",
    f"""WITH {R.ASPECTS}, {R.REVIEWS}, {R.FEATURES}, active AS (SELECT * FROM features WHERE feature_key < 'm')
    SELECT reviews.id, feature_key, round(confidence, 6) AS confidence
    FROM reviews LEFT JOIN (aspects a JOIN active f ON a.feature_id = f.id) ON a.review_id = reviews.id""",
)
def reviews_with_active_aspects(d):
    """A taxonomy that lacks some features: reviews stay when all of their aspects go."""
    rows = B.reviews_with_aspects(d.reviews, d.aspects, d.features.where("feature_key < 'm'"))
    return rows.select("id", "feature_key", r6("confidence"))


# -- priorities and KPIs -------------------------------------------------------

_TIER = """CASE WHEN negative >= 5 AND negative / CAST(mentions AS DOUBLE) >= 0.5 THEN 'Critical'
  WHEN negative >= 3 AND negative / CAST(mentions AS DOUBLE) >= 0.3 THEN 'High'
  WHEN negative >= 1 THEN 'Medium' ELSE 'Low' END AS priority"""


@query(
    "feature_priorities",
    f"WITH {R.FOUND}, {R.COUNTS} SELECT feature, mentions, positive, negative, {_TIER} FROM counts",
)
def feature_priorities(d):
    return P.feature_priorities(d.found_aspects)


_KPI = f"""{R.FOUND}, {R.COUNTS}, kpi AS (
  SELECT CAST(sum(mentions) AS BIGINT) AS total_aspects, sum(positive) * 100.0 / sum(mentions) AS positive_pct,
    sum(negative) * 100.0 / sum(mentions) AS negative_pct,
    sum(mentions) / CAST((SELECT count(DISTINCT original_review) FROM found) AS DOUBLE) AS average_aspects,
    (SELECT feature FROM counts WHERE negative > 0 ORDER BY negative DESC, mentions DESC, feature LIMIT 1) AS top_complaint,
    (SELECT negative FROM counts WHERE negative > 0 ORDER BY negative DESC, mentions DESC, feature LIMIT 1) AS top_complaint_mentions,
    (SELECT feature FROM counts WHERE positive > 0 ORDER BY positive DESC, negative DESC, mentions DESC, feature LIMIT 1) AS top_praise,
    (SELECT positive FROM counts WHERE positive > 0 ORDER BY positive DESC, negative DESC, mentions DESC, feature LIMIT 1) AS top_praise_mentions
  FROM counts)"""


@query(
    "kpi_summary",
    f"""WITH {_KPI} SELECT total_aspects, round(CAST(positive_pct AS DOUBLE), 6) AS positive_pct,
    round(CAST(negative_pct AS DOUBLE), 6) AS negative_pct, round(average_aspects, 6) AS average_aspects,
    top_complaint, top_complaint_mentions, top_praise, top_praise_mentions FROM kpi""",
)
def kpi_summary(d):
    return P.kpi_summary(d.found_aspects).select(
        "total_aspects",
        r6("positive_pct"),
        r6("negative_pct"),
        r6("average_aspects"),
        "top_complaint",
        "top_complaint_mentions",
        "top_praise",
        "top_praise_mentions",
    )


@query(
    "insight_text",
    f"""WITH {_KPI} SELECT '### Top Insights' || chr(10) || '• **' || top_complaint
    || '** is the most complained-about feature (' || top_complaint_mentions || ' negative mentions).' || chr(10)
    || '• Users highly appreciate **' || top_praise || '** (' || top_praise_mentions || ' positive mentions).'
    || chr(10) || chr(10) || '### Recommendation' || chr(10) || 'Prioritize fixing issues related to **'
    || top_complaint || '** before introducing new features.' AS summary_text FROM kpi""",
)
def insight_text(d):
    return P.insight_text(P.kpi_summary(d.found_aspects)).select("summary_text")


@query(
    "sentiment_distribution",
    f"WITH {R.FOUND} SELECT sentiment, count(*) AS mentions FROM found GROUP BY sentiment",
)
def sentiment_distribution(d):
    return P.sentiment_distribution(d.found_aspects)


@query("feature_mentions", f"WITH {R.FOUND}, {R.COUNTS} SELECT feature, mentions FROM counts")
def feature_mentions(d):
    return P.feature_mentions(d.found_aspects)


@query(
    "top_negative_features",
    f"""WITH {R.FOUND}, {R.COUNTS} SELECT feature, negative, mentions FROM counts WHERE negative > 0
    ORDER BY negative DESC, mentions DESC, feature LIMIT 10""",
)
def top_negative_features(d):
    return P.top_negative_features(d.found_aspects)


# -- text ----------------------------------------------------------------------


def clean_sql(text: str) -> str:
    steps = [
        (r"<[^>]+>", " "),
        (r"https?://\S+|www\.\S+", " "),
        (r"\S+@\S+\.\S+", " "),
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "),
        (r"!{3,}", "!!"),
        (r"\?{3,}", "??"),
        (r"\.{3,}", ".."),
        (r"\s+", " "),
    ]
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return f"trim({text})"


def near_sql(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({text}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(
    "clean_pages",
    f"SELECT * FROM (SELECT page_id, {clean_sql('html')} AS html FROM pages) WHERE length(html) > 0",
)
def clean_pages(d):
    return C.clean_reviews(d.pages.select("page_id", "html"), "html")


@query(
    "clean_documents",
    f"SELECT * FROM (SELECT doc_id, {clean_sql('text')} AS text FROM documents) WHERE length(text) > 0",
)
def clean_documents(d):
    return C.clean_reviews(d.documents.select("doc_id", "text"), "text")


@query(
    "cleaning_report",
    f"""SELECT count(*) AS rows_before, count(*) FILTER (n = 0) AS dropped_empty, count(*) FILTER (n > 0) AS rows_after
    FROM (SELECT length({clean_sql('text')}) AS n FROM (
      SELECT text FROM documents UNION ALL SELECT 'www.' || source || '/' || doc_id FROM documents))""",
)
def cleaning_report(d):
    """The documents, and for each a text that is nothing but an address."""
    address = F.concat(F.lit("www."), "source", F.lit("/"), "doc_id").alias("text")
    return C.cleaning_report(d.documents.select("text").union(d.documents.select(address)), "text")


def widened(words):
    wide = F.translate(words, "abcdexyz", "ａｂｃｄｅｘｙｚ")
    return F.replace(F.replace(wide, F.lit("fi"), F.lit("ﬁ")), F.lit("fl"), F.lit("ﬂ"))


@query(
    "clean_compatibility_forms_whole",
    "SELECT doc_id, trim(regexp_replace(text, '[ \\n]+', ' ', 'g')) AS text FROM (SELECT doc_id, "
    "array_to_string(regexp_extract_all(text, '[a-z]+'), ' ') AS text FROM documents) WHERE length(text) > 0",
)
def clean_compatibility_forms_whole(d):
    """Full-width letters and ligatures in place of plain ones, which NFKC turns back."""
    words = F.array_join(F.regexp_extract_all("text", F.lit("([a-z]+)")), " ")
    return C.clean_reviews(d.documents.select("doc_id", widened(words).alias("text")), "text")


def with_variants(d):
    """The documents, and a near copy of each."""
    near = F.concat(F.lit("* "), "text", F.lit(" !?")).alias("text")
    return d.documents.select("doc_id", "source", "text").union(
        d.documents.select((F.col("doc_id") + 10_000_000_000).alias("doc_id"), "source", near)
    )


_VARIANTS = """documents2 AS (SELECT doc_id, source, text FROM documents
  UNION ALL SELECT doc_id + 10000000000, source, '* ' || text || ' !?' FROM documents)"""


def dedup_sql(key: str, table: str = "documents") -> str:
    return f"""SELECT doc_id, source FROM {table}
    QUALIFY row_number() OVER (PARTITION BY source, {key} ORDER BY doc_id) = 1"""


@query("dedup_exact", dedup_sql("text"))
def dedup_exact(d):
    return C.dedup_reviews(d.documents, "doc_id", "text", "source", near=False).select("doc_id", "source")


@query("dedup_near", f"WITH {_VARIANTS} {dedup_sql(near_sql('text'), 'documents2')}")
def dedup_near(d):
    return C.dedup_reviews(with_variants(d), "doc_id", "text", "source").select("doc_id", "source")


@query(
    "dedup_accounting",
    f"""WITH {_VARIANTS}, d AS (SELECT source, text, {near_sql('text')} AS near FROM documents2),
    n AS (SELECT (SELECT count(*) FROM d) AS a, (SELECT count(*) FROM (SELECT DISTINCT source, text FROM d)) AS b,
                 (SELECT count(*) FROM (SELECT DISTINCT source, near FROM d)) AS c)
    SELECT a AS rows_before, a - b AS exact_dropped, b - c AS near_dropped, c AS rows_after FROM n""",
)
def dedup_accounting(d):
    return C.dedup_report(with_variants(d), "text", "source")


@query(
    "blank_near_keys",
    rf"""SELECT source, count(*) AS blank_near_keys FROM (
      SELECT source, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM (
        SELECT source, text FROM documents
        UNION ALL SELECT source, regexp_replace(text, '[A-Za-z0-9]', '*', 'g') FROM documents))
    WHERE length(line) > 0 AND {near_sql('line')} = '' GROUP BY source""",
)
def blank_near_keys(d):
    """The documents, and each with signs in place of its letters."""
    signs = d.documents.select("source", F.regexp_replace("text", "[A-Za-z0-9]", "*").alias("text"))
    lines = readers.lines_as_reviews(d.documents.select("source", "text").union(signs))
    return C.blank_near_keys(lines, "review", "source")


@query("english_documents", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def english_documents(d):
    return C.in_language(d.documents).select("doc_id", "source", "n_chars")


@query(
    "ad_hoc_lines",
    r"""SELECT doc_id, line_no - 1 AS line_no, review FROM (
      SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no,
             regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS review FROM documents)
    WHERE length(review) > 0""",
)
def ad_hoc_lines(d):
    lines = readers.lines_as_reviews(d.documents.select("doc_id", "text"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "review")


# -- ingest --------------------------------------------------------------------


@query(
    "review_records",
    f"""WITH {R.ANNOTATED} SELECT id, 'aware' AS source, app AS app_id, sentence AS review_text, domain,
    CAST(arg_min(rating, row_no) AS BIGINT) AS rating,
    nullif(arg_min(review_id, row_no), 'N/A') AS source_review_id
    FROM annotated GROUP BY id, app, sentence, domain""",
)
def review_records(d):
    return I.review_records(d.annotated, ["row_no"]).select(
        "id", "source", "app_id", "review_text", "domain", F.col("rating").cast("bigint").alias("rating"), "source_review_id"
    )


_ITEM = """term || ':' || category || ':' || sentiment || ':' || span_from || ':' || coalesce(CAST(span_to AS VARCHAR), '-')"""


@query(
    "nest_annotations",
    f"""WITH {R.ANNOTATED} SELECT id AS review_id, CAST(0 AS BIGINT) AS part, count(*) AS n,
    string_agg({_ITEM}, '|' ORDER BY row_no, {_ITEM}) AS annotations FROM annotated GROUP BY id""",
)
def nest_annotations(d):
    nested = I.nest_annotations(I.annotation_rows(d.annotated, F.col("row_no")))
    item = lambda a: F.concat_ws(
        ":", a["aspect_term"], a["aspect_category"], a["polarity"], a["from"], F.coalesce(a["to"].cast("string"), F.lit("-"))
    )
    return nested.select(
        "review_id",
        "part",
        F.size("annotations").cast("bigint").alias("n"),
        F.array_join(F.transform("annotations", item), "|").alias("annotations"),
    )


@query(
    "nest_hot_review",
    f"""WITH {R.ANNOTATED}, p AS (SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY row_no) - 1 AS position,
      row_no, term FROM annotated)
    SELECT domain AS review_id, position // 50 AS part, min(position) AS first, count(*) AS n,
    string_agg(row_no || ':' || term, '|' ORDER BY position) AS items FROM p GROUP BY 1, 2""",
)
def nest_hot_review(d):
    """Lists of thousands of rows (few domains) come in ordered parts."""
    rows = d.annotated.select("domain", "row_no", "term")
    nested = nest(rows, "domain", "row_no", F.concat_ws(":", "row_no", "term"), "items", per_list=50)
    return nested.select(
        F.col("domain").alias("review_id"), "part", (F.col("part") * 50).alias("first"),
        F.size("items").cast("bigint").alias("n"), F.array_join("items", "|").alias("items"),
    )


@query("bad_ratings", "SELECT count(*) AS bad_ratings FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def bad_ratings(d):
    """Urgent and high orders give their number, the others text."""
    rating = F.when(F.col("o_orderpriority") == "1-URGENT", "1").when(F.col("o_orderpriority") == "2-HIGH", "2.0")
    return I.bad_ratings(d.orders.select(F.coalesce(rating, "o_orderpriority").alias("rating")))


@query(
    "metadata_fields",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS domain,
    CASE WHEN event_type NOT IN ('error', 'click') THEN CAST(user_id AS VARCHAR) END AS source_review_id,
    CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS category,
    CAST(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS BIGINT) AS n_annotations FROM events""",
)
def metadata_fields(d):
    kind = F.col("event_type")
    note = F.concat(F.lit('{"aspect_category":"'), F.get_json_object("props", "$.k"), F.lit('"}'))
    text = F.concat(
        F.lit('{"domain":"'), kind, F.lit('","aware_review_id":"'),
        F.when(kind != "click", F.col("user_id").cast("string")).otherwise(""),
        F.lit('","aware_annotations":['), note, F.lit("]}"),
    )
    # events of one kind carry metadata that is not JSON
    meta = readers.review_metadata(F.when(kind != "error", text).otherwise("not json"))
    m = F.col("m")
    return d.events.select("event_id", meta.alias("m")).select(
        "event_id",
        m["domain"].alias("domain"),
        m["source_review_id"].alias("source_review_id"),
        F.get(m["annotations"], F.lit(0))["aspect_category"].alias("category"),
        F.size(m["annotations"]).cast("bigint").alias("n_annotations"),
    )


@query(
    "stable_ids",
    "SELECT c_custkey, sha256(c_name || chr(31) || c_mktsegment) AS id FROM customer",
)
def stable_ids(d):
    return d.customer.select("c_custkey", I.stable_id(F.col("c_name"), F.col("c_mktsegment")).alias("id"))


@query(
    "limited_scan",
    "SELECT CAST(doc_id AS VARCHAR) AS id, text AS review_text FROM documents ORDER BY CAST(doc_id AS VARCHAR) LIMIT 100",
)
def limited_scan(d):
    return readers.first_reviews(d.documents_as_reviews, 100)


# -- split ---------------------------------------------------------------------

_TURN_SPLIT = R.split_sql(R.TURN_GROUPS)
_TURN_ROWS = "SELECT conv_id, turn, split FROM conversations JOIN assigned ON CAST(conv_id AS VARCHAR) = group_key"


def _split_turns(d):
    return L.assign_splits(d.turns, order_by="turn")


@query("split_grouped", f"WITH {_TURN_SPLIT} {_TURN_ROWS}")
def split_grouped(d):
    return _split_turns(d).select("conv_id", "turn", "split")


@query(
    "split_documents",
    f"""WITH {R.split_sql(R.DOCUMENT_GROUPS, 0.2, 0.1)}
    SELECT CAST(group_key AS BIGINT) AS doc_id, split FROM assigned""",
)
def split_documents(d):
    rows = d.documents_as_reviews.select("id", "doc_id", "domain", F.col("id").alias("group_key"))
    return L.assign_splits(rows, test=0.2, val=0.1).select("doc_id", "split")


@query(
    "split_unstratified",
    f"""WITH {R.split_sql("groups AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS group_key, CAST(NULL AS VARCHAR) AS domain FROM events)")}
    SELECT event_id, split FROM events JOIN assigned ON CAST(user_id AS VARCHAR) = group_key""",
)
def split_unstratified(d):
    rows = d.events.select(
        "event_id", F.col("user_id").cast("string").alias("group_key"), F.lit(None).cast("string").alias("domain")
    )
    return L.assign_splits(rows, order_by="event_id").select("event_id", "split")


@query(
    "split_accounting",
    f"""WITH {_TURN_SPLIT} SELECT split, count(*) AS rows, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
    FROM ({_TURN_ROWS}) GROUP BY split""",
)
def split_accounting(d):
    return L.split_report(_split_turns(d)).select("split", "rows", r6("share"))


@query(
    "split_strata_check",
    f"""WITH {R.TURN_GROUPS}, sizes AS (SELECT domain, count(*) AS n FROM groups GROUP BY domain)
    SELECT CAST(sum(n) AS BIGINT) AS n_groups, CAST(coalesce(sum(n) FILTER (domain IS NULL), 0) AS BIGINT) AS n_unknown,
    (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) > 1)) AS n_mixed,
    count(domain) AS n_domains, min(n) AS smallest,
    CAST(count(domain) > 1 AND bool_and(domain IS NOT NULL) AND min(n) >= 2 AS BIGINT) AS usable FROM sizes""",
)
def split_strata_check(d):
    check = L.strata_check(L.group_domains(d.turns, "turn"))
    return check.withColumn("usable", F.col("usable").cast("bigint"))


@query(
    "split_group_domains",
    f"WITH {R.TURN_GROUPS} SELECT group_key, domain FROM groups",
)
def split_group_domains(d):
    return L.group_domains(d.turns, "turn").select("group_key", "domain")


@query(
    "split_atomicity",
    f"""WITH {_TURN_SPLIT}, r AS ({_TURN_ROWS}), g AS (SELECT conv_id, count(DISTINCT split) AS n FROM r GROUP BY conv_id)
    SELECT count(*) AS n_groups, count(*) FILTER (n > 1) AS n_straddling FROM g""",
)
def split_atomicity(d):
    return L.straddling_groups(_split_turns(d))


# -- training records ----------------------------------------------------------

KINDS = ("economy", "large", "medium", "small")  # of six part types; the others are no labels
_KINDS_SQL = "('economy', 'large', 'medium', 'small')"
_PAIRS = f"""{R.ANNOTATED}, pairs AS (
  SELECT id, app, domain, sentence, category, nullif(sentiment, 'N/A') AS sentiment, min(row_no) AS first_at
  FROM annotated WHERE category IN {_KINDS_SQL} GROUP BY ALL),
texts AS (SELECT DISTINCT id, sentence AS text FROM annotated)"""


def _master(d):
    pairs = T.aspect_pairs(I.annotation_rows(d.annotated, F.col("row_no")), KINDS)
    return T.master_records(I.review_records(d.annotated, ["row_no"]), pairs)


@query(
    "training_master",
    f"""WITH {_PAIRS} SELECT t.id AS review_id, text,
    coalesce(string_agg(category || ':' || coalesce(sentiment, '-'), '|' ORDER BY first_at, category, sentiment), '') AS aspects
    FROM texts t LEFT JOIN pairs p ON t.id = p.id GROUP BY t.id, text""",
)
def training_master(d):
    item = lambda a: F.concat_ws(":", a["category"], F.coalesce(a["sentiment"], F.lit("-")))
    return _master(d).select(
        "review_id", "text", F.array_join(F.transform("aspects", item), "|").alias("aspects")
    )


@query(
    "training_category",
    f"""WITH {_PAIRS} SELECT t.id AS review_id, text,
    coalesce(string_agg(DISTINCT category, '|' ORDER BY category), '') AS labels
    FROM texts t LEFT JOIN pairs p ON t.id = p.id GROUP BY t.id, text""",
)
def training_category(d):
    records = T.category_records(_master(d))
    return records.select("review_id", "text", F.array_join("labels", "|").alias("labels"))


@query(
    "training_sentiment",
    f"""WITH {_PAIRS} SELECT t.id AS review_id, category AS aspect, text, sentiment AS label
    FROM texts t JOIN pairs p ON t.id = p.id WHERE sentiment IS NOT NULL""",
)
def training_sentiment(d):
    return T.sentiment_records(_master(d))


@query(
    "training_from_nested",
    f"""WITH {_PAIRS} SELECT t.id AS review_id,
    coalesce(string_agg(category || ':' || coalesce(sentiment, '-'), '|' ORDER BY first_at, category, sentiment), '') AS aspects
    FROM texts t LEFT JOIN pairs p ON t.id = p.id GROUP BY t.id""",
)
def training_from_nested(d):
    nested = I.nest_annotations(I.annotation_rows(d.annotated, F.col("row_no")))
    item = lambda a: F.concat_ws(":", a["category"], F.coalesce(a["sentiment"], F.lit("-")))
    again = I.annotations_of(nested.withColumnRenamed("review_id", "id"))
    master = T.master_records(I.review_records(d.annotated, ["row_no"]), T.aspect_pairs(again, KINDS))
    return master.select("review_id", F.array_join(F.transform("aspects", item), "|").alias("aspects"))


def _split_records(d):
    """All category records, without labels too, whose split is the order status (three values)."""
    known = F.when(F.col("category").isin(*KINDS), F.col("category")).alias("category")
    return d.annotated.select("sentence", "domain", known).groupBy(F.col("sentence").alias("text"), F.col("domain").alias("split")).agg(
        F.collect_set("category").alias("labels")
    )


@query(
    "label_histogram",
    f"""WITH {R.ANNOTATED}, n AS (SELECT domain AS split, category AS label, count(DISTINCT sentence) AS n FROM annotated
      WHERE category IN ('economy', 'large', 'medium', 'small') GROUP BY 1, 2),
    grid AS (SELECT DISTINCT domain AS split, unnest(['economy', 'large', 'medium', 'small', 'unseen']) AS label FROM annotated)
    SELECT split, label, coalesce(n, 0) AS n FROM grid LEFT JOIN n USING (split, label)""",
)
def label_histogram(d):
    return T.label_histogram(_split_records(d), (*KINDS, "unseen"))


@query(
    "sentiment_histogram",
    f"""WITH {R.ANNOTATED} SELECT domain AS split, sentiment AS label, count(*) AS n FROM annotated
    WHERE sentiment <> 'N/A' GROUP BY 1, 2""",
)
def sentiment_histogram(d):
    rows = d.annotated.where("sentiment <> 'N/A'")
    return T.sentiment_histogram(rows.select(F.col("domain").alias("split"), F.col("sentiment").alias("label")))


def _labels(d):
    return d.annotated.select(
        F.col("sentence").alias("review_id"),
        F.col("sentence").alias("review_text"),
        F.col("category").alias("feature_key"),
        "sentiment",
    )


def _progress(d):
    status = F.when(F.col("o_orderstatus") == "P", "failed").otherwise("labeled")
    text = F.concat(F.lit("order, number "), F.col("o_orderkey"))
    return d.orders.select(text.alias("review_id"), text.alias("review_text"), status.alias("status"))


@query(
    "multi_hot",
    f"""WITH {R.ANNOTATED}, f AS (SELECT sentence, bool_or(category = 'economy') AS a, bool_or(category = 'large') AS b,
      bool_or(category = 'medium') AS c, bool_or(category = 'small') AS d FROM annotated GROUP BY sentence)
    SELECT 'order, number ' || o_orderkey AS review_id,
      CAST(coalesce(a, false) AS INT) || '|' || CAST(coalesce(b, false) AS INT) || '|' ||
      CAST(coalesce(c, false) AS INT) || '|' || CAST(coalesce(d, false) AS INT) AS labels
    FROM orders LEFT JOIN f ON sentence = 'order, number ' || o_orderkey WHERE o_orderstatus <> 'P'""",
)
def multi_hot(d):
    examples = T.category_examples(_labels(d).select("review_id", "feature_key"), _progress(d), KINDS)
    hot = F.transform("labels", lambda x: x.cast("int").cast("string"))
    return examples.select("review_id", F.array_join(hot, "|").alias("labels"))


@query(
    "category_pos_weights",
    f"""WITH {R.ANNOTATED}, r AS (SELECT DISTINCT sentence, domain FROM annotated),
    total AS (SELECT count(*) AS total FROM r),
    n AS (SELECT label, (SELECT count(DISTINCT sentence) FROM annotated WHERE category = label) AS positives
          FROM (SELECT unnest(['economy', 'large', 'medium', 'small', 'unseen']) AS label))
    SELECT label, positives, total,
      round(least((total - positives) / (positives + CAST(0.00001 AS DOUBLE)), 15), 6) AS weight FROM n, total""",
)
def category_pos_weights(d):
    weights = T.category_pos_weights(_split_records(d), (*KINDS, "unseen"))
    return weights.select("label", "positives", "total", r6("weight"))


@query(
    "sentiment_class_weights",
    f"""WITH {R.ANNOTATED}, n AS (SELECT label, i AS label_index,
      (SELECT count(*) FROM annotated WHERE sentiment = label) AS n
      FROM (VALUES ('negative', CAST(0 AS BIGINT)), ('neutral', 1), ('positive', 2)) v(label, i))
    SELECT label, label_index, n,
      round(least(CAST(sum(n) OVER () AS DOUBLE) / (3 * (n + CAST(0.00001 AS DOUBLE))), 10), 6) AS weight FROM n""",
)
def sentiment_class_weights(d):
    weights = T.sentiment_class_weights(d.annotated.select(F.col("sentiment").alias("label")))
    return weights.select("label", F.col("label_index").cast("bigint").alias("label_index"), "n", r6("weight"))


def _named_kinds(d):
    """A taxonomy over part types; promo parts have no feature."""
    kind = F.lower("p_type")
    named = d.part.select(kind.alias("feature_key"), F.concat(F.lit("Kind "), kind).alias("display_name"))
    return settle(named.where("feature_key <> 'promo'").distinct())


@query(
    "sentiment_pairs",
    f"""WITH {R.ANNOTATED} SELECT sentence AS review_id, category AS feature_key, sentence AS text_a,
    'Kind ' || category AS text_b, CAST(CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS BIGINT) AS label
    FROM annotated WHERE category <> 'promo' AND sentiment <> 'N/A'""",
)
def sentiment_pairs(d):
    pairs = T.sentiment_pairs(_labels(d), _named_kinds(d))
    return pairs.withColumn("label", F.col("label").cast("bigint"))


@query(
    "sentiment_pair_report",
    f"""WITH {R.ANNOTATED} SELECT count(*) AS rows, count(*) FILTER (category = 'promo') AS unknown_feature,
    count(*) FILTER (category <> 'promo' AND sentiment = 'N/A') AS invalid_sentiment,
    count(*) FILTER (category <> 'promo' AND sentiment <> 'N/A') AS kept FROM annotated""",
)
def sentiment_pair_report(d):
    return T.sentiment_pair_report(_labels(d), _named_kinds(d))


@query(
    "trainer_pairs",
    f"""WITH {R.ANNOTATED} SELECT sentence AS review_id, sentence AS text_a,
    upper(category[1]) || category[2:] || ' ' || upper(term[1]) || term[2:string_split(term, ' ')[1].length()] || ' '
      || upper(string_split(term, ' ')[2][1]) || string_split(term, ' ')[2][2:] AS text_b,
    CAST(CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS BIGINT) AS label
    FROM annotated WHERE sentiment <> 'N/A'""",
)
def trainer_pairs(d):
    aspect = F.concat_ws("_", "category", F.replace("term", F.lit(" "), F.lit("_")))
    rows = d.annotated.select(
        F.col("sentence").alias("review_id"), F.col("sentence").alias("text"), aspect.alias("aspect"), F.col("sentiment").alias("label")
    )
    pairs = T.trainer_pairs(rows)
    return pairs.withColumn("label", F.col("label").cast("bigint"))


@query(
    "label_index",
    "SELECT p_name AS label, row_number() OVER (ORDER BY p_name) - 1 AS label_index FROM (SELECT DISTINCT p_name FROM part)",
)
def label_index(d):
    index = T.label_index(d.part, "p_name")
    return index.select("label", F.col("label_index").cast("bigint").alias("label_index"))


@query(
    "unknown_features",
    "SELECT DISTINCT lower(p_brand) AS feature_key FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_brand = 'Brand#13'",
)
def unknown_features(d):
    used = d.aspects.select(F.lower("feature_id").alias("feature_key"))
    return T.unknown_features(used, d.features.where("is_active"))


@query(
    "taxonomy_missing",
    """SELECT p_partkey AS feature_key FROM part WHERE p_partkey NOT IN
    (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R')""",
)
def taxonomy_missing(d):
    stored = d.lineitem.where("l_quantity >= 49 AND l_returnflag = 'R'")
    return X.missing_features(
        d.part.select(F.col("p_partkey").alias("feature_key")), stored.select(F.col("l_partkey").alias("feature_key"))
    )


# -- aspects from text ---------------------------------------------------------

# Complaints added to documents, so that every rule hits and every tier has a feature.
_COMPLAINTS = [
    ("doc_id BETWEEN 1 AND 2", " The PRICE is too high"),
    ("doc_id BETWEEN 3 AND 5", " late again"),
    ("doc_id % 7 = 0", " then it Crashed"),
    ("doc_id % 7 = 1", " but beautiful"),
    ("doc_id % 7 = 2", " nice design"),
]
_COMPLAINT = "CASE " + " ".join(f"WHEN {when} THEN '{words}'" for when, words in _COMPLAINTS) + " ELSE '' END"


def with_complaints(d):
    return d.documents.select("doc_id", F.concat("text", F.expr(_COMPLAINT)).alias("text"))


_TAGS = f"""complaints AS (SELECT doc_id, text || {_COMPLAINT} AS text FROM documents),
""" + """tags AS (
  SELECT doc_id, text, unnest(CASE WHEN len(hits) > 0 THEN hits ELSE [{'f': 'general', 's': 'neutral', 'c': 0.5}] END) AS tag FROM (
    SELECT doc_id, text, list_filter([
      CASE WHEN contains(t, 'crash') OR contains(t, 'bug') THEN {'f': 'reliability', 's': 'negative', 'c': 0.95} END,
      CASE WHEN contains(t, 'ui') OR contains(t, 'design') OR contains(t, 'beautiful') THEN
        {'f': 'ui_ux', 's': CASE WHEN contains(t, 'beautiful') THEN 'positive' ELSE 'neutral' END, 'c': 0.88} END,
      CASE WHEN contains(t, 'price') OR contains(t, 'expensive') OR contains(t, 'subscription') THEN
        {'f': 'pricing', 's': 'negative', 'c': 0.92} END,
      CASE WHEN contains(t, 'notification') OR contains(t, 'late') THEN
        {'f': 'notifications', 's': 'negative', 'c': 0.85} END], lambda x: x IS NOT NULL) AS hits
    FROM (SELECT doc_id, text, lower(text) AS t FROM complaints)))"""


@query(
    "keyword_tags",
    f"""WITH {_TAGS} SELECT doc_id, tag.f AS feature_key, tag.s AS sentiment, CAST(tag.c AS DOUBLE) AS confidence FROM tags""",
)
def keyword_tags(d):
    return A.tag_reviews(with_complaints(d), "text").drop("original_review")


@query(
    "ad_hoc_analysis",
    f"""WITH {_TAGS}, found AS (SELECT text AS original_review, tag.f AS feature, tag.s AS sentiment FROM tags), {R.COUNTS}
    SELECT feature, mentions, positive, negative, {_TIER} FROM counts""",
)
def ad_hoc_analysis(d):
    return analyse(with_complaints(d).select(F.col("text").alias("review")))["priorities"]


# A stand-in model simple enough for SQL: shares of letters in the text.
LETTERS = {"electric": "e", "quiet": "q", "zealous": "z"}
LETTER_THRESHOLD = 0.004


def letter_categories(letters=tuple(LETTERS.values())):
    def load():
        import numpy as np

        def score(texts):
            size = texts.str.len().to_numpy()
            return np.stack([texts.str.count(c).to_numpy() / size for c in letters], axis=1)

        return score

    return load


def letter_sentiments():
    def load():
        import numpy as np

        def score(texts, names):
            counts = np.stack([texts.str.count(c).to_numpy() for c in "nts"], axis=1) + 1.0
            counts[:, 0] += names.str.len().to_numpy()
            return counts / counts.sum(axis=1, keepdims=True)

        return score

    return load


def _letter_features(d):
    """Features with a display name; only one of them is a label of the stand-in model."""
    english = F.col("lang") == "en"
    named = d.documents.select(
        F.when(english, "electric").otherwise(F.col("lang")).alias("feature_key"),
        F.when(english, "Power").otherwise(F.col("lang")).alias("display_name"),
    )
    return settle(named.distinct())


def _count(c, text="text"):
    return f"(length({text}) - length(replace({text}, '{c}', '')))"


_ROUTED = f"""found AS (
  SELECT doc_id, text, x.k AS feature_key, x.d AS display_name FROM (
    SELECT doc_id, text, unnest([
      {{'k': 'electric', 'd': 'Power', 'p': {_count('e')} / CAST(length(text) AS DOUBLE)}},
      {{'k': 'quiet', 'd': 'quiet', 'p': {_count('q')} / CAST(length(text) AS DOUBLE)}},
      {{'k': 'zealous', 'd': 'zealous', 'p': {_count('z')} / CAST(length(text) AS DOUBLE)}}]) AS x
    FROM documents) WHERE x.p >= CAST(0.004 AS DOUBLE)),
shares AS (SELECT doc_id, feature_key, {_count('n')} + 1.0 + length(display_name) AS a, {_count('t')} + 1.0 AS b,
  {_count('s')} + 1.0 AS c FROM found),
routed AS (SELECT CAST(doc_id AS VARCHAR) AS review_id, feature_key,
  CASE WHEN a >= b AND a >= c THEN 'negative' WHEN b >= c THEN 'neutral' ELSE 'positive' END AS sentiment,
  CAST(greatest(a, b, c) AS DOUBLE) / CAST(a + b + c AS DOUBLE) AS confidence, 'finetuned' AS source FROM shares)"""


def _routed(d):
    return A.route_reviews(
        d.documents_as_reviews,
        _letter_features(d),
        A.scorer(letter_categories()),
        A.scorer(letter_sentiments()),
        labels=tuple(LETTERS),
        threshold=LETTER_THRESHOLD,
    )


@query(
    "routed_aspects",
    f"WITH {_ROUTED} SELECT review_id, feature_key, sentiment, round(confidence, 6) AS confidence, source FROM routed",
)
def routed_aspects(d):
    return _routed(d).withColumn("confidence", r6("confidence"))


def _routed_lines(d):
    """Routed rows with some confidences missing."""
    confidence = F.when(F.col("l_linenumber") != 2, F.col("confidence"))
    return d.aspects.select(
        "review_id", F.lower("feature_id").alias("feature_key"), "sentiment", confidence.alias("confidence"), "source"
    )


@query(
    "aspects_resolved",
    f"""WITH {R.ASPECTS} SELECT review_id, feature_id, sentiment,
    round(CASE WHEN l_linenumber <> 2 THEN confidence ELSE 1 END, 6) AS confidence, source
    FROM aspects WHERE feature_id <> 'Brand#13'""",
)
def aspects_resolved(d):
    resolved = A.resolve_aspects(_routed_lines(d), d.features.where("is_active"))
    return resolved.drop("id").withColumn("confidence", r6("confidence"))


@query(
    "unresolved_aspects",
    f"WITH {R.ASPECTS} SELECT lower(feature_id) AS feature_key, count(*) AS rows FROM aspects WHERE feature_id = 'Brand#13' GROUP BY 1",
)
def unresolved_aspects(d):
    return A.unresolved_aspects(_routed_lines(d), d.features.where("is_active"))


@query(
    "source_rates",
    f"""WITH {R.ASPECTS} SELECT count(*) AS total,
    round(count(*) FILTER (source = 'finetuned') / CAST(count(*) AS DOUBLE), 6) AS finetuned_rate,
    round(count(*) FILTER (source = 'llm_fallback') / CAST(count(*) AS DOUBLE), 6) AS llm_fallback_rate FROM aspects""",
)
def source_rates(d):
    return A.source_rates(d.aspects).select("total", r6("finetuned_rate"), r6("llm_fallback_rate"))


@query(
    "inference_stats",
    f"""WITH {R.ASPECTS}, {R.REVIEWS} SELECT (SELECT count(*) FROM reviews) AS reviews_processed,
    count(*) FILTER (feature_id <> 'Brand#13') AS aspects,
    round(count(*) FILTER (source = 'finetuned' AND feature_id <> 'Brand#13') / CAST(count(*) FILTER (feature_id <> 'Brand#13') AS DOUBLE), 6) AS finetuned_rate,
    round(count(*) FILTER (source = 'llm_fallback' AND feature_id <> 'Brand#13') / CAST(count(*) FILTER (feature_id <> 'Brand#13') AS DOUBLE), 6) AS llm_fallback_rate,
    count(*) FILTER (feature_id = 'Brand#13') AS unresolved, 'brand#13' AS unknown_keys FROM aspects""",
)
def inference_stats(d):
    stats = A.run_statistics(d.reviews, _routed_lines(d), d.features.where("is_active"))
    return stats.select(
        "reviews_processed", "aspects", r6("finetuned_rate"), r6("llm_fallback_rate"), "unresolved",
        F.array_join("unknown_keys", "|").alias("unknown_keys"),
    )


@query(
    "display_names",
    f"""WITH {R.ASPECTS} SELECT lower(feature_id) AS feature_key,
    CASE WHEN feature_id = 'Brand#13' THEN 'brand#13' ELSE 'The ' || feature_id END AS display_name,
    count(*) AS mentions FROM aspects GROUP BY 1, 2""",
)
def display_names(d):
    counts = d.aspects.groupBy(F.lower("feature_id").alias("feature_key")).agg(F.count("*").alias("mentions"))
    return X.with_display_name(counts, d.features.where("is_active"))


# -- model outputs -------------------------------------------------------------


@query(
    "sigmoid_softmax",
    f"""WITH v AS (SELECT vec_id, {R.logits_sql(0, 63, 4.0)} AS x FROM embeddings),
    r AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(x) AS y FROM v),
    m AS (SELECT vec_id, max(y) AS top FROM r GROUP BY vec_id),
    e AS (SELECT vec_id, pos, y, exp(y - top) AS e FROM r JOIN m USING (vec_id))
    SELECT vec_id, pos, round(1 / (1 + exp(-y)), 6) AS sigmoid, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS softmax FROM e""",
)
def sigmoid_softmax(d):
    x = d.logits(0, 63, 4.0)
    zipped = F.arrays_zip(gates.sigmoid(x).alias("sigmoid"), gates.softmax(x).alias("softmax"))
    rows = d.embeddings.select("vec_id", F.posexplode(zipped).alias("pos", "v"))
    return rows.select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), r6("v.sigmoid", "sigmoid"), r6("v.softmax", "softmax")
    )


_PROBS = f"list_transform({R.logits_sql(0, 9, 12.0)}, lambda y: 1 / (1 + exp(-y)))"


@query(
    "category_confidence_gate",
    f"""WITH v AS (SELECT vec_id, {_PROBS} AS p FROM embeddings),
    c AS (SELECT vec_id, p, list_transform(p, lambda q: CASE WHEN q >= 0.6 THEN 0.5 + 0.5 * ((q - 0.6) / (1 - 0.6 + 1e-9))
      ELSE 0.5 + 0.5 * ((0.6 - q) / (0.6 + 1e-9)) END) AS c FROM v)
    SELECT vec_id, len(list_filter(p, lambda q: q >= 0.6)) AS positives, round(list_min(c), 6) AS least_confidence,
      round(list_max(c), 6) AS top_confidence,
      CAST(coalesce(list_min(list_transform(list_filter(p, lambda q: q >= 0.6), lambda q: 0.5 + 0.5 * ((q - 0.6) / (1 - 0.6 + 1e-9)))) < 0.65, false) AS BIGINT) AS needs_fallback
    FROM c""",
)
def category_confidence_gate(d):
    probs = gates.sigmoid(d.logits(0, 9, 12.0))
    sure = gates.decision_confidence(probs, 0.6)
    return d.embeddings.select(
        "vec_id",
        F.size(F.filter(probs, lambda p: p >= 0.6)).cast("bigint").alias("positives"),
        F.round(F.array_min(sure), 6).alias("least_confidence"),
        F.round(F.array_max(sure), 6).alias("top_confidence"),
        gates.category_needs_fallback(probs, threshold=0.6).cast("bigint").alias("needs_fallback"),
    )


@query(
    "predicted_labels",
    f"""WITH v AS (SELECT vec_id, {_PROBS} AS p FROM embeddings)
    SELECT vec_id, array_to_string(list_transform(list_filter(range(10), lambda i: p[i + 1] >= 0.5), lambda i: 'l' || i), '|') AS labels
    FROM v""",
)
def predicted_labels(d):
    names = F.array(*[F.lit(f"l{i}") for i in range(10)])
    found = gates.predicted_labels(gates.sigmoid(d.logits(0, 9, 12.0)), names, 0.5)
    return d.embeddings.select("vec_id", F.array_join(found, "|").alias("labels"))


_SENTIMENT_LOGITS = R.logits_sql(10, 12, 8.0)


@query(
    "sentiment_confidence_gate",
    f"""WITH v AS (SELECT vec_id, {_SENTIMENT_LOGITS} AS x FROM embeddings),
    s AS (SELECT vec_id, x, list_transform(x, lambda y: exp(y - list_max(x))) AS e FROM v),
    p AS (SELECT vec_id, list_max(e) / list_sum(e) AS top, list_position(x, list_max(x)) AS best FROM s)
    SELECT vec_id, ['negative', 'neutral', 'positive'][best] AS sentiment, round(top, 6) AS confidence,
      CAST(top < 0.5 AS BIGINT) AS needs_fallback FROM p""",
)
def sentiment_confidence_gate(d):
    probs = gates.softmax(d.logits(10, 12, 8.0))
    names = F.array(*[F.lit(s) for s in fixed.SENTIMENTS])
    return d.embeddings.select(
        "vec_id",
        gates.top_label(probs, names).alias("sentiment"),
        F.round(gates.top_confidence(probs), 6).alias("confidence"),
        gates.sentiment_needs_fallback(probs).cast("bigint").alias("needs_fallback"),
    )


# -- gold labels and metrics ---------------------------------------------------

MAPPING = {"economy": "cost", "large": "usability", "small": "usability", "medium": None}
_MAPPED = "mapped AS (SELECT *, CASE category WHEN 'economy' THEN 'cost' WHEN 'large' THEN 'usability' WHEN 'small' THEN 'usability' END AS feature_key FROM annotated)"


def _gold_inputs(d):
    rows = d.annotated.withColumn("category", F.concat(F.lit(" "), F.upper("category"), F.lit(" ")))
    return I.review_records(rows, ["row_no"]), I.annotation_rows(rows, F.col("row_no"))


def _gold_features(d):
    """cost and usability, named after the part types mapped to them."""
    kinds = d.part.where("p_type IN ('ECONOMY', 'LARGE')")
    key = F.when(F.col("p_type") == "ECONOMY", "cost").otherwise("usability")
    return settle(kinds.select(key.alias("feature_key"), F.initcap(key).alias("display_name")).distinct())


@query(
    "gold_category_labels",
    f"""WITH {R.ANNOTATED}, {_MAPPED} SELECT id AS review_id, sentence AS review_text,
    CAST(coalesce(bool_or(feature_key = 'cost'), false) AS INT) || '|0|' || CAST(coalesce(bool_or(feature_key = 'usability'), false) AS INT) AS gold_labels
    FROM mapped GROUP BY id, sentence""",
)
def gold_category_labels(d):
    gold = E.gold_category_labels(*_gold_inputs(d), ("cost", "safety", "usability"), MAPPING)
    hot = F.transform("gold_labels", lambda x: x.cast("int").cast("string"))
    return gold.withColumn("gold_labels", F.array_join(hot, "|"))


@query(
    "gold_sentiment_pairs",
    f"""WITH {R.ANNOTATED}, {_MAPPED} SELECT id AS review_id, feature_key, sentence AS text_a,
    upper(feature_key[1]) || feature_key[2:] AS text_b,
    CASE sentiment WHEN 'N/A' THEN 'neutral' ELSE sentiment END AS gold_sentiment FROM mapped WHERE feature_key IS NOT NULL""",
)
def gold_sentiment_pairs(d):
    return E.gold_sentiment_pairs(*_gold_inputs(d), _gold_features(d), MAPPING)


@query(
    "gold_pair_report",
    f"""WITH {R.ANNOTATED}, {_MAPPED}, m AS (SELECT feature_key,
      sentiment IN ('negative', 'positive') AS valid FROM mapped)
    SELECT count(*) AS annotations, count(*) FILTER (feature_key IS NULL) AS not_mapped,
    count(*) FILTER (feature_key IS NOT NULL AND NOT valid) AS invalid_sentiment,
    count(*) FILTER (feature_key = 'usability' AND valid) AS unnamed_feature,
    count(*) FILTER (feature_key = 'cost' AND valid) AS kept FROM m""",
)
def gold_pair_report(d):
    """Missing polarities respelled as something unknown, and a taxonomy with one feature."""
    _, notes = _gold_inputs(d)
    polarity = F.when(F.col("polarity").isin("negative", "positive"), F.col("polarity")).otherwise("odd")
    return E.gold_pair_report(notes.withColumn("polarity", polarity), _gold_features(d).where("feature_key = 'cost'"), MAPPING)


_OUTCOME = """CASE WHEN c IN ('economy', 'large', 'small') THEN 'mapped' WHEN c = 'medium' THEN 'ignored' ELSE 'unmapped' END AS outcome"""


@query(
    "mapping_coverage",
    f"""SELECT {_OUTCOME}, category FROM (SELECT DISTINCT p_type AS category, lower(p_type) AS c
    FROM lineitem JOIN part ON l_partkey = p_partkey)""",
)
def mapping_coverage(d):
    rows = d.lineitem.join(d.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("aspect_category"))
    return X.mapping_coverage(rows, mapping=MAPPING)


@query(
    "coverage_report",
    f"SELECT outcome, count(*) AS categories FROM (SELECT {_OUTCOME} FROM (SELECT DISTINCT lower(p_type) AS c FROM part)) GROUP BY 1",
)
def coverage_report(d):
    return X.coverage_report(d.part.select(F.col("p_type").alias("aspect_category")), mapping=MAPPING)


NAMES = [f"l{i}" for i in range(10)]
_ITEMS = f"""items AS (
  SELECT unnest(range(10)) AS i, unnest({_PROBS}) AS p, label FROM embeddings),
rows_ AS (SELECT 'l' || i AS label, p, i = label AS t FROM items)"""


# counts of a table c(label, tp, fp, fn) turned into rates
_RATES = """m AS (SELECT *, tp + fn AS support, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS pr,
      coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS rc,
      coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1 FROM c),
    k AS (SELECT * FROM m WHERE support > 0)"""
_MACRO = """SELECT 'precision_macro' AS metric, avg(pr) AS value FROM k
      UNION ALL SELECT 'recall_macro', avg(rc) FROM k
      UNION ALL SELECT 'f1_macro', avg(f1) FROM k
      UNION ALL SELECT 'f1_' || label, f1 FROM m
      UNION ALL SELECT 'support_' || label, support FROM m"""
_MICRO = """SELECT 'precision_micro' AS metric, coalesce(sum(tp) / CAST(nullif(sum(tp + fp), 0) AS DOUBLE), 0) AS value FROM k
      UNION ALL SELECT 'recall_micro', coalesce(sum(tp) / CAST(nullif(sum(tp + fn), 0) AS DOUBLE), 0) FROM k
      UNION ALL SELECT 'f1_micro', coalesce(2 * sum(tp) / CAST(nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) AS DOUBLE), 0) FROM k"""


def label_metrics_sql(counts: str, threshold: float) -> str:
    """Multi-label metrics over CTEs ending in c(label, tp, fp, fn)."""
    return f"""WITH {counts}, {_RATES} SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
      {_MICRO} UNION ALL {_MACRO} UNION ALL SELECT 'optimal_threshold', {threshold})"""


def class_metrics_sql(guesses: str) -> str:
    """3-class metrics over CTEs ending in v(truth, guess)."""
    return f"""WITH {guesses}, c AS (SELECT label, count(*) FILTER (truth = i AND guess = i) AS tp,
      count(*) FILTER (truth <> i AND guess = i) AS fp, count(*) FILTER (truth = i AND guess <> i) AS fn
      FROM v, (VALUES (0, 'negative'), (1, 'neutral'), (2, 'positive')) n(i, label) GROUP BY 1), {_RATES}
    SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
      SELECT 'accuracy' AS metric, sum(tp) / CAST(sum(support) AS DOUBLE) AS value FROM m UNION ALL {_MACRO})"""


_LABEL_COUNTS = f"""{_ITEMS}, c AS (SELECT label, count(*) FILTER (p >= 0.55 AND t) AS tp,
    count(*) FILTER (p >= 0.55 AND NOT t) AS fp, count(*) FILTER (p < 0.55 AND t) AS fn FROM rows_ GROUP BY label)"""


@query(
    "category_metrics_best",
    f"""WITH {_ITEMS}, t AS (SELECT CAST(0.1 AS DOUBLE) + i * (CAST(0.15 AS DOUBLE) - 0.1 + 0.00) AS threshold FROM range(17) r(i)),
    a AS (SELECT threshold, label, count(*) FILTER (p >= threshold AND t) AS tp, count(*) FILTER (p >= threshold AND NOT t) AS fp,
      count(*) FILTER (p < threshold AND t) AS fn FROM rows_, t GROUP BY 1, 2),
    b AS (SELECT threshold FROM (SELECT threshold, avg(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0)) AS f1 FROM a GROUP BY 1)
      ORDER BY round(f1, 12) DESC, threshold LIMIT 1), c AS (SELECT label, tp, fp, fn FROM a JOIN b USING (threshold)), {_RATES}
    SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM ({_MICRO} UNION ALL {_MACRO}
      UNION ALL SELECT 'optimal_threshold', round(threshold, 2) FROM b)""",
)
def category_metrics_best(d):
    return E.category_metrics(d.category_outputs, NAMES, None).select("metric", r6("value"))


@query("category_metrics", label_metrics_sql(_LABEL_COUNTS, 0.55))
def category_metrics(d):
    return E.category_metrics(d.category_outputs, NAMES, 0.55).select("metric", r6("value"))


_CURVE = f"""{_ITEMS}, t AS (SELECT CAST(0.1 AS DOUBLE) + i * (CAST(0.15 AS DOUBLE) - 0.1 + 0.00) AS threshold FROM range(17) r(i)),
  c AS (SELECT threshold, label, count(*) FILTER (p >= threshold AND t) AS tp, count(*) FILTER (p >= threshold AND NOT t) AS fp,
    count(*) FILTER (p < threshold AND t) AS fn FROM rows_, t GROUP BY 1, 2),
  curve AS (SELECT threshold, avg(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0)) AS f1 FROM c GROUP BY 1)"""


@query(
    "threshold_curve",
    f"WITH {_CURVE} SELECT round(threshold, 2) AS threshold, round(f1, 6) AS f1_macro FROM curve",
)
def threshold_curve(d):
    curve = E.threshold_curve(d.category_outputs, NAMES)
    return curve.select(F.round("threshold", 2).alias("threshold"), r6("f1_macro"))


@query(
    "threshold_sweep",
    f"WITH {_CURVE} SELECT round(threshold, 2) AS threshold, round(f1, 6) AS f1_macro FROM curve ORDER BY round(f1, 12) DESC, curve.threshold LIMIT 1",
)
def threshold_sweep(d):
    return E.best_threshold(d.category_outputs, NAMES).select("threshold", r6("f1_macro"))


_GUESSES = f"""v AS (SELECT CASE WHEN label < 3 THEN 0 WHEN label < 6 THEN 1 ELSE 2 END AS truth,
      list_position(x, list_max(x)) - 1 AS guess FROM (SELECT label, {_SENTIMENT_LOGITS} AS x FROM embeddings))"""


@query("sentiment_metrics", class_metrics_sql(_GUESSES))
def sentiment_metrics(d):
    return E.sentiment_metrics(d.sentiment_outputs).select("metric", r6("value"))


# -- round trips through files -------------------------------------------------


@query(
    "csv_ingest_roundtrip",
    f"""WITH {R.ANNOTATED}, r AS (SELECT id, app AS app_id, sentence AS review_text, domain, CAST(any_value(rating) AS BIGINT) AS rating,
      nullif(any_value(review_id), 'N/A') AS source_review_id, count(*) AS annotations, CAST(count(span_to) AS BIGINT) AS spans
      FROM annotated GROUP BY 1, 2, 3, 4) SELECT * FROM r""",
)
def csv_ingest_roundtrip(d):
    """A small file first, then all rows: known reviews get the annotations they lack; a repeat adds nothing."""
    some, everything = fresh_path(d.spark, "annotated-csv"), fresh_path(d.spark, "annotated-csv")
    d.annotated.where("row_no % 3 = 0").drop("row_no").write.csv(some, header=True, escape='"')
    d.annotated.drop("row_no").write.csv(everything, header=True, escape='"')
    store = Tables(fresh_path(d.spark, "store"))
    for path in (some, everything, everything):
        ingest_csv(d.spark, path, store)
    counts = store.annotations(d.spark).groupBy(F.col("review_id").alias("id")).agg(
        F.count("*").alias("annotations"), F.count("offset_to").alias("spans")
    )
    return readers.raw_reviews(store.reviews(d.spark)).join(counts, "id").select(
        "id", "app_id", "review_text", "domain", F.col("rating").cast("bigint").alias("rating"), "source_review_id", "annotations", "spans"
    )


@query("ad_hoc_csv", "SELECT text AS review FROM conversations")
def ad_hoc_csv(d):
    path = fresh_path(d.spark, "uploaded-csv")
    d.conversations.select("role", F.col("text").alias("review")).write.csv(path, header=True, escape='"')
    return readers.read_reviews_csv(d.spark, path).select("review")


@query(
    "jsonl_roundtrip",
    f"""WITH {_PAIRS} SELECT t.id AS review_id, text,
    coalesce(string_agg(DISTINCT category, '|' ORDER BY category), '') AS labels
    FROM texts t LEFT JOIN pairs p ON t.id = p.id GROUP BY t.id, text""",
)
def jsonl_roundtrip(d):
    path = fresh_path(d.spark, "category-records")
    writers.write_records(T.category_records(_master(d)).withColumn("split", F.lit("train")), path)
    records = readers.read_records(d.spark, path, schemas.CATEGORY_RECORD, split="train")
    return records.select("review_id", "text", F.array_join("labels", "|").alias("labels"))


@query(
    "split_parquet_roundtrip",
    f"WITH {_TURN_SPLIT}, r AS ({_TURN_ROWS}) SELECT conv_id, turn FROM r WHERE split = 'test'",
)
def split_parquet_roundtrip(d):
    path = fresh_path(d.spark, "splits")
    writers.write_splits(_split_turns(d).select("conv_id", "turn", "split"), path)
    return readers.read_split(d.spark, path, "test").select("conv_id", "turn")


@query(
    "scores_roundtrip",
    f"""WITH {R.ASPECTS}, {R.PARTLY_DATED}, {R.scores_sql('dated')} SELECT feature_id, CAST(window_start AS VARCHAR) AS window_start,
    CAST(window_end AS VARCHAR) AS window_end, round(score, 6) AS score, mention_count, round(negative_ratio, 6) AS negative_ratio,
    round(trend_delta, 6) AS trend_delta FROM scores WHERE window_start IS NOT NULL""",
)
def scores_roundtrip(d):
    tables = Tables(fresh_path(d.spark, "store"))
    for half_life in (1, fixed.HALF_LIFE_DAYS):  # the second set replaces the first
        writers.write_scores(K.windowed_scores(d.partly_dated, half_life), tables.store(d.spark))
    return shown_scores(tables.scores(d.spark))


_STORED_SCORES = f"""WITH {R.ASPECTS}, {R.REVIEWS}, {R.DATED}, {R.scores_sql('dated')} SELECT feature_id,
    CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end, round(score, 6) AS score,
    mention_count, round(negative_ratio, 6) AS negative_ratio, round(trend_delta, 6) AS trend_delta
    FROM scores WHERE window_start IS NOT NULL"""


def stored_reviews(d):
    """A store that holds the reviews."""
    tables = Tables(fresh_path(d.spark, "store"))
    with tables.store(d.spark).begin() as change:
        change.append(writers.REVIEWS, d.reviews.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")))
    return tables


def aspect_loads(d):
    """(run, aspects) of several loads; the third replaces the first, and all aspects stand in the end."""
    line = F.col("l_linenumber")
    rows = d.aspects
    for run, part in (("a", line <= 3), ("b", line >= 3), ("a", line <= 2)):
        yield run, rows.where(part).select("id", "review_id", "feature_id", "sentiment", "confidence", "source")


@query("scores_kept_up_to_date", _STORED_SCORES)
def scores_kept_up_to_date(d):
    """The score table after several loads, each added to the counts kept, equals one full run."""
    tables = stored_reviews(d)
    for run, rows in aspect_loads(d):
        writers.write_aspects(rows, tables.store(d.spark), run)
        increments.refresh(d.spark, tables)
    return shown_scores(tables.scores(d.spark))


@query("scores_from_stream", _STORED_SCORES)
def scores_from_stream(d):
    """As above, by a stream of the commits: a micro-batch after the first load, one after the others, and a replay of all."""
    tables, checkpoint = stored_reviews(d), fresh_path(d.spark, "stream")
    for n, (run, rows) in enumerate(aspect_loads(d)):
        writers.write_aspects(rows, tables.store(d.spark), run)
        if n != 1:
            increments.follow(d.spark, tables, checkpoint).awaitTermination()
    increments.follow(d.spark, tables, fresh_path(d.spark, "stream")).awaitTermination()
    return shown_scores(tables.scores(d.spark))


@query(
    "aspects_roundtrip",
    f"""WITH {R.ASPECTS} SELECT feature_id, sentiment, source, count(*) AS n FROM aspects
    WHERE feature_id <> 'Brand#13' GROUP BY ALL""",
)
def aspects_roundtrip(d):
    tables = Tables(fresh_path(d.spark, "store"))
    resolved = A.resolve_aspects(_routed_lines(d), d.features.where("is_active"))
    writers.write_aspects(resolved, tables.store(d.spark), "first")
    writers.write_aspects(resolved, tables.store(d.spark), "first")  # the same run again replaces itself
    return tables.aspects(d.spark).groupBy("feature_id", "sentiment", "source").agg(F.count("*").alias("n"))


@query(
    "taxonomy_roundtrip",
    f"WITH {R.FEATURES} SELECT feature_key, display_name FROM features",
)
def taxonomy_roundtrip(d):
    tables = Tables(fresh_path(d.spark, "store"))
    writers.add_missing_features(X.list_features(d.features), tables.store(d.spark))  # the active ones
    writers.add_missing_features(d.features, tables.store(d.spark))  # adds only the others
    return tables.features(d.spark).select("feature_key", "display_name")


@query(
    "feature_seed_use",
    """SELECT k AS feature_key, upper(k[1]) || k[2:] AS display_name, count(doc_id) AS documents
    FROM (SELECT unnest(['usability', 'effectiveness', 'general', 'safety', 'learnability', 'cost', 'efficiency',
      'compatibility', 'security', 'aesthetics', 'reliability', 'enjoyability']) AS k)
    LEFT JOIN documents ON contains(lower(text), k) GROUP BY 1, 2""",
)
def feature_seed_use(d):
    """How many documents name each seeded feature."""
    seed = readers.active_features(literals.taxonomy(d.spark))
    lower = F.lower("text")
    named = F.array_compact(F.array(*[F.when(F.contains(lower, F.lit(k)), F.lit(k)) for k in fixed.LABELS]))
    counts = d.documents.select(F.explode(named).alias("feature_key")).groupBy("feature_key").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(seed), "feature_key", "right").select(
        "feature_key", "display_name", F.coalesce("n", F.lit(0)).alias("documents")
    )


# -- models --------------------------------------------------------------------


def _digit_scores():
    def load():
        import numpy as np

        return lambda texts: np.stack([texts.str.count(c).to_numpy() - 0.5 for c in "012"], axis=1)

    return load


_GOLD_COUNTS = f"""{R.ANNOTATED}, {_MAPPED}, g AS (SELECT id, sentence, coalesce(bool_or(feature_key = 'cost'), false) AS cost,
      coalesce(bool_or(feature_key = 'usability'), false) AS usability FROM mapped GROUP BY 1, 2),
    rows_ AS (SELECT 'cost' AS label, contains(sentence, '0') AS p, cost AS t FROM g
      UNION ALL SELECT 'safety', contains(sentence, '1'), false FROM g
      UNION ALL SELECT 'usability', contains(sentence, '2'), usability FROM g),
    c AS (SELECT label, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp,
      count(*) FILTER (NOT p AND t) AS fn FROM rows_ GROUP BY label)"""
_GOLD_GUESSES = f"""{R.ANNOTATED}, {_MAPPED}, x AS (SELECT sentiment, {_count('0', 'sentence')} AS a,
      {_count('1', 'sentence')} AS b, {_count('2', 'sentence')} AS c FROM mapped WHERE feature_key IS NOT NULL),
    v AS (SELECT CASE sentiment WHEN 'negative' THEN 0 WHEN 'N/A' THEN 1 ELSE 2 END AS truth,
      CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS guess FROM x)"""


@query(
    "eval_report_roundtrip",
    f"""SELECT 'category' AS task, * FROM ({label_metrics_sql(_GOLD_COUNTS, 0.5)})
    UNION ALL SELECT 'sentiment', * FROM ({class_metrics_sql(_GOLD_GUESSES)})""",
)
def eval_report_roundtrip(d):
    reviews, notes = _gold_inputs(d)
    path = fresh_path(d.spark, "eval-report")
    category = A.scorer(_digit_scores())
    report = evaluate(
        d.spark,
        reviews,
        notes,
        _gold_features(d),
        category,
        lambda text, name: category(text),
        path,
        ("cost", "safety", "usability"),
        mapping=MAPPING,
    )
    return report.select("task", "metric", r6("value"))


_LANGS = ("de", "en", "es", "fr")


def _routed_by_models(d):
    """Languages as categories and label quality as sentiment, learnt from the texts."""
    docs = baseline.counted(d.documents.select("doc_id", "text", F.array("lang").alias("labels")))
    texts = baseline.fit_texts(docs)
    weights = baseline.weights_by(T.category_pos_weights(docs, _LANGS), "label")
    categories = baseline.fit_categories(baseline.featured(texts, docs), weights)
    mood = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 0, "neutral").otherwise("positive")
    graded = d.labels.select("doc_id", mood.alias("mood"))
    classes = baseline.weights_by(T.sentiment_class_weights(graded, "mood"), "label_index")
    taught = docs.join(graded, "doc_id").withColumn("label", T.sentiment_index(F.col("mood")))
    sentiment = baseline.fit_sentiment(baseline.featured(texts, taught), classes)
    models = baseline.Models(texts, categories, sentiment)
    names = settle(d.documents.select(F.col("lang").alias("feature_key"), F.upper("lang").alias("display_name")).distinct())
    return baseline.route_with_models(d.documents_as_reviews, names, models)


@query("baseline_model_scores")
def baseline_model_scores(d):
    return _routed_by_models(d)


@query(
    "baseline_model_facts",
    """SELECT lang, count(*) AS documents, true AS most_found, true AS few_wrong, true AS one_sentiment_each
    FROM documents WHERE lang IN ('de', 'en', 'es', 'fr') AND length(trim(text)) > 0 GROUP BY lang""",
)
def baseline_model_facts(d):
    """What fitted models must reach, whatever their last digits: by language, 95 % found, 5 % wrong at most, one sentiment a pair."""
    routed = settle(_routed_by_models(d).select("review_id", "feature_key", "sentiment"))
    docs = d.documents.where(F.col("lang").isin(*_LANGS) & (F.length(F.trim("text")) > 0)).select(F.col("doc_id").cast("string").alias("review_id"), "lang")
    pairs = routed.groupBy("review_id", "feature_key").agg(F.count("*").alias("n"), F.count_if(F.col("sentiment").isNull()).alias("none"))
    joined = docs.join(pairs, "review_id", "left")
    hit = F.col("feature_key") == F.col("lang")
    by_doc = joined.groupBy("review_id", "lang").agg(
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("found"), F.count_if(~hit).alias("wrong"),
        F.coalesce(F.bool_and((F.col("n") == 1) & (F.col("none") == 0)), F.lit(True)).alias("single"),
    )
    return by_doc.groupBy("lang").agg(
        F.count("*").alias("documents"), (F.avg(F.col("found").cast("double")) >= 0.95).alias("most_found"),
        (F.avg((F.col("wrong") > 0).cast("double")) <= 0.05).alias("few_wrong"), F.bool_and("single").alias("one_sentiment_each"),
    )
