import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from mendlist.functions import text as X
from mendlist.operators import cleaning as C

GOLDEN = {
    "a!!!! b....c??": "a!! b..c??",
    "x\u00a0y\u2003z": "x y z",
    "mail me@x.io now": "mail now",
    "ﬁne ①": "fine 1",
    "see www.a.b/c?d end": "see end",
    "<b>hi</b>": "hi",
    "https://x": "",
    "a\u0007b\u001cc": "a b c",
    "": "",
}


def apply(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(fn(F.col("t")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_cleaning_goldens(spark):
    assert apply(spark, X.clean_text, list(GOLDEN)) == list(GOLDEN.values())


def test_null_is_cleaned_to_empty(spark):
    assert apply(spark, X.clean_text, [None, "x"]) == ["", "x"]


@pytest.mark.parametrize(
    "text, left",
    [
        ("@b.c", "@b.c"),  # nothing before the @
        ("@a@b.c x", "x"),
        ("a@b. x", "a@b. x"),  # nothing after the dot
        ("a@.b x", "a@.b x"),  # nothing between
        ("a@..b x", "x"),
        ("a@b@c.d x", "x"),
        ("a@b..x y", "y"),
        ("x http://a@b.c", "x"),
        ("me@http://a.b", "me@"),  # the link goes first
        ("a" * 5000 + "@" + "b" * 5000 + " x", "a" * 5000 + "@" + "b" * 5000 + " x"),
    ],
)
def test_addresses(spark, text, left):
    assert apply(spark, X.clean_text, [text]) == [left]


def plain_clean(text):
    """The cleaning steps one after the other."""
    text = unicodedata.normalize("NFKC", text)
    for pattern, by in (
        ("<[^>]+>", " "),
        (r"https?://\S+|www\.\S+", " "),
        (r"\S+@\S+\.\S+", " "),
        ("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "),
        (r"([!?.])\1{2,}", r"\1\1"),
    ):
        text = re.sub(pattern, by, text)
    return " ".join(text.split())


PIECES = [
    " ", "\t", "\n", "\xa0", "\u2003", "\u2028", "\u0085", "\x1c", "\x07", "a", "Zq9", "@", ".", "!", "?",
    "...", "<b>", "<", ">", "http://", "https://", "www.", "me@x.io", "\u00e9", "e\u0301", "\ufb01", "\u2460",
    "\u65e5\u672c", "\ud55c", "\U0001f600", "\u2026", "\uff76\uff9e", "\u0130", "\u212a",
]


def random_texts(seed, n=8000):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_cleaning_equals_plain_steps(spark):
    texts = random_texts(1)
    assert apply(spark, X.clean_text, texts) == [plain_clean(t) for t in texts]


def test_small_functions_equal_python(spark):
    texts = random_texts(2)
    assert apply(spark, X.stripped, texts) == [t.strip() for t in texts]
    assert apply(spark, X.has_text, texts) == [bool(t.strip()) for t in texts]
    near = [" ".join(re.sub(r"[^a-z0-9\s]", "", t.lower()).split()) for t in texts]
    assert apply(spark, X.near_text, texts) == near


def test_stable_characters_need_no_normalisation():
    stable = re.compile(X.NFKC_STABLE.replace(r"\z", r"\Z").replace(r"\x{1f300}-\x{1f64f}", "\U0001f300-\U0001f64f").replace(
        r"\x{1f680}-\x{1f6c5}", "\U0001f680-\U0001f6c5"))
    checked = 0
    for code in range(0x20000):
        char = chr(code)
        if stable.match(char):
            checked += 1
            assert unicodedata.normalize("NFKC", char) == char and not unicodedata.combining(char)
            assert unicodedata.normalize("NFKC", "a" + char) == "a" + char
    assert checked > 30_000


def test_cleaning_is_idempotent_and_drops_empty_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(GOLDEN)], "id int, review_text string")
    once = C.clean_reviews(df)
    assert once.count() == len([v for v in GOLDEN.values() if v])
    assert sorted(map(tuple, C.clean_reviews(once).collect())) == sorted(map(tuple, once.collect()))
    report = C.cleaning_report(df).first()
    assert (report.rows_before, report.dropped_empty, report.rows_after) == (9, 2, 7)


def test_text_is_cleaned_once_per_row(spark):
    df = spark.createDataFrame([("a",)], "review_text string")
    plan = C.clean_reviews(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_near_duplicates(table):
    rows = [(1, "a", "Great app!"), (2, "a", "great app"), (3, "a", "Great app!!"), (4, "b", "great app"),
            (5, "a", "Great app!"), (6, "a", "素晴らしい"), (7, "a", "!!")]
    df = table(rows, "id int, app_id string, review_text string")
    assert {r.id for r in C.dedup_reviews(df, "id").collect()} == {1, 4, 6}
    assert {r.id for r in C.dedup_reviews(df, "id", near=False).collect()} == {1, 2, 3, 4, 6, 7}
    assert C.dedup_report(df).first().asDict() == {
        "rows_before": 7, "exact_dropped": 1, "near_dropped": 3, "rows_after": 3,
    }
    assert C.blank_near_keys(df).first().blank_near_keys == 2


def test_hot_text_is_reduced_before_the_shuffle(spark):
    """A third of all rows share one text; each task sends one of them."""
    df = spark.range(0, 30_000, 1, 6).select(
        "id", F.lit("app").alias("app_id"),
        F.when(F.col("id") % 3 == 0, "same text!").otherwise(F.concat(F.lit("t "), "id")).alias("review_text"),
    )
    kept = C.dedup_reviews(df, "id")
    assert kept.count() == 20_001
    assert kept.where("review_text = 'same text!'").first().id == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_titles(spark):
    assert apply(spark, X.title_words, ["ui_ux", "cost"]) == ["Ui Ux", "Cost"]


def test_blank_near_keys_of_every_letter(spark):
    """The short look agrees with the key itself, also for letters that are ASCII in lower case only."""
    letters = [(chr(i),) for i in range(0x30000) if not 0xD800 <= i < 0xE000] + [("",), (None,), ("éİ",), ("* \n*",)]
    df = spark.createDataFrame(letters, "t string")
    key, short = X.near_text(F.col("t")) != "", X.has_near_text(F.col("t"))
    assert df.where(~key.eqNullSafe(short)).count() == 0
    assert {r.t for r in df.where(short & ~F.col("t").rlike("^[A-Za-z0-9]")).collect()} == {"İ", "K", "éİ"}
