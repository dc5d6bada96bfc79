"""Text functions: cleaning and the near-duplicate key."""

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendlist.functions.binding import bound

# The characters that count as white space, as themselves, as a
# regex class body, and the part that is left of them after NFKC.
SPACES = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NFKC_SPACE = r"\t-\r\x1c-\x20\x85\u1680\u2028\u2029"

# Characters that NFKC leaves alone, each by itself and in any sequence: ASCII,
# Latin-1 letters, basic Cyrillic, kana, unified CJK, Hangul syllables, plain
# dashes, quotes and bullets, and emoji. Text made only of these skips Python.
NFKC_STABLE = (
    r"^[\x00-\x7f\xc0-\xff\u0400-\u045f"
    r"\u2012-\u2016\u2018-\u2023\u20ac"
    r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
    r"\x{1f300}-\x{1f64f}\x{1f680}-\x{1f6c5}]*\z"
)


def _nfkc():
    # a local function is shipped to the executors whole, with no import of this package
    def normalise(texts: pa.Array) -> pa.Array:
        form = unicodedata.normalize
        return pa.array([t and form("NFKC", t) for t in texts.to_pylist()], pa.string())

    # declared non-deterministic so that a later filter on the result is not
    # turned into a second evaluation of it below the first
    return F.arrow_udf(normalise, T.StringType()).asNondeterministic()


def nfkc(text: Column) -> Column:
    """Unicode NFKC form.

    Rows already stable are sent to Python as nulls, so only text that can
    change crosses the JVM boundary.
    """
    return F.coalesce(_nfkc()(F.when(~text.rlike(NFKC_STABLE), text)), text)


def is_stable(text: Column) -> Column:
    """True where NFKC changes nothing, for null too."""
    return F.coalesce(text.rlike(NFKC_STABLE), F.lit(True))


def _where_any(text: Column, marks, pattern: str, to: str) -> Column:
    """``pattern`` replaced in texts that hold one of ``marks``, as any match must."""

    def replaced(t):
        found = F.lit(False)
        for mark in marks:
            found = found | F.contains(t, F.lit(mark))
        return F.when(found, F.regexp_replace(t, pattern, to)).otherwise(t)

    return bound(text, replaced)


def clean_text(text: Column, stable=False) -> Column:
    """Readable one-line text; null becomes the empty string.

    Every step reads its input once, no pattern backtracks over a long run, and
    classes name the printable ASCII characters first, which most text is made of.
    Most texts lack what a pattern needs and skip it. ``stable`` promises that NFKC
    changes nothing.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    text = text if stable else nfkc(text)
    text = _where_any(text, "<", r"<[^>]+>", " ")
    black = rf"[\x21-\x7e[^{NFKC_SPACE}]]"
    text = _where_any(text, ["://", "www."], rf"(?:https?://|www\.){black}++", " ")
    # an address always fills a whole blank-free run: one starting with a first
    # character, an @ later on, and a dot inside what follows the first such @
    to_at = rf"[\x21-\x3f\x41-\x7e[^{NFKC_SPACE}@]]*+"
    to_dot = rf"[\x21-\x2d\x2f-\x7e[^{NFKC_SPACE}.]]*+"
    text = _where_any(text, "@", rf"(?<!{black}){black}{to_at}@{black}{to_dot}\.{black}++", " ")
    # control characters and white space together become single spaces
    gap = r"\x00-\x1f\x7f\x85\u1680\u2028\u2029"
    text = F.regexp_replace(text, rf"[[^\x21-\x7e]&&[{gap} ]]{{2,}}|[[^\x20-\x7e]&&[{gap}]]", " ")
    return F.trim(_where_any(text, ["!!!", "???", "..."], r"([!?.])\1{2,}", "$1$1"))


def stripped(text: Column) -> Column:
    """White space (of any kind) removed at both ends."""
    return F.btrim(text, F.lit(SPACES))


def has_text(text: Column) -> Column:
    """True where anything but white space is left; false for null."""
    return F.coalesce(text.rlike(rf"[\x21-\x7e[^{SPACE}]]"), F.lit(False))


def near_text(text: Column) -> Column:
    """Lower-case ASCII letters, digits and single spaces of ``text``.

    Text in other scripts becomes the empty string.
    """
    kept = F.regexp_replace(F.lower(text), rf"[^a-z0-9{SPACE}]+", "")
    return F.trim(F.regexp_replace(kept, r"[^a-z0-9]+", " "))


def has_near_text(text: Column) -> Column:
    """True where ``near_text`` is not empty: one look for its first character, null for null.

    Some other letters become ASCII in lower case, so texts without ASCII ones are looked at again.
    """
    return text.rlike("[A-Za-z0-9]") | F.lower(text).rlike("[a-z0-9]")


def fingerprint(text: Column) -> Column:
    """32-byte stand-in for a text, to keep keys narrow in shuffles."""
    return F.unhex(F.sha2(text, 256))


def title_words(key: Column) -> Column:
    """``some_key`` -> ``Some Key``."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))
