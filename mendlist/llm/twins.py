"""DuckDB SQL for the queries that SQL can express, each over the whole tables."""

from mendlist.llm import licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"
_FOLD = f"translate({{}}, '{_UPPER}', '{_LOWER}')"


def _words(text: str) -> str:
    return f"coalesce(regexp_extract_all({text}, '{_WORD}'), CAST([] AS VARCHAR[]))"


BASE_RULES = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_words('text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, host, w, unnest(string_split(text, chr(10))) AS l FROM d),
norm AS (SELECT doc_id, host, w, len({_words('l')}) AS n, array_to_string({_words(f"translate(l, '{_UPPER}0123456789', '{_LOWER}0000000000')")}, ' ') AS l FROM ln),
held AS (SELECT host, l FROM norm WHERE n > 0 GROUP BY host, l HAVING count(DISTINCT w) > 20),
lost AS (SELECT doc_id, sum(n) AS n FROM norm JOIN held USING (host, l) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  (SELECT count(*) - count(DISTINCT x) FROM (SELECT unnest(string_split(text, chr(10))) AS x) WHERE regexp_matches(x, '{_WORD}')) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_frequent_words
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * n_frequent_words <= 50 * n_words AS kept FROM g"""

_KEY = "lower(trim({}, ' '))"

LINE_FREQUENCY = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT DISTINCT host, text, {_KEY.format('l')} AS l FROM (SELECT host, text, unnest(ls) AS l FROM d) WHERE trim(l, ' ') <> ''),
t AS (SELECT host, count(DISTINCT text) AS total FROM d GROUP BY host),
b AS (SELECT host, list(l) AS bad FROM (SELECT host, l, count(*) AS n FROM p GROUP BY ALL) JOIN t USING (host)
  WHERE n >= 5 AND n > CAST(0.1 AS DOUBLE) * total GROUP BY host),
k AS (SELECT doc_id, text, ls, CASE WHEN bad IS NULL THEN ls
  ELSE [x for x in ls if trim(x, ' ') = '' OR NOT list_contains(bad, {_KEY.format('x')})] END AS kept FROM d LEFT JOIN b USING (host))
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(kept), 0) AS n_dropped,
  CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text FROM k"""

REPEATED_PASSAGES = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS owner FROM win) WHERE doc_id > owner),
ws AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM ws ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_FOLD.format('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 2] AS g FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _tokens(text: str) -> str:
    return rf"[x for x in regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+') if x <> '']"


# every shift at which an item and a document have a token in common; no seeds
SPACED_SEEDS = f"""WITH d AS (SELECT doc_id, {_tokens('text')} AS w FROM documents),
b AS (SELECT item_id, {_tokens('text')} AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d),
bt AS (SELECT item_id, len(w) AS n_item, unnest(w) AS t, unnest(range(len(w))) AS q FROM b),
m AS (SELECT doc_id, item_id, n_item, p - q AS shift, q FROM dt JOIN bt USING (t)),
c AS (SELECT doc_id, item_id, shift, count(*) AS n_matches FROM m GROUP BY doc_id, item_id, shift, n_item
  HAVING CASE WHEN n_item <= 3 THEN count(*) = n_item ELSE 100 * count(*) >= 60 * n_item OR count(*) >= 11 END),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS run
  FROM m JOIN c USING (doc_id, item_id, shift))
SELECT doc_id, item_id, shift, n_matches, n_item, max(run) AS longest FROM r GROUP BY ALL
HAVING 100 * n_matches >= 60 * n_item OR max(run) >= 11"""

_QUOTE = "'"
_TEMPLATES = ", ".join(f"({i}, '{name}', '{text.replace(_QUOTE, 2 * _QUOTE)}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
_T = len(licenses.TEMPLATES)
_MARKED = f"regexp_matches(lower(unit), '{licenses.MARKER}')"

LICENSES = f"""WITH tpl(template, license, text) AS (VALUES {_TEMPLATES}),
tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({_tokens('text')}) AS term FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln(CAST({1 + _T} AS DOUBLE) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
wt AS (SELECT template, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (term)),
f AS (SELECT concat_ws('/', source, lang, CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path, text FROM documents),
u AS (SELECT * FROM (SELECT path, 'header' AS kind, unnest(string_split(text, chr(10))) AS unit FROM f
  UNION SELECT path, 'header', unnest(regexp_split_to_array(text, '\\n[ \\t\\r\\n]*\\n')) FROM f UNION SELECT path, 'file', text FROM f) WHERE {_MARKED}),
tok AS (SELECT path, kind, unit, term, count(*) * coalesce(any_value(idf), ln(CAST({1 + _T} AS DOUBLE)) + 1) AS own
  FROM (SELECT path, kind, unit, unnest({_tokens('unit')}) AS term FROM u) LEFT JOIN idf USING (term) GROUP BY path, kind, unit, term),
nm AS (SELECT path, kind, unit, sqrt(sum(own * own)) AS norm FROM tok GROUP BY ALL),
cs AS (SELECT path, kind, unit, template, license, round(sum(own * weight) / any_value(norm), 6) AS cosine
  FROM tok JOIN wt USING (term) JOIN nm USING (path, kind, unit) WHERE kind = 'header' OR template < {licenses.FILE_FORMS} GROUP BY path, kind, unit, template, license HAVING round(sum(own * weight) / any_value(norm), 6) >= {licenses.THRESHOLD}),
best AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY path, kind, unit ORDER BY cosine DESC, template) = 1),
own AS (SELECT path, kind, license, cosine FROM best QUALIFY row_number() OVER (PARTITION BY path ORDER BY kind, cosine DESC, license DESC) = 1),
shelf AS (SELECT regexp_replace(path, '/[^/]*$', '') AS directory, path AS from_path, license, cosine FROM own WHERE kind = 'file'
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, license DESC, path DESC) = 1),
up AS (SELECT path, len(p) - 1 - n AS steps, array_to_string(p[1:n], '/') AS directory FROM (
  SELECT path, string_split(path, '/') AS p, unnest(range(0, len(string_split(path, '/')))) AS n FROM f WHERE path NOT IN (SELECT path FROM own))),
inh AS (SELECT path, from_path, license, cosine FROM up JOIN shelf USING (directory) QUALIFY row_number() OVER (PARTITION BY path ORDER BY steps) = 1)
SELECT f.path, coalesce(own.license, inh.license) AS license, coalesce(own.cosine, inh.cosine) AS cosine,
  coalesce(own.kind, CASE WHEN inh.path IS NOT NULL THEN 'inherited' ELSE 'none' END) AS how,
  CASE WHEN own.path IS NOT NULL THEN f.path ELSE inh.from_path END AS license_path
FROM f LEFT JOIN own ON own.path = f.path LEFT JOIN inh ON inh.path = f.path"""


def _assigned(number: int) -> str:
    """Nearest entries under a codebook; distance and entry share one integer, so ties go to the lower entry."""
    return f"""
gaps{number} AS (
  SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d
  FROM cells c JOIN books{number} b ON c.part = b.part AND c.place = b.place GROUP BY ALL),
near{number} AS (SELECT vec_id, part, min(d * 64 + entry) AS m FROM gaps{number} GROUP BY ALL)"""


def _moved(number: int) -> str:
    return f"""
sums{number} AS (
  SELECT c.part, n.m % 64 AS entry, c.place, sum(c.x) AS s, count(*) AS k
  FROM cells c JOIN near{number} n ON c.vec_id = n.vec_id AND c.part = n.part GROUP BY ALL),
books{number + 1} AS (
  SELECT b.part, b.entry, b.place, coalesce((s.s - ((s.s % s.k) + s.k) % s.k) // s.k, b.x) AS x
  FROM books{number} b LEFT JOIN sums{number} s ON b.part = s.part AND b.entry = s.entry AND b.place = s.place)"""


VALUE_DICTIONARIES = f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS v, len(embedding) // 16 AS width FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
cells AS (
  SELECT vec_id, (i - 1) // width AS part, (i - 1) % width AS place, CAST(floor(256 * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
books0 AS (SELECT c.part, f.entry, c.place, c.x FROM cells c JOIN first f USING (vec_id)),
{_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(m % 64 AS INTEGER)), '' ORDER BY part) AS code,
    CAST(sum(m // 64) AS BIGINT) AS error
  FROM near2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM books2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
    FROM documents)),
grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM pieces, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)
  GROUP BY ALL),
candidates AS (SELECT * FROM grams WHERE size >= 2 AND f >= 10),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : size], ' ') AS tail FROM (
    SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r,
    (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(h.f AS HUGEINT) * t.f) AS score
  FROM cuts c JOIN grams h ON h.lang = c.lang AND h.phrase = c.head JOIN grams t ON t.lang = c.lang AND t.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covers AS (
  SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(f) AS f FROM (
    SELECT lang, f, string_split(phrase, ' ') AS w, unnest([1, 2]) AS i FROM candidates WHERE size = 3) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank,
  b.phrase, b.a, b.l, b.r, n, CAST(b.score AS BIGINT) AS score
FROM best b JOIN totals USING (lang) LEFT JOIN covers c ON c.lang = b.lang AND c.phrase = b.phrase
WHERE c.f IS NULL OR 100 * c.f < 50 * b.a
QUALIFY rank <= 2000
"""

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
"""
