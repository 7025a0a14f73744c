"""The queries' equivalents in SQL, where SQL can express them over whole tables."""

WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::HUGEINT AS n FROM s GROUP BY source),
w AS (SELECT source, n, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)]::HUGEINT AS weight FROM t),
l AS (SELECT *, row_number() OVER (ORDER BY n * (10 // weight), source NULLS LAST) AS k FROM w),
c AS (
  SELECT *, 3 * sum(n) OVER () - 4 * coalesce(sum(n) OVER o, 0) AS halves, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights
  FROM l WINDOW o AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
g AS (SELECT k AS fk, halves AS fh, weights AS fw FROM c WHERE halves * weight <= 4 * n * weights ORDER BY k LIMIT 1),
r AS (
  SELECT source, n::BIGINT AS source_size,
    CASE WHEN fk IS NULL OR k < fk THEN (2 * n)::DOUBLE ELSE (fh * weight)::DOUBLE / (2 * fw)::DOUBLE END AS target
  FROM c LEFT JOIN g ON true
),
j AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
    CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || s.doc_id), 1, 13))::BIGINT AS draw
  FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN draw::DOUBLE < (rate - floor(rate)) * 4503599627370496.0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j
"""

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM both_ways
  UNION
  SELECT r.doc_id, v.b FROM reach r JOIN both_ways v ON r.other = v.a
),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""

_RULES = {"symbols": ("n_symbols", "word_chars", 75), "capitals": ("n_capitals", "word_chars", 75), "exclaims": ("n_exclaims", "word_chars", 75), "repeats": ("n_repeat_words", "n_words", 99), "dup_lines": ("n_dup_lines", "n_lines", 99)}
_RATIOS = " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{r}' AS rule, {h} AS higher, CASE WHEN {u} > 0 THEN least(1000 * {o} // {u}, 1000) ELSE 0 END AS bin FROM b" for r, (o, u, h) in _RULES.items())


def _quantiles(keys: str) -> str:
    at = lambda q: f"(min(bin) FILTER (100 * upto >= {q} * total))::DOUBLE"
    return f"""SELECT {keys}rule, max(total)::DOUBLE AS n, {at(25)} AS low, {at(75)} AS mid, {at("higher")} AS high
  FROM (SELECT {keys}rule, higher, bin, count(*) OVER (PARTITION BY {keys}rule ORDER BY bin) AS upto, count(*) OVER (PARTITION BY {keys}rule) AS total FROM r WHERE NOT base_failed)
  GROUP BY {keys}rule"""


def _drawn(x: str) -> str:
    return f"(own.n * own.{x} + 50.0::DOUBLE * ((by_lang.n * by_lang.{x} + 50.0::DOUBLE * by_all.{x}) / (by_lang.n + 50.0::DOUBLE))) / (own.n + 50.0::DOUBLE) AS {x}"


OP9 = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
  FROM documents
),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims, len(l) AS n_lines
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id
),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
r AS ({_RATIOS}),
own AS ({_quantiles("lang, source, ")}),
by_lang AS ({_quantiles("lang, ")}),
by_all AS ({_quantiles("")}),
q AS (
  SELECT own.lang, own.source, own.rule, {_drawn("low")}, {_drawn("mid")}, {_drawn("high")}
  FROM own JOIN by_lang ON by_lang.lang IS NOT DISTINCT FROM own.lang AND by_lang.rule = own.rule JOIN by_all ON by_all.rule = own.rule
),
far AS (
  SELECT r.doc_id, bool_or(r.bin > q.mid + 4 * greatest(q.mid - q.low, q.high - q.mid, 10)) AS far
  FROM r JOIN q ON q.lang IS NOT DISTINCT FROM r.lang AND q.source IS NOT DISTINCT FROM r.source AND q.rule = r.rule
  GROUP BY r.doc_id
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(far.far, false) AS kept
FROM b LEFT JOIN far ON far.doc_id = b.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
f AS (
  SELECT lang, w[i : i + n - 1] AS w, n, count(*)::HUGEINT AS a
  FROM (SELECT lang, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM p, (VALUES (1), (2), (3)) v(n) WHERE len(w) >= n)
  GROUP BY ALL HAVING n = 1 OR a >= 10
),
s AS (
  SELECT c.lang, c.w, c.n, c.a, k, x.a AS l, y.a AS r, 1000000 * c.a * c.a // (x.a * y.a) AS score
  FROM (SELECT *, unnest(generate_series(1, n - 1)) AS k FROM f WHERE n > 1) c
  JOIN f x ON x.lang = c.lang AND x.w = c.w[1 : k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1 : c.n]
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.w ORDER BY score, k) = 1
),
u AS (SELECT lang, w, max(a) AS most FROM (SELECT lang, unnest([w[1 : 2], w[2 : 3]]) AS w, a FROM f WHERE n = 3) GROUP BY ALL),
z AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE n = 1 GROUP BY lang),
o AS (
  SELECT s.lang, array_to_string(s.w, ' ') AS phrase, s.a, l, r, score
  FROM s LEFT JOIN u ON u.lang = s.lang AND u.w = s.w WHERE NOT (100 * coalesce(most, 0) >= 50 * s.a)
)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, z.n, score::BIGINT AS score
FROM o JOIN z ON z.lang = o.lang QUALIFY rank <= 2000
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
),
k AS (SELECT DISTINCT n FROM v),
h AS (
  SELECT d.row, v.item_id, i, d.n
  FROM (SELECT row, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d JOIN k ON len(w) >= n)) d
  JOIN v ON v.n = d.n AND v.g = d.g
),
c AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(generate_series(i, i + n - 1)) AS j FROM h) GROUP BY row),
m AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.row = d.row LEFT JOIN m ON m.row = d.row
"""
