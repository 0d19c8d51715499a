"""DuckDB SQL of the queries of this package that SQL can express."""

ORACLES: dict[str, str] = {}

#: The default template: marks of 8, 8 and 8 characters; every control string in a text costs one more.
ORACLES["op2_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    len(regexp_extract_all(text, '<\\*(s>|/s>|<\\*/?SYS>>|\|(turn|text|end|im_start|im_end|endoftext)\|>)|\[\\*/?INST\]')) AS escapes
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 8 + length(text) + escapes + 8) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE false END) AS valid
FROM o GROUP BY conv_id"""

#: The bisection to 2^-30 of the limit of two repeats in closed form; then the order of the last epoch, document by document.
ORACLES["op3_mix"] = """
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS s, coalesce(CAST(doc_id AS VARCHAR), '') AS k, CAST((octet_length(encode(coalesce(text, ''))) + 3) // 4 + 1 AS BIGINT) AS n FROM documents),
t AS (SELECT s, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY s),
x AS (SELECT CAST(max(n) AS DOUBLE) AS most, CAST(min(n) AS DOUBLE) AS least FROM t),
a AS (SELECT most, CASE WHEN most <= 2 * least THEN 0 ELSE ceil((1 - ln(2) / ln(most / least)) * 1073741824) / 1073741824 END AS a FROM x),
r AS (SELECT s, n, round(exp(ln(n / most) * a) * most / n, 9) AS repeats FROM t, a),
p AS (SELECT s, repeats, CAST(floor(repeats) AS BIGINT) AS whole, CAST(floor((repeats - floor(repeats)) * n) AS BIGINT) AS rest FROM r),
b AS (SELECT d.*, repeats, whole, rest, CAST('0x' || substr(md5('block|' || k), 1, 15) AS BIGINT) % 256 AS block, CAST('0x' || substr(md5('document|' || k), 1, 15) AS BIGINT) AS own FROM d JOIN p USING (s)),
e AS (SELECT b.*, epoch, CAST('0x' || substr(md5('turn|' || s || '|' || block || '|' || epoch), 1, 15) AS BIGINT) AS turn FROM (SELECT *, unnest(range(whole + 1)) AS epoch FROM b) b),
f AS (SELECT *, sum(n) OVER (PARTITION BY s, epoch ORDER BY turn, block, own RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach FROM e)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, block, least(1.0, (epoch + turn / 1152921504606846976) / repeats) AS place, n AS tokens FROM f WHERE epoch < whole OR reach <= rest"""

ORACLES["op5_nearest"] = """
WITH v AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

ORACLES["op9_dedup_passages"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, i, md5(raw[i + 1 : i + 400]) AS h FROM (SELECT r, raw, unnest(range(n - 399)) AS i FROM d WHERE n >= 400)),
hit AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
edge AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS opens FROM hit),
run AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS g FROM edge) GROUP BY r, g),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY r ORDER BY a) IS NULL AS last FROM run),
kept AS (SELECT r, count(*) AS spans, sum(b - a) AS gone, string_agg(hex(raw[before + 1 : a]) || CASE WHEN last THEN hex(raw[b + 1 : n]) ELSE '' END, '' ORDER BY a) AS bytes FROM cut JOIN d USING (r) GROUP BY r),
words AS (SELECT r, list_filter(string_split_regex(decode(raw), '[\\x09-\\x0D\\x1C-\\x20]+'), lambda x: x <> '') AS a FROM d),
ww AS (SELECT r, i, md5(array_to_string(a[i + 1 : i + 51], ' ')) AS h FROM (SELECT r, a, unnest(range(len(a) - 50)) AS i FROM words WHERE len(a) > 50)),
wr AS (SELECT r, count(*) AS runs FROM (SELECT r, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM ww WHERE h IN (SELECT h FROM ww GROUP BY h HAVING count(*) > 1)) WHERE gap IS NULL OR gap > 51 GROUP BY r)
SELECT doc_id, coalesce(runs, 0) AS n_word_runs, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(CASE WHEN spans IS NULL THEN raw ELSE unhex(bytes) END) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN wr USING (r)"""

ORACLES["op10_near_duplicates"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, a || ' ' || b AS g FROM (SELECT doc_id, unnest(w[1 : len(w) - 1]) AS a, unnest(w[2:]) AS b FROM d WHERE len(w) > 1) UNION SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
two AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT DISTINCT doc_id, doc_id AS c FROM documents UNION SELECT two.v, reach.c FROM reach JOIN two ON two.u = reach.doc_id),
c AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

ORACLES["op11_url_filters"] = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(h, p, v))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM a LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC) = 1"""

ORACLES["op12_ranked_search"] = r"""
WITH tok AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT r, doc_id, len(w) AS n, w FROM tok WHERE len(w) > 0),
c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""

ORACLES["op13_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
s AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM s GROUP BY lang),
f AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS g FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k) GROUP BY lang, g HAVING count(*) >= 100),
cut AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
halves AS (SELECT lang, g, a, k, g[1 : k] AS first, g[k + 1 : len(g)] AS rest FROM cut),
scored AS (SELECT h.lang, h.g, h.a, h.k, x.f AS l, y.f AS r, t.n, CAST((1000 * CAST(h.a AS HUGEINT) * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.g = h.first JOIN f y ON y.lang = h.lang AND y.g = h.rest JOIN t ON t.lang = h.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
part AS (SELECT lang, g[i : i + m - 1] AS g, max(f) AS f FROM (SELECT *, unnest(range(1, len(g) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(g))) AS m FROM f WHERE len(g) > 2)) GROUP BY ALL),
kept AS (SELECT least.*, array_to_string(least.g, ' ') AS phrase FROM least LEFT JOIN part ON part.lang = least.lang AND part.g = least.g WHERE part.f IS NULL OR 100 * part.f < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
