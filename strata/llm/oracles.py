"""DuckDB SQL for the pipeline operators that SQL can express."""

from strata.llm import line_rules

SHARDS = """
WITH b AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
n AS (SELECT d, h >> (60 - d)::INT AS p, sum(n_bytes)::BIGINT AS s, count(*) AS c FROM b, range(0, 61) r(d) GROUP BY ALL),
w AS (
  SELECT b.doc_id, b.n_bytes, b.h, n.d, n.s, n.c, row_number() OVER (PARTITION BY b.doc_id ORDER BY n.d) AS k
  FROM b JOIN n ON n.p = b.h >> (60 - n.d)::INT AND (n.s <= 65536 OR n.c = 1))
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(h >> (60 - d)::INT), d::INT, '0') END AS prefix, d::INT AS depth,
  NULL::VARCHAR AS overflow, s AS shard_bytes, c AS shard_rows
FROM w WHERE k = 1
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

LINE_SPREAD = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS site FROM documents),
l AS (SELECT doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM l),
s AS (SELECT t, true AS spread FROM k WHERE t <> '' GROUP BY t HAVING count(DISTINCT site) >= 10),
m AS (SELECT k.*, coalesce(spread, false) AS hit FROM k LEFT JOIN s USING (t)),
a AS (
  SELECT doc_id, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (hit) AS n_spread,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit), '') AS rest
  FROM m GROUP BY doc_id),
f AS (SELECT a.*, d.text, n_spread > 0 AND trim(rest, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' AS cut FROM a JOIN d USING (doc_id))
SELECT doc_id, n_lines, n_spread, CASE WHEN cut THEN n_spread ELSE 0 END AS n_removed,
  length(CASE WHEN cut THEN rest ELSE text END) AS n_chars_left, sha256(CASE WHEN cut THEN rest ELSE text END) AS text_sha256
FROM f
"""


def _steps(name: str, pattern: str, group: int, source: str = "d", text: str = "text", key: str = "doc_id") -> str:
    """A table of the matches of ``pattern``: each with the gap before it, so that lengths give places."""
    whole = f"(?s)(.*?)(?:{pattern}|\\z)".replace("'", "''")
    return f"""
{name}_raw AS (
  SELECT {key}, unnest(regexp_extract_all({text}, '{whole}', 1)) AS gap, unnest(regexp_extract_all({text}, '{whole}', 0)) AS part,
    unnest(regexp_extract_all({text}, '{whole}', {group})) AS v, generate_subscripts(regexp_extract_all({text}, '{whole}', 0), 1) AS i
  FROM {source} WHERE regexp_matches({text}, '{pattern.replace("'", "''")}')),
{name} AS (
  SELECT {key}, (e - length(part) + length(gap))::BIGINT AS s, e, length(v) AS n, substr(part, length(gap) + 1) AS word FROM (
    SELECT *, sum(length(part)) OVER (PARTITION BY {key} ORDER BY i)::BIGINT AS e FROM {name}_raw) WHERE length(part) > length(gap))"""


def _blanked(name: str, source: str, text: str, key: str, spans: str) -> str:
    """A table like ``source`` with spaces in its texts for what ``spans`` cover."""
    return f"""
{name}_hit AS (SELECT DISTINCT {key}, unnest(range(s + 1, e + 1)) AS i FROM {spans}),
{name}_chars AS (
  SELECT {key}, unnest(string_split({text}, '')) AS ch, generate_subscripts(string_split({text}, ''), 1) AS i
  FROM {source} WHERE {key} IN (SELECT {key} FROM {spans})),
{name}_rest AS (
  SELECT {key}, string_agg(CASE WHEN h.i IS NULL THEN ch ELSE ' ' END, '' ORDER BY c.i) AS rest
  FROM {name}_chars c LEFT JOIN {name}_hit h USING ({key}, i) GROUP BY {key}),
{name} AS (SELECT x.* REPLACE (coalesce(rest, {text}) AS {text}) FROM {source} x LEFT JOIN {name}_rest USING ({key}))"""


def _secrets() -> str:
    # The SQL states patterns and limits itself, so that a wrong one in the operator shows.
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    allowed = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|(?i:example|sample|dummy|placeholder|changeme|redacted|x{6}|0{8}|0123456789|abcdefghij)"
    candidate = "[A-Za-z0-9+/_=-]{20,}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_steps("assigned", assign, 2)},
{_steps("access", "AKIA[A-Z0-9]{16,}", 0)},
{_steps("hexed", "[0-9a-f]{24,}", 0)},
base AS (
  SELECT doc_id, s, 0 AS k, e FROM assigned WHERE n >= 6 UNION ALL SELECT doc_id, s, 1, e FROM access UNION ALL SELECT doc_id, s, 2, e FROM hexed),
{_blanked("left_over", "d", "text", "doc_id", "base")},
{_steps("strings", candidate, 0, "left_over")},
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, s) AS string_id FROM strings),
{_steps("fine", allowed, 0, "numbered", "word", "string_id")},
{_blanked("unfine", "numbered", "word", "string_id", "fine")},
{_steps("parts", candidate, 0, "unfine", "word", "string_id")},
pieces AS (SELECT n.doc_id, n.s + p.s AS s, n.s + p.e AS e, p.word FROM parts p JOIN numbered n USING (string_id)),
classed AS (
  SELECT doc_id, s, e, word, CASE WHEN regexp_full_match(word, '[0-9a-fA-F]+') AND regexp_matches(word, '[0-9]') AND regexp_matches(word, '[a-fA-F]') THEN 'hex'
    WHEN regexp_matches(word, '[0-9]') AND regexp_matches(word, '[a-z]') AND regexp_matches(word, '[A-Z]') THEN 'mixed'
    WHEN regexp_matches(word, '[0-9]') AND regexp_matches(word, '[a-zA-Z]') THEN 'single' END AS class
  FROM pieces),
judged AS (
  SELECT doc_id, s, e, class, CASE class WHEN 'mixed' THEN word ELSE lower(word) END AS word FROM classed WHERE class IN ('hex', 'mixed') UNION ALL
  SELECT doc_id, s, e, class, run FROM (SELECT *, unnest(regexp_split_to_array(lower(word), '[+/_=-]')) AS run FROM classed WHERE class = 'single')
  WHERE length(run) >= 20 AND regexp_matches(run, '[0-9]') AND regexp_matches(run, '[a-z]')),
runs AS (SELECT *, row_number() OVER (ORDER BY doc_id, s, word) AS run_id FROM judged),
spots AS (SELECT *, unnest(range(1, length(word) - 20 + 2)) AS place FROM runs),
chars AS (SELECT run_id, doc_id, s, e, class, place, unnest(string_split(substr(word, place, 20), '')) AS ch FROM spots),
counts AS (SELECT run_id, doc_id, s, e, class, place, ch, count(*) AS c FROM chars GROUP BY ALL),
windows AS (SELECT doc_id, s, e, class, log2(20) - sum(c * log2(c)) / 20 AS bits FROM counts GROUP BY run_id, doc_id, s, e, class, place),
added AS (
  SELECT DISTINCT doc_id, s, 3 AS k, e FROM windows WHERE bits >= CASE class WHEN 'hex' THEN 3.0 WHEN 'mixed' THEN 3.8 ELSE 3.5 END - 0.0000001),
every AS (
  SELECT *, CASE k WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'entropy' END || ':' || s || ':' || e AS span
  FROM (FROM base UNION ALL FROM added)),
found AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_entropy,
    string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base_spans, string_agg(span, ',' ORDER BY s, k) AS spans
  FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (doc_id)
"""


def _line_rules() -> str:
    r = line_rules.LineRules()
    words = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
    stops = line_rules.STOPS.replace("'", "''")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {words.format("text")} AS t FROM d),
spread AS (SELECT doc_id, unnest(range(1, len(t) - 3)) AS i, t FROM w),
windows AS (SELECT doc_id, i, t[i:i+4] AS g FROM spread),
twice AS (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM windows JOIN twice USING (doc_id, g)) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
own AS (SELECT doc_id, line, {words.format("line")} AS t FROM lines),
full_lines AS (SELECT *, len(t) AS n, length(array_to_string(t, '')) AS chars FROM own WHERE len(t) > 0),
judged AS (
  SELECT doc_id, line, chars,
    len(list_filter(t, lambda x: length(regexp_replace(x, '[^{line_rules.SYMBOLS}]', '', 'g')) >= 2)) > {r.max_symbol_words} * n
    OR (length(line) - length(replace(line, '!!', ''))) // 2 > {r.max_shout_words} * n
    OR n >= {r.min_words} AND len(list_filter(range(1, n), lambda i: t[i] = t[i + 1])) > {r.max_stutter_words} * n
    OR len(list_filter(t, lambda x: contains('{line_rules.SEPARATORS}', x))) >= {r.min_separators} AND len(list_filter(t, lambda x: contains('{line_rules.SEPARATORS}', x))) > {r.max_separators} * n
    OR n <= {r.max_unstopped_words} AND NOT contains('{stops}', right(t[n], 1))
    OR n <= {r.max_boilerplate_words} AND regexp_matches(lower(line), '{line_rules.BOILERPLATE}') AS failed
  FROM full_lines),
per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(chars) FILTER (failed), 0)::BIGINT AS lost_chars
  FROM judged GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(t) AS n_words, length(array_to_string(t, '')) AS word_chars, length(regexp_replace(text, '[^{line_rules.SYMBOLS}]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_chars, 0) AS lost_chars
  FROM w LEFT JOIN per USING (doc_id) LEFT JOIN covered USING (doc_id)),
g AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND lost_chars <= {r.max_loss} * word_chars AS kept FROM g
"""


ORACLES: dict[str, str] = {
    "op3_extendible_shards": SHARDS,
    "op5_nra_top_k": TOP_K,
    "op6_entropy_secrets": _secrets(),
    "op8_line_rules": _line_rules(),
    "op10_line_spread": LINE_SPREAD,
}
