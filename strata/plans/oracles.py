"""DuckDB SQL equivalent to the driver queries, over the raw tables and raw shingle texts."""

from __future__ import annotations

WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[^ \\t\\n\\r\\f\\v]+')"
W = f"w AS MATERIALIZED (SELECT doc_id, lang, source, text, {WORDS} AS t FROM documents)"
SH = (
    "sh AS MATERIALIZED (SELECT doc_id, lang, source, len(t) AS n_tokens, "
    "list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) AS s FROM w)"
)
D = "d AS MATERIALIZED (SELECT DISTINCT doc_id, lang, unnest(s) AS h FROM sh)"
N = "n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id)"
OV = "ov AS MATERIALIZED (SELECT q.doc_id AS q, c.doc_id AS c, count(*) AS overlap FROM d q JOIN d c ON q.lang = c.lang AND q.h = c.h AND c.doc_id < q.doc_id GROUP BY ALL)"
SHAPE = (
    "shape AS MATERIALIZED (SELECT doc_id, list_transform(t, lambda x: least(length(x), 9)::VARCHAR || CASE WHEN regexp_matches(x, '[0-9]') THEN 'D' ELSE '' END "
    "|| CASE WHEN regexp_matches(x, '[^\\p{L}0-9]') THEN 'P' ELSE '' END) AS t FROM w), "
    "ash AS MATERIALIZED (SELECT doc_id, list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) AS s FROM shape), "
    "ad AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(s) AS h FROM ash)"
)
U = (
    "u AS MATERIALIZED (SELECT doc_id, lang, source, doc_id::VARCHAR AS name, "
    "len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r\\f\\v]')))::INT AS sloc, "
    "(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '.!?', '')) + 1)::INT AS cc FROM documents), "
    "um AS MATERIALIZED (SELECT *, cc * sqrt(sloc) AS mass FROM u)"
)
ROLE = (
    "lab AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id), "
    "r AS MATERIALIZED (SELECT um.*, CASE WHEN toxic = 1 THEN 'test' WHEN quality = 0 THEN 'accessor' ELSE 'general' END AS role FROM um LEFT JOIN lab USING (doc_id))"
)
BEST = (
    "top AS (SELECT * FROM (SELECT ov.*, row_number() OVER (PARTITION BY q ORDER BY overlap DESC, m.source, m.name, c) AS rn "
    "FROM ov JOIN um m ON m.doc_id = ov.c JOIN sh sq ON sq.doc_id = ov.q JOIN um uq ON uq.doc_id = ov.q WHERE sq.n_tokens >= 20 AND uq.sloc >= 1) WHERE rn <= 64), "
    "an AS (SELECT doc_id, count(*) AS n FROM ad GROUP BY doc_id), "
    "p1 AS (SELECT top.q, top.c, top.overlap, wq.t = wc.t AS same, nq.n AS nq, nc.n AS nc, uq.source AS sq, uc.source AS sc, uc.name AS nm "
    "FROM top JOIN n nq ON nq.doc_id = q JOIN n nc ON nc.doc_id = c JOIN w wq ON wq.doc_id = q JOIN w wc ON wc.doc_id = c "
    "JOIN um uq ON uq.doc_id = q JOIN um uc ON uc.doc_id = c WHERE len(wc.t) >= 20 AND uc.sloc >= 1), "
    "p2 AS (SELECT *, CASE WHEN same THEN 1.0::DOUBLE ELSE overlap::DOUBLE / (nq + nc - overlap) END AS tok FROM p1), "
    "p3 AS (SELECT * FROM p2 WHERE tok >= 0.85), "
    "av AS (SELECT p3.q, p3.c, count(b.h) AS shared FROM p3 JOIN ad a ON a.doc_id = p3.q LEFT JOIN ad b ON b.doc_id = p3.c AND b.h = a.h GROUP BY ALL), "
    "p4 AS (SELECT p3.*, CASE WHEN same THEN 1.0::DOUBLE ELSE shared::DOUBLE / (x.n + y.n - shared) END AS shp FROM p3 JOIN av USING (q, c) JOIN an x ON x.doc_id = q JOIN an y ON y.doc_id = c), "
    "best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY least(tok, shp) DESC, sc, nm, c) AS k FROM p4 WHERE shp >= 0.85) WHERE k = 1)"
)
RISK = "CASE WHEN {a} IN ('test', 'accessor') OR {b} IN ('test', 'accessor') THEN 'low' WHEN {a} = 'general' AND {b} = 'general' THEN 'high' ELSE 'medium' END"
FAM = (
    "RECURSIVE {head}, e AS (SELECT q AS a, c AS b FROM best UNION SELECT c, q FROM best), "
    "reach(a, b) AS (SELECT doc_id, doc_id FROM um UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), "
    "fam AS (SELECT a AS doc_id, min(b) AS family FROM reach GROUP BY a)"
)
RUN = 20  # windows that a block of 24 words spans
BLOCK = (
    "btop AS (SELECT * FROM (SELECT ov.*, row_number() OVER (PARTITION BY q ORDER BY overlap DESC, m.source, m.name, c) AS rn "
    "FROM ov JOIN um m ON m.doc_id = ov.c JOIN sh sq ON sq.doc_id = ov.q WHERE sq.n_tokens >= 48) WHERE rn <= 256), "
    "bp AS MATERIALIZED (SELECT btop.q, btop.c FROM btop JOIN sh sc ON sc.doc_id = btop.c WHERE sc.n_tokens >= 48), "
    "pos AS MATERIALIZED (SELECT doc_id, unnest(s) AS h, generate_subscripts(s, 1) - 1 AS ix FROM sh), "
    "lh AS (SELECT bp.q, bp.c, pos.ix FROM bp JOIN pos ON pos.doc_id = bp.q JOIN d ON d.doc_id = bp.c AND d.h = pos.h), "
    "lr AS (SELECT q, c, min(ix) AS start, count(*) AS length FROM (SELECT *, ix - row_number() OVER (PARTITION BY q, c ORDER BY ix) AS g FROM lh) GROUP BY q, c, g), "
    f"lbest AS MATERIALIZED (SELECT q, c, start, length FROM (SELECT *, row_number() OVER (PARTITION BY q, c ORDER BY length DESC, start) AS k FROM lr WHERE length >= {RUN}) WHERE k = 1)"
)
BLOCK2 = (
    "apos AS (SELECT doc_id, unnest(s) AS h, generate_subscripts(s, 1) - 1 AS ix FROM ash), "
    "ah AS (SELECT b.q, b.c, apos.ix FROM lbest b JOIN apos ON apos.doc_id = b.q JOIN ad ON ad.doc_id = b.c AND ad.h = apos.h), "
    "ar AS (SELECT q, c, count(*) AS length FROM (SELECT *, ix - row_number() OVER (PARTITION BY q, c ORDER BY ix) AS g FROM ah) GROUP BY q, c, g), "
    f"abest AS (SELECT q, c, max(length) AS ast_length FROM ar WHERE length >= {RUN} GROUP BY q, c), "
    "spot AS (SELECT * FROM (SELECT b.q, b.c, r.ix, row_number() OVER (PARTITION BY b.q, b.c ORDER BY r.ix) AS nth FROM lbest b JOIN pos a ON a.doc_id = b.q AND a.ix = b.start "
    "JOIN pos r ON r.doc_id = b.c AND r.h = a.h) WHERE nth <= 8), "
    "rh AS (SELECT b.q, b.c, pos.ix FROM lbest b JOIN pos ON pos.doc_id = b.c JOIN d ON d.doc_id = b.q AND d.h = pos.h), "
    "rr AS (SELECT q, c, min(ix) AS start, count(*) AS length FROM (SELECT *, ix - row_number() OVER (PARTITION BY q, c ORDER BY ix) AS g FROM rh) GROUP BY q, c, g), "
    "rl AS (SELECT s.q, s.c, s.ix AS start, rr.start + rr.length - s.ix AS length FROM spot s JOIN rr ON rr.q = s.q AND rr.c = s.c AND s.ix >= rr.start AND s.ix < rr.start + rr.length), "
    f"rbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, c ORDER BY length DESC, start) AS k FROM rl WHERE length >= {RUN}) WHERE k = 1), "
    "fin AS (SELECT l.q, l.c, l.start AS left_start, l.length AS left_length, rb.start AS right_start, rb.length AS right_length, abest.ast_length, least(l.length, rb.length) AS island "
    "FROM lbest l JOIN abest USING (q, c) JOIN rbest rb ON rb.q = l.q AND rb.c = l.c)"
)
CM = (
    "it AS (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY l_orderkey), "
    "cm AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey, count(*)::INT AS sloc, sum(items)::INT AS cc FROM orders JOIN it ON l_orderkey = o_orderkey GROUP BY ALL), "
    "cmm AS (SELECT *, cc * sqrt(sloc) AS mass FROM cm), "
    "ms AS (SELECT month, cutoff, sum(mass) AS total_mass, coalesce(sum(mass) FILTER (cc > cutoff), 0.0) AS high_mass, count(*) FILTER (cc > cutoff) AS high_count "
    "FROM cmm, (VALUES (3), (5), (8)) k(cutoff) GROUP BY ALL), "
    "mr AS (SELECT *, CASE WHEN total_mass > 0 THEN high_mass / total_mass ELSE 0.0 END AS erosion_ratio FROM ms), "
    "md AS (SELECT *, erosion_ratio - lag(erosion_ratio) OVER (PARTITION BY cutoff ORDER BY month) AS delta FROM mr)"
)
EMIT = (
    f"{U}, {ROLE}, em AS (SELECT doc_id AS emit_seq, 'function-mass' AS rule_id, 'error' AS severity, "
    "printf('new function mass %.2f exceeds limit %.2f', mass, 80.0) AS message, source AS path, 1 AS line, NULL::VARCHAR AS base_path, name, NULL::VARCHAR AS scope, 80.0 AS threshold, mass FROM r WHERE mass > 80 "
    "UNION ALL SELECT doc_id + 1000000000, 'near-clone', 'warning', 'unit with role ' || role, source, 1, CASE WHEN sloc > 3 THEN lang END, name, 'block', NULL, NULL FROM r WHERE role <> 'general')"
)


def _quantile(p: float) -> str:
    return f"round(max(CASE WHEN rn = floor((n - 1) * {p}) + 1 THEN delta END), 6) AS p{round(p * 100)}"


ORACLES: dict[str, str] = {
    "shingle_sets": f"WITH {W}, {SH} SELECT doc_id, n_tokens::INT AS n_tokens, len(s)::INT AS n_shingles, len(list_distinct(s))::INT AS n_distinct FROM sh",
    "shingle_postings": f"WITH {W}, {SH}, {D} SELECT lang, h AS shingle, count(*) AS n_docs FROM d GROUP BY ALL HAVING count(*) >= 3",
    "shingle_overlap": f"WITH {W}, {SH}, {D}, {OV} SELECT q AS doc_id, c AS other_id, overlap FROM ov WHERE overlap >= 5",
    "exact_duplicates": f"WITH {W} SELECT lang, sha256(array_to_string(t, ' ')) AS digest, min(doc_id) AS first_id, count(*) AS n_copies FROM w GROUP BY ALL HAVING count(*) > 1",
    "renamed_clone": f"WITH {W} SELECT lang, sha256(array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^[0-9\"''`]') THEN 'LIT' WHEN regexp_matches(x, '[0-9]') THEN 'ID' ELSE x END), ' ')) AS digest, "
    "min(doc_id) AS first_id, count(*) AS n_docs FROM w GROUP BY ALL HAVING count(*) > 1",
    "stream_digests": f"WITH {W} SELECT doc_id, sha256(array_to_string(t, ' ')) AS token_digest, sha256(coalesce(text, '')) AS content_digest FROM w",
    "line_runs": f"WITH {W}, x AS (SELECT doc_id, unnest(t) AS v, generate_subscripts(t, 1) AS i FROM w), y AS (SELECT doc_id, least(length(v), 9) AS v, i FROM x), "
    "g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, v ORDER BY i) AS k FROM y), runs AS (SELECT doc_id, v, k, min(i) AS i, count(*) AS n FROM g GROUP BY ALL), "
    "a AS (SELECT doc_id, count(*) AS n_runs, string_agg(n::VARCHAR || ':' || v::VARCHAR, ',' ORDER BY i) AS s FROM runs GROUP BY doc_id) "
    "SELECT documents.doc_id, coalesce(n_runs, 0)::INT AS n_runs, md5(coalesce(s, '')) AS digest, true AS decodes FROM documents LEFT JOIN a USING (doc_id)",
    "hex_codec": "SELECT o_custkey, string_agg(lpad(lower(to_hex(o_orderkey)), 8, '0'), '' ORDER BY o_orderkey) AS hex_text, true AS decodes FROM orders GROUP BY o_custkey",
    "near_clone_pairs": f"WITH {W}, {SH}, {D}, {N}, {OV}, j AS (SELECT q, c, overlap, overlap::DOUBLE / (a.n + b.n - overlap) AS j FROM ov JOIN n a ON a.doc_id = q JOIN n b ON b.doc_id = c) "
    "SELECT q AS doc_id, c AS other_id, overlap, round(j, 6) AS jaccard FROM j WHERE j >= 0.85",
    "near_clone_topk": f"WITH {W}, {SH}, {D}, {OV}, k AS (SELECT ov.*, row_number() OVER (PARTITION BY q ORDER BY overlap DESC, m.source, m.doc_id::VARCHAR, c) AS rn FROM ov JOIN documents m ON m.doc_id = c) "
    "SELECT q AS doc_id, c AS other_id, overlap, rn::INT AS place FROM k WHERE rn <= 64",
    "near_clone_best": f"WITH {W}, {SH}, {D}, {N}, {OV}, {SHAPE}, {U}, {BEST}, {ROLE} SELECT q AS doc_id, c AS other_id, round(tok, 6) AS token_similarity, round(shp, 6) AS shape_similarity, "
    f"round(least(tok, shp), 6) AS similarity, {RISK.format(a='a.role', b='b.role')} AS risk, sq = sc AS same_source FROM best JOIN r a ON a.doc_id = q JOIN r b ON b.doc_id = c",
    "block_longest_run": f"WITH {W}, {SH}, {D}, {OV}, {U}, {BLOCK} SELECT q AS doc_id, c AS other_id, start::INT AS start, length FROM lbest",
    "block_matches": f"WITH {W}, {SH}, {D}, {OV}, {SHAPE}, {U}, {BLOCK}, {BLOCK2} SELECT doc_id, other_id, left_start, left_length, right_start, right_length, ast_length, island FROM ("
    "SELECT q AS doc_id, c AS other_id, fin.*, row_number() OVER (PARTITION BY q ORDER BY island DESC, m.source, m.name, c) AS k FROM fin JOIN um m ON m.doc_id = c) WHERE k <= 3",
    "clone_families": "WITH " + FAM.format(head=f"{W}, {SH}, {D}, {N}, {OV}, {SHAPE}, {U}, {BEST}") + " SELECT doc_id, family FROM fam",
    "family_summary": "WITH " + FAM.format(head=f"{W}, {SH}, {D}, {N}, {OV}, {SHAPE}, {U}, {BEST}, {ROLE}") + ", m AS (SELECT fam.family, r.*, "
    "row_number() OVER (PARTITION BY family ORDER BY r.source, r.name, r.doc_id) AS nth FROM fam JOIN r USING (doc_id)) "
    "SELECT family, count(*) AS members, round(sum(mass), 6) AS family_mass, round(max(mass), 6) AS largest_mass, round(greatest(sum(mass) - max(mass), 0.0), 6) AS recoverable_mass, "
    "array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, CASE WHEN count(*) FILTER (role NOT IN ('test', 'accessor')) = 0 THEN 'low' WHEN count(*) FILTER (role NOT IN ('test', 'accessor')) = count(*) THEN 'high' ELSE 'medium' END AS risk, "
    "max(source) FILTER (nth = 1) AS path, max(source) FILTER (nth = 2) AS base_path FROM m GROUP BY family HAVING count(*) >= 2",
    "contamination_containment": f"WITH {W}, {SH}, {D}, b AS (SELECT item_id, {WORDS} AS t FROM benchmark), "
    "bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))) AS h FROM b), bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id), "
    "o AS (SELECT item_id, doc_id, count(*) AS overlap FROM bs JOIN d USING (h) GROUP BY ALL) "
    "SELECT item_id, doc_id, overlap, round(overlap::DOUBLE / n, 6) AS containment FROM o JOIN bn USING (item_id) WHERE round(overlap::DOUBLE / n, 6) >= 0.5",
    "page_tag_stream": "WITH p AS (SELECT page_id, regexp_extract_all(lower(html), '<(/?[a-z][a-z0-9]*)', 1) AS t FROM pages) "
    "SELECT page_id, len(t)::INT AS n_tags, len(list_filter(t, lambda x: NOT starts_with(x, '/')))::INT AS n_nodes, md5(array_to_string(t, ' ')) AS digest FROM p",
    "page_structure_clones": "WITH p AS (SELECT page_id, regexp_extract_all(lower(html), '<(/?[a-z][a-z0-9]*)', 1) AS t FROM pages), "
    "q AS (SELECT page_id, len(list_filter(t, lambda x: NOT starts_with(x, '/')))::INT AS n_nodes, md5(array_to_string(t, ' ')) AS digest FROM p) "
    "SELECT digest, count(*) AS n_pages, min(page_id) AS first_page, max(n_nodes) AS n_nodes FROM q GROUP BY digest HAVING count(*) > 1",
    "unit_mass": f"WITH {U} SELECT doc_id, sloc, cc, round(mass, 6) AS mass FROM um",
    "mass_summary": f"WITH {U}, s AS (SELECT lang AS language, cutoff, sum(mass) AS total_mass, coalesce(sum(mass) FILTER (cc > cutoff), 0.0) AS high_mass, count(*) FILTER (cc > cutoff) AS high_count, max(cc) AS max_cc, max(mass) AS max_mass "
    "FROM um, (VALUES (5), (10), (15), (20), (30)) k(cutoff) GROUP BY ALL) SELECT language, cutoff, round(total_mass, 6) AS total_mass, round(high_mass, 6) AS high_mass, high_count, max_cc, round(max_mass, 6) AS max_mass, "
    "round(CASE WHEN total_mass > 0 THEN high_mass / total_mass ELSE 0.0 END, 6) AS erosion_ratio FROM s",
    "top_contributors": f"WITH {U}, k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY mass DESC, source, name) AS rank FROM um WHERE cc > 10) "
    "SELECT lang AS language, rank::INT AS rank, source AS path, name, cc, round(mass, 6) AS mass FROM k WHERE rank <= 3",
    "erosion_by_cutoff": f"WITH {CM} SELECT month, cutoff, round(total_mass, 6) AS total_mass, round(high_mass, 6) AS high_mass, high_count, round(erosion_ratio, 6) AS erosion_ratio FROM mr",
    "erosion_history": f"WITH {CM} SELECT month, "
    + ", ".join(f'round(max(erosion_ratio) FILTER (cutoff = {c}), 6) AS "{c}_ratio", round(max(delta) FILTER (cutoff = {c}), 6) AS "{c}_delta"' for c in (3, 5, 8))
    + " FROM md GROUP BY month",
    "delta_quantiles": f"WITH {CM}, k AS (SELECT cutoff, delta, row_number() OVER (PARTITION BY cutoff ORDER BY delta) AS rn, count(*) OVER (PARTITION BY cutoff) AS n FROM md WHERE delta IS NOT NULL) "
    "SELECT cutoff, max(n) AS n, " + ", ".join(_quantile(p) for p in (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)) + " FROM k GROUP BY cutoff",
    "erosion_breaches": f"WITH {CM}, y AS (SELECT *, month[1:4]::INT AS year, month[6:7] AS m FROM mr), e AS (SELECT b.year AS base_year, b.m AS month, b.cutoff, h.erosion_ratio - b.erosion_ratio AS delta, h.erosion_ratio AS ratio, "
    "CASE WHEN b.high_mass = 0 THEN CASE WHEN h.high_mass > 0 THEN 1.0 ELSE 0.0 END ELSE (h.high_mass - b.high_mass) / b.high_mass END AS growth FROM y b JOIN y h ON h.year = b.year + 1 AND h.m = b.m AND h.cutoff = b.cutoff) "
    "SELECT base_year, month, cutoff, round(delta, 6) AS delta, round(growth, 6) AS growth, concat_ws(',', CASE WHEN growth > 0.08 THEN 'mass-growth' END, CASE WHEN delta > 0.08 THEN 'ratio-delta' END, CASE WHEN ratio > 0.5 THEN 'ratio-level' END) AS breaches FROM e",
    "history_rollup": f"WITH {CM}, x AS (SELECT *, month[1:4] AS year FROM cmm) SELECT year, month, round(sum(mass), 6) AS total_mass, max(cc) AS max_cc, count(*) AS n_units FROM x GROUP BY ROLLUP (year, month)",
    "mass_delta": f"WITH {CM}, y AS (SELECT month[1:4] AS year, o_custkey, sum(sloc)::INT AS sloc, sum(cc)::INT AS cc FROM cm GROUP BY ALL), z AS (SELECT *, cc * sqrt(sloc) AS mass FROM y), "
    "j AS (SELECT h.o_custkey, h.mass, b.mass AS base_mass FROM z h LEFT JOIN z b ON b.o_custkey = h.o_custkey AND b.year = '1996' WHERE h.year = '1997'), "
    "k AS (SELECT *, CASE WHEN base_mass IS NULL AND mass > 10 THEN 'new' WHEN mass - base_mass > 5 THEN 'grown' END AS kind FROM j) "
    "SELECT o_custkey, kind, round(mass, 6) AS head_mass, round(base_mass, 6) AS base_mass, round(mass - base_mass, 6) AS delta FROM k WHERE kind IS NOT NULL",
    "entry_diff": "WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n, md5(string_agg(o_orderpriority, ',' ORDER BY o_orderpriority)) AS h FROM orders GROUP BY ALL), "
    "j AS (SELECT coalesce(b.o_custkey, h.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN h.o_custkey IS NULL THEN 'deleted' WHEN (b.n, b.h) IS DISTINCT FROM (h.n, h.h) THEN 'changed' END AS status "
    "FROM (FROM o WHERE y = 1996) b FULL JOIN (FROM o WHERE y = 1997) h ON b.o_custkey = h.o_custkey) SELECT o_custkey, status FROM j WHERE status IS NOT NULL",
    "feature_expansion": "WITH f AS (SELECT year(l_shipdate) AS y, l_suppkey, list(DISTINCT l_returnflag || l_linestatus || l_linenumber::VARCHAR) AS s FROM lineitem GROUP BY ALL), "
    "j AS (SELECT h.l_suppkey, b.s IS NULL AS fresh, list_sort(list_filter(h.s, lambda x: NOT list_contains(coalesce(b.s, []), x))) AS added FROM f h LEFT JOIN f b ON b.l_suppkey = h.l_suppkey AND b.y = 1996 WHERE h.y = 1997) "
    "SELECT l_suppkey, CASE WHEN fresh THEN 'new' ELSE 'expanded' END AS change, array_to_string(added, ',') AS added FROM j WHERE fresh OR len(added) > 0",
    "set_broadened": "WITH f AS (SELECT year(o_orderdate) AS y, o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders GROUP BY ALL) "
    "SELECT h.o_custkey, array_to_string(h.s, ',') AS items, coalesce(len(list_filter(b.s, lambda x: NOT list_contains(h.s, x))) = 0 AND len(b.s) < len(h.s), false) AS broadened "
    "FROM f h LEFT JOIN f b ON b.o_custkey = h.o_custkey AND b.y = 1996 WHERE h.y = 1997 AND h.s IS DISTINCT FROM b.s",
    "bag_difference": "WITH l AS (SELECT *, year(l_shipdate) AS y FROM lineitem), "
    "n1 AS (SELECT *, row_number() OVER (PARTITION BY y, l_returnflag, l_linestatus, l_quantity ORDER BY l_orderkey, l_linenumber) AS k FROM l WHERE y IN (1996, 1997)), "
    "s1 AS (SELECT a.* FROM n1 a WHERE NOT EXISTS (SELECT 1 FROM n1 b WHERE b.y = 2 * 1996 + 1 - a.y AND b.l_returnflag = a.l_returnflag AND b.l_linestatus = a.l_linestatus AND b.l_quantity = a.l_quantity AND b.k = a.k)), "
    "n2 AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY y, l_returnflag, l_suppkey ORDER BY l_orderkey, l_linenumber) AS k FROM s1) "
    "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_suppkey FROM n2 a WHERE y = 1997 AND NOT EXISTS (SELECT 1 FROM n2 b WHERE b.y = 1996 AND b.l_returnflag = a.l_returnflag AND b.l_suppkey = a.l_suppkey AND b.k = a.k)",
    "interval_contains": "WITH r AS (SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY user_id) SELECT * FROM r WHERE EXISTS ("
    "SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.value > 90 AND e.user_id % 7 = r.user_id % 7 AND e.event_id BETWEEN r.first_id AND r.last_id)",
    "severity_policy": f"WITH {EMIT} SELECT emit_seq, rule_id, 'warning' AS severity, message FROM em WHERE rule_id = 'function-mass'",
    "suppressed_findings": f"WITH {EMIT} SELECT rule_id, path, count(*) AS n_findings FROM em WHERE NOT (rule_id = 'function-mass' AND path = 'src0') AND NOT (rule_id = 'near-clone' AND path = 'src1' AND line = 1) "
    "AND NOT (rule_id = 'near-clone' AND path = 'src2' AND line = 2) GROUP BY ALL",
    "findings_union_sorted": f"WITH {EMIT} SELECT path, line, rule_id, base_path, emit_seq, 'warning' AS severity, message FROM em WHERE NOT (rule_id = 'function-mass' AND path = 'src0') AND NOT (rule_id = 'near-clone' AND path = 'src1' AND line = 1) "
    "ORDER BY path, line, rule_id, base_path NULLS FIRST, emit_seq",
    "finding_fingerprint": f"WITH {EMIT} SELECT emit_seq, sha256(rule_id || chr(31) || path || chr(31) || name || chr(31) || coalesce(base_path, '') || coalesce(chr(31) || scope, '')) AS fingerprint FROM em",
    "rule_coverage_matrix": "WITH f AS (SELECT source || '/' || doc_id::VARCHAR || CASE doc_id % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '/Cargo.toml' ELSE '.txt' END AS path, n_chars > 200 AS ok FROM documents), "
    "k AS (SELECT path, ok, rule_id, rule_id = 'unsafe-surface-growth' AS is_off, CASE WHEN rule_id IN ('function-mass', 'near-clone') THEN regexp_matches(path, '\\.(rs|py|ts|tsx)$') "
    "WHEN rule_id = 'dependency-surface-growth' THEN regexp_matches(path, '(^|/)Cargo\\.toml$') ELSE regexp_matches(path, '\\.rs$') END AS applicable FROM f, "
    "(VALUES ('function-mass'), ('near-clone'), ('lint-suppression-growth'), ('unsafe-surface-growth'), ('dependency-surface-growth'), ('structural-erosion')) v(rule_id)) "
    "SELECT path, rule_id, applicable, is_off OR NOT applicable OR ok AS completed, CASE WHEN is_off THEN 'disabled' WHEN NOT applicable THEN 'not-applicable' WHEN ok THEN 'completed' ELSE 'failed' END AS status, "
    "CASE WHEN is_off THEN 'rule is off' WHEN NOT applicable THEN 'rule does not apply to this path' WHEN ok THEN '' ELSE 'too short' END AS detail FROM k",
    "budget_prefix": "WITH s AS (SELECT doc_id, source, (sum(n_chars) OVER v)::BIGINT AS running_bytes, (row_number() OVER v)::INT AS file_index FROM documents WINDOW v AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) "
    "SELECT *, CASE WHEN running_bytes <= 40000 AND file_index <= 30 THEN 'analyzed' ELSE 'failed' END AS status, CASE WHEN running_bytes <= 40000 AND file_index <= 30 THEN '' ELSE 'resource budget exceeded' END AS detail FROM s",
    "risk_label": f"WITH {U}, {ROLE}, p AS (SELECT lang AS language, role, lead(role) OVER (PARTITION BY lang ORDER BY doc_id) AS other FROM r) "
    f"SELECT language, role, other, {RISK.format(a='role', b='other')} AS risk, count(*) AS n_pairs FROM p WHERE other IS NOT NULL GROUP BY ALL",
    "role_classify": f"WITH {U}, {ROLE} SELECT doc_id, role, role IN ('test', 'accessor') AS is_low_risk FROM r",
    "path_checks": "WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) SELECT page_id, NOT contains(path, '\\') AND len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS is_relative, "
    "regexp_replace(trim(path), '/+$', '') AS locator FROM p",
    "snapshot_fingerprint": "WITH d AS (SELECT source, sha256(doc_id::VARCHAR || chr(31) || lang || chr(31) || sha256(coalesce(text, ''))) AS h FROM documents), "
    "p AS (SELECT source, count(*) AS n, substr(h, 1, 3) || sha256(string_agg(h, chr(30) ORDER BY h)) AS h FROM d GROUP BY source, substr(h, 1, 3)) "
    "SELECT source, sum(n)::BIGINT AS n_entries, sha256(string_agg(h, chr(30) ORDER BY h)) AS fingerprint FROM p GROUP BY source",
}
