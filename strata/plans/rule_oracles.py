"""DuckDB SQL equivalent to the driver queries of the gate's rules."""

from __future__ import annotations

from strata.plans.oracles import BEST, D, FAM, N, OV, RISK, ROLE, SH, SHAPE, U, W

FN = (
    "it AS (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY l_orderkey), "
    "fn AS (SELECT year(o_orderdate) AS y, o_custkey AS pos, 'c' || ((o_custkey // 2) % 25) AS path, (o_custkey // 2 // 25)::VARCHAR AS name, count(*) AS sloc, sum(items)::INT AS cc, "
    "md5(string_agg(o_orderpriority, ',' ORDER BY o_orderpriority)) AS h FROM orders JOIN it ON l_orderkey = o_orderkey WHERE year(o_orderdate) IN (1996, 1997) GROUP BY y, o_custkey), "
    "fm AS MATERIALIZED (SELECT *, cc * sqrt(sloc) AS mass, CASE path WHEN 'c2' THEN 'c3' WHEN 'c3' THEN 'c2' ELSE path END AS old FROM fn), "
    "known AS (SELECT * FROM fm WHERE y = 1996 QUALIFY row_number() OVER (PARTITION BY path, name ORDER BY pos DESC) = 1)"
)
LINE = "line AS (SELECT *, year(l_shipdate) AS y, 's' || (l_suppkey % 10) AS path FROM lineitem WHERE year(l_shipdate) IN (1996, 1997))"
OLD = "CASE WHEN y = 1996 THEN path WHEN path = 's2' THEN 's3' WHEN path = 's3' THEN 's2' ELSE path END"
FILES = (
    "f AS (SELECT source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' ELSE '/Cargo.toml' END AS path, "
    "CASE WHEN n_chars > 3000 THEN 'resource budget exceeded' WHEN n_chars <= 200 THEN 'too short' ELSE '' END AS detail FROM documents)"
)
LAST = "coalesce(b.mass, 0.0)"

ORACLES: dict[str, str] = {
    "rule_function_mass": f"WITH {FN}, j AS (SELECT h.*, b.mass AS bm, b.pos AS bp FROM fm h LEFT JOIN known b ON b.path = h.old AND b.name = h.name WHERE h.y = 1997 AND h.path <> 'c24' AND h.h IS DISTINCT FROM b.h) "
    "SELECT path, pos::INT AS line, CASE WHEN bm IS NULL THEN printf('new function mass %.2f exceeds limit 10.00', mass) ELSE printf('function mass increased by %.2f; limit is 5.00', mass - bm) END AS message, "
    "CASE WHEN bm IS NOT NULL THEN old END AS base_path, bp::INT AS base_line, round(bm, 6) AS base_mass, round(mass, 6) AS head_mass, round(mass - bm, 6) AS delta, "
    "CASE WHEN bm IS NULL THEN 10.0 ELSE 5.0 END::DOUBLE AS threshold, name AS qualified_name FROM j WHERE (bm IS NULL AND mass > 10) OR mass - bm > 5",
    "rule_lint_growth": "WITH l AS (SELECT year(o_orderdate) AS y, 'c' || (o_custkey % 25) AS path, o_orderpriority AS kind, o_custkey AS target, list_sort(list(DISTINCT 'q' || quarter(o_orderdate))) AS s, "
    "max(o_orderstatus) AS tk, min(o_orderkey)::INT AS line FROM orders GROUP BY ALL), "
    "h AS (SELECT *, CASE path WHEN 'c2' THEN 'c3' WHEN 'c3' THEN 'c2' ELSE path END AS old FROM l WHERE y = 1997 AND path <> 'c24' AND line % 3 <> 0) "
    "SELECT h.path, h.line, 'warning' AS severity, CASE WHEN len(b.s) < len(h.s) AND list_has_all(h.s, b.s) THEN 'lint suppression broadened' ELSE 'new lint suppression introduced' END AS message, "
    "h.kind AS pattern_id, array_to_string(h.s, ',') AS lint_paths, h.tk AS target_kind "
    "FROM h LEFT JOIN l b ON b.y = 1996 AND b.path = h.old AND b.kind = h.kind AND b.target = h.target WHERE b.s IS DISTINCT FROM h.s",
    "rule_unsafe_growth": f"WITH {LINE}, u AS (SELECT y, path, {OLD} AS old, l_returnflag || l_linestatus AS p, l_quantity AS fp, (l_orderkey % 50 * 8 + l_linenumber)::INT AS line FROM line), "
    "v AS (SELECT *, row_number() OVER (PARTITION BY y, old, p, fp ORDER BY line) AS k FROM u WHERE y = 1996 OR (path <> 's9' AND line % 3 <> 0)), "
    "s AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY y, old, p, line) AS k FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.y <> a.y AND b.old = a.old AND b.p = a.p AND b.fp = a.fp AND b.k = a.k)) "
    "SELECT path, line, 'warning' AS severity, 'new ' || p || ' introduced' AS message, p AS pattern_id, count(*) AS n_findings FROM s a "
    "WHERE y = 1997 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.y = 1996 AND b.old = a.old AND b.p = a.p AND b.line = a.line AND b.k = a.k) GROUP BY ALL",
    "rule_dependency_growth": f"WITH {LINE}, e AS (SELECT y, path, {OLD} AS old, l_returnflag AS t, (l_suppkey // 10)::VARCHAR AS dep, max(l_linestatus) AS sk, max(l_linestatus) FILTER (l_linenumber = 7) AS src, "
    "sum(l_quantity::INT) % 2 = 0 AS d, list_sort(list(DISTINCT l_linenumber::VARCHAR)) AS f, min(l_orderkey)::INT AS line FROM line GROUP BY ALL), "
    "j AS (SELECT h.*, list_filter(h.f, lambda x: NOT list_contains(coalesce(b.f, []), x)) AS more, CASE WHEN b.y IS NULL THEN 'new' WHEN h.sk <> b.sk OR h.src IS DISTINCT FROM b.src THEN 'source changed' "
    "WHEN NOT list_has_all(b.f, h.f) OR (h.d AND NOT b.d) THEN 'features expanded' END AS change FROM e h LEFT JOIN e b ON b.y = 1996 AND b.path = h.old AND b.t = h.t AND b.dep = h.dep WHERE h.y = 1997 AND h.path <> 's9') "
    "SELECT path, line, 'warning' AS severity, printf('dependency %s in %s: %s', dep, t, change) AS message, dep AS dependency, t AS \"table\", change, sk AS source_kind, array_to_string(more, ',') AS added_features FROM j WHERE change IS NOT NULL",
    "rule_structural_erosion": f"WITH {FN}, s AS (SELECT y, cutoff, sum(mass) AS total, coalesce(sum(mass) FILTER (cc > cutoff), 0.0) AS high FROM fm, (VALUES (5), (10)) v(cutoff) GROUP BY ALL), "
    "e AS (SELECT h.cutoff, b.high AS bh, h.high AS hh, b.high / b.total AS br, h.high / h.total AS hr, hr - br AS delta, (hh - bh) / bh AS growth, "
    "concat_ws(',', CASE WHEN growth > 0.08 THEN 'mass-growth' END, CASE WHEN delta > 0.08 THEN 'ratio-delta' END, CASE WHEN hr > 0.5 THEN 'ratio-level' END) AS breaches "
    "FROM s b JOIN s h ON h.cutoff = b.cutoff WHERE b.y = 1996 AND h.y = 1997), "
    f"c AS (SELECT h.path, h.pos, h.name, b.mass AS bm, row_number() OVER (ORDER BY h.mass - {LAST} DESC, h.mass DESC, h.path, h.pos) AS n FROM fm h LEFT JOIN known b ON b.path = h.old AND b.name = h.name "
    "WHERE h.y = 1997 AND h.cc > 5 AND (b.mass IS NULL OR h.mass > b.mass) AND EXISTS (SELECT 1 FROM fm l WHERE l.y = 1997 AND l.path = h.path AND l.pos % 3 = 0 AND l.pos + 1 BETWEEN h.pos AND h.pos + 1)) "
    "SELECT c.path, c.pos::INT AS line, 'error' AS severity, printf('structural erosion at %.2f%% (base %.2f%%, ratio delta %+.2f%%, high-complexity mass %+.2f%% at CC>5) [%s]', hr * 100, br * 100, delta * 100, growth * 100, breaches) AS message, "
    "round(bh, 6) AS base_mass, round(hh, 6) AS head_mass, round(delta, 6) AS delta, 0.08::DOUBLE AS threshold, breaches, printf('%.6f', delta) AS erosion_delta, printf('%.6f', growth) AS high_complexity_mass_growth, "
    "printf('%.6f', hr) AS erosion_at_cc_5, (SELECT printf('%.6f', hr) FROM e WHERE cutoff = 10) AS erosion_at_cc_10, name AS contributor_1_qualified_name, coalesce(printf('%.6f', bm), 'new') AS contributor_1_base_mass, "
    "(SELECT path FROM c WHERE n = 3) AS contributor_3_path FROM e, c WHERE cutoff = 5 AND n = 1 AND breaches <> ''",
    "rule_scan": "WITH "
    + FAM.format(head=f"{W}, {SH}, {D}, {N}, {OV}, {SHAPE}, {U}, {BEST}, {ROLE}")
    + ", m AS (SELECT fam.family, r.*, row_number() OVER (PARTITION BY family ORDER BY source, name, doc_id) AS nth FROM fam JOIN r USING (doc_id)), "
    "g AS (SELECT family, 'CF-' || substr(sha256(string_agg(source || chr(31) || name, chr(30) ORDER BY source || chr(31) || name)), 1, 16) AS id, count(*) AS n, greatest(sum(mass) - max(mass), 0.0) AS spare, "
    "count(*) FILTER (role IN ('test', 'accessor')) AS low, max(source) FILTER (nth = 1) AS p1, max(source) FILTER (nth = 2) AS p2 FROM m GROUP BY family HAVING count(*) > 1), "
    "gr AS (SELECT *, CASE WHEN low = n THEN 'low' WHEN low = 0 THEN 'high' ELSE 'medium' END AS risk FROM g), "
    f"b AS (SELECT *, least(tok, shp) AS sim, {RISK.format(a='x.role', b='y.role')} AS risk FROM best JOIN r x ON x.doc_id = q JOIN r y ON y.doc_id = c JOIN fam ON fam.doc_id = q JOIN g USING (family)) "
    "SELECT sq AS path, 1 AS line, 'near-clone' AS rule_id, 'warning' AS severity, printf('whole-function structural similarity %.2f%% to %s exceeds threshold 85.00%% [%s]', round(sim * 100, 2), c::VARCHAR, risk) AS message, "
    "sc AS base_path, round(sim, 6) AS similarity, 'whole-function' AS clone_scope, risk AS clone_risk, id AS family_id, NULL::VARCHAR AS member_count, NULL::VARCHAR AS recoverable_mass, "
    "q::VARCHAR AS \"left\", c::VARCHAR AS \"right\", (sq = sc)::VARCHAR AS same_file FROM b "
    "UNION ALL SELECT p1, 1, 'near-clone', 'warning', printf('clone family %s has %d members; recoverable mass %.2f [%s]', id, n, spare, risk), p2, NULL, 'family', risk, id, n::VARCHAR, printf('%.6f', spare), NULL, NULL, NULL FROM gr",
    "rule_analysis_error": f"WITH {FILES} SELECT path, 1 AS line, 'analysis-error' AS rule_id, 'warning' AS severity, 'could not analyze file: ' || detail AS message FROM f WHERE detail <> ''",
    "incomplete_reasons": f"WITH {FILES}, k AS (SELECT *, CASE WHEN path LIKE '%.rs' THEN 5 WHEN path LIKE '%.py' THEN 2 ELSE 1 END AS rules FROM f WHERE detail <> '') "
    "SELECT CASE WHEN contains(detail, 'budget') THEN 'budget-exceeded' ELSE 'analysis-failed' END AS kind, detail, min(path) AS first_path, sum(rules)::BIGINT AS n FROM k GROUP BY ALL",
    "path_filter": f"WITH {FILES} SELECT path, CASE WHEN detail = '' THEN 'analyzed' ELSE 'failed' END AS status FROM f WHERE starts_with(path, 'src1/') OR starts_with(path, 'src2/')",
    "revision_manifest": "WITH o AS (SELECT year(o_orderdate) AS y, o_custkey AS id, md5(string_agg(o_orderpriority, ',' ORDER BY o_orderpriority)) AS h, max(length(o_orderstatus)) AS mode FROM orders GROUP BY ALL), "
    "j AS (SELECT coalesce(b.id, n.id) AS id, b.id AS was, n.id AS now, b.h IS DISTINCT FROM n.h OR b.mode IS DISTINCT FROM n.mode AS differs FROM (FROM o WHERE y = 1996) b FULL JOIN (FROM o WHERE y = 1997) n ON b.id = n.id), "
    "k AS (SELECT *, CASE WHEN now % 7 = 0 AND now + 1 IN (SELECT id FROM o WHERE y = 1996) THEN now + 1 END AS old FROM j) "
    "SELECT id::VARCHAR AS path, CASE WHEN now IS NULL THEN 'deleted' WHEN was IS NULL AND old IS NULL THEN 'added' WHEN differs THEN 'changed' ELSE 'unchanged' END AS status, old::VARCHAR AS old_path FROM k "
    "WHERE now IS NOT NULL OR id NOT IN (SELECT old FROM k WHERE old IS NOT NULL)",
}
