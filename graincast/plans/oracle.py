"""DuckDB SQL for the posting engine's queries, written from the definitions rather than from the plans."""

from __future__ import annotations

_P = """p AS (
  SELECT o_orderkey AS id, o_orderpriority AS title, c_name AS company, lower(regexp_replace(c_name, '[^\\p{L}\\p{N}]+', '', 'g')) AS ckey,
    CASE o_orderstatus WHEN 'F' THEN 'platform_a' WHEN 'O' THEN 'platform_b' ELSE 'official' END AS source,
    r_name, c_mktsegment AS seg, n_name, o_orderstatus AS st, o_custkey AS custkey,
    CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice / 50000)::INT END AS lo,
    CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice / 50000)::INT + (o_orderkey % 3)::INT END AS hi,
    strftime(o_orderdate, '%Y-%m-%d') AS created,
    CASE o_orderkey % 7 WHEN 0 THEN '상시' WHEN 1 THEN NULL ELSE strftime(o_orderdate::DATE + 30, '%Y-%m-%d') END AS deadline
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_S = _P + """, parts AS (
  SELECT *, CASE WHEN seg IN ('BUILDING', 'MACHINERY') THEN 1.0 WHEN seg = 'AUTOMOBILE' THEN 0.6 WHEN r_name = 'ASIA' THEN 0.35 ELSE 0.0 END::DOUBLE AS p_role,
    CASE WHEN lo IS NULL THEN 0.7 WHEN 4 BETWEEN lo AND hi THEN 1.0 WHEN lo > 4 AND lo <= 6 THEN greatest(0.3::DOUBLE, 1.0::DOUBLE - 0.35::DOUBLE * (lo - 4)) WHEN lo > 4 THEN 0.1 WHEN hi >= 2 THEN 0.5 ELSE 0.3 END::DOUBLE AS p_career,
    CASE WHEN title LIKE '1-URGENT' THEN 0.75 WHEN title = '2-HIGH' THEN 0.5 WHEN title = '3-MEDIUM' THEN 0.25 ELSE 0 END::DOUBLE AS p_tech,
    CASE WHEN contains(n_name, 'NATION_1') OR contains(n_name, 'NATION_7') THEN 1.0 ELSE 0.3 END::DOUBLE AS p_region,
    CASE st WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.4 ELSE 0.7 END::DOUBLE AS p_employment FROM p
), s AS (
  SELECT *, round((0.0::DOUBLE + p_role * 35.0::DOUBLE + p_career * 25.0::DOUBLE + p_tech * 20.0::DOUBLE + p_region * 10.0::DOUBLE + p_employment * 10.0::DOUBLE) / 100.0::DOUBLE * 100, 1) AS rule,
    contains(ckey, 'customer00000001') AS company_out, contains(lower(title), 'not specified') AS title_out FROM parts
), sc AS (SELECT *, NOT company_out AND NOT title_out AND rule >= 45 AND p_role <> 0 AS qualified FROM s)"""
_C = """c AS (
  SELECT 'c' || c_custkey AS id, lower(regexp_replace(c_name, '[^\\p{L}\\p{N}]+', '', 'g')) AS name_key, 'alias' || (c_custkey % 400) AS alias_key, c_custkey % 3 <> 0 AS enabled,
    ['S', 'A', 'B', 'C'][length(c_mktsegment) % 4 + 1] AS tier, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 10 END::INT AS priority,
    CASE WHEN c_custkey % 4 <> 0 THEN 'fam' || (c_custkey % 6) END AS family,
    CASE c_custkey % 7 WHEN 0 THEN 'generic_adapter_priority' WHEN 1 THEN 'adapter_candidate' WHEN 2 THEN 'restricted_research_needed' WHEN 3 THEN 'job_endpoint_research_needed' END AS status,
    CASE WHEN c_custkey % 2 = 0 THEN 'https://jobs.example.com/' || (c_custkey % 20) END AS url, c_custkey % 8 = 0 AS has_filter, c_custkey AS ck
  FROM customer WHERE c_custkey % 5 = 0)"""
_K = _C + ", k AS (SELECT DISTINCT name_key AS key, id, enabled, ck FROM c UNION SELECT alias_key, id, enabled, ck FROM c)"
_Q = _S + ", " + _K + """, hay AS (SELECT *, regexp_replace(lower(title || ' ' || seg || ' ' || r_name), '[\\s_/.,()·|-]+', '', 'g') AS hay FROM sc),
q AS (
  SELECT hay.*, k.id AS target_id, CASE WHEN k.id IS NULL THEN 'not_target' WHEN NOT (CASE
      WHEN ck % 3 = 1 OR ck % 4 = 0 THEN NOT (ck % 4 = 0 AND contains(hay, 'household')) AND (ck % 3 <> 1 OR contains(hay, 'urgent') OR contains(hay, 'high'))
      ELSE NOT contains(lower(title), 'medium') END) THEN 'role' END AS reason
  FROM hay LEFT JOIN k ON k.enabled AND hay.ckey = k.key)"""
_SEEN = _P + ", seen AS (SELECT id, CASE WHEN id % 13 <> 0 THEN created END AS first_seen, id % 3 = 0 AS notified, created FROM p WHERE created < '2001-07-02')"
_E = """req AS (
  SELECT l_orderkey AS id, CASE WHEN l_linenumber <= 3 THEN 'REQUIRED' WHEN l_linenumber <= 5 THEN 'PREFERRED' ELSE 'CONTEXT' END AS importance,
    CASE WHEN l_returnflag = 'A' THEN 'FULL' WHEN l_returnflag = 'R' THEN 'PARTIAL' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'NONE' ELSE 'UNKNOWN' END AS m, l_suppkey % 4 = 0 AS bare FROM lineitem
), ev AS (SELECT id, importance, CASE WHEN bare AND m IN ('FULL', 'PARTIAL') THEN 'UNKNOWN' ELSE m END AS m, bare AND m IN ('FULL', 'PARTIAL') AS demoted FROM req),
cr AS (SELECT *, CASE m WHEN 'FULL' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 WHEN 'NONE' THEN 0.0 END::DOUBLE AS credit FROM ev),
ax AS (
  SELECT id, avg(credit) FILTER (importance = 'REQUIRED') AS required, count(credit) FILTER (importance = 'REQUIRED') AS required_known, count(*) FILTER (importance = 'REQUIRED') AS required_total,
    avg(credit) FILTER (importance = 'PREFERRED') AS preferred, count(credit) FILTER (importance = 'PREFERRED') AS preferred_known, count(*) FILTER (importance = 'PREFERRED') AS preferred_total, count(*) AS n_rows
  FROM cr GROUP BY id)"""
_F = _S + ", " + _E + """, w AS (
  SELECT sc.*, ax.required, ax.preferred, required_known AS known, required_total AS total, (p_region + p_employment) / 2 AS pref FROM sc JOIN ax ON sc.id = ax.id
), f AS (
  SELECT *, round((coalesce(required * 0.55::DOUBLE, 0) + coalesce(preferred * 0.15::DOUBLE, 0) + p_tech * 0.1::DOUBLE + p_career * 0.1::DOUBLE + pref * 0.1::DOUBLE)
      / (CASE WHEN required IS NULL THEN 0 ELSE 0.55 END::DOUBLE + CASE WHEN preferred IS NULL THEN 0 ELSE 0.15 END::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE) * 100, 1) AS fit,
    CASE WHEN lo IS NOT NULL THEN greatest(0, lo - 4) END AS gap FROM w
), g AS (
  SELECT *, least(CASE WHEN fit >= 90 THEN 4 WHEN fit >= 80 THEN 3 WHEN fit >= 70 THEN 2 WHEN fit >= 60 THEN 1 ELSE 0 END,
    CASE WHEN total < 5 OR known = 0 OR known <= 0.5 * total THEN 2 ELSE 9 END, CASE WHEN gap >= 3 AND contains(title, 'URGENT') THEN 0 WHEN gap >= 2 THEN 2 ELSE 9 END, CASE WHEN id % 17 = 0 THEN 0 ELSE 9 END) AS lvl FROM f
), r AS (SELECT *, ['SKIP', 'ARCHIVE', 'REVIEW', 'APPLY', 'STRONG_APPLY'][lvl + 1] AS recommendation FROM g),
ma AS (
  SELECT *, custkey % 5 = 0 AS target, coalesce(fit, rule) AS score, id % 19 = 0 AS deferred,
    date_diff('day', DATE '2001-08-01', try_cast(deadline AS DATE)) AS days FROM r
), mm AS (SELECT *, NOT deferred AND recommendation IN ('STRONG_APPLY', 'APPLY') AS eligible FROM ma)"""
_D = _F + """, dash AS (
  SELECT id, company, score, score >= 60 AND recommendation <> 'SKIP' AS hot, coalesce(days BETWEEN 0 AND 3, false) AS urgent, coalesce(days < 0, false) AS expired,
    CASE WHEN deadline IS NULL THEN 100001 WHEN deadline = '상시' THEN 100000 ELSE days END::INT AS dsort, '-' AS verdict FROM mm WHERE created >= '2001-05-03')"""
_H = """fe AS (SELECT user_id AS source_id, ts, event_id, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN floor(value / 50)::BIGINT END AS jobs FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, event_id DESC) AS back FROM fe),
h AS (
  SELECT source_id, count(*) AS n_fetches, arg_max(jobs, (ts, event_id)) FILTER (ok) AS jobs_seen, max(ts) FILTER (ok) AS last_ok,
    coalesce(min(back) FILTER (ok) - 1, count(*)) AS consecutive_failures, arg_max(jobs, (ts, event_id)) FILTER (ok AND jobs > 0) AS nz FROM o GROUP BY source_id
), hs AS (SELECT source_id, n_fetches, jobs_seen, consecutive_failures, CASE WHEN jobs_seen = 0 THEN nz END AS last_nonzero, last_ok FROM h)"""
_EXACT = "concat_ws('|', ckey, lower(regexp_replace(title, '[^\\p{L}\\p{N}]+', '', 'g')), coalesce(lo::VARCHAR, 'None') || '~' || coalesce(hi::VARCHAR, 'None'), n_name)"
_LOOSE = "ckey || '|' || lower(regexp_replace(title, '[^\\p{L}\\p{N}]+', '', 'g'))"
#: Reposts: whole rows of first arrivals, the deadline filled.
_M = _P.replace("p AS (", "p0 AS (", 1) + f""", k0 AS (SELECT *, {_EXACT} AS key FROM p0), src AS (SELECT key, source, min(id) AS s FROM k0 GROUP BY key, source),
g0 AS (SELECT key, min(id) AS mid, count(*) AS n_merged, arg_min(deadline, id) FILTER (deadline IS NOT NULL) AS dl FROM k0 GROUP BY key),
p AS (SELECT a.* REPLACE (g0.dl AS deadline), n_merged, (SELECT string_agg(source, ',' ORDER BY s) FROM src WHERE src.key = g0.key) AS sources FROM g0 JOIN p0 a ON a.id = g0.mid)"""
#: A whole run: wq is what it scanned, wf what is fresh, wm its matches.
_W = _M + _Q[len(_P):] + ", " + _E + """, seen AS (SELECT id, CASE WHEN id % 13 <> 0 THEN created END AS first_seen, id % 3 = 0 AS notified, CASE WHEN id % 2 = 0 THEN created END AS created_at FROM p0 WHERE created < '2001-07-02'),
wt AS (SELECT *, target_id IS NOT NULL AND reason IS NULL AND NOT company_out AS target FROM q), wq AS (SELECT *, (qualified OR target) AND NOT company_out AS picked FROM wt),
wa AS (SELECT wq.*, s.first_seen, s.created_at AS cached FROM wq LEFT JOIN seen s ON wq.id = s.id WHERE picked AND NOT coalesce(s.notified, false)),
wb AS (SELECT id FROM wa WHERE cached IS NULL AND id % 5 <> 0 ORDER BY rule DESC, id LIMIT 300),
wd AS (SELECT *, CASE WHEN cached IS NOT NULL THEN cached WHEN id % 9 <> 0 THEN created ELSE coalesce(first_seen, '2001-08-01') END AS created_at FROM wa WHERE cached IS NOT NULL OR id IN (SELECT id FROM wb)),
wf AS (SELECT * FROM wd WHERE date_diff('day', created_at::DATE, DATE '2001-08-01') <= 400),
wj AS (SELECT *, row_number() OVER (ORDER BY rule DESC, id) <= 200 AS in_budget FROM wf),
wx AS (SELECT wj.*, ax.*  EXCLUDE (id), in_budget AND wj.id % 4 <> 0 AND ax.id IS NOT NULL AS answered, in_budget AND wj.id % 4 <> 0 AND ax.id IS NOT NULL AND wj.id % 17 IN (0, 2) AS barred, (p_region + p_employment) / 2 AS pref FROM wj LEFT JOIN ax ON wj.id = ax.id),
wy AS (SELECT *, CASE WHEN answered THEN round((coalesce(required * 0.55::DOUBLE, 0) + coalesce(preferred * 0.15::DOUBLE, 0) + p_tech * 0.1::DOUBLE + p_career * 0.1::DOUBLE + pref * 0.1::DOUBLE)
      / (CASE WHEN required IS NULL THEN 0 ELSE 0.55 END::DOUBLE + CASE WHEN preferred IS NULL THEN 0 ELSE 0.15 END::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE) * 100, 1) END AS fit, CASE WHEN lo IS NOT NULL THEN greatest(0, lo - 4) END AS gap FROM wx),
wm AS (SELECT *, coalesce(fit, rule) AS score, NOT in_budget OR NOT answered AS deferred, CASE WHEN fit IS NOT NULL THEN ['SKIP', 'ARCHIVE', 'REVIEW', 'APPLY', 'STRONG_APPLY'][least(CASE WHEN fit >= 90 THEN 4 WHEN fit >= 80 THEN 3 WHEN fit >= 70 THEN 2 WHEN fit >= 60 THEN 1 ELSE 0 END,
    CASE WHEN required_total < 5 OR required_known = 0 OR required_known <= 0.5 * required_total THEN 2 ELSE 9 END, CASE WHEN gap >= 2 THEN 2 ELSE 9 END, CASE WHEN barred THEN 0 ELSE 9 END) + 1] END AS recommendation FROM wy)"""
#: Landed pages, and the walks over them: a term's pages up to the first that ends it.
_L = """o AS (SELECT *, o_orderkey // 800 AS page FROM orders JOIN customer ON o_custkey = c_custkey),
pg AS (
  SELECT 'platform_a' AS source, o_orderpriority AS term, page, o_orderkey AS k, o_orderpriority AS title, c_name, c_mktsegment, o_orderdate FROM o WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'platform_a', '2-HIGH', page, o_orderkey, 'again', c_name, c_mktsegment, o_orderdate FROM o WHERE o_orderstatus = 'F' AND o_orderkey % 10 = 0
  UNION ALL SELECT 'platform_b', (o_orderkey % 3)::VARCHAR, page, o_orderkey, o_orderpriority, c_name, NULL, o_orderdate FROM o WHERE o_orderstatus = 'O'
), have AS (SELECT DISTINCT source, term, page FROM pg),
gap AS (SELECT source, term, min(page) AS miss FROM (SELECT source, term, page + 1 AS page FROM have UNION SELECT source, term, 0 FROM have) c WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.source = c.source AND h.term = c.term AND h.page = c.page) GROUP BY source, term),
walk AS (
  SELECT h.source, h.term, least(coalesce(min(h.page) FILTER ((h.term = '5-LOW' AND h.page = 1) OR (h.term = '4-NOT SPECIFIED' AND h.page = 1) OR (h.term = '2' AND h.page = 1)), min(miss) - 1), min(miss) - 1) AS stop, min(h.page) FILTER (h.term = '5-LOW' AND h.page = 1) AS failed_at
  FROM have h JOIN gap USING (source, term) GROUP BY h.source, h.term),
rd AS (SELECT pg.*, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], term) AS nterm FROM pg JOIN walk USING (source, term) WHERE page <= stop AND NOT (term = '5-LOW' AND page = 1) AND NOT (term = '2' AND page = 1)),
listed AS (
  SELECT k::VARCHAR AS id, 0 AS nth, source, arg_max(title, (nterm, page, title)) AS title, any_value(c_name) AS company, any_value(c_mktsegment) AS depths, false AS synthetic, (any_value(k) % 7)::INT AS career_min, NULL AS deadline FROM rd WHERE source = 'platform_a' GROUP BY k, source
  UNION ALL SELECT k::VARCHAR, 2, source, title, c_name, 'backend', true, NULL, strftime(o_orderdate, '%Y-%m-%d') FROM rd WHERE source = 'platform_b')"""
_CP = """c AS (
  SELECT 's' || s_suppkey AS id, s_suppkey AS k, s_suppkey % 17 AS kind, s_name, CASE WHEN s_suppkey % 11 = 0 THEN 'no careers_url' WHEN s_suppkey % 13 = 0 THEN 'robots rules forbid the address'
    ELSE CASE s_suppkey % 17 WHEN 1 THEN 'no page landed' WHEN 2 THEN 'HTTP 404' WHEN 3 THEN 'no embedded data' WHEN 4 THEN 'broken data' WHEN 5 THEN 'no openings query' WHEN 6 THEN 'openings aren''t a list' WHEN 8 THEN 'timed out' END END AS error
  FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0)"""

SQL = {
    "postings_union": f"WITH {_P} SELECT CASE source WHEN 'platform_a' THEN 0 WHEN 'platform_b' THEN 1 ELSE 2 END AS nth, id AS seq, source, id, title, company, deadline FROM p",
    "landed_postings": f"WITH {_L} SELECT id, nth, source, title, company, depths, synthetic, career_min, deadline FROM listed",
    "landed_sources": f"WITH {_L}, w AS (SELECT source, term, min(stop) + 1 AS n_pages, bool_or(failed_at <= stop) AS failed FROM walk GROUP BY source, term) SELECT CASE source WHEN 'platform_a' THEN 0 ELSE 2 END AS nth, source, (SELECT count(*) FROM listed l WHERE l.source = s.source) > 0 OR s.bad = 0 AS ok, CASE WHEN s.bad > 0 AND (SELECT count(*) FROM listed l WHERE l.source = s.source) = 0 THEN 'HTTP 503' END AS error, n_walks, n_pages, (SELECT count(*) FROM listed l WHERE l.source = s.source) AS jobs FROM (SELECT source, count(*)::INT + CASE source WHEN 'platform_a' THEN 1 ELSE 0 END AS n_walks, sum(n_pages)::BIGINT + CASE source WHEN 'platform_a' THEN 1 ELSE 0 END AS n_pages, count(*) FILTER (failed) + CASE source WHEN 'platform_a' THEN 1 ELSE 0 END AS bad FROM w GROUP BY source) s UNION ALL SELECT 1, 'nowhere', false, 'unknown source', 0, 0, 0",
    "career_results": f"WITH {_CP} SELECT 'greetinghr:' || id AS source_id, id AS company_id, 'greetinghr' AS family, error IS NULL AS ok, error, CASE WHEN kind NOT IN (1, 8) THEN CASE WHEN kind = 2 THEN 404 ELSE 200 END END::INT AS http_status, CASE WHEN kind <> 1 THEN 'https://c.example.com/' END AS final_url, CASE WHEN error IS NULL THEN CASE WHEN kind = 7 THEN 0 ELSE (SELECT count(*) FROM lineitem WHERE l_linenumber = 1 AND l_suppkey = k AND l_orderkey % 10 <> 0) END END AS jobs FROM c",
    "career_openings": f"WITH {_CP} SELECT 'greetinghr:' || id || ':' || l_orderkey AS id, l_returnflag AS title, s_name AS company, id AS canonical, '상시' AS deadline, 'https://c.example.com/' || k || '/ko/o/' || l_orderkey AS detail_url FROM c JOIN lineitem ON l_suppkey = k AND l_linenumber = 1 AND l_orderkey % 10 <> 0 WHERE error IS NULL AND kind <> 7",
    "reposts": f"WITH {_M} SELECT id, title, company, deadline, n_merged, sources FROM p",
    "run_matches": f"WITH {_W} SELECT id, target, score, recommendation, deferred, n_merged, CASE WHEN id % 5 <> 0 THEN 'platform' ELSE 'thin' END AS jd_source, created_at FROM wm",
    "run_note": f"WITH {_W}, x AS (SELECT id, CASE coalesce(recommendation, 'REVIEW') WHEN 'STRONG_APPLY' THEN 1 WHEN 'APPLY' THEN 2 WHEN 'REVIEW' THEN 3 WHEN 'ARCHIVE' THEN 4 ELSE 5 END::INT AS rank, target, score FROM wm WHERE NOT deferred AND (score >= 50 OR target)) SELECT row_number() OVER (ORDER BY target DESC, rank, score DESC, id)::INT AS place, id, rank FROM x QUALIFY place <= 100",
    "run_cards": f"WITH {_W} SELECT wm.id, rule, score, company, CASE recommendation WHEN 'STRONG_APPLY' THEN '강력추천' WHEN 'APPLY' THEN '추천' WHEN 'REVIEW' THEN '검토' WHEN 'ARCHIVE' THEN '보류' WHEN 'SKIP' THEN '제외' END AS verdict, deadline, coalesce(lo::VARCHAR, '?') || '~' || coalesce(hi::VARCHAR, '?') || '년' AS career, fit IS NOT NULL AS scored, recommendation, target, tier FROM wm LEFT JOIN c ON c.id = target_id WHERE NOT deferred AND (score >= 50 OR target)",
    "run_state": f"WITH {_W}, st AS (SELECT id, coalesce(s.first_seen, CASE WHEN l.id IS NOT NULL THEN '2001-08-01' END) AS first_seen, coalesce(f.created_at, s.created_at) AS created_at, coalesce(s.notified, false) OR coalesce(NOT w.deferred AND (w.score >= 50 OR w.target), false) AS notified FROM seen s FULL JOIN (SELECT id FROM wq WHERE NOT company_out) l USING (id) LEFT JOIN wf f USING (id) LEFT JOIN wm w USING (id)) SELECT * FROM st WHERE coalesce(first_seen, '9999') >= '2000-08-01'",
    "run_counters": f"WITH {_W} SELECT (SELECT count(*) FROM wq) AS scanned, (SELECT sum(n_merged) - count(*) FROM wq)::BIGINT AS merged, (SELECT count(*) FROM wq WHERE company_out) AS company_excluded, (SELECT count(*) FROM wq WHERE qualified) AS discovery_candidates, (SELECT count(*) FROM wq WHERE target) AS target_candidates, (SELECT count(*) FROM wq WHERE reason = 'role' AND NOT company_out) AS target_role_dropped, (SELECT count(*) FROM wq WHERE picked) AS rule_pass, (SELECT count(*) FROM wf) AS fresh, (SELECT count(*) FROM wf WHERE target) AS target_fresh, 0::BIGINT AS dates_unread, (SELECT count(*) FROM wm WHERE answered) AS scored, (SELECT count(*) FROM wm WHERE answered) AS structured, (SELECT count(*) FROM wm JOIN ev ON wm.id = ev.id WHERE answered AND ev.demoted) AS demoted, (SELECT count(*) FROM wm WHERE barred) AS blocked, 0::BIGINT AS enriched, (SELECT count(*) FROM wm WHERE deferred) AS deferred, (SELECT count(*) FROM wm WHERE in_budget AND NOT answered) AS failed",
    "run_samples": f"WITH {_W} SELECT * FROM (SELECT 'excluded' AS kind, id AS at, company || ' / ' || title AS name, NULL AS detail FROM wq WHERE company_out ORDER BY id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'role', id, company || ' / ' || title, NULL FROM wq WHERE reason = 'role' AND NOT company_out ORDER BY id LIMIT 8)",
    "company_normalize": "SELECT c_name || ' Co., Ltd.' AS raw, lower(replace(c_name, '#', '')) AS key FROM customer UNION ALL SELECT 'Inc. ' || s_name, lower(replace(s_name, '#', '')) FROM supplier",
    "title_keys": f"WITH {_P} SELECT id, {_LOOSE} AS loose, {_EXACT} AS exact FROM p",
    "dedup_survivors": f"WITH {_P}, x AS (SELECT * REPLACE ('c' || (custkey % 50) AS ckey) FROM p), e AS (SELECT *, {_EXACT} AS key FROM x), src AS (SELECT key, source, min(id) AS s FROM e GROUP BY key, source), j AS (SELECT key, string_agg(source, ',' ORDER BY s) AS sources FROM src GROUP BY key) SELECT min(id) AS id, any_value(sources) AS sources, count(*) AS merged, arg_min(deadline, id) FILTER (deadline IS NOT NULL) AS deadline, arg_min(created, id) AS created FROM e JOIN j USING (key) GROUP BY key",
    "ambiguous_keys": f"WITH {_P} SELECT {_LOOSE} AS loose, count(DISTINCT {_EXACT}) AS n_exact FROM p GROUP BY 1 HAVING n_exact > 1",
    "text_dedup": "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g'))",
    "exclusions": f"WITH {_S} SELECT id, company_out, title_out FROM s",
    "score_parts": f"WITH {_S} SELECT id, p_role, p_career, p_tech, p_region, p_employment FROM s",
    "rule_score": f"WITH {_S} SELECT id, rule, qualified FROM sc",
    "rule_topk": f"WITH {_S} SELECT id, company, title, rule FROM sc WHERE qualified ORDER BY rule DESC, id LIMIT 50",
    "resolve_target": f"WITH {_Q} SELECT id, target_id, target_id AS canonical_id FROM q",
    "alias_collisions": f"WITH {_K} SELECT key, count(DISTINCT id) AS n FROM k GROUP BY key HAVING n > 1",
    "near_misses": "WITH n AS (SELECT DISTINCT lower(replace(p_name, ' ', '')) AS raw FROM part), k AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS key FROM part) SELECT raw, key FROM n, k WHERE raw NOT IN (SELECT key FROM k) AND length(raw) >= 2 AND length(key) >= 2 AND abs(length(raw) - length(key)) >= 2 AND (starts_with(raw, key) OR ends_with(raw, key) OR starts_with(key, raw) OR ends_with(key, raw))",
    "qualify_reason": f"WITH {_Q} SELECT id, target_id, reason FROM q",
    "mode_union": f"WITH {_Q} SELECT count(*) FILTER (qualified) AS discovery, count(*) FILTER (reason IS NULL) AS target, count(*) AS both FROM q WHERE qualified OR reason IS NULL",
    "families": f"WITH {_C} SELECT coalesce(family, id) AS family, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM c WHERE enabled GROUP BY 1",
    "collectible_families": f"WITH {_C} SELECT coalesce(family, id) AS family, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM c WHERE enabled AND status IN ('generic_adapter_priority', 'adapter_candidate') GROUP BY 1",
    "portal_conflicts": f"WITH {_C} SELECT url AS careers_url, count(*) AS n, string_agg(id, ',' ORDER BY id) FILTER (NOT has_filter) AS lacking FROM c WHERE enabled AND url IS NOT NULL GROUP BY url HAVING n >= 2 AND lacking IS NOT NULL",
    "research_needed": f"WITH {_C} SELECT status, count(*) AS n FROM c WHERE enabled AND status IN ('restricted_research_needed', 'job_endpoint_research_needed') GROUP BY status",
    "tier_listing": f"WITH {_C} SELECT list_position(['S', 'A', 'B', 'C'], tier)::INT AS tier_rank, tier, coalesce(priority, 0)::INT AS priority, id FROM c WHERE enabled",
    "seen_upsert": f"WITH {_SEEN} SELECT id, coalesce(s.first_seen, '2001-08-01') AS first_seen, coalesce(s.notified, false) AS notified FROM p FULL JOIN seen s USING (id)",
    "seen_retention": f"WITH {_SEEN} SELECT id, first_seen FROM seen WHERE first_seen IS NULL OR first_seen >= '2000-08-01'",
    "not_notified": f"WITH {_SEEN} SELECT id, created FROM p WHERE id NOT IN (SELECT id FROM seen WHERE notified)",
    "created_cache": f"WITH {_SEEN} SELECT p.id, CASE WHEN s.id IS NOT NULL AND p.id % 2 = 0 THEN p.created WHEN p.id % 5 <> 0 AND p.id % 9 <> 0 THEN p.created ELSE coalesce(s.first_seen, '2001-08-01') END AS created_at FROM p LEFT JOIN seen s ON p.id = s.id",
    "fresh_window": f"WITH {_P} SELECT id, date_diff('day', created::DATE, DATE '2001-08-01')::INT AS age FROM p WHERE age <= 30",
    "assess_budget": f"WITH {_S} SELECT id, rule, row_number() OVER (ORDER BY rule DESC, id) <= 200 AS in_budget, row_number() OVER (ORDER BY rule DESC, id) > 200 AS deferred FROM sc WHERE qualified",
    "detail_budget": f"WITH {_S} SELECT id, rule FROM sc WHERE id % 5 <> 0 ORDER BY rule DESC, id LIMIT 100",
    "thin_bodies": "SELECT doc_id, length(text)::INT AS n FROM documents WHERE length(text) < 400 ORDER BY doc_id LIMIT 15",
    "deadline_states": f"WITH {_P}, x AS (SELECT id, deadline, try_cast(deadline AS DATE) AS due, date_diff('day', DATE '2001-08-01', try_cast(deadline AS DATE))::INT AS days FROM p) SELECT id, CASE WHEN deadline IS NULL THEN '미상' WHEN deadline = '상시' THEN '상시' WHEN days < 0 THEN '마감(' || strftime(due, '%m/%d') || ')' WHEN days = 0 THEN '오늘마감(' || strftime(due, '%m/%d') || ')' ELSE 'D-' || days || ' (' || strftime(due, '%m/%d') || ')' END AS label, days, CASE WHEN deadline IS NULL THEN 'unknown' WHEN deadline = '상시' THEN 'rolling' ELSE 'date' END AS state FROM x",
    "requirement_normalize": f"WITH {_E} SELECT importance, m AS match, CASE WHEN demoted THEN 'LOW' ELSE 'HIGH' END AS confidence, demoted, count(*) AS n FROM ev GROUP BY ALL",
    "match_axis": f"WITH {_E} SELECT * FROM ax",
    "fit_score": f"WITH {_F} SELECT id, fit, gap FROM f",
    "recommend": f"WITH {_F} SELECT id, recommendation FROM r",
    "note_rank": f"WITH {_F} SELECT id, target, (5 - lvl)::INT AS rank, score, row_number() OVER (ORDER BY target DESC, 5 - lvl, score DESC, id)::INT AS place FROM mm WHERE NOT deferred AND (score >= 50 OR target) QUALIFY place <= 100",
    "push_top8": f"WITH {_F} SELECT id, target, score, row_number() OVER (ORDER BY target DESC, score DESC, id)::INT AS place FROM mm WHERE NOT deferred AND (eligible OR (target AND recommendation <> 'SKIP')) QUALIFY place <= 8",
    "push_overflow": f"WITH {_F} SELECT count(*) AS told, count(*) FILTER (target) AS targets, greatest(0, count(*) - 8) AS more FROM mm WHERE NOT deferred AND (eligible OR (target AND recommendation <> 'SKIP'))",
    "final_order": f"WITH {_F} SELECT id, score, row_number() OVER (ORDER BY score DESC, rule DESC, id)::INT AS place FROM mm QUALIFY place <= 60",
    "recommend_why": f"WITH {_F} SELECT id, concat_ws('; ', CASE WHEN id % 17 = 0 THEN 'barred: no licence' END, CASE WHEN total = 0 THEN 'no required rows were read' WHEN total < 5 THEN 'only ' || total || ' required rows' WHEN known = 0 THEN 'none of ' || total || ' required rows is judged' WHEN known <= 0.5 * total THEN known || ' of ' || total || ' required rows are judged' END, CASE WHEN gap >= 3 AND contains(title, 'URGENT') THEN gap || ' years short of a senior role' WHEN gap >= 2 THEN gap || ' years short' END) AS why FROM g",
    "told_marking": f"WITH {_F}, seen AS (SELECT id, CASE WHEN id % 13 <> 0 THEN created END AS first_seen, id % 3 = 0 AS notified, created FROM p WHERE created < '2001-07-02') SELECT p.id, coalesce(s.first_seen, '2001-08-01') AS first_seen, CASE WHEN mm.id IS NOT NULL AND p.id % 4 = 0 THEN p.created WHEN s.id IS NOT NULL AND p.id % 2 = 0 THEN p.created END AS created_at, coalesce(s.notified, false) OR coalesce(NOT mm.deferred AND (mm.score >= 50 OR mm.target), false) AS notified FROM p LEFT JOIN seen s ON p.id = s.id LEFT JOIN mm ON p.id = mm.id",
    "seed_marking": f"WITH {_F} SELECT count(*) AS n, count(*) FILTER ((p.created < '2001-07-02' AND p.id % 3 = 0) OR (mm.id IS NOT NULL AND p.id % 4 = 0)) AS told FROM p LEFT JOIN mm ON p.id = mm.id",
    "dashboard_rank": f"WITH {_D} SELECT id, score, hot, urgent, expired, dsort, verdict FROM dash",
    "dashboard_order": f"WITH {_D}, x AS (SELECT 'score' AS by, id, row_number() OVER (ORDER BY score DESC, dsort, id)::INT AS place FROM dash UNION ALL SELECT 'due', id, row_number() OVER (ORDER BY dsort, score DESC, id)::INT FROM dash) SELECT * FROM x WHERE place <= 40",
    "dashboard_search": f"WITH {_D} SELECT id, company FROM dash WHERE contains(lower(company), '0000012')",
    "dashboard_kpis": f"WITH {_D} SELECT count(*) AS total, count(*) FILTER (hot) AS hot, count(*) FILTER (urgent) AS urgent FROM dash",
    "run_stats": f"WITH {_F} SELECT count(*) AS matches, count(*) FILTER (deferred) AS deferred, count(*) FILTER (eligible) AS eligible, count(*) FILTER (target) AS targets, count(*) FILTER (recommendation IS NULL) AS unjudged FROM mm",
    "health_rollup": f"WITH {_H} SELECT source_id, n_fetches, jobs_seen, consecutive_failures, last_nonzero FROM hs",
    "health_warnings": f"WITH {_H} SELECT source_id, CASE WHEN consecutive_failures >= 2 THEN 'failed' ELSE 'emptied' END AS warning FROM hs WHERE consecutive_failures >= 2 OR (jobs_seen = 0 AND last_nonzero IS NOT NULL)",
    "health_summary": f"WITH {_H} SELECT count(*) AS checked, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed, count(*) FILTER (ok AND jobs = 0) AS n_empty, sum(jobs)::BIGINT AS n_jobs, coalesce(string_agg(DISTINCT source_id::VARCHAR, ',' ORDER BY source_id::VARCHAR) FILTER (NOT ok), '') AS failed_ids, coalesce(string_agg(DISTINCT source_id::VARCHAR, ',' ORDER BY source_id::VARCHAR) FILTER (ok AND jobs = 0), '') AS empty_ids FROM fe",
    "health_order": f"WITH {_H} SELECT row_number() OVER (ORDER BY source_id)::INT AS place, source_id, CASE WHEN consecutive_failures >= 2 THEN 'failed' ELSE 'emptied' END AS warning FROM hs WHERE consecutive_failures >= 2 OR (jobs_seen = 0 AND last_nonzero IS NOT NULL) QUALIFY place <= 50",
    "health_stale": f"WITH {_H} SELECT source_id, date_diff('day', last_ok::DATE, DATE '2024-02-01')::INT AS days FROM hs",
    "page_extract": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^/en/') AS english_path FROM pages",
    "event_json": "SELECT event_type, sum((props::JSON->>'$.k')::BIGINT)::BIGINT AS k_sum, count(*) AS n FROM events GROUP BY event_type",
    "positions_fold": "SELECT l_orderkey, min(l_quantity) AS career_from, max(l_quantity) AS career_to, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS fields FROM lineitem GROUP BY l_orderkey",
    "last_value_upsert": "SELECT user_id, min(event_id) AS place, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "robots_guard": "WITH u AS (SELECT page_id, url, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL) SELECT page_id, nth::INT AS nth, CASE nth WHEN 0 THEN regexp_matches(path, '^(/(ko|en))?(/o/[^/]+/apply|/m/|/a/)') WHEN 4 THEN regexp_matches(CASE WHEN contains(url, '?') OR contains(url, '#') THEN path ELSE path || '/apply' END, '^(/(ko|en))?(/o/[^/]+/apply|/m/|/a/)') ELSE true END AS blocked FROM u, range(5) r(nth)",
    "role_names": "SELECT DISTINCT 'Back-end / ' || p_name AS raw, 'backend' || regexp_replace(lower(p_name), '[\\s_/.,()·|-]+', '', 'g') AS key FROM part",
    "company_legal": "SELECT ['주식회사', '( 주 )', '(有) ', '유한책임회사 '][c_custkey % 4 + 1] || c_name || CASE WHEN c_custkey % 3 = 0 THEN ' Pte. Ltd.' ELSE '' END AS raw, lower(replace(c_name, '#', '')) AS key FROM customer",
    "key_typos": f"WITH {_C} SELECT id, 'colour,teir' AS unknown FROM c WHERE ck % 9 = 0",
    "unclassified": f"WITH {_C} SELECT id FROM c WHERE enabled AND status IS NULL",
    "official_urls": f"WITH {_C} SELECT id, concat_ws(' ', url, CASE WHEN ck % 10 = 0 AND url IS DISTINCT FROM 'https://jobs.example.com/0' THEN 'https://jobs.example.com/0' END) AS urls, CASE WHEN ck % 10 = 0 THEN 'official platform' ELSE '' END AS types FROM c",
    "adapted_companies": f"WITH {_C} SELECT id, family FROM c WHERE enabled AND status IN ('generic_adapter_priority', 'adapter_candidate') AND family IN ('fam1', 'fam2')",
    "blocker_adoption": "WITH a AS (SELECT l_orderkey % 17 AS kind, count(*) AS n FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey) SELECT '기타' AS kind, CASE kind WHEN 0 THEN 'no licence' WHEN 1 THEN n || ' years of experience' WHEN 2 THEN 'Entry level only, not ' || n || ' years of experience' ELSE 'lives abroad' END AS detail, CASE kind WHEN 1 THEN 'only years lack' WHEN 3 THEN 'nothing backs it' ELSE 'adopted' END AS reject, count(*) AS n FROM a WHERE kind < 4 GROUP BY 2, 3",
    "evidence_narrow": "WITH e AS (SELECT user_id AS id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY user_id) AS held, event_type IN ('purchase', 'click') AND event_id % 2 = 1 AS demoted FROM events) SELECT id, count(*)::INT AS n_rows, any_value(held) > 12 AS truncated, count(*) FILTER (demoted)::INT AS demoted, 'req ' || min(event_id) AS first, count(*) FILTER (event_type = 'purchase' AND NOT demoted)::INT AS n_full, count(*) FILTER (event_id % 3 = 0)::INT AS n_required, 'a,b' AS blockers FROM e WHERE nth <= 12 GROUP BY id",
    "evidence_deferral": f"WITH {_S}, b AS (SELECT id, row_number() OVER (ORDER BY rule DESC, id) <= 200 AS in_budget FROM sc WHERE qualified) SELECT id, in_budget, in_budget AND id % 3 = 0 AS failed, NOT in_budget OR id % 3 = 0 AS deferred FROM b",
    "body_sources": f"WITH {_S}, b AS (SELECT *, id % 2 = 1 AS thin FROM sc WHERE qualified), t AS (SELECT id FROM b WHERE thin AND id % 5 <> 0 ORDER BY rule DESC, id LIMIT 30) SELECT b.id, CASE WHEN t.id IS NOT NULL AND b.id % 7 <> 0 THEN 'crawled' WHEN thin THEN 'thin' ELSE 'platform' END AS jd_source, CASE WHEN t.id IS NOT NULL AND b.id % 7 <> 0 THEN 6000 WHEN thin THEN 5 ELSE 300 END::INT AS n FROM b LEFT JOIN t ON b.id = t.id",
    "source_badges": f"WITH {_P} SELECT id, CASE source WHEN 'platform_a' THEN 'A' WHEN 'platform_b' THEN 'B A' ELSE 'official A' END AS badge FROM p",
    "platform_b_postings": "WITH o AS (SELECT (o_orderkey % 1000)::VARCHAR AS id, min(o_orderkey) AS seq, arg_max(o_orderpriority, o_orderkey) AS title, max(o_orderkey) AS last, arg_max(o_orderdate, o_orderkey) AS d FROM orders GROUP BY 1) SELECT id, seq, title, last % 9 = 0 AS unnamed, 'backend' AS depths, true AS synthetic, CASE WHEN last % 5 = 0 THEN '상시' ELSE strftime(d, '%Y-%m-%d') END AS deadline, 'https://b.example.com/position/' || id AS detail_url FROM o",
    "platform_b_details": "SELECT c_custkey::VARCHAR AS id, '[responsibility]' || chr(10) || c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || '[qualifications]' || chr(10) || c_mktsegment ELSE '' END || chr(10) || chr(10) || '[welfares]' || chr(10) || 'tea' || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || chr(10) || '[기술스택] Spark, SQL' ELSE '' END AS body FROM customer",
    "career_postings": "WITH o AS (SELECT o_orderkey AS k, ['서울특별시 강남구', '경기도 성남시', 'HQ', 'HQ'] AS r FROM orders), x AS (SELECT *, r[(k % 4 + 1)::INT] AS r0, r[((k + 1) % 4 + 1)::INT] AS r1, CASE WHEN k % 6 = 0 THEN '재택' END AS home FROM o) SELECT 'greetinghr:acme:' || k AS id, '?' AS title, concat_ws(',', r0, home, CASE WHEN r1 <> r0 THEN r1 END) AS regions, '정규직,인턴' AS kinds, (k % 5)::INT AS career_min, (k % 5 + 2)::INT AS career_max, CASE WHEN k % 3 = 0 THEN '2001-09-01' ELSE '상시' END AS deadline, 'https://acme.example.com/ko/o/' || k AS detail_url FROM x WHERE k % 8 <> 0",
    "rich_text_flatten": "SELECT conv_id, turn, regexp_replace(regexp_replace(role || ' ' || text || CASE WHEN turn % 2 = 0 THEN chr(10) || '[태그] a, b' ELSE '' END, '^\\s+', ''), '\\s+$', '') AS body FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL",
    "embedded_json_pick": "SELECT conv_id, turn, turn::BIGINT AS n FROM conversations",
}
