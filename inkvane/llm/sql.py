"""DuckDB twins of those queries of the nine problems that SQL can express over whole tables."""

from __future__ import annotations

PLAIN = r"nullif(lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"

P5_FOUND = f"""
WITH r AS (
  SELECT id, max({PLAIN.format('label')}) AS label, max({PLAIN.format('generation.model_family')}) AS model_family, max({PLAIN.format('source')}) AS source
  FROM records WHERE id IS NOT NULL GROUP BY id),
s AS (SELECT count(*) // 5 AS size FROM r),
n AS (
  SELECT 'label' AS axis, label AS category, count(*) AS n FROM r GROUP BY label
  UNION ALL SELECT 'model_family', model_family, count(*) FROM r GROUP BY model_family
  UNION ALL SELECT 'source', source, count(*) FROM r GROUP BY source)
SELECT t.axis, t.category FROM sample_targets t CROSS JOIN s LEFT JOIN n ON n.axis = t.axis AND n.category = t.category
WHERE coalesce(n.n, 0) < greatest(t.min_count, (t.share_bp * s.size + 9999) // 10000)
"""

_SPLIT = f"""CASE WHEN {PLAIN.format('split')} IN ('train', 'training', 'trn') THEN 'train'
  WHEN {PLAIN.format('split')} IN ('val', 'valid', 'validation', 'dev', 'development') THEN 'val'
  WHEN {PLAIN.format('split')} IN ('test', 'testing', 'tst', 'eval', 'evaluation') THEN 'test' END"""

P2_FOUND = f"""
WITH RECURSIVE r AS (
  SELECT id, max(regexp_replace({PLAIN.format('group_id')}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '-', 'g')) AS g, max(transform.parent_id) AS p, max({_SPLIT}) AS split
  FROM records WHERE id IS NOT NULL GROUP BY id),
e AS (
  SELECT id, 'g' || g AS k FROM r WHERE g IS NOT NULL
  UNION SELECT id, 'p' || p FROM r WHERE p IS NOT NULL
  UNION SELECT id, 'p' || id FROM r),
l AS (SELECT DISTINCT a.id AS x, b.id AS y FROM e a JOIN e b ON a.k = b.k),
w(x, y) AS (SELECT x, y FROM l UNION SELECT w.x, l.y FROM w JOIN l ON w.y = l.x),
u AS (SELECT x AS id, min(y) AS unit_id FROM w GROUP BY x),
s AS (SELECT unit_id FROM u JOIN r ON r.id = u.id GROUP BY unit_id HAVING count(DISTINCT split) > 1)
SELECT id AS record_id, unit_id FROM u WHERE unit_id IN (SELECT unit_id FROM s)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p5_found": P5_FOUND}
