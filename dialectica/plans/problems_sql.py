"""SQL of the general problems, for an engine that reads the same Parquet tables as views."""

_BASKETS = r"""
items AS (
  SELECT idx, unnest(target_item.categories) AS c FROM sample_input
  UNION ALL SELECT idx, unnest(h.categories) AS c FROM (SELECT idx, unnest(history) AS h FROM sample_input)
), cleaned AS (
  SELECT DISTINCT idx, lower(trim(regexp_replace(c, '\s+', ' ', 'g'))) AS c FROM items WHERE c IS NOT NULL
), held AS (SELECT * FROM cleaned WHERE c <> ''),
total AS (SELECT count(DISTINCT idx) AS n FROM held),
single AS (SELECT c, count(*) AS k FROM held GROUP BY c),
pairs AS (
  SELECT x.c AS cat_a, y.c AS cat_b, count(*) AS m FROM held x JOIN held y ON x.idx = y.idx AND x.c < y.c GROUP BY 1, 2
)
"""

ORACLE = {
    "p3_found": f"""
WITH {_BASKETS}
SELECT cat_a, cat_b FROM pairs JOIN single a ON a.c = cat_a JOIN single b ON b.c = cat_b, total
WHERE m >= 5 AND 10 * m * n >= 15 * a.k * b.k
""",
    "p3_pairs": f"""
WITH {_BASKETS}
SELECT cat_a, cat_b, a.k AS n_a, b.k AS n_b, m AS n_ab, n,
  m::DOUBLE * n / (a.k::DOUBLE * b.k) AS lift,
  CASE WHEN a.k > m THEN a.k::DOUBLE * (n - b.k) / n / (a.k - m) END AS conviction_ab,
  CASE WHEN b.k > m THEN b.k::DOUBLE * (n - a.k) / n / (b.k - m) END AS conviction_ba
FROM pairs JOIN single a ON a.c = cat_a JOIN single b ON b.c = cat_b, total
""",
}
