"""SQL for the queries that SQL can express, on the same tables."""

from __future__ import annotations

from millrace.llm import licenses, mixing, url_rules

BLANK = "[^\\x20\\x09-\\x0D]+"

# Shingle sets, their exact similarities, and the smallest id reachable by links.
NGRAM_JOIN = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '{BLANK}') w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) s FROM docs),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
common AS (
  SELECT a.doc_id a, b.doc_id b, count(*) c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a, min(b) component_id FROM reach GROUP BY 1),
deg AS (SELECT a, count(*) n_links FROM both_ways GROUP BY 1)
SELECT docs.doc_id, coalesce(n.n, 0) AS n_shingles, low.component_id, coalesce(deg.n_links, 0) AS n_links
FROM docs LEFT JOIN n ON n.doc_id = docs.doc_id LEFT JOIN low ON low.a = docs.doc_id LEFT JOIN deg ON deg.a = docs.doc_id
"""

# A source takes whole passes over its shuffled stream of words and a part of one more.
SOURCE_MIX = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{BLANK}')) AS size, md5(CAST(doc_id AS VARCHAR)) p
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) s FROM docs GROUP BY 1),
num AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 k FROM src),
wt AS (SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][k % {len(mixing.WEIGHTS)} + 1] w, {mixing.MOST_PASSES} * s AS top
       FROM num),
ord AS (SELECT *, sum(s) OVER () * {mixing.SHARE_PERCENT / 100} - coalesce(sum(top) OVER (ORDER BY top / w, k
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) l,
        sum(w) OVER (ORDER BY top / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) o FROM wt),
lev AS (SELECT *, CAST(w * l AS DOUBLE) / o >= top AS full_ FROM ord),
best AS (SELECT arg_max(l, l) l, arg_max(o, l) o FROM lev WHERE NOT full_),
goal AS (SELECT source, s, CASE WHEN full_ OR best.l IS NULL THEN CAST(top AS DOUBLE)
           ELSE CAST(w AS DOUBLE) * best.l / best.o END target FROM lev CROSS JOIN best),
pos AS (SELECT d.*, g.s, g.target, CAST(round(g.target) AS BIGINT) t, coalesce(sum(size) OVER (PARTITION BY d.source
          ORDER BY p, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) f
        FROM docs d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, s AS source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE CAST(t // s * size + greatest(0, least(size, t % s - f)) AS BIGINT) END AS taken
FROM pos
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle(), "op4_ngram_join": NGRAM_JOIN, "op5_source_mix": SOURCE_MIX,
            "op12_url_filter": url_rules.oracle()}
