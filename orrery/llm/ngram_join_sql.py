"""The n-gram Jaccard join as one SQL statement over all pairs of documents."""

from orrery.llm.ngram_join import THRESHOLD

SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), g AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '') ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS gram FROM w
), s AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS MATERIALIZED (
  SELECT x, y FROM o JOIN s p ON p.doc_id = x JOIN s q ON q.doc_id = y WHERE shared / (p.n + q.n - shared) >= {THRESHOLD}
), r AS (
  SELECT DISTINCT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
), c AS (
  SELECT x, min(y) AS class_id FROM r GROUP BY 1
), l AS (
  SELECT x, count(*) AS n_links FROM e GROUP BY 1
)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN c ON c.x = d.doc_id LEFT JOIN l ON l.x = d.doc_id
"""
