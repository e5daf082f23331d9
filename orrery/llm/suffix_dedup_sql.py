"""The repeats of 50 words or more as SQL: every window of every text is compared."""

from orrery.llm.suffix_dedup import LENGTH

SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), q AS (
  SELECT doc_id, w, unnest(range(0, len(w) - {LENGTH} + 1)) AS lo FROM w WHERE len(w) >= {LENGTH}
), h AS (
  SELECT doc_id, lo, md5(array_to_string(w[lo + 1:lo + {LENGTH}], ' ')) AS h FROM q
), c AS (
  SELECT doc_id, lo, count(*) OVER (PARTITION BY h) AS c, row_number() OVER (PARTITION BY h ORDER BY doc_id, lo) AS k FROM h
), r AS (
  SELECT doc_id, lo, k FROM c WHERE c > 1
), i AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY lo) AS run FROM (
    SELECT *, CASE WHEN lo - lag(lo) OVER (PARTITION BY doc_id ORDER BY lo) <= {LENGTH} THEN 0 ELSE 1 END AS n FROM r)
), s AS (
  SELECT doc_id, run, min(lo) AS word_start, max(lo) + {LENGTH} AS word_end FROM i GROUP BY 1, 2
), g AS (
  SELECT doc_id, lo, least({LENGTH}, coalesce(lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) - lo, {LENGTH})) AS n FROM r WHERE k > 1
)
SELECT s.doc_id, s.word_start::INT AS word_start, s.word_end::INT AS word_end, coalesce(sum(g.n), 0)::BIGINT AS later_words
FROM s LEFT JOIN g ON g.doc_id = s.doc_id AND g.lo >= s.word_start AND g.lo < s.word_end
GROUP BY ALL
"""
