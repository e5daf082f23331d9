"""Longest-processing-time scheduling as SQL: a recursion that places one group a step.

Groups of one size are alike; those of a size that a shard gets are the next ones
by key, shards in rising order.
"""

from orrery.llm.sharding import SHARDS

SQL = f"""
WITH RECURSIVE g AS (
  SELECT md5(text) AS group_key, sum(greatest(coalesce(length(text), 0), 0))::BIGINT AS total FROM documents GROUP BY 1
), h AS (
  SELECT total, row_number() OVER (ORDER BY total DESC) AS k FROM g
), s AS (
  SELECT 0::BIGINT AS k, list_transform(range({SHARDS}), lambda i: 0::BIGINT) AS load, 0 AS shard
  UNION ALL
  SELECT k, list_transform(load, lambda x, i: x + CASE WHEN i = p THEN total ELSE 0 END), p - 1
  FROM (SELECT h.k, h.total, s.load, list_position(s.load, list_min(s.load)) AS p FROM s JOIN h ON h.k = s.k + 1)
), n AS (
  SELECT total, shard, count(*) AS n FROM s JOIN h USING (k) GROUP BY ALL
), u AS (
  SELECT *, sum(n) OVER (PARTITION BY total ORDER BY shard) AS upto FROM n
), r AS (
  SELECT group_key, total, row_number() OVER (PARTITION BY total ORDER BY group_key NULLS FIRST) AS place FROM g
)
SELECT doc_id, md5(text) AS group_key, shard::INT AS shard
FROM documents d JOIN r ON r.group_key IS NOT DISTINCT FROM md5(d.text) JOIN u ON u.total = r.total AND place > upto - n AND place <= upto
"""
