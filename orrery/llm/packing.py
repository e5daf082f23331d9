"""Packing by optimal length buckets.

The lengths of all documents, in words, make one histogram; dynamic programming
over it chooses the ``buckets`` upper bounds that need the least padding in all,
each document being padded to its bucket's bound.  Inside a bucket, documents in
the order of a keyed hash fill batches of as many as fit the token budget at that
bound; a document longer than the budget is a batch of its own.

The histogram has one row a length, so it is bounded by the longest document and
not by the number of documents.  Places inside a bucket come from counts of 4,096
hash ranges and an order within each, so no task sees a whole bucket.

Nulls, empties and ties: a null or empty text has length 0 and is packed like any
other, in the first bucket (a bound of 0 counts as 1 for the batch size).  A null
id hashes as the empty string.  Ties of the hash are ordered by length, then by
content, so that rows which repeat another are interchangeable.  Fewer distinct
lengths than buckets make as many buckets as lengths; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm import textops
from orrery.llm.common import cut, small_batches

BUCKETS, BUDGET = 8, 16384


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 13, 32]] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text: maximal runs of anything but space, tab and line ends."""
    raw, bounds = textops.buffers(column)
    out = np.zeros(len(bounds) - 1, dtype=np.int64)
    for i, j in textops.slices(bounds):
        for lo in range(int(bounds[i]), int(bounds[j]), textops.SLICE_BYTES):
            hi = min(lo + textops.SLICE_BYTES, int(bounds[j]))
            inside = ~_SPACE[raw[lo:hi]]
            begin = inside.copy()
            begin[1:] &= ~inside[:-1]
            if lo > bounds[i]:  # a long text goes on
                begin[0] &= bool(_SPACE[raw[lo - 1]])
            at = np.clip(bounds[i : j + 1], lo, hi) - lo
            edge = at[:-1][at[:-1] < at[1:]]
            if lo == bounds[i]:
                begin[edge] = inside[edge]
            total = np.concatenate([[0], np.cumsum(begin)])
            out[i:j] += total[at[1:]] - total[at[:-1]]
    return out


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens``, one row a document; a null text has no words."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(word_counts(batch.column(1)).astype(np.int32))], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens int")


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper bounds of the buckets with the least padding; ties: the lower bound.

    Divide and conquer: the best cut before a length never moves down as the
    length grows, so a layer takes about ``m log m`` steps.
    """
    m = len(lengths)
    if m == 0:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(counts)])
    best = [lengths * total[1:]]
    cuts = []
    for layer in range(1, min(buckets, m)):
        prev, now, cut = best[-1], np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
        todo = [(layer, m - 1, layer, m - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(max(a, layer), min(b, j) + 1)
            cost = prev[i - 1] + lengths[j] * (total[j + 1] - total[i])
            k = int(np.argmin(cost))
            now[j], cut[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best.append(now)
        cuts.append(cut)
    out, j = [], m - 1
    for cut in reversed(cuts):
        out.append(lengths[j])
        j = int(cut[j]) - 1
    out.append(lengths[j])
    return np.array(out[::-1])


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, bucket, bucket_length, batch``, one row a document.

    ``batch`` counts from 0 within the bucket.
    """
    if buckets < 1 or budget < 1:
        raise ValueError("buckets and budget must be at least 1")
    # The texts are read once; all that follows reads the table of their lengths.
    rows = cut(docs.sparkSession, lengths(docs, id_col, text_col), "lengths").withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    hist = rows.groupBy("n_tokens").count().orderBy("n_tokens").toPandas()
    upper = bounds(hist["n_tokens"].to_numpy(np.int64), hist["count"].to_numpy(np.int64), buckets)
    edges = F.array(*[F.lit(int(x)) for x in upper]) if len(upper) else F.array(F.lit(0))
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("n_tokens")))).withColumn("bucket_length", F.element_at(edges, F.col("bucket") + 1)).withColumn("_slot", F.substring("_h", 1, 3))
    before = rows.groupBy("bucket", "_slot").agg(F.count("*").alias("c"))
    before = before.withColumn("_before", F.sum("c").over(W.partitionBy("bucket").orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).drop("c")
    place = F.row_number().over(W.partitionBy("bucket", "_slot").orderBy("_h", "n_tokens"))
    rows = rows.withColumn("_place", place).join(before, ["bucket", "_slot"])
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))))
    batch = F.floor((F.col("_before") + F.col("_place") - 1) / room)
    return rows.select("doc_id", "n_tokens", "bucket", "bucket_length", batch.cast("long").alias("batch"))


def _sql() -> str:
    """The same programme as SQL, a table for each number of buckets."""
    steps = ["t1 AS (SELECT j, l * c AS cost, [l] AS path FROM h)"]
    for b in range(2, BUCKETS + 1):
        steps.append(
            f"t{b} AS (SELECT h.j, min_by(t.cost + h.l * (h.c - p.c), t.j) FILTER (true) AS ignored, min(t.cost + h.l * (h.c - p.c)) AS cost, list_append(arg_min(t.path, (t.cost + h.l * (h.c - p.c), t.j)), any_value(h.l)) AS path"
            f" FROM h JOIN t{b - 1} t ON t.j < h.j JOIN h p ON p.j = t.j GROUP BY h.j)"
        )
    best = " UNION ALL ".join(f"SELECT {b} AS b, path FROM t{b} WHERE j = (SELECT max(j) FROM h)" for b in range(1, BUCKETS + 1))
    return f"""
WITH d AS (
  SELECT doc_id, len(list_filter(string_split_regex(translate(coalesce(text, ''), chr(9) || chr(10) || chr(13), '   '), ' +'), lambda x: x <> ''))::INT AS n_tokens,
         md5(coalesce(doc_id::VARCHAR, '')) AS hash FROM documents
), h AS (
  SELECT n_tokens::BIGINT AS l, row_number() OVER (ORDER BY n_tokens) AS j, (sum(count(*)) OVER (ORDER BY n_tokens))::BIGINT AS c FROM d GROUP BY n_tokens
), {", ".join(steps)}, best AS (SELECT path FROM ({best}) ORDER BY b DESC LIMIT 1),
e AS (SELECT d.*, len(list_filter(path, lambda x: x < n_tokens))::INT AS bucket, path FROM d, best),
k AS (SELECT *, path[bucket + 1]::INT AS bucket_length, row_number() OVER (PARTITION BY bucket ORDER BY hash, n_tokens) - 1 AS k FROM e)
SELECT doc_id, n_tokens, bucket, bucket_length, (k // greatest(1, {BUDGET} // greatest(bucket_length, 1)))::BIGINT AS batch FROM k
"""


SQL = _sql()
