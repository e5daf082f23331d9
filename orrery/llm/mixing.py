"""Mixing sources to target weights by Pareto order sampling.

Each source gets a whole number of the ``total`` documents by its target weight
(largest remainders).  Within a source, a document's expected number of copies is
its share of the source's size measure times that number: the whole part of it is
given for certain, and the rest is its inclusion odds in a sample of fixed size.
The sample takes the documents that come first when ranked by

    (u / (1 - u)) / (p / (1 - p))

with ``u`` a uniform number from a keyed hash of the id and ``p`` the rest.

The cut of each source is found without sorting it: counts in 65,536 ranges of the
rank find the range that holds the last place, and only its ranks are ordered, each
with its number of rows.

Nulls, empties and ties: a null source is a source of its own, ``null_source``;
null, zero or negative sizes count as 1.  A null id ranks as the empty string; ``u``
comes from id and size.  Equal ranks are ordered by id, rows with equal id and size
by a hash of the whole row; of rows that agree in that too, so many are drawn as
there are places left, so the size of a sample is exact whatever repeats.  A source
with a target but no rows gives nothing; a source without a target weight gets none.
An empty table gives an empty result.  Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.common import sized

SEED = "mix-1"
RANGES = 1 << 16
NULL_SOURCE = "null_source"


def _source(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(NULL_SOURCE))


def _size(col: str) -> Column:
    return F.greatest(F.coalesce(F.col(col), F.lit(1)).cast("long"), F.lit(1))


def uniform(id_col: str, size_col: str, seed: str = SEED) -> Column:
    """In (0, 1), from the first 52 bits of the MD5 of seed, id and size."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), _size(size_col).cast("string"))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def allot(docs: DataFrame, weights: dict[str, float] | None, total: int | None, source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """``_s, _x, _n``: each source, the sum of its sizes and its number of documents.

    Without ``weights`` all sources weigh the same; without ``total`` as many
    documents are drawn as there are.
    """
    per = docs.select(_source(source_col).alias("_s"), _size(size_col).alias("x")).groupBy("_s").agg(F.sum("x").alias("_x"), F.count("*").alias("c"))
    if weights is None:
        per = per.withColumn("w", F.lit(1.0))
    else:
        pairs = [F.lit(v) for kv in weights.items() for v in (kv[0], float(kv[1]))]
        per = per.withColumn("w", F.coalesce(F.create_map(*pairs)[F.col("_s")] if pairs else F.lit(0.0), F.lit(0.0)))
    every = W.partitionBy()  # one row a source
    count = F.sum("c").over(every) if total is None else F.lit(total)
    per = per.withColumn("want", count * F.col("w") / F.sum("w").over(every)).filter("w > 0")
    per = per.withColumn("base", F.floor("want"))
    left = F.round(F.sum("want").over(every)) - F.sum("base").over(every)
    order = F.row_number().over(W.orderBy(F.round(F.col("base") - F.col("want"), 9), "_s"))
    return per.withColumn("k", order).withColumn("_n", (F.col("base") + F.when(F.col("k") <= left, 1).otherwise(0)).cast("long")).select("_s", "_x", "_n")


def pareto_sample(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars", seed: str = SEED) -> DataFrame:
    """``_row, _copies``: each row of ``docs`` with its copies, only rows with at least one."""
    spark = docs.sparkSession
    per = sized(spark, allot(docs, weights, total, source_col, size_col), "allotted")

    def ranked(rows: DataFrame, extra: list[str]) -> DataFrame:
        rows = rows.select(*extra, _source(source_col).alias("_s"), _size(size_col).alias("_size"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), uniform(id_col, size_col, seed).alias("_u")).join(per, "_s")
        share = F.col("_n").cast("double") * F.col("_size").cast("double") / F.col("_x").cast("double")
        rows = rows.withColumn("_e", share).withColumn("_whole", F.floor("_e").cast("long")).withColumn("_p", F.col("_e") - F.col("_whole"))
        odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
        return rows.withColumn("_q", F.when(F.col("_p") > 0, odds))

    key = F.floor(F.col("_q") / (1 + F.col("_q")) * RANGES).cast("int")
    part = ranked(docs.select(id_col, source_col, size_col), [])
    # Whole copies and ranges are counted together, in one pass and one shuffle.
    counts = part.groupBy("_s", key.alias("_b")).agg(F.count("_q").alias("c"), F.sum("_whole").alias("g"), F.first("_n").alias("_n"))
    source = W.partitionBy("_s")
    run = source.orderBy(F.col("_b").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("m", F.col("_n") - F.sum("g").over(source)).withColumn("upto", F.sum("c").over(run))
    last = counts.filter("_b is not null and m > 0 and upto >= m and upto - c < m").select("_s", "_b", (F.col("m") - F.col("upto") + F.col("c")).alias("place"))
    whole = counts.filter("_b is not null").groupBy("_s").agg(F.first("m").alias("m"), F.max("upto").alias("all"))
    inside = part.filter("_q is not null").withColumn("_b", key).join(last, ["_s", "_b"]).groupBy("_s", "_q", "_id").agg(F.count("*").alias("c"), F.first("place").alias("place"))
    inside = inside.withColumn("upto", F.sum("c").over(source.orderBy("_q", "_id").rowsBetween(W.unboundedPreceding, 0)))
    left = F.col("place") - F.col("upto") + F.col("c")
    ends = inside.filter("upto >= place and upto - c < place").select("_s", F.col("_q").alias("_qc"), F.col("_id").alias("_idc"), left.alias("_left"), (left < F.col("c")).alias("_split"))
    rule = sized(spark, whole.join(ends, "_s", "left").select("_s", "_qc", "_idc", "_left", F.coalesce("_split", F.lit(False)).alias("_split"), (F.col("m") >= F.col("all")).alias("_every")), "cuts")
    chosen = ranked(docs, [F.struct(*[docs[c] for c in docs.columns]).alias("_row")]).join(rule, "_s", "left")
    at_cut = F.coalesce((F.col("_q") == F.col("_qc")) & (F.col("_id") == F.col("_idc")), F.lit(False))
    drawn = F.when(F.col("_q").isNull(), 0).when(F.col("_every"), 1).when((F.col("_q") < F.col("_qc")) | at_cut | ((F.col("_q") == F.col("_qc")) & (F.col("_id") < F.col("_idc"))), 1).otherwise(0)
    out = chosen.withColumn("_copies", F.col("_whole") + drawn)
    if rule.filter("_split").take(1):
        # The last places of a source go to some of the rows that agree in id and size.
        split = at_cut & F.coalesce("_split", F.lit(False)) & ~F.coalesce("_every", F.lit(False))
        tied = chosen.filter(split).withColumn("_h", F.xxhash64("_row")).groupBy("_s", "_h").agg(F.count("*").alias("_c"), F.first("_row").alias("_row"), F.first("_whole").alias("_whole"), F.first("_left").alias("_left"))
        before = F.sum("_c").over(source.orderBy("_h").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")
        tied = tied.withColumn("_take", F.col("_left") - before).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))))
        tied = tied.withColumn("_copies", F.col("_whole") + F.when(F.col("_i") <= F.col("_take"), 1).otherwise(0))
        out = out.filter(~split).select("_row", "_copies").union(tied.select("_row", "_copies"))
    return out.filter("_copies > 0").select("_row", "_copies")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` in the mixed numbers: each row as often as it has copies."""
    out = pareto_sample(docs, **how)
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


def plan(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, source, copies`` of the documents in the mix."""
    out = pareto_sample(docs.select("doc_id", "source", "n_chars"), **how)
    return out.select("_row.doc_id", F.coalesce("_row.source", F.lit(NULL_SOURCE)).alias("source"), F.col("_copies").alias("copies"))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '{NULL_SOURCE}') AS source, greatest(coalesce(n_chars, 1), 1) AS x,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || greatest(coalesce(n_chars, 1), 1)), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r} AS u
  FROM documents
), a AS (
  SELECT source, sum(x)::BIGINT AS sx, count(*) AS c FROM d GROUP BY 1
), b AS (
  SELECT *, sum(c) OVER () * 1.0::DOUBLE / sum(1.0::DOUBLE) OVER () AS want FROM a
), n AS (
  SELECT source, sx, floor(want) + CASE WHEN row_number() OVER (ORDER BY round(floor(want) - want, 9), source) <= round(sum(want) OVER ()) - sum(floor(want)) OVER () THEN 1 ELSE 0 END AS n FROM b
), e AS (
  SELECT doc_id, d.source, u, n, n::DOUBLE * x::DOUBLE / sx::DOUBLE AS e FROM d JOIN n USING (source)
), p AS (
  SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p FROM e
), r AS (
  SELECT *, n - sum(whole) OVER (PARTITION BY source) AS m, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p
), k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY q NULLS LAST, coalesce(doc_id::VARCHAR, '')) AS k FROM r
)
SELECT doc_id, source, (whole + CASE WHEN q IS NOT NULL AND k <= m THEN 1 ELSE 0 END)::BIGINT AS copies
FROM k WHERE whole + CASE WHEN q IS NOT NULL AND k <= m THEN 1 ELSE 0 END > 0
"""
