"""Ranks and order statistics by counts of ranges, so that nothing is sorted in one place.

Values are cut into ``RANGES`` ranges between the least and the largest; a range's
count says how many rows come before the next, and rows are ordered only within
their range.  The table of ranges has a fixed size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 1 << 14


def _ranged(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``_b``, the range of its value."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    if ends.lo is None or ends.hi <= ends.lo:
        return df.withColumn("_b", F.lit(0))
    part = (F.col(column).cast("double") - F.lit(ends.lo)) * F.lit((RANGES - 1) / (ends.hi - ends.lo))
    return df.withColumn("_b", F.floor(part).cast("int"))


def placed(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """``df`` with ``place``, from 0 in rising order of ``column`` within the groups of ``by``, and ``n``, their size.

    Rows without a value in ``column`` have no place.  A group is spread over the ranges.
    """
    rows = _ranged(df.filter(F.col(column).isNotNull()), column)
    group = W.partitionBy(*by)
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    counts = counts.select(*by, "_b", F.sum("_c").over(group).alias("n"), (F.sum("_c").over(group.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_before"))
    inside = rows.withColumn("_k", F.row_number().over(W.partitionBy(*by, "_b").orderBy(column)) - 1)
    return inside.join(counts, [*by, "_b"]).withColumn("place", F.col("_before") + F.col("_k")).drop("_b", "_k", "_before")


def at_places(df: DataFrame, column: str, places: list[int]) -> dict[int, object]:
    """The values at the given places, from 0 in rising order."""
    rows = _ranged(df.filter(F.col(column).isNotNull()).select(column), column)
    before, where = 0, {}
    for b, c in sorted(rows.groupBy("_b").count().collect()):  # at most RANGES rows
        for p in places:
            if before <= p < before + c:
                where.setdefault(b, []).append((p, p - before))
        before += c
    if not where:
        return {}
    k = F.row_number().over(W.partitionBy("_b").orderBy(column)) - 1
    wanted = [f"{b}:{q}" for b, ps in where.items() for _, q in ps]
    found = rows.filter(F.col("_b").isin(list(where))).withColumn("_k", k).filter(F.concat_ws(":", "_b", "_k").isin(wanted)).collect()
    value = {(r["_b"], r["_k"]): r[column] for r in found}
    return {p: value[b, q] for b, ps in where.items() for p, q in ps}
