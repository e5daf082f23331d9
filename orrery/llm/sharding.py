"""Sharding by longest-processing-time scheduling.

Rows that must stay together form a group; groups in falling order of size go to
the shard with the least load (of equals: the lowest number), through a heap.

The driver never sees the groups, only how many there are of each size.  Groups of
one size are alike, so a run of ``c`` of them is placed at once: few go through the
heap one by one, many fill the shards to a common level that a search finds, with
the heap for the last ones.  The loads are those of placing them one by one.  The
groups of a size then take the run's places in the order of their keys, ranked
within ranges (the first two characters) so that no task sees a whole size: keys
should be hashes, as hexadecimal digits.

Nulls, empties and ties: a null key is a group of its own, of all rows with it; a
null or negative size counts as 0, and groups of size 0 are spread by heap order
like any other.  Rows that repeat are counted each.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.common import cut, sized

SHARDS = 64
#: Rows of a group beyond which they are told their shard by broadcast.
HOT = 50_000


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``size's place, shard, groups`` of all shards that get groups of a size (sizes fall); the loads."""
    load, out = [0] * shards, []
    for k, (s, c) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        if s == 0:
            # Loads stay as they are: all of them go to the least loaded shard.
            out.append((k, load.index(min(load)), c))
            continue
        got: dict[int, int] = {}
        if c > 4 * shards:
            # The highest level to which fewer than c places begin below it.
            lo, hi = min(load), max(load) + s * c
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if sum((mid - x + s - 1) // s for x in load if x < mid) <= c:
                    lo = mid
                else:
                    hi = mid
            for i, x in enumerate(load):
                if x < lo:
                    n = (lo - x + s - 1) // s
                    got[i] = n
                    load[i] += n * s
                    c -= n
        heap = [(x, i) for i, x in enumerate(load)]
        heapq.heapify(heap)
        for _ in range(c):
            x, i = heap[0]
            heapq.heapreplace(heap, (x + s, i))
            got[i] = got.get(i, 0) + 1
            load[i] = x + s
        out += [(k, i, n) for i, n in sorted(got.items())]
    return np.array(out, dtype=np.int64).reshape(-1, 3), np.array(load)


def shard(docs: DataFrame, key: Column, size: Column, shards: int = SHARDS, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, group_key, shard``: all rows of a key on one shard."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), key.cast("string").alias("group_key"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("_size"))
    # Keys are hashed and groups summed once; all that follows reads these tables.
    rows = cut(spark, rows, "keyed")
    sizes = rows.groupBy("group_key").agg(F.sum("_size").alias("_total"), F.count("*").alias("_rows"))
    sizes = cut(spark, sizes.withColumn("_slot", F.coalesce(F.substring("group_key", 1, 2), F.lit(""))), "groups")
    slots = sizes.groupBy("_total", "_slot").agg(F.count("*").alias("c"))
    hist = slots.groupBy("_total").agg(F.sum("c").alias("c")).orderBy(F.desc("_total")).toPandas()
    plan, _ = schedule(hist["_total"].to_numpy(np.int64), hist["c"].to_numpy(np.int64), shards)
    # Of each size only the shards that get any, with the rank up to which they do.
    turn = pd.DataFrame({"_total": hist["_total"].to_numpy(np.int64)[plan[:, 0]], "shard": plan[:, 1].astype(np.int32), "n": plan[:, 2]})
    turn["upto"] = turn.groupby("_total")["n"].cumsum()
    places = turn.groupby("_total").agg(upto=("upto", list), shards=("shard", list)).reset_index()
    if not len(places):
        return rows.select("doc_id", "group_key", F.lit(0).alias("shard"))
    places = spark.createDataFrame(places, "_total long, upto array<long>, shards array<int>")
    run = W.partitionBy("_total").orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    before = slots.withColumn("_before", F.sum("c").over(run) - F.col("c")).drop("c")
    rank = F.row_number().over(W.partitionBy("_total", "_slot").orderBy(F.col("group_key").asc_nulls_first()))
    ranked = sizes.withColumn("_k", rank).join(before, ["_total", "_slot"]).join(places, "_total")
    spot = F.size(F.filter("upto", lambda u: u < F.col("_before") + F.col("_k"))) + 1
    placed = cut(spark, ranked.select(F.col("group_key").alias("_g"), F.element_at("shards", spot).cast("int").alias("_to"), "_rows"), "placed")
    # The rows of a very large group stay where they are.
    hot = sized(spark, placed.filter(F.col("_rows") > HOT), "hot")
    named = rows.join(hot, rows["group_key"].eqNullSafe(hot["_g"]), "left").select("doc_id", "group_key", F.col("_to").alias("shard"))
    rest, cold = named.filter("shard is null").select("doc_id", "group_key"), placed.filter(F.col("_rows") <= HOT)
    rest = rest.join(cold, rest["group_key"].eqNullSafe(cold["_g"])).select("doc_id", "group_key", F.col("_to").alias("shard"))
    return named.filter("shard is not null").union(rest)
