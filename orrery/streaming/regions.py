"""Streams of spatial events and subscriptions to regions.

Events have ``item_id, event_type, ts`` and a point (``r, theta, phi, ux, uy, uz``).
``entered`` and ``left`` trust the publisher's type; ``transitions`` derives it from
where an item was before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.functions import sphere as S
from orrery.functions.regions import Region
from orrery.sources.points import from_spherical
from orrery.sources.tables import shared_dir

#: States that items share in ``transitions``.
GROUPS = 512


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def spatial_events(events: DataFrame) -> DataFrame:
    """The event table as points: users on the golden-angle lattice, values as radius."""
    k = "CAST(user_id AS DOUBLE)"
    rows = events.select(
        "event_id",
        "ts",
        F.concat(F.lit("u"), "user_id").alias("item_id"),
        F.expr("CASE event_type WHEN 'click' THEN 'entered' WHEN 'error' THEN 'left' ELSE 'moved' END").alias("event_type"),
        (F.col("value") / 10).alias("r"),
        F.expr(S.wrap("value / 100.0D * 6.0D")).alias("theta"),
        F.expr(f"acos(1.0D - 2.0D * ({k} * 0.6180339887498949D - floor({k} * 0.6180339887498949D)))").alias("phi"),
    )
    return from_spherical(rows)


def entered(events: DataFrame, region: Region) -> DataFrame:
    return events.filter((F.col("event_type") == "entered") & region.column())


def left(events: DataFrame, region: Region) -> DataFrame:
    return events.filter((F.col("event_type") == "left") & region.column())


def transitions(events: DataFrame, region: Region, delay: str = "1 hour", forget_ms: int = 86_400_000) -> DataFrame:
    """``item_id, ts, change``: where an item's last known side of the border changes.

    Events wait until the watermark has passed them, and are then taken in the order
    of their times (and ids, where these are equal), so that an event which comes late,
    by up to ``delay``, is judged in its place.  An item's state is dropped after a
    day of event time without events.  Items share ``GROUPS`` states, so that the calls
    of Python do not grow with the items.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, was, until, who, ts, ids, inside = state.get if state.exists else ([],) * 7
        mark, place = state.getCurrentWatermarkMs(), {n: i for i, n in enumerate(names)}
        who, ts, ids, inside = ([np.array(v, kind)] for v, kind in ((who, np.int64), (ts, np.int64), (ids, np.int64), (inside, bool)))
        for rows in batches:
            codes, found = pd.factorize(rows["item_id"])
            who.append(np.array([place.setdefault(n, len(place)) for n in found], np.int64)[codes])
            ts.append(rows["ts"].astype("datetime64[us]").astype("int64").to_numpy())
            ids.append(rows["event_id"].to_numpy())
            inside.append(rows["inside"].to_numpy(bool))
        touched = np.zeros(len(place), bool)
        touched[np.concatenate(who[1:] or who)] = True
        names, more = np.array(list(place), dtype=object), len(place) - len(names)
        was, until = np.append(np.array(was, bool), np.zeros(more, bool)), np.append(np.array(until, np.int64), np.zeros(more, np.int64))
        who, ts, ids, inside = map(np.concatenate, (who, ts, ids, inside))
        order = np.lexsort((inside, ids, ts, who))
        ready = ts[order] // 1000 <= mark  # the watermark has milliseconds
        now, rest = order[ready], order[~ready]
        item, side = who[now], inside[now]
        first = np.append(True, item[1:] != item[:-1])[: len(item)]
        before = np.where(first, was[item], np.append(False, side[:-1])[: len(item)])
        out = now[side != before]
        change = pd.DataFrame({"item_id": names[who[out]], "ts": pd.to_datetime(ts[out], unit="us"), "change": np.where(inside[out], "entered", "left").astype(object)})
        last = np.append(first[1:], True)[: len(item)]
        was[item[last]] = side[last]
        touched[item] = True
        until[touched] = mark + forget_ms
        waits = np.zeros(len(place), bool)
        waits[who[rest]] = True
        keep = waits | touched | (until >= mark)
        if keep.any():
            number = np.cumsum(keep) - 1
            state.update((names[keep].tolist(), was[keep].tolist(), until[keep].tolist(), number[who[rest]].tolist(), ts[rest].tolist(), ids[rest].tolist(), inside[rest].tolist()))
            state.setTimeoutTimestamp(int(max(mark + 1, min([*until[keep & ~waits], *(ts[rest] // 1000)]))))
        else:
            state.remove()
        if len(change):
            yield change

    rows = events.select("item_id", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), region.column().alias("inside")).withWatermark("ts", delay)
    held = "names array<string>, was array<boolean>, until array<long>, who array<long>, ts array<long>, ids array<long>, inside array<boolean>"
    return rows.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(GROUPS))).groupBy("part").applyInPandasWithState(step, "item_id string, ts timestamp, change string", held, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, region: Region, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Events in the region by window and type, with late data up to ``delay``."""
    rows = events.filter(region.column()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"))


def finished(stream: DataFrame, name: str, complete: bool = False) -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder.

    ``complete`` is for aggregates: the table has their last state.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/orrery/streams/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}-checkpoint")
    if complete:
        last = lambda batch, _: batch.write.mode("overwrite").parquet(at)
        writer.outputMode("complete").foreachBatch(last).start().awaitTermination()
    else:
        writer.format("parquet").option("path", at).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)
