"""A table of points that changes: stored by cell, appended to, and asked with pruning.

Inserts append files; a removal is a row in a table of tombstones, and an update is
both, so a change costs what it changes and not the table.  Readers see the rows
that no later tombstone names.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.regions import Region
from orrery.operators import knn
from orrery.sources import points as P
from orrery.sources.tables import once

COLUMNS = "item_id string, ordinal long, category string, r double, theta double, phi double, ux double, uy double, uz double, x double, y double, z double"


class PointIndex:
    def __init__(self, spark: SparkSession, path: str, shells: list[float] | None = None, theta_parts: int = 12, phi_parts: int = 6, capacity: int = 128) -> None:
        if theta_parts < 1 or phi_parts < 1:
            raise ValueError("divisions must be at least 1")
        self.spark, self.path = spark, path.rstrip("/")
        self.bounds, self.theta_parts, self.phi_parts = sorted(set(shells or [])), theta_parts, phi_parts
        self.version, self.capacity, self.hits, self.misses = 0, capacity, 0, 0
        self._cache: OrderedDict = OrderedDict()
        self._names = [c.split()[0] for c in COLUMNS.split(", ")]

    def _table(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        there = jvm.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)
        return self.spark.read.schema(schema).parquet(at) if there else self.spark.createDataFrame([], schema)

    @property
    def rows(self) -> DataFrame:
        """All items as they are now, with their cells."""
        stored = self._table("points", COLUMNS + ", version long, sector_id int, shell_id int")
        gone = self._table("gone", "item_id string, version long").select(F.col("item_id").alias("g"), F.col("version").alias("v"))
        return stored.join(gone, (stored.item_id == gone.g) & (stored.version <= gone.v), "left_anti").drop("version")

    def _changed(self) -> None:
        self.version += 1
        self._cache.clear()

    def insert(self, points: DataFrame, radius: str | None = None) -> None:
        """Adds items, at another radius (an expression) if one is given; refuses ids that are there or come twice."""
        if radius is not None:
            points = P.from_spherical(points.withColumn("r", F.expr(radius)))
        points = once(points.select(*self._names), "inserted")
        twice = points.groupBy("item_id").count().filter("count > 1").take(1) or points.join(self.rows.select("item_id"), "item_id", "left_semi").take(1)
        if twice:
            raise ValueError(f"item {twice[0].item_id!r} is there already")
        self._changed()
        cells = P.with_cells(points.withColumn("version", F.lit(self.version).cast("long")), self.bounds, self.theta_parts, self.phi_parts)
        cells.repartition("sector_id").write.mode("append").partitionBy("sector_id", "shell_id").parquet(f"{self.path}/points")

    def remove(self, ids: DataFrame) -> None:
        """Removes the items named in ``item_id``; unknown ones are ignored."""
        ids.select("item_id", F.lit(self.version).cast("long").alias("version")).write.mode("append").parquet(f"{self.path}/gone")
        self._changed()

    def update(self, points: DataFrame) -> None:
        """Puts items in place of those with the same ids; new ones are added."""
        points = once(points.select(*self._names), "updated")
        self.remove(points)
        self.insert(points)

    def get(self, ids: list[str]) -> DataFrame:
        return self.rows.filter(F.col("item_id").isin(ids))

    def has(self, item_id: str) -> bool:
        return bool(self.get([item_id]).take(1))

    def count(self) -> int:
        return self.rows.count()

    def is_empty(self) -> bool:
        return not self.rows.take(1)

    def _cached(self, key, make) -> DataFrame:
        if (found := self._cache.get(key)) is not None:
            self.hits += 1
            self._cache.move_to_end(key)
            return found
        self.misses += 1
        self._cache[key] = found = once(make(), "answer")
        while len(self._cache) > self.capacity:
            self._cache.popitem(last=False)
        return found

    def query(self, region: Region) -> DataFrame:
        """The items in a region; answers are kept until the next change."""
        return self._cached(region, lambda: knn.in_region(self.rows, region, self.theta_parts, self.phi_parts, self.bounds))

    def within(self, target, distance: float) -> DataFrame:
        near = lambda: knn.within(knn.near_sectors(self.rows, target, distance, self.theta_parts, self.phi_parts), target, distance)
        return self._cached(("within", tuple(target), distance), near)

    def nearest(self, target, k: int = 5, max_distance: float | None = None) -> DataFrame:
        return self._cached(("nearest", tuple(target), k, max_distance), lambda: knn.nearest(self.rows, target, k, max_distance))
