"""Vector tables: records of ``id, vector, metadata`` with the operations of a store.

A ``VectorTable`` is a DataFrame and a directory of Parquet; each change writes a new
version, so readers of the old one are not disturbed.  Remote stores plug in by the
same methods (``VectorStore``).
"""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import sphere as S
from orrery.functions import vectors as V
from orrery.operators.knn import cosine_top

SCHEMA = "seq long, id string, vector array<double>, metadata map<string,string>"
R_KEY, THETA_KEY, PHI_KEY = "_orrery_r", "_orrery_theta", "_orrery_phi"


class StoreError(ValueError):
    """A record or a request that the store cannot take."""


class VectorStore(Protocol):
    dimension: int
    name: str

    def upsert(self, records: DataFrame) -> None: ...
    def get(self, ids: list[str]) -> DataFrame: ...
    def delete(self, ids: list[str]) -> None: ...
    def search(self, query, k: int) -> DataFrame: ...
    def page(self, offset: int, limit: int) -> DataFrame: ...
    def count(self) -> int: ...
    def set_payload(self, updates: DataFrame) -> None: ...


class VectorTable:
    """``id, vector, metadata`` in insertion order; an id is there once."""

    def __init__(self, spark: SparkSession, name: str, dimension: int, path: str) -> None:
        self.spark, self.name, self.dimension, self.path = spark, name, dimension, path.rstrip("/")
        self._rows = spark.createDataFrame([], SCHEMA)

    def _write(self, rows: DataFrame) -> None:
        at = f"{self.path}/{self.name}-{uuid.uuid4().hex}"
        rows.write.parquet(at)
        self._rows = self.spark.read.schema(SCHEMA).parquet(at)

    @property
    def rows(self) -> DataFrame:
        return self._rows

    def upsert(self, records: DataFrame) -> None:
        """The last of equal ids counts; a known id keeps its place."""
        bad = records.filter(F.col("vector").isNull() | (F.size("vector") != self.dimension)).limit(1).count()
        if bad:
            raise StoreError(f"vectors must have {self.dimension} numbers")
        new = records.select("id", V.doubles("vector").alias("vector"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), F.monotonically_increasing_id().alias("n"))
        new = new.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy(F.desc("n")))).filter("k = 1")
        start = (self._rows.agg(F.max("seq")).first()[0] if self.count() else -1) or 0
        old = self._rows.select("id", F.col("seq").alias("was"))
        put = new.join(old, "id", "left").select(F.coalesce("was", F.lit(start + 1) + F.col("n")).alias("seq"), "id", "vector", "metadata")
        self._write(self._rows.join(new.select("id"), "id", "left_anti").select("seq", "id", "vector", "metadata").union(put))

    def get(self, ids: list[str]) -> DataFrame:
        return self._rows.filter(F.col("id").isin(list(ids))).drop("seq")

    def delete(self, ids: list[str]) -> None:
        self._write(self._rows.filter(~F.col("id").isin(list(ids))))

    def search(self, query, k: int) -> DataFrame:
        if len(query) != self.dimension:
            raise StoreError(f"queries must have {self.dimension} numbers")
        return cosine_top(self._rows.drop("seq"), query, k)

    def page(self, offset: int, limit: int) -> DataFrame:
        return self._rows.orderBy("seq").offset(offset).limit(limit).drop("seq")

    def count(self) -> int:
        return self._rows.count()

    def set_payload(self, updates: DataFrame) -> None:
        """``id, metadata``: new keys join the old ones and win over them."""
        u = updates.select("id", F.col("metadata").alias("_u"))
        both = F.map_concat(F.map_filter("metadata", lambda k, v: ~F.coalesce(F.map_contains_key("_u", k), F.lit(False))), "_u")
        merged = F.when(F.col("_u").isNull(), F.col("metadata")).otherwise(both)
        self._write(self._rows.join(u, "id", "left").select("seq", "id", "vector", merged.alias("metadata")))

    def fetch_all(self, most: int | None = None) -> DataFrame:
        rows = self._rows.drop("seq")
        return rows if most is None else self._rows.orderBy("seq").limit(most).drop("seq")

    def corpus(self, category: Column | None = None) -> DataFrame:
        """The table as a corpus; a missing category is ``unknown``."""
        c = category if category is not None else F.col("metadata")["category"]
        return self._rows.select(F.col("id").alias("item_id"), F.col("seq").alias("ordinal"), F.coalesce(c, F.lit("unknown")).alias("category"), F.col("vector").alias("embedding"))

    def sync_projections(self, points: DataFrame) -> None:
        """Writes each point's coordinates into its record's metadata."""
        m = F.create_map(*[x for k, c in ((R_KEY, "r"), (THETA_KEY, "theta"), (PHI_KEY, "phi")) for x in (F.lit(k), F.format_string("%.9f", F.col(c)))])
        self.set_payload(points.select(F.col("item_id").alias("id"), m.alias("metadata")))


def hybrid_search(points: DataFrame, vectors: DataFrame, target, query, final_k: int = 5, recall_k: int = 20) -> DataFrame:
    """``recall_k`` by the angle of the projection, re-ranked by the cosine of the vectors.

    ``vectors`` has ``item_id, embedding``; points without a vector drop out.
    """
    near = points.withColumn("_p", F.expr(S.cosine_proxy(S.vec("u"), S.literal(target)))).orderBy("_p", "ordinal").limit(recall_k).select("item_id", "ordinal")
    score = V.cosine("embedding", V.constant(query), nb=F.lit(float(sum(float(x) ** 2 for x in query)) ** 0.5))
    return near.join(vectors.select("item_id", "embedding"), "item_id").withColumn("score", score).orderBy(F.desc("score"), "ordinal").limit(final_k).drop("embedding")
