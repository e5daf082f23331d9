"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orrery.sources import tables
from orrery.sources.tables import release, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = "4m"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python a few megabytes at a time, however long they are.

    A session that has its own bound, other than Spark's default, keeps it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, BATCH)


def tidy() -> None:
    """Gives back what a worker holds on to after a task's last batch, as workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def sized(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A side of a join, written once; broadcast if it has at most ``SMALL_ROWS`` rows."""
    return tables.sized(df, name)


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage with data that outlive any executor: a lost executor
    costs the tasks it ran and nothing upstream of the table.
    """
    return tables.once(df, name)


def kind_of(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type of a column."""
    return to_arrow_type(df.schema[column].dataType)


#: Bits of the filters of ids.
BITS = 1 << 25


def _words(ids: DataFrame) -> DataFrame:
    """``w, v``: the words of 64 bits, with a bit for each hash of a ``doc_id``, that are not empty."""
    bit = id_bit("doc_id")
    return ids.select(F.shiftright(bit, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))


def ids_bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of a ``doc_id``: of fixed size, whatever the corpus."""
    rows = _words(ids).toPandas()
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return out


def id_bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows whose ``doc_id`` surely is not in ``ids``, a written table, and the others.

    Told by a bitmap of the ids where the rows are read, so that few texts move when
    the others are joined.  The bitmap is broadcast as a table of its words, of which
    there are at most ``BITS / 64``.
    """
    names, word, bits = docs.columns, "_word", "_bits"
    while {word, bits} & {n.lower() for n in names}:
        word, bits = word + "_", bits + "_"
    words = F.broadcast(cut(docs.sparkSession, _words(ids).toDF(word, bits), "bitmap"))
    bit = id_bit("doc_id")
    told = docs.join(words, F.shiftright(bit, 6).cast("int") == F.col(word), "left")
    hit = F.coalesce(F.call_function("shiftright", bits, F.pmod(bit, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    columns = [docs[n] for n in names]
    return told.filter(~hit).select(*columns), told.filter(hit).select(*columns)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in ``gone``, a written table."""
    clear, unsure = parted(docs, gone)
    ids = gone.select(F.col("doc_id").alias("_gone"))
    return clear.union(unsure.join(ids, unsure["doc_id"] == ids["_gone"], "left_anti"))
