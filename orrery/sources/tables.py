"""Tables on the way: written once in the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made for sessions without the setting, by application.
_own: dict[str, str] = {}
#: Tables written by ``once``, in order.
_written: list[str] = []
#: Rows of a side that is broadcast; a larger one is left to the planner.
SMALL_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent in local mode (tests) a temporary folder is made
    once for the application; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="orrery-")
    return base.rstrip("/")


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: planned and computed once, however often it is read.

    The table outlives any executor; a lost one costs the tasks it ran.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orrery/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for ``release``: how many tables ``once`` has written so far."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete the tables that ``once`` wrote between two marks; without marks, all of the application.

    Results that still have to be read must not depend on them.
    """
    gone = _written[since:until]
    if since == 0 and until is None:
        gone = [f"{shared_dir(spark)}/orrery/{spark.sparkContext.applicationId}"]
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, name: str) -> DataFrame:
    """``once``, broadcast if it has at most ``SMALL_ROWS`` rows."""
    table = once(df, name)
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once a row, however often they are used.

    They come out of a generator, through which neither projections nor filters
    are merged; as plain columns, each use would repeat their whole expression.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
