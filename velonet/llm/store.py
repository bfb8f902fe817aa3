"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset (tests on one machine) a folder of our own."""
    global _own
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="velonet-")
    return _own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def giving_back(spark: SparkSession) -> Iterator[None]:
    """What the shuffles of the actions within leave on the executors' disks is given back at once, rather than kept until the driver runs short of memory."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")  # of these actions alone; those of others go as they are collected
    try:
        yield
    finally:
        spark.conf.set(key, before)
    gc.collect()
    spark._jvm.System.gc()


def settled(df: DataFrame, name: str) -> DataFrame:
    """``materialise``, and what the shuffles before it left is given back."""
    with giving_back(df.sparkSession):
        return materialise(df, name)


def made() -> int:
    """How many tables were written so far: a mark for ``clear``."""
    return len(_made)


def clear(spark: SparkSession, since: int) -> None:
    """Delete the tables written since a mark but for the last one; nothing lazy may still need them."""
    for path in _made[since:-1]:
        drop(spark, path)
    del _made[since:-1]


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Rounds:
    """The table of an iterative job: each write drops the one before, which nothing reads any more."""

    def __init__(self, name: str):
        self.name, self.path = name, None

    def write(self, df: DataFrame) -> DataFrame:
        spark, before = df.sparkSession, self.path
        self.path = new_path(spark, self.name)
        df.write.parquet(self.path)
        if before:
            drop(spark, before)
        return spark.read.schema(df.schema).parquet(self.path)


def ids_repeat(rows: DataFrame, key: str = "doc_id") -> bool:
    return not rows.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()


def renumbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``doc_id`` of its own for each row; ``own_id`` is what it was. Written, so the numbers hold."""
    return materialise(docs.withColumn("own_id", F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()), "renumbered")


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Arrow batches of at most ``most`` bytes for this session, unless it has a setting of its own: a worker holds a batch or two."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64MB") in ("67108864b", "64MB"):
        spark.conf.set(key, most)
