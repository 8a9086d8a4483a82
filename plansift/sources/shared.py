"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="plansift-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: What stored() wrote and nothing has deleted yet, oldest first.
_written: list[str] = []


#: The share of the heap's limit beyond which stored() has the driver's garbage collected.
FULL = 0.5


def collected(spark: SparkSession) -> None:
    """Has the driver's garbage collected if its heap takes over FULL of its limit.

    Left alone, the heap grows towards its limit on what finished plans left, some four times what is in use, and keeps that size. A
    collection gives it back; it also tells Spark which shuffle files and broadcasts nothing needs any more.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > FULL * heap.maxMemory():
        spark._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what follows is planned and run from there, also after lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    collected(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whole plans that run once: neither planned again after each of their shuffles nor with small tables sent through the driver.
PLAIN = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@contextmanager
def plain_plans(spark: SparkSession) -> Iterator[None]:
    """What runs inside is planned by PLAIN, which holds for the session meanwhile; what is only made inside and runs later is not.

    For many small plans with many shuffles each. An adaptive plan is planned and described anew whenever one of its shuffles or
    broadcasts has ended, each in a thread of its own: in spatial_manholes 160 to 270 MB of the driver's memory. Partitions are as many as
    spark.sql.shuffle.partitions says, however few rows there are, and skewed joins aren't split: for joins on pages, not on a key of very many rows.
    """
    was = {k: spark.conf.get(k, None) for k in PLAIN}
    try:
        for k, v in PLAIN.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores: a small file is one task, whatever is made of its rows."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that stored() wrote."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(path)


@contextmanager
def scratch(spark: SparkSession, keep: bool = False) -> Iterator[list[str]]:
    """Tables that stored() writes inside are deleted at the end, but for those whose paths are put in the list that this gives.

    What is computed from them has to be written by then. With keep nothing is deleted, to look at.
    """
    first, wanted = len(_written), []
    try:
        yield wanted
    finally:
        if not keep:
            discard(spark, [p for p in _written[first:] if p not in wanted])


def last_stored() -> str:
    """The path of the table that stored() wrote last."""
    return _written[-1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
