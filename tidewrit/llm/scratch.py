"""Intermediate tables in the folder that all executors share, and values sent to every task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a temporary one if all tasks run in this machine's one
    process; on a cluster that is an error, as executors do not see each other's disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewrit-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def sent(spark: SparkSession, value) -> Iterator[Broadcast]:
    """A value that is sent to the tasks of the block and destroyed with it: the block must keep what it makes of it."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes that tell rows of other ids or other texts apart; nulls are told from empty texts."""
    parts = [F.col(id_col).cast("long"), F.col(text_col), F.col(text_col).isNull()]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((1, "h1"), (2, "h2"))]


class Scratch:
    """Tables written as Parquet, so that their lineage ends there and a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by keep(), once nothing reads them any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            p.getFileSystem(conf).delete(p, True)
