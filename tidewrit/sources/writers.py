"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEPT = "kept"


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", bom: bool = True) -> None:
    """CSV with a header. With bom, each file begins with a byte-order mark, as spreadsheets want it: it is a part of the
    first column's name, so Spark writes it with the header."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "﻿" + first) if bom else df
    out.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def split_sinks(df: DataFrame, reason: Column, kept: str, rejected: str, partition_reasons: bool = True) -> None:
    """Passing rows to one table and the others to one that is partitioned by reason."""
    df = df.withColumn("reason", reason)
    df.where("reason is null").drop("reason").write.parquet(kept)
    out = df.where("reason is not null").write
    (out.partitionBy("reason") if partition_reasons else out).parquet(rejected)


class observed:
    """df with aggregates that are taken while it is written; get() has them then."""

    def __init__(self, df: DataFrame, **measures: Column):
        self._seen = Observation()
        self.df = df.observe(self._seen, *(c.alias(n) for n, c in measures.items()))

    def get(self) -> dict:
        return self._seen.get


def write_outcomes(df: DataFrame, reason: Column, path: str, drop: tuple[str, ...] = (), **measures: Column) -> dict:
    """One table of all rows, partitioned by outcome (``kept``, or the reason of refusal), written in one pass over df, and the
    counts that were taken on the way: rows, kept, rejected, and the given aggregates. read_outcomes() reads a part of it."""
    bad = F.count_if(F.col("outcome") != KEPT)
    seen = observed(df.withColumn("outcome", F.coalesce(reason, F.lit(KEPT))), rows=F.count(F.lit(1)), kept=F.count(F.lit(1)) - bad, rejected=bad, **measures)
    seen.df.drop(*drop).write.partitionBy("outcome").parquet(path)
    return seen.get()


def read_outcomes(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows kept, and the others with their reason; only the folders of each are read."""
    every = spark.read.schema(f"{schema}, outcome string").parquet(path)
    return every.where(F.col("outcome") == KEPT).drop("outcome"), every.where(F.col("outcome") != KEPT).withColumnRenamed("outcome", "reason")


def append_cache(answers: DataFrame, path: str, id_col: str = "id", payload: str = "payload") -> None:
    """Answers with the fingerprint of what was asked; operators.corpus.todo() finds what is still to ask."""
    answers.withColumn("fingerprint", F.sha2(F.col(payload).cast("binary"), 256)).write.mode("append").parquet(path)
