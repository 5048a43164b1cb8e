"""A store of answers to requests: resumable, with versions, and right after any retry or killed run.

Answers are Parquet folders below ``data``; a folder counts once a manifest below ``commits`` names it, and a manifest
appears whole or not at all. An attempt has a name, and a name is committed once: a batch that is run again changes
nothing, and a run that is killed leaves a folder that nobody reads. An answer belongs to an id, a version (of the prompt,
say) and a fingerprint of version and payload; of several answers the one of the latest commit holds. Answers to
a payload that has changed since, or of another version, are no answers.

The driver reads manifests, as many as there were attempts since the last compaction. Null ids are stored and never
match; a null part of a payload is told from an empty one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import first_by_key
from .files import Folder

#: Between the parts of what is fingerprinted.
SEPARATOR = "\x1f"


def fingerprint(version: str, *payload: Column) -> Column:
    parts = [F.when(p.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), p.cast("string"))) for p in payload]
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(version), *parts).cast("binary"), 256)


class AnswerStore:
    def __init__(self, spark: SparkSession, path: str, answer: str, payload: tuple[str, ...] = ("payload",), id_col: str = "id", id_type: str = "string"):
        """answer: the type of answers. payload: the columns of a request that its answer depends on."""
        self.spark, self.path, self.payload, self.id_col = spark, path.rstrip("/"), payload, id_col
        self.schema = f"id {id_type}, version string, fingerprint string, answer {answer}, n long"
        self.commits = Folder(spark, f"{self.path}/commits")

    def manifests(self) -> list[dict]:
        """In the order of their commits; without those that a compaction replaces."""
        found = [json.loads(self.commits.read(n)) for n in self.commits.names()]
        gone = {x for m in found for x in m["replaces"]}
        return sorted((m for m in found if m["attempt"] not in gone), key=lambda m: (m["n"], m["attempt"]))

    def _write(self, rows: DataFrame, attempt: str, n: int, replaces: list[str]) -> bool:
        folder = f"data/{attempt}-{uuid.uuid4().hex}"  # of its own, so that two tries of an attempt do not meet
        rows.write.parquet(f"{self.path}/{folder}")
        if self.commits.create(f"{attempt}.json", json.dumps({"attempt": attempt, "n": n, "folder": folder, "replaces": replaces})):
            return True
        Folder(self.spark, f"{self.path}/data").delete(folder.split("/")[1])
        return False

    def commit(self, answers: DataFrame, version: str, attempt: str) -> bool:
        """answers: id, the payload's columns and answer. False if the attempt was committed before."""
        if f"{attempt}.json" in self.commits.names():
            return False
        n = max((m["n"] for m in self.manifests()), default=0) + 1
        rows = answers.select(F.col(self.id_col).alias("id"), F.lit(version).alias("version"), fingerprint(version, *map(F.col, self.payload)).alias("fingerprint"), "answer", F.lit(n).cast("long").alias("n"))
        return self._write(rows, attempt, n, [])

    def rows(self) -> DataFrame:
        """All that is committed, several answers to a request among it."""
        folders = [f"{self.path}/{m['folder']}" for m in self.manifests()]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        """One answer for each id, version and fingerprint."""
        key = F.struct("id", "version", "fingerprint")
        return first_by_key(self.rows(), key, [F.desc("n"), F.to_json(F.struct("answer"))])

    def answered(self, requests: DataFrame, version: str) -> DataFrame:
        """requests with answer, those that have one."""
        held = self.latest().where(F.col("version") == version).select(F.col("id").alias("__id"), F.col("fingerprint").alias("__print"), "answer")
        asked = requests.withColumn("__own", fingerprint(version, *map(F.col, self.payload)))
        return asked.join(held, (F.col(self.id_col) == F.col("__id")) & (F.col("__own") == F.col("__print"))).select(*requests.columns, "answer")

    def todo(self, requests: DataFrame, version: str) -> DataFrame:
        """The requests that no answer of the version fits."""
        held = self.rows().where(F.col("version") == version).select(F.col("id").alias("__id"), F.col("fingerprint").alias("__print"))
        asked = requests.withColumn("__own", fingerprint(version, *map(F.col, self.payload)))
        return asked.join(held, (F.col(self.id_col) == F.col("__id")) & (F.col("__own") == F.col("__print")), "left_anti").select(requests.columns)

    def migrate(self, requests: DataFrame, unchanged: Column, old: str, new: str, attempt: str | None = None) -> bool:
        """Takes answers of an old version over for requests that the new version asks no differently, and has not answered."""
        rows = self.answered(self.todo(requests.where(unchanged), new), old)
        return self.commit(rows, new, attempt or f"migrate-{old}-{new}")

    def upsert(self, stream: DataFrame, version: str, checkpoint: str, name: str = "stream"):
        """A running query that commits each batch of a stream of answers under the batch's number."""
        return stream.writeStream.foreachBatch(lambda batch, k: self.commit(batch, version, f"{name}-{k}") and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def compact(self, keep_versions: list[str] | None = None) -> str:
        """One folder with the latest answers in place of all, of the versions that are kept. What is replaced is deleted only
        by vacuum(), so readers that began before go on."""
        old = self.manifests()
        rows = self.latest()
        if keep_versions is not None:
            rows = rows.where(F.col("version").isin(keep_versions))
        attempt = f"compact-{uuid.uuid4().hex}"
        self._write(rows, attempt, max((m["n"] for m in old), default=0), [m["attempt"] for m in old])
        return attempt

    def vacuum(self) -> list[str]:
        """Deletes folders that no manifest in force names, those of runs that are writing now included: run it alone.
        Manifests stay, so that a replaced attempt is still known to be done."""
        live = {m["folder"].split("/")[1] for m in self.manifests()}
        data = Folder(self.spark, f"{self.path}/data")
        gone = [n for n in data.names() if n not in live]
        for n in gone:
            data.delete(n)
        return gone
