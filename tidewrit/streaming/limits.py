"""The limiter of operators.limiter over a stream: state by key, timers by event time.

Requests wait in the state until the watermark has passed them, so they are asked in the order of their times whatever
batch brings them, and the answers are those of the batch form. Requests that come later than the watermark allows are
dropped by Spark. The state of a key is its ring and what still waits.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.limiter import Limits, Ring

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key string, request string, admitted_us long, refused string"


class Admission(StatefulProcessor):
    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "times array<bigint>, tokens array<bigint>, day bigint, used bigint, last bigint")
        self.waiting = handle.getListState("waiting", "us bigint, tokens bigint, request string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            for us, tokens, request in zip(part["us"].tolist(), part["tokens"].tolist(), part["request"].tolist()):
                self.waiting.appendValue((int(us), int(tokens), request))
                first = us if first is None else min(first, us)
        if first is not None:
            self.handle.registerTimer(int(first) // 1000 + 1)
        yield _answers("", [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted((r[0], r[2], r[1]) for r in self.waiting.get())
        ready, rest = [r for r in every if r[0] <= passed], [r for r in every if r[0] > passed]
        ring = Ring()
        if self.ring.exists():
            times, tokens, day, used, last = self.ring.get()
            ring = Ring(deque(zip(times, tokens)), sum(tokens), day, used, last)
        answers = [(request, *ring.ask(self.limits, us, tokens)) for us, request, tokens in ready]
        self.ring.update(([t for t, _ in ring.admitted], [n for _, n in ring.admitted], ring.day, ring.used, ring.last))
        if rest:
            self.waiting.put([(us, tokens, request) for us, request, tokens in rest])
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        yield _answers(key[0], answers)


def _answers(key: str, rows: list[tuple]) -> pd.DataFrame:
    request, admitted, refused = zip(*rows) if rows else ((), (), ())
    columns = {"key": [key] * len(rows), "request": request, "admitted_us": admitted, "refused": refused}
    return pd.DataFrame({c: pd.Series(list(v), dtype="Int64" if c == "admitted_us" else object) for c, v in columns.items()})


def admissions(stream: DataFrame, key: str, time: str, tokens: str, request: str, limits: Limits = Limits(), late: str = "10 minutes") -> DataFrame:
    """A stream of (key, request, admitted_us, refused); requests are told by the text of their column, in which those of one
    moment also go. Every request has a key and a time; others are dropped."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    asked = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at"), F.col(request).cast("string").alias("request"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("tokens"))
    asked = asked.where("key is not null and at is not null").withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    return asked.groupBy("key").transformWithStateInPandas(Admission(limits), OUTPUT, "append", "eventtime")
