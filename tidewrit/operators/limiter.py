"""Admission by calls and tokens in a sliding window and by calls a day, in the order of requests of a key.

A request is admitted at the first moment, not before its own time nor before the request admitted last, at which the
window's admitted requests and it are within the limits; an admitted request stays in the window for its whole length.
One whose tokens alone are over the limit is refused (``tokens``), and so is one that comes when the day's calls are used
up (``day``). Without waiting, one that does not fit at its own time is refused (``window``).

Whether a request is admitted depends on all before it, so the requests of a key are a fold in one task; its state is
a ring of at most ``calls`` entries. The rows stream through in order, and none is held.
Null times and null keys: a request without time is refused (``time``); null is a key as any other. Null tokens are 0.
Requests of one moment go in the order of ``tie``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000


@dataclass(frozen=True)
class Limits:
    """The defaults are those of a service that allows 30 calls and 16,000 tokens a minute and 14,400 calls a day, of which
    85 % of the calls and tokens a minute are used."""

    calls: int = int(30 * 0.85)
    tokens: int = int(16_000 * 0.85)
    daily: int = 14_400
    window: int = 60_000_000  # microseconds
    wait: bool = True


@dataclass
class Ring:
    """What is remembered of one key."""

    admitted: deque = field(default_factory=deque)  # (time, tokens)
    tokens: int = 0
    day: int = -1
    used: int = 0
    last: int = -(1 << 62)

    def ask(self, limits: Limits, time: int | None, tokens: int | None, actual: int | None = None) -> tuple[int | None, str | None]:
        """(time of admission, None) or (None, reason); actual tokens, if known, stand in the window instead of the estimate."""
        tokens = tokens or 0
        if time is None:
            return None, "time"
        if tokens > limits.tokens:
            return None, "tokens"
        at = max(time, self.last)
        if at // DAY == self.day and self.used >= limits.daily or limits.daily <= 0:
            return None, "day"
        while True:
            while self.admitted and at - self.admitted[0][0] > limits.window:
                self.tokens -= self.admitted.popleft()[1]
            if len(self.admitted) < limits.calls and self.tokens + tokens <= limits.tokens:
                break
            if not limits.wait or not self.admitted:
                return None, "window"
            at = self.admitted[0][0] + limits.window + 1
        spent = tokens if actual is None else actual
        self.admitted.append((at, spent))
        self.tokens += spent
        self.day, self.used, self.last = at // DAY, 1 if at // DAY != self.day else self.used + 1, at
        return at, None


def admissions(requests: DataFrame, key: str, time: str, tokens: str, tie: str, limits: Limits = Limits(), actual: str | None = None) -> DataFrame:
    """requests with admitted_at (null if refused) and refused (null if admitted)."""
    names = requests.columns
    asked = requests.withColumns({
        "__key": F.col(key).cast("string"), "__us": F.unix_micros(F.col(time).cast("timestamp")), "__tokens": F.col(tokens).cast("long"),
        "__actual": F.col(actual).cast("long") if actual else F.lit(None).cast("long"),
    })
    asked = asked.repartition("__key").sortWithinPartitions("__key", F.asc_nulls_last("__us"), tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ring = (), Ring()
        for b in batches:
            at, why = [], []
            for k, us, n, real in zip(*(b.column(c).to_pylist() for c in ("__key", "__us", "__tokens", "__actual"))):
                if held != (k,):
                    held, ring = (k,), Ring()
                admitted, refused = ring.ask(limits, us, n, real)
                at.append(admitted)
                why.append(refused)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(at, pa.int64()), pa.array(why, pa.string())], [*names, "admitted_us", "refused"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    out = asked.mapInArrow(run, f"{kinds}, admitted_us long, refused string")
    return out.select(*names, F.timestamp_micros("admitted_us").alias("admitted_at"), "refused")
