"""Bloom filters whose bits are or-ed together by the tasks, and whose size is checked before they are sent to them."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

#: Bytes of the bits of one filter, in the driver and in each Python worker.
LARGEST_LEVEL = 32 << 20


class Level:
    def __init__(self, bits: np.ndarray, size: int, hashes: int, salt: int):
        self.bits, self.size, self.hashes, self.salt = bits, size, hashes, salt

    @staticmethod
    def positions(h: np.ndarray, size: int, hashes: int, salt: int) -> np.ndarray:
        a = kernels.mix(h + kernels.U64(salt * 0x9E3779B97F4A7C15 % (1 << 64)))
        b = kernels.mix(a ^ kernels.U64(0xD6E8FEB86659FD93)) | kernels.U64(1)
        return np.stack([(a + kernels.U64(i) * b) % kernels.U64(size) for i in range(hashes)])

    def passes(self, h: np.ndarray) -> np.ndarray:
        p = self.positions(h, self.size, self.hashes, self.salt)
        return ((self.bits[p >> kernels.U64(6)] >> (p & kernels.U64(63))) & kernels.U64(1)).astype(bool).all(axis=0)


def n_bytes(n: int, error: float) -> int:
    return ceil(-max(n, 1) * log(error) / log(2) ** 2 / 8)


def build(keys: DataFrame, n: int, error: float, salt: int) -> Level:
    """A Bloom filter of n keys (column h) that passes others with about the given probability. The caller sees to it
    that its size is within LARGEST_LEVEL."""
    size = max(64, 8 * n_bytes(n, error))
    size += -size % 64
    if size // 8 > LARGEST_LEVEL + 8:
        raise ValueError(f"a level of {n} keys takes {size // 8} bytes")
    k = min(max(1, round(size / max(n, 1) * log(2))), 32)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 64, kernels.U64)
        for b in batches:
            p = Level.positions(b.column(0).to_numpy().view(kernels.U64), size, k, salt).reshape(-1)
            np.bitwise_or.at(bits, p >> kernels.U64(6), kernels.U64(1) << (p & kernels.U64(63)))
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(bits[some].view(np.int64))], ["word", "bits"])

    got = keys.select("h").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, kernels.U64)
    bits[got["word"].to_numpy()] = got["bits"].to_numpy().view(kernels.U64)
    return Level(bits, size, k, salt)


def members(keys: DataFrame, n: int, error: float = 0.01) -> Level | None:
    """A filter of the column h, only there to keep other rows out of a shuffle. With more keys than the bound on its size
    allows for, it lets more of the others pass; None if that would be over half of them, so that it is not worth while."""
    error = max(error, exp(-LARGEST_LEVEL * 8 * log(2) ** 2 / max(n, 1)))
    return build(keys, n, error, 1) if error <= 0.5 else None


def may_hold(level: Level, spark):
    """A function of a long column: whether the filter may hold it; null is never held."""
    shared = spark.sparkContext.broadcast(level)

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        some = h.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(h), bool)
        out[some] = shared.value.passes(h.drop_null().to_numpy().view(kernels.U64))
        return pa.array(out)

    return test.asNondeterministic()  # else it is also asked about the other side of each join that follows


#: Keys that are sent to all tasks as they are.
FEW = 200_000


def without(docs: DataFrame, gone: DataFrame, scratch, keys: list, repeated: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose keys (two columns that name a row, see scratch.row_keys) are not in gone (h1, h2). Of rows
    with equal keys in repeated one stays, as they are equal.

    A few keys are sent to the rows, which are read once. Of many, a Bloom filter lets all other rows pass where they are,
    so only the few that it holds are shuffled.
    """
    gone = scratch.keep(gone.select("h1", "h2").distinct(), "gone")
    listed = gone
    if repeated is not None:
        repeated = scratch.keep(repeated.select("h1", "h2").distinct(), "repeated")
        repeated = None if repeated.isEmpty() else repeated
        listed = gone if repeated is None else gone.unionByName(repeated)
    n = listed.count()
    if not n:
        return docs
    # the row itself goes along as one column, so none of its names can clash
    some, rest = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *keys), None
    level = None if n <= FEW else members(listed.select(F.col("h1").alias("h")), n)
    if level is not None:
        held = may_hold(level, docs.sparkSession)("h1")
        some, rest = some.where(held), some.where(~held)
    send = F.broadcast if n <= FEW else lambda df: df
    some = some.join(send(gone), ["h1", "h2"], "left_anti")
    if repeated is not None:
        again = some.join(send(repeated), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
        some = some.join(send(repeated), ["h1", "h2"], "left_anti").unionByName(again)
    out = some.select("row.*")
    return out if rest is None else out.unionByName(rest.select("row.*"))
