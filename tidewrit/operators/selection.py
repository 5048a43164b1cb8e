"""Where a running sum over a seeded order reaches a target, without sorting or moving the rows.

The order is that of a hash of 60 bits of each key, then of the key. A target's place is found 12 bits at a time: sums of
the weights by the next 12 bits say in which of 4,096 ranges it lies, and only that range is summed more finely. Five
sums, each pre-aggregated in its tasks, and the driver sees at most 4,096 numbers for each target. The place is a
literal, so what depends on it is a filter.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, STEP = 60, 12


class Place(NamedTuple):
    """A place in the order; the rows up to it are those of the target."""

    hash: int
    key: str


NOWHERE = Place(-1, "")
END = Place(1 << BITS, "")


def text_key(value: Column) -> Column:
    """A key as text; null is a key of its own."""
    return F.coalesce(value.cast("string"), F.lit("\x00null"))


def seeded(seed: str, key: Column) -> Column:
    """60 bits that order keys; the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key).cast("binary")), 1, 15), 16, 10).cast("long")


def up_to(place: Place, h: Column, key: Column) -> Column:
    return (h < place.hash) | ((h == place.hash) & (key <= place.key))


def places(rows: DataFrame, targets: dict[str, int]) -> dict[str, Place]:
    """rows: group, h, key, w (a weight of at least 0). For each target the first place at which the weights of its group up
    to there reach it: NOWHERE for targets of 0 and less, END if the group has less."""
    found = {g: NOWHERE for g, n in targets.items() if n <= 0}
    open_ = {g: (0, n) for g, n in targets.items() if n > 0}  # the bits so far, and what is still to be reached
    for shift in range(BITS - STEP, -1, -STEP):
        if not open_:
            return found
        within = reduce(Column.__or__, ((F.col("group") == g) & (F.shiftright("h", shift + STEP) == prefix) for g, (prefix, _) in open_.items()))
        sums: dict[str, dict[int, int]] = {}
        for r in rows.where(within).groupBy("group", F.shiftright("h", shift).bitwiseAND((1 << STEP) - 1).alias("bin")).agg(F.sum("w").alias("w")).collect():
            sums.setdefault(r["group"], {})[r["bin"]] = r["w"]
        for g, (prefix, need) in list(open_.items()):
            for b in sorted(sums.get(g, {})):
                if sums[g][b] >= need:
                    open_[g] = prefix << STEP | b, need
                    break
                need -= sums[g][b]
            else:
                found[g] = END
                del open_[g]
    for g, (h, need) in open_.items():  # keys of one hash: hardly ever more than one
        same = rows.where((F.col("group") == g) & (F.col("h") == h)).groupBy("key").agg(F.sum("w").alias("w")).orderBy("key").collect()
        for r in same:
            need -= r["w"]
            if need <= 0:
                found[g] = Place(h, r["key"])
                break
    return found
