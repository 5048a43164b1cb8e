"""Windows of subwords over long utterances, and the choice among overlapping predictions."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

USEFUL, OVERLAP = 224, 40


def plan(counts: list[int], useful: int = USEFUL, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(first word, word behind the last, subwords). A word larger than a window has one of its own; every step advances,
    and the next window begins at the last word from which at least the overlap is shared."""
    total, out, first = [0, *accumulate(counts)], [], 0
    while first < len(counts):
        behind = max(first + 1, bisect_right(total, total[first] + useful) - 1)
        out.append((first, behind, total[behind] - total[first]))
        if behind == len(counts):
            break
        first = max(first + 1, bisect_right(total, total[behind] - overlap, 0, behind) - 1)
    return out


def _plan_all(counts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("word_start", "word_end", "subwords"), w)) for w in plan([int(x) for x in c])] if c is not None else None for c in counts])


def plan_windows(counts: Column) -> Column:
    """Array of (word_start, word_end, subwords) for an array of subword counts."""
    return F.pandas_udf(_plan_all, "array<struct<word_start:int,word_end:int,subwords:int>>")(counts)


def stitch(predictions: DataFrame, id_col: str = "id") -> DataFrame:
    """Of (id, window_no, word_start, word_end, word, value): for each word the value of the window whose centre is nearest."""
    centre = (F.col("word_start") + F.col("word_end") - 1) / 2
    by = Window.partitionBy(id_col, "word").orderBy(F.abs(F.col("word") - centre), "window_no")
    return predictions.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
