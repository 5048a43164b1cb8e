"""Compound words of raw tokens, and the two layers that result."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import spans as S

MODEL = "array<struct<word:string,raw_start:int,raw_end:int>>"
LONGEST = 4


def lexicon(vocabulary: list[str]) -> set[tuple[str, ...]]:
    """Compounds of two to four syllables of a tokenizer's vocabulary (joined by _, with </w> at the end)."""
    parts = (tuple(unicodedata.normalize("NFC", v.removesuffix("</w>").lower()).split("_")) for v in vocabulary if "_" in v)
    return {p for p in parts if 2 <= len(p) <= LONGEST and all(p)}


def segmenter(spark: SparkSession, compounds: set[tuple[str, ...]], most: int = 2_000_000):
    """A function of an array of tokens that joins the longest compounds, from left to right."""
    if len(compounds) > most:
        raise ValueError("the lexicon is too large to be sent to every task")
    shared = spark.sparkContext.broadcast(compounds)

    @F.pandas_udf(MODEL)
    def segment(tokens: pd.Series) -> pd.Series:
        out = []
        for row in tokens:
            row = list(row) if row is not None else []
            low, model, i = [unicodedata.normalize("NFC", t).lower() for t in row], [], 0
            while i < len(row):
                n = next((n for n in range(min(LONGEST, len(row) - i), 1, -1) if tuple(low[i : i + n]) in shared.value), 1)
                model.append({"word": "_".join(row[i : i + n]), "raw_start": i, "raw_end": i + n - 1})
                i += n
            out.append(model)
        return pd.Series(out)

    return segment


def reversible(tokens: Column, model: Column) -> Column:
    """Whether the model words give the raw tokens back."""
    again = lambda t: F.flatten(F.transform(model, lambda m: F.slice(t, m["raw_start"] + 1, m["raw_end"] - m["raw_start"] + 1))) == t
    return S.let(tokens, again)


def pooled(vectors: Column, first: Column, last: Column, dims: int) -> Column:
    """Mean of the subword vectors first..last of a word."""
    rows = F.slice(vectors, first + 1, last - first + 1)
    total = F.aggregate(rows, F.array_repeat(F.lit(0.0), dims), lambda a, r: F.zip_with(a, r, lambda x, y: x + y))
    return F.transform(total, lambda x: x / (last - first + 1))
