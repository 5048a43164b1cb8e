"""Normalisation as Arrow functions: one engine per Python worker, which remembers each (type, text) it has read."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogues, native
from ..functions.lexicon import SIBLINGS
from ..functions.normalizers import Engine
from ..functions.validators import VALIDATED, valid

RESULT = "normalized string, valid boolean, reason string, resolved string"
MOST_CATALOGUE = 64 << 20
_engines: dict[str, Engine] = {}


def _engine(entries: str) -> Engine:
    if entries not in _engines:
        _engines.clear()
        _engines[entries] = Engine(json.loads(entries))
    return _engines[entries]


def attempt(engine: Engine, kind: str, text: str) -> tuple:
    """The first of the type and its siblings that have validators whose form is valid; on a miss the type's own result."""
    own = None
    for k in [kind, *(s for s in SIBLINGS.get(kind, []) if s in VALIDATED)]:
        out, ok, reason = engine.normalize(k, text)
        if ok and not valid(k, out):
            ok, reason = False, f"validator: {out!r} is no {k}"
        if ok:
            return out, True, "", k
        own = own or (out, False, reason, kind)
    return own


def _each(call, kinds: pa.Array, texts: pa.Array, names: tuple[str, ...]) -> pa.Array:
    """call(kind, text) for each element of two list columns, as a list column of structs; null where either is."""
    ok = pc.and_(kinds.is_valid(), texts.is_valid())
    some, other = kinds.filter(ok), texts.filter(ok)
    found = [call(k, t) for k, t in zip(some.flatten().to_pylist(), other.flatten().to_pylist())]
    columns = list(zip(*found)) or [()] * len(names)
    values = pa.StructArray.from_arrays([pa.array(c, pa.bool_() if n == "valid" else pa.string()) for n, c in zip(names, columns)], list(names))
    many = np.zeros(len(kinds), np.int32)
    many[ok.to_numpy(zero_copy_only=False)] = some.value_lengths().to_numpy()
    offsets = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=pc.invert(ok))


class Normalization:
    """The functions over one set of catalogues: {name: {canonical: [readings]}}; a table or file of them is a parameter."""

    def __init__(self, spark: SparkSession, entries: dict[str, dict[str, list[str]]] | None = None):
        text = json.dumps(entries or catalogues.defaults(), ensure_ascii=False)
        if len(text) > MOST_CATALOGUE:
            raise ValueError("the catalogues are too large to be sent to every task; use operators.lookup on a table")
        shared = spark.sparkContext.broadcast(text)

        @F.pandas_udf(RESULT)
        def one(kind: pd.Series, text: pd.Series) -> pd.DataFrame:
            e = _engine(shared.value)
            return pd.DataFrame([attempt(e, k, t) for k, t in zip(kind, text)], columns=["normalized", "valid", "reason", "resolved"])

        @F.arrow_udf(f"array<struct<{RESULT.replace(' ', ':')}>>".replace(",:", ","))
        def many(kinds: pa.Array, texts: pa.Array) -> pa.Array:
            e = _engine(shared.value)
            return _each(lambda k, t: attempt(e, k, t), kinds, texts, ("normalized", "valid", "reason", "resolved"))

        @F.arrow_udf("array<struct<normalized:string,valid:boolean,reason:string>>")
        def parsed(kinds: pa.Array, texts: pa.Array) -> pa.Array:
            return _each(_engine(shared.value).normalize, kinds, texts, ("normalized", "valid", "reason"))

        self._one, self._many, self._parsed = one, many, parsed
        #: The function of a type and a text, for registration in SQL.
        self.function = one

    def column(self, kind: Column | str, text: Column) -> Column:
        """struct(normalized, valid, reason, resolved) of a span's text; total: nulls are invalid. A type that is given by name
        and has an expression (functions.native) needs no Python."""
        if isinstance(kind, str) and kind in native.NATIVE:
            return native.NATIVE[kind](F.coalesce(text, F.lit("")), kind)
        return self._one(F.lit(kind) if isinstance(kind, str) else kind, F.coalesce(text, F.lit("")))

    def columns(self, kinds: Column, texts: Column) -> Column:
        """The same for arrays."""
        return self._many(kinds, texts)

    def parsed(self, kinds: Column, texts: Column) -> Column:
        """For arrays, struct(normalized, valid, reason) of each type's own grammar, without its siblings and validators."""
        return self._parsed(kinds, texts)

    def distinct(self, df: DataFrame, kind: str, text: str) -> DataFrame:
        """df with the column result, each different (kind, text) being read once in the whole table: for tables whose
        values repeat across tasks. Joins back by the pair; nulls get a null result."""
        pairs = df.select(kind, text).where(f"`{kind}` is not null and `{text}` is not null").distinct()
        return df.join(pairs.withColumn("result", self.column(F.col(kind), F.col(text))), [kind, text], "left")
