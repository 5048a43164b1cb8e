"""The engine in SQL: scalar functions, table functions, and views over tables of utterances.

``register(spark)`` adds to a session
  normalize_span(type, text)        struct(normalized, valid, reason, resolved)
  valid_span(type, text)            whether a written form is one of the type
  deaccent(text), phonetic_key(text)
  tag_spans(tags)                   table (span_no, first, last) of BIOES tags
  trace_spans(words, spans)         table of one row a span: what it says, what it is written as, whether it is emitted, and why not
  text_sentences(text)              table (n, sentence)
and ``views(spark, name)`` makes, of a table or view of utterances (an id, words, spans with confidences, punct), the views
  <name>_written     with written, outputs and skipped_reason
  <name>_trace       one row a span
  <name>_emission    by type: spans, those emitted, those below their threshold, those invalid.

Table functions see one row at a time and stream; null arguments give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import catalogues, keys
from .functions import lexicon as L
from .functions.validators import valid
from .operators import pipeline
from .operators.normalize import Normalization, _engine, attempt

TRACE = "span_no int, raw_text string, start int, end int, predicted_type string, resolved_type string, boundary_conf double, type_conf double, confidence double, threshold double, normalized string, valid boolean, reason string, emitted boolean"


def _four(x: float) -> float:
    """Half away from zero, as SQL rounds."""
    return int(abs(x) * 10_000 + 0.5 + 1e-9) / 10_000 * (1 if x >= 0 else -1)


def trace_function(entries: dict[str, dict[str, list[str]]] | None = None, thresholds: dict[str, float] | None = None):
    text, limits = json.dumps(entries or catalogues.defaults(), ensure_ascii=False), pipeline.THRESHOLDS | (thresholds or {})

    class TraceSpans:
        def eval(self, words: list, spans: list) -> Iterator[tuple]:
            if words is None or spans is None:
                return
            engine = _engine(text)
            for n, s in enumerate(spans):
                if s is None or not 0 <= s["start"] <= s["end"] < len(words):
                    continue
                raw = " ".join(words[s["start"] : s["end"] + 1])
                written, ok, reason, resolved = attempt(engine, s["type"], raw)
                sure, limit = min(s["boundary_conf"], s["type_conf"]), float(limits.get(s["type"], L.DEFAULT_THRESHOLD))
                why = reason or ("below threshold" if sure < limit else None)
                yield n, raw, s["start"], s["end"], s["type"], resolved, _four(s["boundary_conf"]), _four(s["type_conf"]), _four(sure), limit, written, ok, why, ok and sure >= limit

    return F.udtf(TraceSpans, returnType=TRACE)


@F.udtf(returnType="span_no int, first int, last int")
class TagSpans:
    """Tolerant: a span that is not closed ends before what cannot go on, and one that is not opened begins where it is."""

    def eval(self, tags: list) -> Iterator[tuple]:
        n, begin = 0, None
        for i, tag in enumerate([*(tags or []), "O"]):
            kind = (tag or "O")[:1]
            if begin is not None and kind in "OBS":
                yield n, begin, i - 1
                n, begin = n + 1, None
            if kind == "S":
                yield n, i, i
                n += 1
            elif kind == "E":
                yield n, i if begin is None else begin, i
                n, begin = n + 1, None
            elif kind in "BI" and begin is None:
                begin = i


@F.udtf(returnType="n int, sentence string")
class TextSentences:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from ((n, s) for n, s in enumerate(x for x in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if x))


def register(spark: SparkSession, entries: dict[str, dict[str, list[str]]] | None = None, thresholds: dict[str, float] | None = None) -> Normalization:
    norm = Normalization(spark, entries)

    @F.pandas_udf("boolean")
    def valid_span(kind: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if k is None else valid(k, t) for k, t in zip(kind, text)], dtype="object")

    def texts(f):
        @F.pandas_udf("string")
        def of(text: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else f(t) for t in text], dtype="object")

        return of

    spark.udf.register("normalize_span", norm.function)
    spark.udf.register("valid_span", valid_span)
    spark.udf.register("deaccent", texts(keys.fold))
    spark.udf.register("phonetic_key", texts(keys.phonetic_key))
    spark.udtf.register("trace_spans", trace_function(entries, thresholds))
    spark.udtf.register("tag_spans", TagSpans)
    spark.udtf.register("text_sentences", TextSentences)
    return norm


def views(spark: SparkSession, name: str, id_col: str = "id", norm: Normalization | None = None) -> list[str]:
    written: DataFrame = pipeline.write(spark, spark.table(name), norm)
    trace = pipeline.trace(written, id_col)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    emission = trace.groupBy(F.col("predicted_type").alias("type")).agg(F.count("*").alias("spans"), count(F.col("emitted")).alias("emitted"), count(F.col("valid") & ~F.col("emitted")).alias("below_threshold"), count(~F.col("valid")).alias("invalid"))
    out = []
    for part, df in (("written", written), ("trace", trace), ("emission", emission)):
        df.createOrReplaceTempView(f"{name}_{part}")
        out.append(f"{name}_{part}")
    return out
