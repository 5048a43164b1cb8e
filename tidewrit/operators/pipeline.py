"""From utterances with tags, types and confidences to written text and a trace row for every span.

An utterance has words (raw tokens), spans (start, end, type, boundary_conf, type_conf) and punct (a label a word); it may
have model_words (compounds joined by _) with their raw places. All steps are narrow: one Arrow call a batch reads all
spans of an utterance, the rest is native, and nothing is exploded and gathered again. Rows whose arrays do not fit
together get a skipped_reason instead of being dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from . import spans as S
from .normalize import Normalization

THRESHOLDS = {k: L.DEFAULT_THRESHOLD for k in L.TYPES} | {k: L.CRITICAL_THRESHOLD for k in [*L.CRITICAL, *L.STRICT_IDENTIFIERS]} | {k: L.CATALOGUE_THRESHOLD for k in L.CATALOGUED}


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer parts than there are, as a table of one small file does. Reading spans costs far
    more than moving them; a table of many parts is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def threshold(kind: Column, own: dict[str, float] | None = None) -> Column:
    table = THRESHOLDS | (own or {})
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, float(v)))), kind), F.lit(L.DEFAULT_THRESHOLD))


def with_gold_confidence(spans: Column) -> Column:
    """Gold spans with confidences of 1."""
    return F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["type"].alias("type"), F.lit(1.0).alias("boundary_conf"), F.lit(1.0).alias("type_conf")))


def skipped_reason(words: Column, spans: Column, punct: Column) -> Column:
    return S.let(words, spans, punct, _skipped_reason)


def _skipped_reason(words: Column, spans: Column, punct: Column) -> Column:
    n = F.size(words)
    return F.coalesce(
        F.when(words.isNull() | spans.isNull(), "no words or spans"),
        F.when(punct.isNotNull() & (F.size(punct) != n), "punctuation of another length"),
        F.when(F.exists(spans, lambda s: (s["start"] < 0) | (s["end"] >= n) | (s["start"] > s["end"])), "span out of range"),
        F.when(F.size(S.without_overlaps(spans_only(spans))) != F.size(spans), "spans overlap"),
    )


def spans_only(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["type"].alias("type")))


def render(words: Column, outputs: Column, punct: Column) -> Column:
    """outputs: (start, end, normalized, emitted). An emitted piece is protected; other words lose the _ of compounds."""
    return S.let(words, outputs, punct, _render)


def _render(words: Column, outputs: Column, punct: Column) -> Column:
    marks = F.create_map(*(F.lit(x) for k, v in L.PUNCTUATION.items() for x in (k, v)))
    mark = lambda i: F.coalesce(F.try_element_at(marks, F.coalesce(F.get(punct, i), F.lit("O"))), F.lit(""))

    def piece(w: Column, i: Column) -> Column:
        s = F.get(F.filter(outputs, lambda o: o["emitted"] & (o["start"] <= i) & (i <= o["end"])), F.lit(0))
        free = F.struct(F.replace(w, F.lit("_"), F.lit(" ")).alias("text"), F.lit(False).alias("safe"), mark(i).alias("mark"))
        fixed = F.struct(s["normalized"].alias("text"), F.lit(True).alias("safe"), mark(s["end"]).alias("mark"))
        return F.when(s.isNull(), free).when(i == s["start"], fixed)

    def shown(pieces: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            first = F.substring(p["text"], 1, 1)
            begins = (i == 0) | F.get(pieces, i - 1)["mark"].isin(".", "?")
            return F.concat(F.when(begins & ~p["safe"] & first.rlike(r"\p{L}"), F.concat(F.upper(first), F.substr(p["text"], F.lit(2)))).otherwise(p["text"]), p["mark"])

        return F.array_join(F.transform(pieces, one), " ")

    written = S.let(F.filter(F.transform(words, piece), lambda p: p.isNotNull() & (p["text"] != "")), shown)
    return F.trim(F.regexp_replace(written, " +", " "))


def write(spark: SparkSession, utterances: DataFrame, norm: Normalization | None = None, thresholds: dict[str, float] | None = None) -> DataFrame:
    """utterances with the columns outputs (one struct a span), written and skipped_reason."""
    norm = norm or Normalization(spark)
    if "punct" not in utterances.columns:
        utterances = utterances.withColumn("punct", F.lit(None).cast("array<string>"))
    # however these are made, they are made once a row
    df = S.settled(utterances, words=F.col("words"), spans=F.col("spans"), punct=F.col("punct"))
    df = df.withColumn("skipped_reason", skipped_reason(F.col("words"), F.col("spans"), F.col("punct")))
    usable = F.when(F.col("skipped_reason").isNull(), F.col("spans"))
    texts = S.let(F.col("words"), lambda words: F.transform(usable, lambda s: S.text_of(words, s["start"], s["end"])))
    df = S.settled(df, __kinds=F.transform(usable, lambda s: s["type"]), __texts=texts)
    df = df.withColumn("__found", norm.columns(F.col("__kinds"), F.col("__texts")))

    def output(s: Column, r: Column) -> Column:
        least = F.least(s["boundary_conf"], s["type_conf"])
        limit = threshold(s["type"], thresholds)
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("predicted_type"), r["resolved"].alias("resolved_type"), F.round(s["boundary_conf"], 4).alias("boundary_conf"),
            F.round(s["type_conf"], 4).alias("type_conf"), F.round(least, 4).alias("confidence"), limit.alias("threshold"), r["normalized"].alias("normalized"), r["valid"].alias("valid"),
            F.when(r["reason"] != "", r["reason"]).when(least < limit, "below threshold").alias("reason"), (r["valid"] & (least >= limit)).alias("emitted"),
        )

    df = df.withColumn("outputs", F.zip_with(F.col("spans"), F.col("__found"), output)).drop("__kinds", "__found")
    df = df.withColumn("written", F.when(F.col("skipped_reason").isNull(), render(F.col("words"), F.col("outputs"), F.col("punct"))))
    return df.withColumnRenamed("__texts", "span_texts")


def gathered_punct(punct: Column, model: Column) -> Column:
    """Labels over raw tokens, those within a model word (raw_start, raw_end) moved to its last token; its last label holds."""

    def moved(punct: Column, model: Column) -> Column:
        def one(i: Column) -> Column:
            m = F.get(F.filter(model, lambda m: m["raw_end"] == i), F.lit(0))
            label = F.try_element_at(F.filter(F.slice(punct, m["raw_start"] + 1, m["raw_end"] - m["raw_start"] + 1), lambda x: x != "O"), F.lit(-1))
            return F.coalesce(label, F.lit("O"))

        return F.transform(punct, lambda _, i: one(i))

    return S.let(punct, model, moved)


def write_gold(spark: SparkSession, annotated: DataFrame, norm: Normalization | None = None, segment=None) -> DataFrame:
    """write() with gold spans (start, end, type): every span is certain. With segment (operators.segment.segmenter) words are
    joined to compounds first: conflicts are the spans that a compound cuts, which makes the utterance skipped, and the
    punctuation within a compound goes to its end."""
    df = annotated.withColumn("conflicts", F.array().cast("array<struct<start:int,end:int,type:string>>"))
    if segment is not None:
        df = S.settled(df, words=F.col("words"), spans=F.col("spans"), punct=F.col("punct")).withColumn("__model", segment("words"))
        cut = S.let(F.col("spans"), F.col("__model"), lambda spans, model: F.filter(F.zip_with(spans, S.project(spans, model), lambda s, p: F.struct(s.alias("s"), p["conflict"].alias("bad"))), lambda x: x["bad"]))
        conflicts = F.transform(cut, lambda x: F.struct(x["s"]["start"].cast("int").alias("start"), x["s"]["end"].cast("int").alias("end"), x["s"]["type"].alias("type")))
        df = df.withColumns({"conflicts": conflicts, "punct": gathered_punct(F.col("punct"), F.col("__model"))}).drop("__model")
    out = write(spark, df.withColumn("spans", with_gold_confidence(F.col("spans"))), norm)
    bad = F.size("conflicts") > 0
    out = out.withColumns({"skipped_reason": F.when(bad, "a compound cuts a span").otherwise(F.col("skipped_reason")), "written": F.when(~bad, F.col("written"))})
    return out.withColumn("spans", spans_only(F.col("spans")))


def trace(written: DataFrame, id_col: str = "id") -> DataFrame:
    """One row a span: id, span_no, raw_text and the fields of outputs."""
    rows = written.select(id_col, "span_texts", F.posexplode("outputs").alias("span_no", "o"))
    return rows.select(id_col, "span_no", F.get("span_texts", F.col("span_no")).alias("raw_text"), "o.*")
