"""Jobs for the command line: ``python -m tidewrit JOB ...``; each reads and writes by URI and prints one line of JSON.

Formats go by the end of a path: .csv, .json and .jsonl, and Parquet for everything else. Exit codes: 0 done, 1 refused
(a leak between splits, a tuning set that overlaps the final test, a tree without a record), 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import converters, corpus, metrics, pipeline, spans as S
from .operators.normalize import Normalization
from .sources import readers, schemas, writers

RECORDS = f"gold {schemas.SPANS}, pred {schemas.SPANS}, gold_punct array<string>, pred_punct array<string>, gold_text string, pred_text string, source_text string"
TAGGED = "id string, words array<string>, spans array<struct<start:int,end:int,type:string,boundary_conf:double,type_conf:double>>, punct array<string>"
OBSERVED = "spoken string, type string, confidence double, ok boolean"
PAIRS = "id string, spoken string, types array<string>, spans " + schemas.SPANS


class Refused(Exception):
    """A job that must not go on; its message is for the user."""


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if path.endswith((".json", ".jsonl")):
        return spark.read.schema(schema).json(path)
    return spark.read.schema(schema).parquet(path)


def write(df: DataFrame, path: str) -> None:
    if path.endswith(".csv"):
        writers.write_csv(df, path)
    elif path.endswith((".json", ".jsonl")):
        writers.write_jsonl(df, path)
    else:
        df.write.parquet(path)


def count(df: DataFrame) -> int:
    return df.count()


# --- the jobs ------------------------------------------------------------------------------------------------------------


def write_texts(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Tagged utterances to written text, with what was emitted and what a threshold stopped."""
    limits = {k: a.threshold for k in pipeline.THRESHOLDS} if a.threshold is not None else None
    out = pipeline.write(spark, read(spark, a.input, TAGGED), Normalization(spark), limits)
    shown = lambda keep: F.array_join(F.transform(F.filter(F.arrays_zip("outputs", "span_texts"), lambda x: keep(x["outputs"])), lambda x: F.concat(x["span_texts"], F.lit(" -> "), F.coalesce(x["outputs"]["normalized"], F.lit("")), F.lit(" ["), x["outputs"]["predicted_type"], F.lit("]"))), "; ")
    emitted = F.size(F.filter("outputs", lambda o: o["emitted"]))
    spoken = F.array_join("words", " ")
    table = out.select("id", spoken.alias("spoken"), "written", F.greatest(emitted, F.lit(0)).alias("n_spans"), shown(lambda o: o["emitted"]).alias("emitted"), shown(lambda o: ~o["emitted"] & o["valid"]).alias("stopped"), "skipped_reason")
    seen = writers.observed(table, rows=F.count(F.lit(1)), skipped=F.count_if(F.col("skipped_reason").isNotNull()), spans=F.coalesce(F.sum("n_spans"), F.lit(0)), changed=F.count_if(F.coalesce(F.lower(F.regexp_replace("written", r"\.$", "")) != F.col("spoken"), F.lit(False))))
    write(seen.df, a.out)
    return seen.get()


LAYOUTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bundle": lambda spark, path: converters.from_bundle(spark, readers.read_any_bundle(spark, path)),
    "split-bundle": lambda spark, path: converters.from_split_bundle(readers.read_bundle(spark, path)),
    "flat": lambda spark, path: converters.from_flat_corpus(readers.read_jsonl(spark, path, schemas.OLD_CORPUS), Normalization(spark)),
    "markup": lambda spark, path: converters.from_markup(spark, spark.read.text(path).select(F.explode(readers.harvest_lines(F.col("value"))).alias("line")).select(readers.parse_markup(F.col("line")).alias("m")).select("m.*")),
}


def convert(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Records of a layout to utterances: one table by outcome, in one pass."""
    out = LAYOUTS[a.layout](spark, a.input)
    seen = writers.write_outcomes(out, F.col("reason"), a.out, drop=("reason",))
    every = spark.read.parquet(a.out)
    reasons = {r["outcome"]: r["n"] for r in every.groupBy("outcome").agg(F.count("*").alias("n")).collect()} if seen["rows"] else {}
    return {**seen, "reasons": dict(sorted(reasons.items()))}


def splits(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Utterances to four splits that do not leak; refuses what leaks."""
    df = read(spark, a.input, schemas.UTTERANCE)
    words = F.coalesce(F.col("words"), F.split("spoken", " "))
    df = df.withColumn("signature", S.template_signature(words, F.coalesce("spans", F.array().cast(schemas.SPANS)))).withColumn("leak_key", F.coalesce("leak_key", "spoken"))
    made = corpus.build_splits(df, seed=a.seed)
    leaks = corpus.leakage(made).count()
    if leaks:
        raise Refused(f"{leaks} groups stand in more than one split")
    made.drop("signature").write.partitionBy("split").format("json" if a.out.endswith((".json", ".jsonl")) else "parquet").save(a.out)
    sizes = {r["split"]: r["n"] for r in made.groupBy("split").agg(F.count("*").alias("n")).collect()}
    return {"rows": sum(sizes.values()), "splits": dict(sorted(sizes.items()))}


def rebalance(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The base and what of the rest does not exceed the caps of its types."""
    caps = {}
    for item in a.cap:
        kind, _, n = item.partition("=")
        caps[kind] = int(n)
    base, full = read(spark, a.base, PAIRS), read(spark, a.full, PAIRS)
    out = corpus.rebalance(base, full, caps, key="spoken", seed=a.seed)
    seen = writers.observed(out, rows=F.count(F.lit(1)))
    write(seen.df, a.out)
    return {**seen.get(), "base": count(base), "full": count(full)}


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Figures of a run over its utterances, with the types to a table if one is named."""
    rows = read(spark, a.input, RECORDS)
    if a.types:
        write(metrics.run_by_type(rows), a.types)
    return metrics.run_summary(rows).first().asDict()


def tune(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Thresholds by type from observed spans, never on sentences of the final test."""
    records, final = read(spark, a.input, OBSERVED), read(spark, a.final_test, "spoken string")
    try:
        table = metrics.guarded_thresholds(records, final, low=a.least, high=a.most, min_support=a.min_support)
    except metrics.Overlap as e:
        raise Refused(str(e)) from e
    write(table, a.out)
    return {"types": count(table), "records": count(records)}


def check(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Utterances against the rules of their schema, by reason."""
    df = read(spark, a.input, schemas.UTTERANCE)
    bad = df.select(corpus.utterance_reason().alias("reason"))
    reasons = {r["reason"] or "kept": r["n"] for r in bad.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    if not reasons:
        raise Refused(f"{a.input} holds no record")
    return {"rows": sum(reasons.values()), "reasons": dict(sorted(reasons.items()))}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m tidewrit", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = p.add_subparsers(dest="job", required=True)

    def job(name: str, f: Callable, *options: tuple) -> None:
        s = jobs.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        s.set_defaults(run=f)
        for flag, kind, default in options:
            extra = {"required": True} if default is ... else {"default": default}
            s.add_argument(flag, **({"action": "append"} if kind is list else {"choices": kind} if isinstance(kind, tuple) else {"type": kind}), **extra)

    job("write", write_texts, ("--input", str, ...), ("--out", str, ...), ("--threshold", float, None))
    job("convert", convert, ("--layout", tuple(LAYOUTS), ...), ("--input", str, ...), ("--out", str, ...))
    job("splits", splits, ("--input", str, ...), ("--out", str, ...), ("--seed", int, 13))
    job("rebalance", rebalance, ("--base", str, ...), ("--full", str, ...), ("--out", str, ...), ("--cap", list, []), ("--seed", int, 13))
    job("evaluate", evaluate, ("--input", str, ...), ("--types", str, None))
    job("tune", tune, ("--input", str, ...), ("--final-test", str, ...), ("--out", str, ...), ("--least", float, 0.2), ("--most", float, 0.95), ("--min-support", int, 3))
    job("check", check, ("--input", str, ...))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """spark: a session to use; without one, one is made as spark-submit says and stopped at the end."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    own = spark is None
    spark = spark or SparkSession.builder.appName(f"tidewrit {args.job}").getOrCreate()
    try:
        result = args.run(spark, args)
    except Refused as e:
        print(json.dumps({"job": args.job, "refused": str(e)}, ensure_ascii=False), file=sys.stderr)
        return 1
    finally:
        if own:
            spark.stop()
    print(json.dumps({"job": args.job, **result}, ensure_ascii=False))
    return 0
