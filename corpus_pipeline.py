"""A training corpus from the documents table: five stages, each reading what the one before has written.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages
decide by row, not by id: of rows that share an id, each stays or goes for its own text, and rows without an id are judged
as all others. Empty tables pass as empty ones. Columns that docs has beside those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewrit.llm import bloom, decontam, jaccard, mixing, queries, shards, toxicity
from tidewrit.llm.scratch import Scratch, row_keys


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose noisy-or of sentence scores reaches 0.3; null and empty texts stay."""
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"), Scratch(spark, "stage5").keep)
    return docs.where(toxicity.scorer(spark, model)(docs["text"]) < 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 on shingles of five words: the one of the least id. Texts without words
    stay."""
    queries.bounded_batches(spark)
    return jaccard.keep_representatives(docs, Scratch(spark, "stage9"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, exactly or edited."""
    scratch = Scratch(spark, "stage6")
    found = decontam.contamination(docs, queries.table(spark, sf_dir, "benchmark"), keep=scratch.keep)
    return bloom.without(docs, found, scratch, row_keys("doc_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of smaller sources up to 1.25 times on average."""
    return mixing.mix(docs, keep=Scratch(spark, "stage7").keep).select(docs.columns)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences at their slots of the training order: slot, shard, byte_offset, n_tokens, doc_ids, crc."""
    queries.bounded_batches(spark)
    scratch = Scratch(spark, "stage2")
    return shards.materialise(docs, f"{scratch.root}/shards", keep=scratch.keep)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_sources", mix_sources),
    ("token_id_output", write_shards),
]

#: Learned weights, alignment scores and keyed permutations have no SQL form; tests/llm compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of sf_dir."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
