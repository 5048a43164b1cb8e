"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has the logit bias + sum of the weights of its features (lower-cased
tokens and their prefixes of 4, 5, 6 and 8 bytes, hashed); the document's probability is the noisy-or of its sentences,
1 - prod(1 - p). The weights are fitted to document labels alone, by gradient ascent on the log-likelihood of the
noisy-or, so that blame goes to the sentences that explain the label; offending_sentences() then reads them off.

The fit uses a bounded sample of labelled rows (``sample`` documents, the least hashes of their ids), each with its whole
text, as the label is that of the whole text. Tasks cut it into sentences and tokens; the driver gets the hashes of the
tokens and the features of each different token. Together the documents have at most ``most_chars`` characters: in the
order of the hashes, a document that does not fit any more is left out as a whole. Of an id with several texts the longest
is taken (then that of the least hash); of its labels, toxic. Scoring streams all whole texts through the weights, a fixed
table of 2**bits numbers. A feature counts only if at least ``min_docs`` sampled documents hold it.

Null and empty texts have no sentence and score 0. A sentence ends at . ! ? or a line break, or after 60 tokens. Without
labelled rows every score is that of the first bias, near 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import groups, kernels

PORTIONS = 8
PREFIXES = (4, 5, 6, 8)
LONGEST = 60
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def featurise(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (token x feature), offsets of sentences among tokens, offsets of texts among sentences, and the
    start and end byte of each sentence in its chunk."""
    buf, offs = kernels.raw(column)
    s, e, woff = kernels.tokens(buf, offs, kernels.TOKEN_BYTES)
    sums = kernels.prefix_sums(buf)
    cols = [kernels.slice_hashes(sums, s, e)]
    for k in PREFIXES:
        cols.append(kernels.slice_hashes(sums, s, np.minimum(s + k, e)) + kernels.U64(0x9E3779B97F4A7C15 * k % (1 << 64)))
    x = np.empty((len(s), len(cols)), np.int32)
    for i, c in enumerate(cols):
        x[:, i] = kernels.mix(c) >> kernels.U64(64 - bits)
    first = np.zeros(len(s), bool)
    if len(s):
        ends = np.concatenate([[0], np.cumsum(_ENDS[buf])])
        first[1:] = ends[s[1:]] > ends[e[:-1]]
        first[woff[:-1][np.diff(woff) > 0]] = True
        run = np.flatnonzero(first)
        place = np.arange(len(s)) - run[np.cumsum(first) - 1]
        first |= place % LONGEST == 0
    soff = np.concatenate([np.flatnonzero(first), [len(s)]])
    doff = np.searchsorted(soff[:-1], woff)
    return x, soff, doff, s[soff[:-1]], e[soff[1:] - 1] if len(s) else s


def _logits(x: np.ndarray, soff: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    if len(soff) < 2:
        return np.zeros(0)
    return bias + np.add.reduceat(weights[x].sum(axis=1, dtype=np.float64), soff[:-1])


def _sum_by(v: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(v)])
    return total[off[1:]] - total[off[:-1]]


@dataclass
class Bags:
    """Sampled documents as features. A token is a row of ``table``, so a repeated token of a chunk costs one number."""

    table: np.ndarray  # token x feature
    parts: list  # of each document with a sentence: its tokens, the offsets of its sentences among them, its label
    seen: np.ndarray  # documents that hold each feature


def gather(kept: DataFrame, bits: int = 20) -> Bags:
    """The sampled documents of bags() for the fit."""
    words = kept.select(F.explode(F.arrays_zip("words", "features")).alias("x")).select("x.words", "x.features").dropDuplicates(["words"]).toArrow().sort_by("words")
    known = words["words"].to_numpy()
    table = words["features"].combine_chunks().flatten().to_numpy().reshape(len(known), 1 + len(PREFIXES)).astype(np.int32)
    parts, seen = [], np.zeros(1 << bits, np.int32)
    for k in range(PORTIONS):  # one after the other, so that the driver holds few rows beside what it makes of them
        rows = kept.select("doc_id", "y", "tokens", "ends").where(F.pmod(F.xxhash64("doc_id"), F.lit(PORTIONS)) == k)
        b = rows.toArrow().sort_by("doc_id").combine_chunks()
        tokens, ends = (groups.one_chunk(b.column(c)) for c in (2, 3))
        token, toff = np.searchsorted(known, tokens.flatten().to_numpy()).astype(np.int32), np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy())])
        end, eoff = ends.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ends.value_lengths().to_numpy())])
        for i, y in enumerate(b.column(1).to_numpy()):
            own = token[toff[i] : toff[i + 1]]
            if len(own):
                np.add.at(seen, np.unique(table[np.unique(own)]), 1)
                parts.append((own, np.concatenate([[0], end[eoff[i] : eoff[i + 1]]]), int(y)))
    return Bags(table, parts, seen)


def fit(bags: Bags, bits: int = 20, epochs: int = 30, rate: float = 0.15, shrink: float = 5e-4, min_docs: int = 3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias from document labels. Only the features that count are fitted; the last place stands for the others."""
    parts, used = bags.parts, np.flatnonzero(bags.seen >= min_docs)
    n = len(used)
    place = np.full(1 << bits, n, np.int32)
    place[used] = np.arange(n)
    table = place[bags.table]
    weights, bias, rng = np.zeros(n + 1), -5.0, np.random.default_rng(seed)
    grad2, bias2 = np.full(n + 1, 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), 256):
            some = [parts[i] for i in order[at : at + 256]]
            x = table[np.concatenate([p[0] for p in some])]
            tok = np.concatenate([[0], np.cumsum([len(p[0]) for p in some])])
            soff = np.concatenate([[0], *(p[1][1:] + t for p, t in zip(some, tok))])
            doff = np.concatenate([[0], np.cumsum([len(p[1]) - 1 for p in some])])
            label = np.repeat(np.array([p[2] for p in some], float), np.diff(doff))
            p = 1 / (1 + np.exp(-np.clip(_logits(x, soff, weights, bias), -30, 30)))
            none = np.exp(np.repeat(_sum_by(np.log1p(-p + 1e-12), doff), np.diff(doff)))
            g = np.where(label > 0, p * none / np.maximum(1 - none, 1e-9), -p)
            gw = np.bincount(x.reshape(-1), np.repeat(np.repeat(g, np.diff(soff)), x.shape[1]), minlength=n + 1)
            gw[n] = 0
            hit = np.flatnonzero(gw)
            grad2[hit] += gw[hit] ** 2
            step = rate / np.sqrt(grad2[hit])
            w = weights[hit] + step * gw[hit]
            weights[hit] = np.sign(w) * np.maximum(np.abs(w) - step * shrink * len(some), 0)
            bias2 += g.sum() ** 2
            bias += rate / np.sqrt(bias2) * g.sum()
    out = np.zeros(1 << bits, np.float32)
    out[used] = weights[:n]
    return out, float(bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, most_chars: int) -> DataFrame:
    """(doc_id, y, text) of at most ``sample`` labelled rows that are not held out, those of the least hash of the id."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = docs.select("doc_id", "text").where("text is not null")
    sizes = docs.select("doc_id", F.length("text").alias("n")).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max("n").alias("n"), F.first("y").alias("y"), F.xxhash64("doc_id").alias("u"))
    sizes = sizes.toArrow().sort_by([("u", "ascending"), ("doc_id", "ascending")])
    fits, total = [], 0
    for n in sizes["n"].to_pylist():
        fits.append(total + n <= most_chars)
        total += n if fits[-1] else 0
    chosen = docs.sparkSession.createDataFrame(sizes.filter(pa.array(fits, pa.bool_())).select(["doc_id", "y"]))
    longest = F.max_by("text", F.struct(F.length("text"), F.xxhash64("text")))
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), longest.alias("text"))


def bags(sampled: DataFrame, bits: int = 20) -> DataFrame:
    """Of each sampled document the hashes of its tokens, the ends of its sentences among them, and its different tokens with
    their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, text in kernels.lowered(b.column(2)):
                x, soff, doff, _, _ = featurise(text, bits)
                name = np.zeros(len(x), kernels.U64)
                for i in range(x.shape[1]):
                    name = kernels.mix(name * kernels.U64(0x9E3779B97F4A7C15) + x[:, i].astype(kernels.U64))
                name = name.view(np.int64)
                rows = []
                for a, e in zip(doff[:-1], doff[1:]):
                    own = name[soff[a] : soff[e]]
                    words, first = np.unique(own, return_index=True)
                    rows.append((own, soff[a + 1 : e + 1] - soff[a], words, x[soff[a] + first].astype(np.int32)))
                columns = [pa.array([r[i].tolist() for r in rows], t) for i, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *columns], ["doc_id", "y", "tokens", "ends", "words", "features"])

    return sampled.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, tokens array<long>, ends array<int>, words array<long>, features array<array<int>>")


def train(docs: DataFrame, labels: DataFrame, keep, sample: int = 10_000, most_chars: int = 100_000_000, bits: int = 20) -> tuple[np.ndarray, float]:
    return fit(gather(keep(bags(labelled_sample(docs, labels, sample, most_chars), bits), "bags"), bits), bits)


def scorer(spark: SparkSession, model: tuple[np.ndarray, float]):
    """A function of a text column: the score, from 0 to 1, of the whole text."""
    weights, bias = model
    bits = len(weights).bit_length() - 1
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            found = [np.zeros(0)]
            for _, _, text in kernels.lowered(b):
                x, soff, doff, _, _ = featurise(text, bits)
                none = -np.logaddexp(0, _logits(x, soff, shared.value, bias))
                found.append(np.clip(-np.expm1(_sum_by(none, doff)), 0.0, 1.0))
            yield pa.array(np.concatenate(found))

    return score_of


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row, whole texts."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))


def offending_sentences(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_no, sentence in lower case, score) of the sentences that score at least the threshold alone."""
    weights, bias = model
    bits = len(weights).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, part in kernels.lowered(b.column(1)):
                x, soff, doff, s, e = featurise(part, bits)
                p = 1 / (1 + np.exp(-np.clip(_logits(x, soff, shared.value, bias), -700, 700)))
                hit = np.flatnonzero(p >= threshold)
                data, doc = kernels.raw(part)[0].tobytes(), np.searchsorted(doff, hit, "right") - 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array((hit - doff[doc]).astype(np.int32)), pa.array([data[s[i] : e[i]].decode("utf-8", "replace") for i in hit], pa.string()), pa.array(p[hit])], ["doc_id", "sentence_no", "sentence", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, sentence_no int, sentence string, score double")
