"""Words to subwords and back: byte-pair merges by rank within each word, with the places of each word's subwords.

A word is its characters, the last one with the end mark; the adjacent pair of the lowest rank is merged, wherever it
stands, until no pair of two neighbours is in the list. A subword outside the vocabulary is the unknown one, and so is an
empty or null word, so every word has at least one place. Begin and end marks of the sentence take the first and last
place. Nothing is cut: operators.windows plans windows from the counts, and pooled() makes a vector a word again.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .segment import pooled

ENCODED = "struct<ids:array<int>,words:array<struct<first:int,last:int>>>"
#: Entries of a vocabulary and merges that are sent to every task; words that a task remembers.
MOST_SENT, MOST_WORDS = 2_000_000, 500_000


class Subwords:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>", unknown: str = "<unk>", begin_mark: str | None = None, end_mark: str | None = None, lower: bool = False):
        if len(vocabulary) + len(merges) > MOST_SENT:
            raise ValueError("the vocabulary is too large to be sent to every task")
        self.vocabulary, self.rank, self.end, self.lower = vocabulary, {tuple(m): i for i, m in enumerate(merges)}, end, lower
        self.unknown = vocabulary.get(unknown, -1)
        self.around = [[vocabulary[m]] if m else [] for m in (begin_mark, end_mark)]
        self.known: dict[str | None, list[int]] = {}

    @classmethod
    def from_json(cls, text: str, **options) -> Subwords:
        """From a file of the common layout: model.vocab, model.merges and added_tokens."""
        whole = json.loads(text)
        model = whole["model"]
        vocabulary = model["vocab"] | {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        return cls(vocabulary, [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], **{"end": model.get("end_of_word_suffix") or "", "unknown": model.get("unk_token") or "<unk>"} | options)

    def pieces(self, word: str) -> list[str]:
        parts = [*word[:-1], word[-1:] + self.end]
        while len(parts) > 1:
            ranks = [self.rank.get(pair, MOST_SENT) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == MOST_SENT:
                break
            out, i = [], 0
            while i < len(parts):
                both = i + 1 < len(parts) and ranks[i] == best
                out.append(parts[i] + parts[i + 1] if both else parts[i])
                i += 1 + both
            parts = out
        return parts

    def word(self, word: str | None) -> list[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MOST_WORDS:
                self.known.clear()
            text = (word.lower() if self.lower else word) if word else ""
            found = [self.vocabulary.get(p, self.unknown) for p in self.pieces(text)] if text else [self.unknown]
            self.known[word] = found
        return found

    def rows(self, words: pa.Array) -> pa.Array:
        """Of a list column of words, the struct of ENCODED; null where it is null."""
        size = pc.fill_null(words.value_lengths(), 0).to_numpy().astype(np.int64)
        ids = [self.word(w) for w in words.flatten().to_pylist()]
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        before, after = map(len, self.around)
        woff = np.concatenate([[0], np.cumsum(size)])
        total = np.concatenate([[0], np.cumsum(many)])
        extra = before + after
        off = total[woff] + extra * np.arange(len(woff))
        first = total[:-1] - np.repeat(total[woff[:-1]], size) + before
        flat = [x for a, b in zip(woff[:-1], woff[1:]) for x in (*self.around[0], *(y for w in ids[a:b] for y in w), *self.around[1])]
        mask = words.is_null()
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat, pa.int32()))
        places = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array((first + many - 1).astype(np.int32))], ["first", "last"])
        return pa.StructArray.from_arrays([lists, pa.ListArray.from_arrays(pa.array(woff.astype(np.int32)), places)], ["ids", "words"], mask=mask)


def encoder(spark: SparkSession, subwords: Subwords):
    """A function of an array of words: struct(ids, words), words having the first and last place of each word's subwords."""
    shared = spark.sparkContext.broadcast(subwords)

    @F.arrow_udf(ENCODED)
    def encode(words: pa.Array) -> pa.Array:
        return shared.value.rows(words)

    return encode


def counts(encoded: Column) -> Column:
    """How many subwords each word has; for operators.windows.plan_windows()."""
    return F.transform(encoded["words"], lambda w: w["last"] - w["first"] + 1)


def word_vectors(encoded: Column, vectors: Column, dims: int) -> Column:
    """The mean of each word's subword vectors (one for each of ids)."""
    return F.transform(encoded["words"], lambda w: pooled(vectors, w["first"], w["last"], dims))
