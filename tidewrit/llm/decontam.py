"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

1. Words are tokens of letters and digits of the lower-cased text. The n-grams of the benchmark items are counted: one pass
   over all documents finds in how many documents each occurs.
2. An n-gram is a seed of an item if it is rare, that is if it stands in at most ``most_share`` of the documents (or 20) and
   in at most ``most_items`` items, or if it is among the ``least_seeds`` rarest of its item. So n-grams of ordinary prose open
   nothing, and an item that was copied very often still has seeds.
3. A second pass looks up every document's n-grams among the seeds. Hits of one item that lie near one diagonal form a
   candidate region if at least two distinct seeds hit (one, if the item has no more) or if the rarity of the one that
   hits, ln((documents + 1) / frequency), reaches ``min_rarity``. Regions go to their items by a join.
4. Each region is aligned with the item by Smith-Waterman on words (match 2, mismatch -1, gap -1), whole batches of
   regions at once. The score is divided by that of the item with itself, so it lies in 0 to 1. A region matches if it
   reaches ``threshold``, or the score of ``LONG`` equal words however long the item is.

Tasks hold only hashes of n-grams, of blocks of about ``block_chars`` characters of items; a larger benchmark means more
blocks and passes, not a larger broadcast. Of the documents only the words of regions are shuffled.

Null or empty texts and items match nothing. An item of fewer than n words has one seed, of all its words. Very long
texts are scanned whole. Rows without an id return matches with a null id; equal rows return equal matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .scratch import row_keys, sent

MATCH, MISMATCH, GAP = 2, -1, -1
LONG = 50


def smith_waterman(items: np.ndarray, item_len: np.ndarray, regions: np.ndarray, region_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each row of words: its score, and where it ends in the item and in the region.

    Along antidiagonals, for all rows of the batch at once. Positions past a length never match.
    """
    n, m, b = items.shape[1], regions.shape[1], len(items)
    best, end_i, end_j = np.zeros(b, np.int32), np.zeros(b, np.int32), np.zeros(b, np.int32)
    ok_i = np.arange(n)[None, :] < item_len[:, None]
    before, last = np.zeros((b, n + 1), np.int32), np.zeros((b, n + 1), np.int32)
    rows = np.arange(b)
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n, d + 1)
        i = np.arange(lo, hi)
        j = d - i
        valid = ok_i[:, lo:hi] & (j[None, :] < region_len[:, None])
        same = (items[:, lo:hi] == regions[:, j]) & valid
        h = before[:, lo:hi] + np.where(same, MATCH, MISMATCH)
        np.maximum(h, last[:, lo:hi] + GAP, out=h)
        np.maximum(h, last[:, lo + 1 : hi + 1] + GAP, out=h)
        np.maximum(h, 0, out=h)
        h *= valid
        new = np.zeros((b, n + 1), np.int32)
        new[:, lo + 1 : hi + 1] = h
        k = h.argmax(axis=1)
        top = h[rows, k]
        better = top > best
        best = np.where(better, top, best)
        end_i, end_j = np.where(better, i[k], end_i), np.where(better, j[k], end_j)
        before, last = last, new
    return best, end_i, end_j


@dataclass
class Block:
    """Items as n-grams: g (sorted) with the item and the place of each occurrence."""

    id: np.ndarray  # the number of the item's text
    words: np.ndarray  # of each item
    g: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: list[int]  # lengths of the items of fewer than n words

    @staticmethod
    def of(rows: pa.Table, n: int) -> Block:
        h, woff = kernels.words(*kernels.raw(kernels.lower(rows["text"].combine_chunks())), kernels.TOKEN_BYTES)
        g, goff = kernels.shingles(h, woff, n)
        item = np.repeat(np.arange(rows.num_rows), np.diff(goff))
        place = np.arange(len(g)) - np.repeat(goff[:-1], np.diff(goff))
        order = np.argsort(g, kind="stable")
        words = np.diff(woff)
        return Block(rows["item"].to_numpy(), words, g[order], item[order], place[order], sorted({int(c) for c in words if 0 < c < n}))

    def seeds(self, frequency: np.ndarray, documents: int, most_share: float, most_items: int, least_seeds: int) -> tuple[Block, np.ndarray]:
        """The block with its rare n-grams alone, and the rarity of each of them. frequency: of np.unique(g)."""
        _, first, code = np.unique(self.g, return_index=True, return_inverse=True)
        pair = np.unique(np.stack([self.item, code], axis=1), axis=0) if len(code) else np.zeros((0, 2), np.int64)
        held_by = np.bincount(pair[:, 1], minlength=len(first))
        rare = (frequency <= max(20, most_share * documents)) & (held_by <= most_items)
        order = np.lexsort((self.g[first][pair[:, 1]], held_by[pair[:, 1]], frequency[pair[:, 1]], pair[:, 0]))
        rank = np.arange(len(order)) - np.searchsorted(pair[order, 0], pair[order, 0])
        chosen = pair[order[rank < least_seeds]] @ np.array([len(first), 1])
        use = rare[code] | np.isin(self.item * len(first) + code, chosen)
        block = Block(self.id, self.words, self.g[use], self.item[use], self.place[use], self.short)
        return block, np.log((documents + 1) / np.maximum(frequency[code[use]], 1))


def _grams(text: pa.Array, n: int, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk and each length of gram: words, their offsets, gram hashes, the text and the word of each gram."""
    for lo, hi, part in kernels.lowered(text):
        h, woff = kernels.words(*kernels.raw(part), kernels.TOKEN_BYTES)
        found = []
        for size in (n, *short):
            g, goff = kernels.shingles(h, woff, size)
            if size != n:  # a short item is one gram of its own length; it hashes as shingles() does for short texts
                g = _padded(h, woff, goff, size)
            doc = np.repeat(np.arange(hi - lo), np.diff(goff))
            found.append((g, doc, np.arange(len(g)) - goff[doc] + woff[doc]))
        yield lo, h, woff, *(np.concatenate(x) for x in zip(*found))


def _padded(h: np.ndarray, woff: np.ndarray, goff: np.ndarray, size: int) -> np.ndarray:
    many = np.diff(goff)
    at = np.repeat(woff[:-1] - goff[:-1], many) + np.arange(goff[-1])
    end = np.repeat(woff[1:], many)
    c, padded = kernels._coefficients(size), np.concatenate([h, np.zeros(size, kernels.U64)])
    total = np.zeros(len(at), kernels.U64)
    for j in range(size):
        total += np.where(at + j < end, padded[at + j], kernels.U64(0)) * c[j]
    return kernels.mix(total)


def _regions(block: Block, doc, word, k, rarity, woff, item_seeds, min_rarity):
    """Candidate regions (text, item, first word, end word) from hits: occurrences k of seeds at a word of a text."""
    if not len(doc):
        return []
    item, g = block.item[k], block.g[k]
    start = word - block.place[k]  # where the item would begin
    order = np.lexsort((start, item, doc))
    doc, item, start, g, rarity = doc[order], item[order], start[order], g[order], rarity[k][order]
    slack = np.maximum(4, block.words[item] // 2)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > slack[1:])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    by = np.lexsort((g, group))
    other = np.ones(len(by), bool)
    other[1:] = (group[by][1:] != group[by][:-1]) | (g[by][1:] != g[by][:-1])
    kinds = np.bincount(group[by][other], minlength=len(first))
    weight = np.bincount(group[by][other], rarity[by][other], minlength=len(first))
    out = []
    end = np.concatenate([first[1:], [len(doc)]]) - 1
    for x in np.flatnonzero((kinds >= np.minimum(2, item_seeds[item[first]])) | (weight >= min_rarity)):
        d, i = doc[first[x]], item[first[x]]
        pad = max(4, block.words[i] // 2)
        a, b = max(woff[d], start[first[x]] - pad), min(woff[d + 1], start[end[x]] + block.words[i] + pad)
        step = 4 * block.words[i] + 16  # long runs of hits are cut into overlapping regions
        while b - a > 2 * step:
            out.append((d, i, a, a + 2 * step))
            a += step
        out.append((d, i, a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, min_rarity: float = 6.0, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8_000_000, most_share: float = 0.01, most_items: int = 20, least_seeds: int = 8, *, keep) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) of each document and item whose best alignment reaches threshold or LONG words;
    start_word is where the aligned region begins, end_word the last aligned word of the text. h1, h2 name the row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *row_keys(f"`{id_col}`", f"`{text_col}`"), F.col(f"`{text_col}`").alias("text"))
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    # equal texts are one item, so a text that many items repeat opens one region
    texts = keep(items.groupBy("text").agg(F.collect_set("item_id").alias("item_ids"), F.count_if(F.col("item_id").isNull()).alias("no_id")).withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-(texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // block_chars))
    regions = None
    for k in range(blocks):
        block = Block.of(texts.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "text").toArrow().sort_by("item"), n)
        one = keep(_one_block(rows, block, n, min_rarity, most_share, most_items, least_seeds), "regions")
        regions = one if regions is None else regions.unionByName(one)
    aligned = regions.join(texts.select("item", F.col("text").alias("item_text")), "item").select("doc_id", "h1", "h2", "item", "item_text", "start", "words")
    found = aligned.mapInArrow(_align(threshold), "doc_id long, h1 long, h2 long, item long, score double, start_word long, end_word long")
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word")))
    found = found.groupBy("doc_id", "h1", "h2", "item").agg(best.alias("b"))
    ids = texts.select("item", F.explode(F.concat(F.col("item_ids"), F.when(F.col("no_id") > 0, F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>")))).alias("item_id"))
    return found.join(ids, "item").select("doc_id", "item_id", "b.score", "b.start_word", "b.end_word", "h1", "h2")


def _one_block(rows: DataFrame, block: Block, n: int, min_rarity: float, most_share: float, most_items: int, least_seeds: int) -> DataFrame:
    spark, grams = rows.sparkSession, np.unique(block.g)
    with sent(spark, (grams, block.short)) as shared:
        counted = rows.select("text").mapInArrow(_count(shared, n), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(grams) + 1, np.int64)
    frequency[counted["gram"].to_numpy()] = counted["n"].to_numpy()
    seeds, rarity = block.seeds(frequency[:-1], int(frequency[-1]), most_share, most_items, least_seeds)
    shared = spark.sparkContext.broadcast((seeds, rarity))
    return rows.mapInArrow(_open_regions(shared, n, min_rarity), "doc_id long, h1 long, h2 long, item long, start long, words binary")


def _count(shared, n: int):
    """In how many texts each n-gram of the block stands; the number of texts itself comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, short = shared.value
        total = np.zeros(len(grams) + 1, np.int64)
        for b in batches:
            total[-1] += b.num_rows
            for _, _, _, g, doc, _ in _grams(b.column(0), n, short):
                at = np.minimum(np.searchsorted(grams, g), max(len(grams) - 1, 0))
                hit = np.flatnonzero(grams[at] == g) if len(grams) else np.zeros(0, np.int64)
                pair = np.unique(at[hit] * np.int64(len(doc) + 1) + doc[hit]) // np.int64(len(doc) + 1)
                total += np.bincount(pair, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    return run


def _open_regions(shared, n: int, min_rarity: float):
    """Of each candidate region the item, where its words begin in the text, and the words as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rarity = shared.value
        kinds = np.unique(np.stack([block.item.astype(np.uint64), block.g], axis=1), axis=0)[:, 0].astype(np.int64) if len(block.g) else np.zeros(0, np.int64)
        item_seeds = np.bincount(kinds, minlength=len(block.id))
        for b in batches:
            for lo, h, woff, g, doc, word in _grams(b.column(3), n, block.short):
                if not len(block.g):
                    continue
                hit = np.flatnonzero(block.g[np.minimum(np.searchsorted(block.g, g), len(block.g) - 1)] == g)
                a, e = np.searchsorted(block.g, g[hit]), np.searchsorted(block.g, g[hit], "right")
                many = e - a
                k = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at = np.repeat(hit, many)
                found = _regions(block, doc[at], word[at], k, rarity, woff, item_seeds, min_rarity)
                for x in range(0, len(found), 4096):
                    d, i, p, q = np.array(found[x : x + 4096]).T
                    off = np.concatenate([[0], np.cumsum(q - p)])
                    words = h[np.repeat(p - off[:-1], q - p) + np.arange(off[-1])]
                    data = pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer((off * 8).astype(np.int32)), pa.py_buffer(words.tobytes())])
                    rows = pa.array(d + lo)
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in range(3)), pa.array(block.id[i]), pa.array(p - woff[d]), data], ["doc_id", "h1", "h2", "item", "start", "words"])

    return run


def _align(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, ioff = kernels.words(*kernels.raw(kernels.lower(b.column(4))), kernels.TOKEN_BYTES)
            buf, boff = kernels.raw(b.column(6))
            hr, roff = buf.view(np.uint64), boff // 8
            items, regions = np.diff(ioff), np.diff(roff)
            order = np.lexsort((regions, items))
            for x in range(0, len(order), 256):
                some = order[x : x + 256]
                wi, wr = _padded_rows(hi, ioff, some, 0), _padded_rows(hr, roff, some, 1)
                best, _, end = smith_waterman(wi, items[some], wr, regions[some])
                value = best / (MATCH * items[some])
                y = np.flatnonzero((value >= threshold) | (best >= MATCH * LONG))
                row, start = pa.array(some[y]), b.column(5).to_numpy()[some[y]]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in range(4)), pa.array(value[y]), pa.array(start), pa.array(start + end[y])], ["doc_id", "h1", "h2", "item", "score", "start_word", "end_word"])

    return run


def _padded_rows(h: np.ndarray, off: np.ndarray, rows: np.ndarray, fill: int) -> np.ndarray:
    size = off[rows + 1] - off[rows]
    out = np.full((len(rows), max(1, int(size.max()))), fill, np.uint64)
    inner = np.arange(out.shape[1])[None, :] < size[:, None]
    out[inner] = h[np.repeat(off[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    return out
