"""Ranked lexical search by per-term geometric blocking.

1. A first pass counts documents, terms and, for each term of the items, the documents that hold it; only these counts
   reach the driver, and they are as many as the items have terms.
2. Every task makes an index of its own documents, a segment at a time: the vectors of impacts (what a term adds to the
   score of a document) and the posting list of each term. A posting list is cut into blocks of similar documents: some
   of its documents are centres, and each goes to the centre that is nearest by projections of the vectors. A block has a
   summary, the greatest impact of each term among its documents; it holds the terms that stand in an item beside the
   list's own, as no other item asks this list. Lists are cut when an item first needs them.
3. An item reads the lists of its terms from the greatest impact down, and ends when what the remaining lists could add
   together is below the k-th best score so far. A block is skipped only if the sum of its summary over the item's terms
   is below that score; the documents of other blocks are scored exactly. So nothing that is among the best is lost, and
   the best so far carry over from segment to segment.
4. Each task gives k documents an item at most, and these are ranked together.

A term weighs floor(1000 ln((2N + 2) / (2 df + 1))), N being the documents with a term; a document of n terms has length
m = 10 + (90 n N) div L, L being all terms; a term that it holds tf times adds weight * ((10^9 tf) div (1000 tf + 8 m)).
Sums are of integers; those that 64 bits might not hold are made of longer ones.

Items are worked on in blocks of ``block_chars`` characters, each a pass over the documents, so what is sent to every task
is bounded. Terms are compared by a hash of 64 bits and their length; such of over 512 bytes by their bytes too. Long
texts are read in slices. Null and empty texts have no terms: such documents are never found and such items find none.
Rows that share an item's id are one item with the terms of all. Every row of documents is a document of its own, whether
or not its id repeats; a null id comes after all others among equal scores. Empty tables give an empty result. Columns
other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .groups import bounds
from .scratch import sent

SLICE, LONG_TERM = 1 << 20, 512
#: A segment ends with so many documents or postings.
SEGMENT_DOCS, SEGMENT_POSTINGS = 8192, 1 << 20
#: Documents of a block, on average, and numbers of a projection.
BLOCK, DIMENSIONS = 24, 16


def lowered(buf: np.ndarray) -> np.ndarray:
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


@dataclass
class Items:
    """The items of a block and their terms, numbered in the order of the terms' hashes."""

    ids: list
    hash: np.ndarray
    size: np.ndarray
    long: dict[int, bytes]
    off: np.ndarray  # of each item among terms
    terms: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    documents: int = 0
    length: int = 0

    @classmethod
    def of(cls, ids: list, texts: list[list[str]]) -> Items:
        """ids and the texts of each."""
        found: dict[bytes, int] = {}
        each = []
        for own in texts:
            buf, offs = kernels.raw(pa.array(own, pa.string()))
            low = lowered(buf)
            s, e, _ = kernels.tokens(low, offs, kernels.TOKEN_BYTES)
            data = low.tobytes()
            each.append({found.setdefault(data[a:b], len(found)) for a, b in zip(s.tolist(), e.tolist())})
        term = list(found)
        sizes = np.array([len(t) for t in term], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        h = kernels.slice_hashes(kernels.prefix_sums(np.frombuffer(b"".join(term), np.uint8)), ends[:-1], ends[1:]) if term else np.zeros(0, np.uint64)
        order = np.argsort(h)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        terms = [np.sort(number[list(x)]) for x in each]
        long = {int(number[i]): t for i, t in enumerate(term) if len(t) > LONG_TERM}
        return cls(ids, h[order], sizes[order], long, np.cumsum([0, *map(len, terms)]), np.concatenate([np.zeros(0, np.int64), *terms]))

    def weigh(self, df: np.ndarray, documents: int, length: int) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        self.documents, self.length = documents, length

    def hits(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows i to j, how many terms each has, and the row (from i) and the number of each of the items' terms in them."""
        buf, offs = kernels.raw(column)
        for i, j in kernels.chunks(offs, SLICE):
            n, rows, terms = np.zeros(j - i, np.int64), [], []
            for part, off, first in _slices(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                low = lowered(part)
                s, e, woff = kernels.tokens(low, off, kernels.TOKEN_BYTES)
                n[first : first + len(off) - 1] += np.diff(woff)
                if not len(s) or not len(self.hash):
                    continue
                h = kernels.slice_hashes(kernels.prefix_sums(low), s, e)
                at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
                hit = np.flatnonzero((self.hash[at] == h) & (self.size[at] == e - s))
                if self.long:
                    data = low.tobytes()
                    hit = np.array([x for x in hit.tolist() if int(at[x]) not in self.long or data[s[x] : e[x]] == self.long[int(at[x])]], np.int64)
                rows.append(np.searchsorted(woff, hit, "right") - 1 + first)
                terms.append(at[hit])
            yield i, j, n, np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *terms])


def _slices(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The texts, or parts of a long text that end where no term goes on: bytes, offsets, and the first text's number."""
    if len(offs) != 2 or len(buf) <= 2 * SLICE:
        yield buf, offs, 0
        return
    at = 0
    while at < len(buf):
        end = min(len(buf), at + SLICE)
        while end < len(buf):  # a term of any length stays whole
            stop = np.flatnonzero(~kernels.TOKEN_BYTES[buf[end : end + SLICE]])
            end = min(len(buf), end + (int(stop[0]) if len(stop) else SLICE))
            if len(stop):
                break
        yield buf[at:end], np.array([0, end - at]), 0
        at = end


class Segment:
    """Documents as vectors of impacts, and the posting lists of their terms."""

    def __init__(self, items: Items, ids: np.ndarray, no_id: np.ndarray, off: np.ndarray, terms: np.ndarray, impacts: np.ndarray, projections: np.ndarray):
        self.items, self.ids, self.no_id, self.off, self.terms, self.impacts = items, ids, no_id, off, terms, impacts
        doc = np.repeat(np.arange(len(ids)), np.diff(off))
        order = np.argsort(terms, kind="stable")
        self.docs, lists = doc[order], bounds(terms[order])
        self.list_of = {int(t): k for k, t in enumerate(terms[order][lists[:-1]])}
        self.lists = lists
        self.most = dict(zip(self.list_of, np.maximum.reduceat(impacts[order], lists[:-1]).tolist())) if len(terms) else {}
        flat = np.concatenate([np.zeros((1, DIMENSIONS), np.float32), np.cumsum(projections[terms] * np.sqrt(impacts)[:, None], axis=0, dtype=np.float64)])
        self.place = flat[off[1:]] - flat[off[:-1]]
        self.place /= np.maximum(np.linalg.norm(self.place, axis=1, keepdims=True), 1e-9)
        self.cut: dict[int, tuple] = {}

    def vectors(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of these documents, and the offset of each document among them."""
        n = self.off[docs + 1] - self.off[docs]
        ends = np.concatenate([[0], np.cumsum(n)])
        return np.repeat(self.off[docs] - ends[:-1], n) + np.arange(ends[-1]), ends

    def blocks(self, term: int, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a term's list: documents block by block, the blocks' offsets, and their summaries over the terms beside it."""
        if term not in self.cut:
            k = self.list_of[term]
            docs = self.docs[self.lists[k] : self.lists[k + 1]]
            many = -(-len(docs) // BLOCK)
            if many > 1:
                centres = self.place[docs[np.linspace(0, len(docs) - 1, many).astype(np.int64)]]
                nearest = np.concatenate([np.argmax(self.place[docs[a : a + 1024]] @ centres.T, axis=1) for a in range(0, len(docs), 1024)])
                order = np.argsort(nearest, kind="stable")
                docs, off = docs[order], bounds(nearest[order])
            else:
                off = np.array([0, len(docs)])
            at, ends = self.vectors(docs)
            column = np.searchsorted(beside, self.terms[at])
            column[column == len(beside)] = 0
            some = np.flatnonzero(beside[column] == self.terms[at])
            block = np.repeat(np.repeat(np.arange(len(off) - 1), np.diff(off)), np.diff(ends))[some]
            summary = np.zeros((len(off) - 1, len(beside)), np.int64)
            np.maximum.at(summary, (block, column[some]), self.impacts[at[some]])
            self.cut[term] = docs, off, summary
        return self.cut[term]


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        self.rows = [(np.zeros(0, np.int64),) * 3 for _ in items.ids]  # score, without id, id
        asked = np.repeat(np.arange(len(items.ids)), np.diff(items.off))
        order = np.argsort(items.terms, kind="stable")
        self.by_term, self.term_off = asked[order], np.searchsorted(items.terms[order], np.arange(len(items.hash) + 1))
        self.near: dict[int, np.ndarray] = {}

    def beside(self, term: int) -> np.ndarray:
        """The terms of the items that have this term."""
        if term not in self.near:
            own = self.by_term[self.term_off[term] : self.term_off[term + 1]]
            self.near[term] = np.unique(np.concatenate([self.items.terms[self.items.off[i] : self.items.off[i + 1]] for i in own.tolist()]))
        return self.near[term]

    def read(self, segment: Segment) -> None:
        wanted, column = np.zeros(len(self.items.hash), bool), np.zeros(len(segment.ids), bool)
        for i in range(len(self.items.ids)):
            terms = self.items.terms[self.items.off[i] : self.items.off[i + 1]]
            lists = sorted((-segment.most[t], t) for t in terms.tolist() if t in segment.most)
            if not lists:
                continue
            wanted[terms] = True
            rest, touched = -sum(m for m, _ in lists), []
            for most, t in lists:
                least = int(self.rows[i][0][-1]) if len(self.rows[i][0]) == self.k else 1
                if rest < least:
                    break
                rest += most
                docs, off, summary = segment.blocks(t, beside := self.beside(t))
                above = summary[:, np.searchsorted(beside, terms)].sum(axis=1) >= least
                docs = docs[np.repeat(above, np.diff(off))]
                docs = docs[~column[docs]]  # not scored before
                if not len(docs):
                    continue
                column[docs] = True
                touched.append(docs)
                at, ends = segment.vectors(docs)
                score = np.add.reduceat(np.where(wanted[segment.terms[at]], segment.impacts[at], 0), ends[:-1])
                good = score >= least
                docs, score = docs[good], score[good]
                if len(docs):
                    s, n, d = (np.concatenate(x) for x in zip(self.rows[i], (score, segment.no_id[docs], segment.ids[docs])))
                    order = np.lexsort((d, n, -s))[: self.k]
                    self.rows[i] = s[order], n[order], d[order]
            wanted[terms] = False
            for docs in touched:
                column[docs] = False


def _long_ints(items: Items, n: np.ndarray) -> np.ndarray:
    """Lengths m of documents of n terms."""
    if len(n) and 90 * int(n.max()) * items.documents >= 1 << 63:
        return np.array([10 + 90 * int(x) * items.documents // items.length for x in n], np.int64)
    return 10 + 90 * n * items.documents // max(1, items.length)


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        total = np.zeros(len(items.hash) + 2, np.int64)  # the last two: documents, terms
        for b in batches:
            for _, _, n, row, term in items.hits(b.column(0)):
                pair = np.unique(row * np.int64(len(items.hash) + 1) + term) % np.int64(len(items.hash) + 1)
                where, many = np.unique(pair, return_counts=True)
                total[where] += many
                total[-2:] += int((n > 0).sum()), int(n.sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    return run


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        best, held, postings = Best(items, k), [], 0
        # projections of terms follow from their hashes, so they are the same in every task
        bits = kernels.mix(items.hash[:, None] + np.arange(DIMENSIONS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        projections = (bits >> np.uint64(63)).astype(np.float32) * 2 - 1

        def flush() -> None:
            ids, no_id, many, terms, impacts = (np.concatenate(x) for x in zip(*held))
            best.read(Segment(items, ids, no_id, np.concatenate([[0], np.cumsum(many)]), terms, impacts, projections))
            held.clear()

        for b in batches:
            doc_ids = b.column(0)
            null, ids = doc_ids.is_null().to_numpy(zero_copy_only=False), doc_ids.fill_null(0).to_numpy()
            for i, j, n, row, term in items.hits(b.column(1)):
                heavy = items.weight[term] > 0
                width = np.int64(max(1, len(items.hash)))
                pair, tf = np.unique(row[heavy] * width + term[heavy], return_counts=True)
                row, term = pair // width, pair % width
                impact = items.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * _long_ints(items, n)[row]))
                some, many = np.unique(row, return_counts=True)
                if len(some):
                    held.append((ids[i:j][some], null[i:j][some], many, term, impact))
                    postings += len(term)
                if sum(len(x[0]) for x in held) >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                    flush()
                    postings = 0
        if held:
            flush()
        for at, (score, no_id, doc) in enumerate(best.rows):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), at)), pa.array([items.ids[at]] * len(score), pa.int64()), pa.array(doc, pa.int64(), mask=no_id.astype(bool)), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    return run


def rank(docs: DataFrame, benchmark: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8_000_000, *, keep) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 of each item, equal ones by ascending id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    asked = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    blocks = max(1, -(-(asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // block_chars))
    out = None
    for part in range(blocks):
        held: dict = {}
        for item, text in zip(*(c.to_pylist() for c in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == part).toArrow().columns)):
            held.setdefault(item, []).append(text)
        items = Items.of(list(held), list(held.values()))
        with sent(spark, items) as shared:
            counted = rows.select("text").mapInArrow(_count(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(len(items.hash) + 2, np.int64)
        total[counted["term"].to_numpy()] = counted["n"].to_numpy()
        items.weigh(total[:-2], int(total[-2]), int(total[-1]))
        with sent(spark, items) as shared:
            found = rows.mapInArrow(_search(shared, k), "item long, item_id long, doc_id long, score long")
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            best = keep(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "best")
        out = best if out is None else out.unionByName(best)
    return out
