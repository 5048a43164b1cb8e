"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each text becomes a 128-bit fingerprint of its lower-cased words and a MinHash signature of its word shingles.
   Texts with equal words are one class; it goes on as one node, whatever the number of its rows.
2. Bands of the signature make candidate buckets. A bucket is cut into blocks by the hash of its members, so a bucket of
   any size becomes many small tasks (block against block), and no pair is ever a row.
3. In each block pair the signatures are compared a few values at a time. With a uniform prior on the similarity s,
   P(s >= t | m of n values equal) is the distribution function of Binomial(n + 1, t) at m: pairs for which it falls
   below the tolerance are dropped. A pair is handled only in the first band in which it collides.
4. The pairs that are left are verified exactly on their shingle sets, again by block pair; each block pair returns for
   each text the number of its links and one edge of a spanning forest. Distributed components give the group.

Definitions: words are runs of non-blank characters of the lower-cased text. A text of fewer than n words has one
shingle, of all its words. Null, empty and blank texts have no shingle, link with nothing and are each their own group.
Everything is decided by row: an id that occurs with several texts has each of them compared, and equal rows count once.
Rows with a null id are compared as all others; each is a document of its own, and a group's id is the least that is not
null (null, if all of them are).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, groups, kernels
from .components import components
from .scratch import Scratch, row_keys

ROWS, BANDS, BLOCK = 4, 16, 256
STEP = 16


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The least number of equal values of n for which the pair stays."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, text in kernels.lowered(b.column(3)):
                h, woff = kernels.words(*kernels.raw(text))
                g, goff = kernels.shingles(h, woff, n)
                f1, f2 = kernels.sequences(h, woff)
                own = [b.column(c).slice(lo, hi - lo) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(np.diff(woff)), kernels.fixed_binary(kernels.minhash(g, goff, ROWS * BANDS))], ["id", "h1", "h2", "f1", "f2", "n_words", "sig"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = kernels.band_keys(kernels.binary_matrix(b.column(1), np.uint32), ROWS)
        n = len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(keys.reshape(-1).view(np.int64))], ["rep", "band", "key"])


def _sides(off: np.ndarray, block: np.ndarray, first: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each group: all of one block with itself, or those across its two blocks."""
    for a, b in groups.pairs_within(off):
        ok = (first[a] == other[a]) | (block[a] != block[b])
        yield a[ok], b[ok]


def _prune(threshold: float, tolerance: float):
    least = {n: least_matches(n, threshold, tolerance) for n in range(STEP, ROWS * BANDS + 1, STEP)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups.whole_groups(batches, "gid"):
            t = t.combine_chunks()
            members = groups.one_chunk(t["rep"])
            at = np.repeat(np.arange(t.num_rows), members.value_lengths().to_numpy())
            gid, band, block, first, other = (t[c].to_numpy()[at] for c in ("gid", "band", "block", "lo", "hi"))
            rep, sig = members.flatten().to_numpy(), kernels.binary_matrix(groups.one_chunk(t["sig"]).flatten(), np.uint32)
            off = groups.bounds(gid)
            left, right = [], []
            for a, b in _sides(off, block, first, other):
                for lo in range(0, len(a), 1 << 18):
                    i, j = a[lo : lo + (1 << 18)], b[lo : lo + (1 << 18)]
                    same = np.zeros(len(i), np.int64)
                    earlier = np.zeros(len(i), bool)
                    for n in range(STEP, ROWS * BANDS + 1, STEP):
                        eq = sig[i, n - STEP : n] == sig[j, n - STEP : n]
                        whole = eq.reshape(len(i), STEP // ROWS, ROWS).all(axis=2)
                        earlier |= (whole & (np.arange((n - STEP) // ROWS, n // ROWS)[None, :] < band[i][:, None])).any(axis=1)
                        same += eq.sum(axis=1)
                        stay = (same >= least[n]) & ~earlier
                        i, j, same, earlier = i[stay], j[stay], same[stay], earlier[stay]
                    left.append(i)
                    right.append(j)
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            who = np.unique(np.concatenate([i, j]))
            start, end = np.searchsorted(i, who), np.searchsorted(i, who, "right")
            if len(who):
                offs = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(gid[who]), pa.array(rep[who]), pa.ListArray.from_arrays(pa.array(offs), pa.array(rep[j]))], ["gid", "rep", "mates"])

    return run


def intersections(g: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i]; g[off[k]:off[k + 1]] is set k, without repeats."""
    docs = np.unique(np.concatenate([a, b]))
    if len(a) < 8 * len(docs):
        return np.array([len(np.intersect1d(g[off[x] : off[x + 1]], g[off[y] : off[y + 1]], assume_unique=True)) for x, y in zip(a, b)], np.int64)
    place = {int(d): i for i, d in enumerate(docs)}
    member = np.concatenate([np.full(off[d + 1] - off[d], i) for i, d in enumerate(docs)])
    _, code = np.unique(np.concatenate([g[off[d] : off[d + 1]] for d in docs]), return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, member = code[order], member[order]
    both = np.zeros((len(docs), len(docs)), np.float64)
    width = max(1, (1 << 22) // len(docs))
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        s, e = np.searchsorted(code, [lo, lo + width])
        m = np.zeros((len(docs), width), np.float32)
        m[member[s:e], code[s:e] - lo] = 1
        both += m @ m.T
    return both[[place[int(x)] for x in a], [place[int(y)] for y in b]].astype(np.int64)


def _verify(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups.whole_groups(batches, "gid"):
            gid = t["gid"].to_numpy()
            off = groups.bounds(gid)
            total = kernels.raw(t["text"])[1]
            k = 0
            while k < len(off) - 1:  # groups of about a chunk together
                m = k + 1
                while m < len(off) - 1 and total[off[m + 1]] - total[off[k]] < 4 * kernels.CHUNK_BYTES:
                    m += 1
                yield from part(t.slice(off[k], off[m] - off[k]), off[k : m + 1] - off[k])
                k = m

    def part(t: pa.Table, off: np.ndarray) -> Iterator[pa.RecordBatch]:
        rep, copies = t["rep"].to_numpy(), t["copies"].to_numpy()
        sets, at = [], [0]
        for lo, hi, text in kernels.lowered(t["text"].combine_chunks()):
            g, goff = kernels.shingles(*kernels.words(*kernels.raw(text)), n)
            for x in range(hi - lo):
                sets.append(np.unique(g[goff[x] : goff[x + 1]]))
                at.append(at[-1] + len(sets[-1]))
        g, at = np.concatenate(sets), np.array(at)
        mates = groups.one_chunk(t["mates"])
        many = mates.value_lengths().to_numpy()
        other, moff = mates.flatten().to_numpy(), np.concatenate([[0], np.cumsum(many)])
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for lo, hi in zip(off[:-1], off[1:]):
            own = rep[lo:hi]
            order = np.argsort(own)
            a = np.repeat(np.arange(lo, hi), many[lo:hi])
            b = lo + order[np.searchsorted(own, other[moff[lo] : moff[hi]], sorter=order)]
            both = intersections(g, at, a, b)
            ok = both >= threshold * (at[a + 1] - at[a] + at[b + 1] - at[b] - both) - 1e-9
            a, b = a[ok], b[ok]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root[lo:hi] = lo + groups.forest(hi - lo, a - lo, b - lo)
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[root[some]])], ["rep", "links", "peer"])

    return run


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-5) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least id of its group), n_copies (documents of equal words, itself
    included) and n_links (other documents of similarity >= threshold, copies included). See the module for null, empty,
    repeated and very long texts."""
    return _groups(docs, scratch, id_col, text_col, n, threshold, tolerance).select("doc_id", "class_id", "n_copies", "n_links")


def _groups(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, n: int, threshold: float, tolerance: float) -> DataFrame:
    """near_duplicates() with h1, h2, which name the row, and least, which names the row of the group that stays (both null
    for rows without words)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), *row_keys(f"`{id_col}`", f"`{text_col}`"), F.col(f"`{text_col}`").alias("text"))
    sketch = scratch.keep(rows.mapInArrow(_sketch(n), "id long, h1 long, h2 long, f1 long, f2 long, n_words long, sig binary"), "sketch")
    copies = F.count_distinct("id") + F.count_if(F.col("id").isNull())
    counted = sketch.where("n_words > 0").groupBy("f1", "f2").agg(copies.alias("copies"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2"))
    classes = sketch.where("n_words > 0").groupBy("f1", "f2").agg(first.alias("least"), F.first("sig").alias("sig"))
    # written once, so that the number of a class is the same for all that read it
    classes = scratch.keep(classes.join(counted, ["f1", "f2"]).withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = classes.select("rep", "sig")
    bands = reps.mapInArrow(_bands, "rep long, band int, key long")
    full = bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = bands.join(full, "key").withColumn("blocks", F.expr(f"cast(ceil(m / {BLOCK}) as int)"))
    members = members.withColumn("block", F.expr("cast(pmod(xxhash64(rep, key), blocks) as int)"))
    # a block of about BLOCK members becomes one row before it meets the others: a bucket of m texts makes (m / BLOCK)**2 rows
    blocks = members.join(reps, "rep").groupBy("key", "band", "block", "blocks").agg(F.collect_list(F.struct("rep", "sig")).alias("x"))
    blocks = blocks.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"lo": F.least("block", "o"), "hi": F.greatest("block", "o")})
    tasks = blocks.select(F.xxhash64("key", "lo", "hi").alias("gid"), "band", "block", "lo", "hi", F.col("x.rep").alias("rep"), F.col("x.sig").alias("sig"))
    pruned = tasks.repartition("gid").sortWithinPartitions("gid").mapInArrow(_prune(threshold, tolerance), "gid long, rep long, mates array<long>")
    pruned = scratch.keep(pruned, "candidates")
    found = scratch.keep(_verified(rows, pruned, classes, scratch, n, threshold), "links")
    roots = components(found.select(F.col("rep").alias("u"), F.col("peer").alias("v")), scratch)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    grouped = scratch.keep(classes.drop("sig").join(linked, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "grouped")
    heads = scratch.keep(grouped.where("links is not null").groupBy("root").agg(F.min("least").alias("head")), "heads")
    result = grouped.join(heads, "root", "left").select("f1", "f2", "copies", F.coalesce("head", "least").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sketch.drop("sig").join(result, ["f1", "f2"], "left")
    none = F.col("n_words") == 0
    return out.select(
        F.col("id").alias("doc_id"), "h1", "h2", F.when(none, F.col("id")).otherwise(F.col("least.id")).alias("class_id"), F.when(none, 1).otherwise(F.col("copies")).cast("long").alias("n_copies"),
        F.when(none, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(~none, F.struct("least.h1", "least.h2")).alias("least"),
    )


def _verified(rows: DataFrame, pruned: DataFrame, classes: DataFrame, scratch: Scratch, n: int, threshold: float) -> DataFrame:
    """Of the candidates (gid, rep, mates) the links of each text and an edge to its peer. Only one text of each class is
    shuffled, that of its least row, and only for classes with candidates."""
    reps = pruned.select("rep").distinct()
    wanted = scratch.keep(classes.join(reps, "rep", "left_semi").select("rep", "copies", F.col("least.h1").alias("h1"), F.col("least.h2").alias("h2")), "wanted")
    level = bloom.members(wanted.select(F.col("h1").alias("h")), wanted.count())
    texts = rows.select("h1", "h2", "text")
    if level is not None:
        texts = texts.where(bloom.may_hold(level, rows.sparkSession)("h1"))
    one = wanted.join(texts, ["h1", "h2"]).dropDuplicates(["rep"]).select("rep", "copies", "text")
    return pruned.join(one, "rep").repartition("gid").sortWithinPartitions("gid").mapInArrow(_verify(n, threshold), "rep long, links long, peer long")


def keep_representatives(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-5) -> DataFrame:
    """One row of docs for each group of near duplicates: that of the least id (null ids last). Rows without words stay;
    of wholly equal rows (id and text) one stays."""
    rows = scratch.keep(_groups(docs, scratch, id_col, text_col, n, threshold, tolerance).select("h1", "h2", "least"), "rows")
    gone = rows.where("h1 <> least.h1 or h2 <> least.h2").select("h1", "h2")
    repeated = rows.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    return bloom.without(docs, gone, scratch, row_keys(f"`{id_col}`", f"`{text_col}`"), repeated)
