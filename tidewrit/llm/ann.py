"""Nearest neighbours by low-dimensional stable projections in a kd-tree, with a chi-square stopping test.

Gaussian (2-stable) projections to m dimensions keep distances in distribution: for two vectors at distance d, the
squared distance of their projections over d**2 is chi-square with m degrees of freedom. A query takes its projected
neighbours in the order of their projected distance r, in small steps, and verifies each on the original vectors, until
chi2_m(r**2 / d_k**2) >= confidence for the next r, where d_k is the distance of the k-th best so far. The k-th true
neighbour is then missed with a probability of at most 1 - confidence and nearer ones with a smaller one; with the default
of 0.9 the recall of 10 neighbours is about 0.95 (README).

The tree has two levels. The upper one is fitted on a bounded sample (``sample`` vectors) and deals all vectors into
cells of about ``cell_rows``; each cell, a task's work, has a tree of its own over the projections of all its vectors,
whose leaves open in the order of their boxes' distance. A query is answered in its own cell first, with that d_k in the
``NEAR`` cells whose boxes are nearest, and with the better d_k in those other cells whose box passes the test. Where
vectors lie in clusters, few cells and vectors pass; of vectors without any structure about a quarter is verified.

Equal vectors are one vector in the tree. Of each only the k + 1 least ids can be in an answer, and only they are kept;
equal queries are one query. So a vector that a third of the rows hold is one row in its cell. Ties go to lesser ids.
Ids that have several vectors stand in the tree once for each, apart from ids of one vector, and a search goes on until it
has enough different ids. A cell of over four times ``cell_rows`` is dealt out to parts by hash, each with a tree of its
own, and its queries go to all of them; so what a worker holds is bounded for any number of vectors.

No part have vectors that are null, empty, all zero, of another length than most, or hold null or non-finite numbers,
and rows whose id is null. Rows with the query's id are its own, and an id is in an answer once, at the least distance of
its vectors, also to a query that has several itself. With fewer than k others all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scratch import sent

LEAF, MOST_CELLS, NEAR = 64, 32_768, 4
STEP = 48


def chi2_quantile(confidence: float, m: int) -> float:
    """For an even number m of degrees of freedom."""

    def cdf(x: float) -> float:
        term, total = 1.0, 0.0
        for i in range(m // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - exp(-x / 2) * total

    lo, hi = 0.0, 10.0 * m + 200
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < confidence else (lo, mid)
    return hi


class Tree:
    """Splits at medians of the widest dimension down to a fixed depth; every leaf's box reaches to its split planes."""

    def __init__(self, points: np.ndarray, depth: int):
        m = points.shape[1]
        self.depth, n = depth, 1 << depth
        self.dim, self.at = np.zeros(n, np.int64), np.full(n, np.inf)
        self.lo, self.hi = np.full((2 * n, m), -np.inf), np.full((2 * n, m), np.inf)
        inside = {1: np.arange(len(points))}
        for node in range(1, n):
            rows = inside.pop(node, np.zeros(0, np.int64))
            if len(rows) > 1:
                p = points[rows]
                d = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
                self.dim[node], self.at[node] = d, np.median(p[:, d])
            d, at = self.dim[node], self.at[node]
            for child, keep in ((2 * node, points[rows, d] <= at), (2 * node + 1, points[rows, d] > at)):
                self.lo[child], self.hi[child] = self.lo[node], self.hi[node]
                inside[child] = rows[keep]
            self.hi[2 * node, d], self.lo[2 * node + 1, d] = min(self.hi[2 * node, d], at), max(self.lo[2 * node + 1, d], at)
        self.lo, self.hi = self.lo[n:], self.hi[n:]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] > self.at[node])
        return node - (1 << self.depth)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each leaf's box."""
        gap = np.maximum(np.maximum(self.lo - point, point - self.hi), 0.0)
        return (gap * gap).sum(axis=1)


class Cell:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: np.ndarray):
        self.ids, self.vectors, self.projections = ids, vectors, projections
        self.tree = Tree(projections, max(0, int(np.ceil(np.log2(max(1, len(ids) / LEAF))))))
        leaf = self.tree.leaf(projections)
        self.order = np.argsort(leaf, kind="stable")
        self.off = np.searchsorted(leaf[self.order], np.arange((1 << self.tree.depth) + 1))

    def neighbours(self, point: np.ndarray, least_step: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows in the order of their projected distance, with its square: leaves open as their boxes come into reach."""
        far = self.tree.distances(point)
        leaves = np.argsort(far, kind="stable")
        rows, dist, i, step = np.zeros(0, np.int64), np.zeros(0), 0, least_step
        while i < len(leaves):
            new = np.concatenate([self.order[self.off[x] : self.off[x + 1]] for x in leaves[i : i + step]])
            gap = self.projections[new] - point
            rows, dist = np.concatenate([rows, new]), np.concatenate([dist, (gap * gap).sum(axis=1)])
            i, step = i + step, step * 2
            ready = dist <= far[leaves[i]] if i < len(leaves) else np.ones(len(dist), bool)
            near = np.flatnonzero(ready)
            near = near[np.argsort(dist[near], kind="stable")]
            yield rows[near], dist[near]
            if i < len(leaves):  # what follows is no nearer than this
                yield np.zeros(0, np.int64), far[leaves[i]][None]
            rows, dist = rows[~ready], dist[~ready]

    def nearest(self, vector: np.ndarray, point: np.ndarray, k: int, stop: float, bound: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows of the k best different ids (by distance, then id), their distances, and how many were verified; bound: of k others that
        are known."""
        rows, dist, seen = np.zeros(0, np.int64), np.zeros(0), 0

        def over(r2: float) -> bool:
            kth = min(bound, dist[k - 1]) if len(dist) >= k else bound
            return r2 > stop * kth * kth

        for new, r2 in self.neighbours(point):
            if len(r2) and over(r2[0]):
                break
            for lo in range(0, len(new), STEP):
                if over(r2[lo]):
                    return rows, dist, seen
                some = new[lo : lo + STEP]
                gap = self.vectors[some] - vector
                rows, dist = np.concatenate([rows, some]), np.concatenate([dist, np.sqrt((gap * gap).sum(axis=1))])
                best = np.lexsort((self.ids[rows], dist))
                best = best[np.sort(np.unique(self.ids[rows[best]], return_index=True)[1])[:k]]  # each id once, at its least distance
                rows, dist, seen = rows[best], dist[best], seen + len(some)
        return rows, dist, seen


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def usable(vector: Column) -> Column:
    """Whether a vector takes part, but for its length."""
    v = F.coalesce(vector, F.array().cast("array<double>"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(v) > 0) & ~F.coalesce(odd, F.lit(False)) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", m: int = 24, confidence: float = 0.9, cell_rows: int = 8192, sample: int = 100_000, seed: int = 11, *, keep) -> DataFrame:
    """query_id, rank, vec_id, score, and of the query's search verified, the number of different vectors that were looked at
    in full. is_query is a condition on the column vec_id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("vec_id is not null").where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    dims = int(sizes[0]["d"])
    rows = rows.where(F.size("v") == dims).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(seed), "v")})
    several = keep(rows.select("vec_id", "h1", "h2").distinct().groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("vec_id").alias("own")), "several")
    if not several.isEmpty():  # what such an id has in the tree is its alone
        rows = rows.join(several, F.col("vec_id") == F.col("own"), "left").withColumn("place", F.col("h2")).withColumn("h2", F.when(F.col("own").isNotNull(), F.xxhash64("h2", "own")).otherwise(F.col("h2")))
        first = Window.partitionBy("h1", "place").orderBy("vec_id")
        few = rows.where("own is not null").select("h1", "place", "h2", "vec_id").distinct().withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1).select("h1", "h2").distinct()
        rows = rows.where("own is null").unionByName(rows.where(F.col("own").isNotNull()).join(few, ["h1", "h2"], "left_semi")).drop("own", "place")
    # ids of one vector: told apart before they are ranked, so repeated rows push no other id out
    by = Window.partitionBy("h1", "h2").orderBy("vec_id")
    ids = rows.select("h1", "h2", "vec_id").distinct().withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= k + 1)
    members = keep(ids.drop("rn"), "members")
    whole = keep(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.first("v").alias("v")), "vectors")
    asked = keep(rows.where(is_query).select("h1", "h2", "vec_id").distinct(), "queries")
    queries = whole.join(asked.select("h1", "h2").distinct(), ["h1", "h2"])

    n = whole.count()
    depth = max(0, ceil(np.log2(max(1, min(n / cell_rows, MOST_CELLS, sample / 4)))))
    matrix = np.random.default_rng(seed).standard_normal((dims, m))
    part = whole.where(F.pmod(F.xxhash64(F.lit(seed + 1), "h1"), F.lit(1 << 30)) <= F.lit(float(min(1.0, sample / max(n, 1)) * (1 << 30)))).select("v").limit(2 * sample).toArrow()
    tree = Tree(_matrix(part["v"].combine_chunks(), float) @ matrix if part.num_rows else np.zeros((0, m)), depth)
    stop = chi2_quantile(confidence, m)
    with sent(spark, (tree, matrix)) as shared:
        data = keep(whole.mapInArrow(_deal(shared, 0), DEALT), "cells")
        # at most MOST_CELLS numbers; most often no cell is cut
        large = data.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 4 * cell_rows).collect()
        parts = np.ones(1 << depth, np.int64)
        for r in large:
            parts[r["cell"]] = -(-r["n"] // (2 * cell_rows))
        layout = np.concatenate([[0], np.cumsum(parts)])
        if large:
            where = spark.createDataFrame(list(enumerate(zip(layout.tolist(), parts.tolist()))), "cell long, at struct<first: long, parts: long>")
            data = keep(data.join(F.broadcast(where), "cell").withColumn("cell", F.col("at.first") + F.pmod("h1", "at.parts")).select(data.columns), "parts-of-cells")

        def ask(q: DataFrame, name: str) -> DataFrame:
            both = data.unionByName(q).repartition("cell").sortWithinPartitions("cell", "kind")
            return keep(both.mapInArrow(_answer(shared, dims, k + 1, stop), ANSWERS), name)

        found = [ask(queries.mapInArrow(_deal(shared, 1, layout), DEALT), "own-cell")]
        if depth or large:
            for name in ("near-cells", "other-cells"):
                found.append(ask(_next(found, k + 1).mapInArrow(_cells(shared, stop, NEAR if name == "near-cells" else None, layout), DEALT), name))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    verified = every.groupBy("q1", "q2").agg(F.sum("verified").alias("verified"))
    both = every.select("q1", "q2", F.explode(F.arrays_zip("h1", "h2", "ids", "dist")).alias("x")).select("q1", "q2", "x.h1", "x.h2", F.col("x.ids").alias("least"), F.col("x.dist").alias("score"))
    best = Window.partitionBy("q1", "q2")
    both = both.withColumn("r", F.row_number().over(Window.partitionBy("q1", "q2", "least").orderBy("score", "h2"))).where("r = 1")
    top = both.withColumn("r", F.row_number().over(best.orderBy("score", "least"))).where(F.col("r") <= k + 1).drop("r", "least")
    near = top.join(members, ["h1", "h2"]).withColumn("r", F.row_number().over(best.orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), "vec_id", "score")
    result = asked.withColumnRenamed("vec_id", "query_id").join(near.join(verified.toDF("h1", "h2", "verified"), ["h1", "h2"]), ["h1", "h2"]).where("query_id <> vec_id")
    result = result.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.max("verified").alias("verified"))
    result = result.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")


DEALT = "cell long, kind int, bound double, h1 long, h2 long, least long, v array<double>"
ANSWERS = "q1 long, q2 long, least long, v array<double>, cell long, verified long, h1 array<long>, h2 array<long>, ids array<long>, dist array<double>"


def _deal(shared, kind: int, layout: np.ndarray | None = None):
    """(h1, h2, least, v) to cells: as data (0) or as queries (1), these to all parts of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, matrix = shared.value
        for b in batches:
            if b.num_rows:
                cell, columns = tree.leaf(_matrix(b.column(3), float) @ matrix), b.columns
                if layout is not None:
                    parts = layout[cell + 1] - layout[cell]
                    row = pa.array(np.repeat(np.arange(len(cell)), parts))
                    cell, columns = np.repeat(layout[cell] - np.cumsum(parts) + parts, parts) + np.arange(parts.sum()), [c.take(row) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(cell), kind, np.int32)), pa.array(np.full(len(cell), np.inf)), *columns], ["cell", "kind", "bound", "h1", "h2", "least", "v"])

    return run


def _answer(shared, dims: int, k: int, stop: float):
    """Cells one after the other, each first its vectors and then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, matrix = shared.value
        now, held, cell = None, [], None
        for b in batches:
            where, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(where) != 0) | (np.diff(kind) != 0)) + 1, [len(where)]]) if len(where) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                some = b.slice(lo, hi - lo)
                v = _matrix(some.column(6), float)
                h1, h2, least = (some.column(i).to_numpy() for i in (3, 4, 5))
                if where[lo] != now:
                    now, held, cell = where[lo], [(np.zeros(0, np.int64),) * 3 + (np.zeros((0, dims)),)], None
                if kind[lo] == 0:
                    held.append((h1, h2, least, v))
                    continue
                if cell is None:
                    g1, g2, gl, gv = (np.concatenate(x) for x in zip(*held))
                    cell = Cell(gl, gv, gv @ matrix)
                bound, points = some.column(2).to_numpy(), v @ matrix
                got = [cell.nearest(v[i], points[i], k, stop, bound[i]) for i in range(len(v))]
                off = pa.array(np.concatenate([[0], np.cumsum([len(r) for r, _, _ in got])]).astype(np.int32))
                at, dist = np.concatenate([r for r, _, _ in got]).astype(np.int64), np.concatenate([d for _, d, _ in got])
                lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (g1[at], g2[at], gl[at], dist)]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in (3, 4, 5, 6)), pa.array(np.full(len(v), now)), pa.array([n for _, _, n in got], pa.int64()), *lists], ["q1", "q2", "least", "v", "cell", "verified", "h1", "h2", "ids", "dist"])

    return run


def _next(found: list[DataFrame], k: int) -> DataFrame:
    """Of each query its vector, the distance of the k-th best id so far (null if there are fewer) and the cells it was in."""
    every = found[0].select("q1", "q2", "cell", "ids", "dist")
    for x in found[1:]:
        every = every.unionByName(x.select("q1", "q2", "cell", "ids", "dist"))
    near = every.select("q1", "q2", F.explode(F.arrays_zip("ids", "dist")).alias("x")).groupBy("q1", "q2", "x.ids").agg(F.min("x.dist").alias("dist"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy("dist"))).where(F.col("r") == k).select("q1", "q2", F.col("dist").alias("bound"))
    so_far = every.groupBy("q1", "q2").agg(F.collect_set("cell").alias("been")).join(near, ["q1", "q2"], "left")
    return found[0].select("q1", "q2", "least", "v").join(so_far, ["q1", "q2"])


def _cells(shared, stop: float, most: int | None, layout: np.ndarray):
    """Queries to the cells whose boxes pass the test; to the nearest ones first, if most is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, matrix = shared.value
        parts = np.diff(layout)
        for b in batches:
            points = _matrix(b.column(3), float) @ matrix
            for i in range(b.num_rows):
                bound = b.column(5)[i].as_py()
                bound = np.inf if bound is None else bound
                far = np.repeat(tree.distances(points[i]), parts)
                cells = np.setdiff1d(np.flatnonzero(far <= (stop * bound * bound if bound < np.inf else np.inf)), b.column(4)[i].as_py())
                cells = cells[np.argsort(far[cells], kind="stable")][:most]
                if len(cells):
                    same = pa.array(np.full(len(cells), i))
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.ones(len(cells), np.int32)), pa.array(np.full(len(cells), bound)), *(b.column(c).take(same) for c in (0, 1, 2, 3))], ["cell", "kind", "bound", "h1", "h2", "least", "v"])

    return run
