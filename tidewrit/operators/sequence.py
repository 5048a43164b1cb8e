"""A linear-chain model with BIOES constraints over emissions: best path, marginals, partition, and confidences.

Emissions are arrays of T rows of five scores in the order O, B, I, E, S. Utterances of a batch are padded and advance
together; padding never changes a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import NEXT

TAGS = "OBIES"
PENALTY = -1e4
LEGAL = np.array([[0.0 if b in NEXT[a] else PENALTY for b in TAGS] for a in TAGS])
START = np.array([0.0 if t in "OBS" else PENALTY for t in TAGS])
STOP = np.array([0.0 if t in "OES" else PENALTY for t in TAGS])


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def pad(batch: list) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(e) for e in batch])
    out = np.zeros((len(batch), max(1, size.max(initial=0)), len(TAGS)))
    for i, e in enumerate(batch):
        if len(e):
            out[i, : len(e)] = np.stack([np.asarray(r, float) for r in e])
    return out, size


def forward(e: np.ndarray, size: np.ndarray, step=None) -> np.ndarray:
    """Log-sums of all paths to each position and tag."""
    move = LEGAL if step is None else LEGAL + step
    a = np.zeros_like(e)
    a[:, 0] = START + e[:, 0]
    for t in range(1, e.shape[1]):
        new = logsumexp(a[:, t - 1, :, None] + move[None], 1) + e[:, t]
        a[:, t] = np.where((t < size)[:, None], new, a[:, t - 1])
    return a


def partition(e: np.ndarray, size: np.ndarray) -> np.ndarray:
    return logsumexp(forward(e, size)[:, -1] + STOP, 1)


def marginals(e: np.ndarray, size: np.ndarray) -> np.ndarray:
    a = forward(e, size)
    b = np.zeros_like(e)
    for t in range(e.shape[1] - 1, -1, -1):
        last = (t == size - 1)[:, None]
        ahead = logsumexp(LEGAL[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2) if t + 1 < e.shape[1] else np.zeros_like(b[:, t])
        b[:, t] = np.where(last, STOP, ahead)
    z = logsumexp(a[:, -1] + STOP, 1)
    return np.exp(a + b - z[:, None, None])


def viterbi(e: np.ndarray, size: np.ndarray) -> list[list[int]]:
    best, came = START + e[:, 0], []
    for t in range(1, e.shape[1]):
        through = best[:, :, None] + LEGAL[None]
        came.append(through.argmax(axis=1))
        best = np.where((t < size)[:, None], through.max(axis=1) + e[:, t], best)
    last, out = (best + STOP).argmax(axis=1), []
    for i, n in enumerate(size):
        path = [int(last[i])] if n else []
        for t in range(n - 2, -1, -1):
            path.append(int(came[t][i, path[-1]]))
        out.append(path[::-1])
    return out


def score(e: np.ndarray, path: list[int]) -> float:
    return float(START[path[0]] + STOP[path[-1]] + sum(e[t, k] for t, k in enumerate(path)) + sum(LEGAL[a, b] for a, b in zip(path, path[1:])))


def _best_tags(emissions: pd.Series) -> pd.DataFrame:
    e, size = pad([x if x is not None else [] for x in emissions])
    p, paths = marginals(e, size), viterbi(e, size)
    return pd.DataFrame({"tags": [[TAGS[k] for k in path] for path in paths], "confidence": [[float(p[i, t, k]) for t, k in enumerate(path)] for i, path in enumerate(paths)]})


def best_tags(emissions: Column) -> Column:
    """The best legal tags and the marginal probability of each."""
    return F.pandas_udf(_best_tags, "tags array<string>, confidence array<double>")(emissions)


def boundary_confidence(confidence, start, end):
    """The least marginal of a span's tags."""
    return F.array_min(F.slice(confidence, start + 1, end - start + 1))


def type_confidence(logits, start, end, n_types: int):
    """(type number, probability) from the mean of a span's type logits."""
    rows = F.slice(logits, start + 1, end - start + 1)
    total = F.aggregate(rows, F.array_repeat(F.lit(0.0), n_types), lambda a, r: F.zip_with(a, r, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / (end - start + 1))
    top = F.array_max(mean)
    z = F.aggregate(mean, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.struct((F.array_position(mean, top) - 1).cast("int").alias("type"), (1 / z).alias("probability"))
