"""Verification of candidate lines by bitmaps and exact sets, without Spark."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa

from tidewrit.llm import groups, lines


def verified(texts, blocks=None):
    """The components that _verify() links one group of lines to."""
    n = len(texts)
    parts = [list(range(n))] if blocks is None else [[i for i in range(n) if blocks[i] == b] for b in (0, 1)]
    rows = [{"near": 1, "gid": 1, "lines": [{"id": i, "text": texts[i].encode()} for i in part], "block": b, "lo": 0, "hi": len(parts) - 1} for b, part in enumerate(parts)]
    schema = pa.schema([("near", pa.int64()), ("gid", pa.int64()), ("lines", pa.list_(pa.struct([("id", pa.int64()), ("text", pa.binary())]))), ("block", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
    out = list(lines._verify(8, 0.8)(iter([pa.RecordBatch.from_pylist(rows, schema=schema)])))
    u, v = (np.array([x for b in out for x in b.column(c).to_pylist()], np.int64) for c in (0, 1))
    return groups.forest(n, u, v).tolist()


def alike(x, y):
    def bag(t, k, count):
        found = Counter(t[i : i + k] for i in range(max(len(t) - k + 1, 1)))
        return found if count else Counter(set(found))

    for k, least, most in ((8, 0, 10**9), *(s[:3] for s in lines.SCALES)):
        if all(least <= len(t) <= most for t in (x, y)):
            a, b = bag(x, k, k < 8), bag(y, k, k < 8)
            if (a & b).total() >= 0.8 * (a | b).total() - 1e-9:
                return True
    return False


def test_links_equal_those_of_every_pair():
    r, links = random.Random(5), 0
    for turn in range(12):
        texts = []
        for _ in range(12):
            base = "".join(r.choice("ab é国ố𝔘cdefgh") for _ in range(r.choice([3, 8, 30, 45, 64, 100, 192, 700, 3000])))
            texts += [base, *("".join(c if r.random() > p else r.choice("xyzế") for c in base) for p in (0.003, 0.01, 0.03, 0.1))]
        texts = list(dict.fromkeys(texts))
        block = [r.randrange(2) for _ in texts] if turn % 2 else None
        ok = [(i, j) for i, j in combinations(range(len(texts)), 2) if (block is None or block[i] != block[j]) and alike(texts[i], texts[j])]
        want = groups.forest(len(texts), *(np.array(x, np.int64) for x in zip(*ok)))
        links += len(ok)
        assert verified(texts, block) == want.tolist()
    assert links > 100


def test_unlike_candidates_are_not_compared_exactly(monkeypatch):
    asked, old = [], lines.Sets.__init__
    monkeypatch.setattr(lines.Sets, "__init__", lambda self, g, line, *x: (asked.extend(np.unique(line).tolist()), old(self, g, line, *x))[1])
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("aeiounrst") for _ in range(r.randint(2, 7))) for _ in range(r.choice([6, 20, 60]))) for _ in range(200)]
    assert verified(texts) == list(range(200)) and not asked
    texts[150] = texts[20] + "."
    assert verified(texts)[150] == 20 and set(asked) == {20, 150}
