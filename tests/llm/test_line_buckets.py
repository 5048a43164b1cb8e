"""Which lines meet in buckets, without Spark."""

import random

import numpy as np
import pyarrow as pa

from tidewrit.llm import kernels, lines

RANGES = 8


def met(texts):
    """The sets of lines, by place, that meet."""
    place = {int(a): i for i, a in enumerate(lines._halves(lines.identities(*joined(texts)))[0])}
    blobs = [r for b in lines._pack(8, RANGES, None)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])) for r in b.to_pylist()]
    out = set()
    for k in range(RANGES):
        part = pa.RecordBatch.from_pylist([r for r in blobs if r["range"] == k], pa.schema([("range", pa.int32()), ("entries", pa.binary())]))
        found = {}
        for b in lines._buckets(lines.RANGE_BYTES)(iter([part])):
            for r in b.to_pylist():
                members = r["lines"] if "lines" in r else [r["a"]]
                found.setdefault(r["bucket"], set()).update(place[a] for a in members)
        out |= set(map(frozenset, found.values()))
    return out


def joined(texts):
    buf, offs = kernels.raw(pa.array(texts))
    return buf, offs[:-1], offs[1:]


SYLLABLES = [a + b for a in ("th", "r", "st", "n", "国", "l") for b in ("e", "an ", "ing", "ê ", "o", "at ")]


def words(r, size):
    return "".join(r.choice(SYLLABLES) for _ in range(size)).strip() + "."


def test_unlike_lines_of_a_key_do_not_meet():
    r = random.Random(3)
    texts = list(dict.fromkeys(words(r, r.randint(18, 60)) for _ in range(6000)))
    pairs = {(i, j) for group in met(texts) for i in group for j in group if i < j}
    assert len(pairs) < 11_000


def test_lines_that_differ_in_a_character_meet():
    r, texts = random.Random(4), []
    for _ in range(700):
        line = words(r, r.randint(14, 150))
        at = r.randrange(1, len(line) - 1)
        texts += [line, line[:at] + "#" + line[at + 1 :]]
    assert len(set(texts)) == len(texts) and min(map(len, texts)) >= 29
    together = {(i, i + 1) for group in met(texts) for i in group if i % 2 == 0 and i + 1 in group}
    assert len(together) == 700


def test_a_bucket_of_many_lines_stays_whole_and_a_large_range_gives_rows(monkeypatch):
    n = lines.PARTED + 50
    key, line = np.full(n, 5 << 32, np.uint64), np.arange(n, dtype=np.uint64)
    key |= np.where(line % 2, 0xFFFFFFFF, 0).astype(np.uint64)  # two kinds of sketches

    def run(many, most):
        part = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), kernels.fixed_binary(np.stack([key, line], axis=1)[:many].reshape(1, -1))], ["range", "entries"])
        return [r for b in lines._buckets(most)(iter([part])) for r in b.to_pylist()]

    whole = run(n, 1 << 20)
    assert sorted(a for r in whole for a in r["lines"]) == list(range(n)) and {r["m"] for r in whole} == {n} and len({r["bucket"] for r in whole}) == 1
    assert {(r["m"], *r["lines"]) for r in run(6, 1 << 20)} == {(3, 0, 2, 4), (3, 1, 3, 5)}
    rows = run(n, 10)
    assert sorted(r["lines"][0] for r in rows) == list(range(n)) and {r["m"] for r in rows} == {None} and len({r["bucket"] for r in rows}) == 1


def test_characters_hash_alike_wherever_they_stand():
    r = random.Random(8)
    texts = ["".join(r.choice("abc é国𝔘") for _ in range(r.choice([1, 3, 7, 8, 9, 40]))) for _ in range(60)]
    for k in (3, 5, 8):
        seen, hashes = {}, {}
        for some in (texts, texts[::-1], texts[7:9], *([t] for t in texts)):
            buf, s, e = joined(some)
            g, off = lines.shingle_lines(lines.Characters(buf), s, e, k)
            for i, t in enumerate(some):
                cut = [t[j : j + k] for j in range(max(len(t) - k + 1, 1))]
                assert len(cut) == off[i + 1] - off[i]
                for x, h in zip(cut, g[off[i] : off[i + 1]].tolist()):
                    assert seen.setdefault(x, h) == h and hashes.setdefault(h, x) == x
        g = lines.numbered(*lines.shingle_lines(lines.Characters(joined(texts)[0]), *joined(texts)[1:], k))
        assert len(np.unique(g)) == len({(x, n) for t in texts for x, n in counted([t[j : j + k] for j in range(max(len(t) - k + 1, 1))])})


def counted(cut):
    return [(x, cut[:i].count(x)) for i, x in enumerate(cut)]
