"""Fuzzy line de-duplication: one line of each component of similar lines stays.

Lines are the parts of a text between line feeds, lower-cased and without blanks at their ends; blank lines stay as they
are. Two lines are linked if the Jaccard similarity of their sets of ``k``-character shingles is at least ``threshold``
(a line of fewer characters is one shingle). As one changed character costs ``k`` shingles, shorter lines are also linked
by shorter shingles: two lines whose lengths both lie within the limits of one of ``SCALES``, if the similarity of their
bags of its shingles is at least ``threshold``. At 0.8 any two lines of 29 to 192 characters that differ in one character
are linked, longer ones by ``k`` = 8. Equal lines are one line from the start, by a 128-bit hash.

1. One pass numbers all lines by hash; per distinct line the least place (doc_id, line_no) and the count are kept.
2. A second pass signs lines by MinHash, for each length of shingles that holds for them. Each key of a band has a sketch
   beside it, 32 bits of other bands' values, and lines of one key meet only if few of these differ; a pair of similarity
   0.8 is missed with a probability of at most 1e-5. Lines that occur very often (their number is bounded) are signed once, from one
   occurrence, all others where they stand. The keys of bands, with a hash of the line, are packed by key range into blobs,
   so the shuffle moves 16 bytes a key and few rows. A key range finds its buckets by one sort and parts them into lines
   that sketches connect (a bucket of more than ``PARTED`` lines stays whole); a range that is larger than
   ``RANGE_BYTES`` because of a bucket of very many lines passes its keys on as rows, which Spark then groups. Only buckets
   of two or more different lines go on, and buckets with the same members are one.
3. A bucket is cut into blocks of bounded length, a block is one row when it meets another, and a task verifies the pairs of
   two blocks exactly on the lines' texts, which a third pass fetches for the candidates alone. Bitmaps of the lines' shingles
   bound a pair's similarity from above; where that bound allows a link, the sets are compared. A line is compared with
   those of its block that it is not yet linked to through others; the task returns a spanning forest, never pairs.
4. Distributed union-find joins the forests. Of each component the line of the least place stays.

Rows without an id take no part and keep all their lines. Of rows that share an id each is judged for its own text, as its
lines have their places in it; rows of one id and one text are one document. Null and
empty texts have no line. Very long lines are signed and verified whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, groups, kernels
from .components import components
from .scratch import Scratch, sent

ROWS, BANDS, DIFFER, BLOCK = 3, 17, 11, 1024
#: Characters of the lines of a block; bytes of the keys of a range; lines that may count as very frequent.
BLOCK_CHARS, RANGE_BYTES, MOST_FREQUENT, LEAST_FREQUENT = 1 << 19, 64 << 20, 1_000_000, 1000
#: Characters of a shingle, least and most characters of a line, rows, bands, and the bits that sketches of similar lines
#: differ in at most. The shorter the shingles, the more unlike lines share some, so the more rows. At 0.8 bands alone
#: miss 5.0e-6 of the pairs for ``k``, 9.6e-6 for 3 and 9.2e-6 for 5; in simulations sketches made these 6.8e-6, 9.7e-6, 9.5e-6.
SCALES = ((3, 29, 64, 6, 38, 10), (5, 49, 192, 4, 22, 11))
PACK = 4 << 20
#: Of the polynomials that shingles are hashed by.
BASE = 0xC2B2AE3D27D4EB4F
#: The scale of a key is its remainder by this power of two.
SCALE_KEYS = 4
#: Most lines of a bucket whose sketches are compared with each other.
PARTED = 256
#: Bits of a line's bitmap; pairs that bitmaps are compared of at a time.
SKETCH, PAIRS = 1024, 1 << 15


def split(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines that are not blank: the text and the number in it, the first and the end byte."""
    n = len(offs) - 1
    feed = np.flatnonzero(buf == 10)
    text_of_feed = np.searchsorted(offs, feed, "right") - 1
    s = np.concatenate([offs[:-1], feed + 1])
    text = np.concatenate([np.arange(n), text_of_feed])
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    per = np.bincount(text, minlength=n) if n else np.zeros(0, np.int64)
    e = np.append(s[1:] - 1, len(buf))
    last = np.cumsum(per) - 1
    e[last] = offs[1:]
    number = np.arange(len(s)) - np.repeat(last + 1 - per, per)
    black = np.flatnonzero(buf > 32)
    a, b = np.searchsorted(black, s), np.searchsorted(black, e)
    some = b > a
    return text[some], number[some], black[a[some]], black[b[some] - 1] + 1


class Characters:
    """The characters of a chunk as numbers made of their bytes, and how many stand before a byte."""

    def __init__(self, buf: np.ndarray):
        code, lead = buf.astype(np.uint64), np.flatnonzero(buf >= 0xC0)
        for j, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            lead = lead[buf[lead] >= least]
            code[lead] |= buf[np.minimum(lead + j, len(buf) - 1)].astype(np.uint64) << kernels.U64(8 * j)
        self.at = np.flatnonzero((buf & 0xC0) != 0x80)
        self.code = code[self.at] if len(self.at) < len(buf) else code

    def before(self, byte: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, byte)

    def hashes(self, k: int) -> np.ndarray:
        """A polynomial of the k characters from each character on that has so many."""
        h, size = self.code, 1
        for bit in f"{k:b}"[1:]:
            h = h[:-size] * kernels.U64(pow(BASE, size, 1 << 64)) + h[size:]
            size *= 2
            if bit == "1":
                h = h[:-1] * kernels.U64(BASE) + self.code[size:]
                size += 1
        return h


def shingle_lines(chars: Characters, s: np.ndarray, e: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-character shingles of lines [s, e), which follow each other, and the offset of each line among them."""
    a, b, n = chars.before(s), chars.before(e), len(chars.code)
    many = np.maximum(b - a - k + 1, 1)
    off = np.concatenate([[0], np.cumsum(many)])
    if 2 * off[-1] > n >= k:  # shingles from all characters on, of which those within lines are taken
        runs = np.empty(2 * len(s) + 1, np.int64)
        runs[0], runs[1::2], runs[2:-1:2] = a[0], many, a[1:] - a[:-1] - many[:-1]
        runs[-1] = n - a[-1] - many[-1]
        within = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
        h = chars.hashes(k)
        if within[len(h) :].any():
            h = np.concatenate([h, np.zeros(n - len(h), np.uint64)])
        g = h[within[: len(h)]]
    else:
        at = np.repeat(a - off[:-1], many) + np.arange(off[-1])
        g = chars.code[at]
        for j in range(1, k):
            g *= kernels.U64(BASE)
            g += chars.code[np.minimum(at + j, n - 1)]
    short = np.flatnonzero(b - a < k)
    if len(short):
        at, size, h = a[short], (b - a)[short], np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            h = np.where(j < size, h * kernels.U64(BASE) + chars.code[np.minimum(at + j, n - 1)], h)
        g[off[:-1][short]] = h
    g ^= g >> kernels.U64(32)
    g *= kernels.U64(0x94D049BB133111EB)
    return g, off


def numbered(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The shingles of each line, those that repeat told apart by their number: sets of them are bags of shingles."""
    if not len(g):
        return g
    order, new = kernels.ascending(kernels.mix(g + np.repeat(np.arange(len(off) - 1, dtype=np.uint64) * kernels.U64(0xD6E8FEB86659FD93), np.diff(off))))
    again = np.flatnonzero(~new)
    run = np.flatnonzero(np.concatenate([[True], again[1:] != again[:-1] + 1])) if len(again) else again
    number = np.arange(1, len(again) + 1) - np.repeat(run, np.diff(np.append(run, len(again))))
    out, at = g.copy(), order[again + 1]
    out[at] = kernels.mix(g[at] + number.astype(np.uint64) * kernels.U64(0x9E3779B97F4A7C15))
    return out


def fitting(chars: Characters, s: np.ndarray, e: np.ndarray, least: int, most: int) -> np.ndarray:
    """The lines [s, e) of least to most characters."""
    length = chars.before(e) - chars.before(s)
    return np.flatnonzero((length >= least) & (length <= most))


def scales(chars: Characters, s: np.ndarray, e: np.ndarray, k: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ``k`` and each of SCALES: its number, rows, bands, which lines it holds for, their shingles and offsets."""
    yield 0, ROWS, BANDS, np.arange(len(s)), *shingle_lines(chars, s, e, k)
    for scale, (size, least, most, rows, bands, _) in enumerate(SCALES, 1):
        some = fitting(chars, s, e, least, most)
        if size < k and len(some):
            g, off = shingle_lines(chars, s[some], e[some], size)
            yield scale, rows, bands, some, numbered(g, off), off


def _chunks(text: pa.Array, most: int = kernels.CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for lo, _, part in kernels.lowered(text, most):
        yield lo, *kernels.raw(part)


def identities(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[bytes]:
    """16 bytes for each line."""
    data, digest = buf.tobytes(), xxhash.xxh3_128_digest
    return [digest(data[a:z]) for a, z in zip(s.tolist(), e.tolist())]


def _halves(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, buf, offs in _chunks(b.column(2)):
            text, number, s, e = split(buf, offs)
            at, names, first = pa.array(text + lo), identities(buf, s, e), {}
            for i, x in enumerate(zip(text.tolist(), names)):
                first.setdefault(x, i)
            again = np.ones(len(names), bool)
            again[list(first.values())] = False
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(number), *map(pa.array, _halves(names)), pa.array(again)], ["doc_id", "row", "line_no", "a", "b", "again"])


def _pack(k: int, ranges: int, frequent):
    """The keys of all lines but those in frequent (a set of identities), as blobs of (key, line). The high half of a key's hash
    says its range, the low half stands in the blob, above the line's sketch."""

    def flush(held):
        key, sketch, line = (np.concatenate(x) for x in zip(*held))
        to = (key >> kernels.U64(32)) * kernels.U64(ranges) >> kernels.U64(32)
        order = np.argsort(to.astype(np.min_scalar_type(ranges)), kind="stable")
        to, both = to[order], np.stack([key << kernels.U64(32) | sketch, line], axis=1)[order]
        cut = np.searchsorted(to, np.arange(ranges + 1).astype(np.uint64))
        some = np.flatnonzero(np.diff(cut))
        offs = np.concatenate([[0], cut[some + 1]]) * 16
        data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(both.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), data], ["range", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for b in batches:
            for _, buf, offs in _chunks(b.column(0)):  # signatures are made in the processor's cache
                _, _, s, e = split(buf, offs)
                first: dict = {}
                for i, name in enumerate(identities(buf, s, e)):
                    first.setdefault(name, i)
                names = [x for x in first if x not in seen and (frequent is None or x not in frequent.value)]
                if not names:
                    continue
                seen.update(names)  # most repeats of a line; the rest goes where the range is sorted
                at, line = np.array([first[x] for x in names]), _halves(names)[0].view(np.uint64)
                for scale, rows, bands, some, g, off in scales(Characters(buf), s[at], e[at], k):
                    sig = kernels.minhash(g, off, rows * bands, masks=False)
                    keys = kernels.mix(kernels.band_keys(sig, rows).reshape(-1) + kernels.U64(scale))
                    keys += kernels.U64(scale) - keys % kernels.U64(SCALE_KEYS)
                    held.append((keys, kernels.band_sketches(sig, rows).reshape(-1), np.repeat(line[some], bands)))
                    size += keys.size * 16
                if size > PACK:
                    yield flush(held)
                    held, size, seen = [], 0, set()
        if held:
            yield flush(held)

    return run


def _buckets(most: int):
    """(bucket, lines, m): the members of buckets of m >= 2 different lines, in pieces; bucket is a hash of its members. A range
    of more than most bytes gives (key, [line], null) for all its keys instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, rows = [], 0, False
        for b in batches:
            data, offs = kernels.raw(b.column(1))
            word, line = np.frombuffer(data.tobytes(), np.uint64).reshape(-1, 2).T
            key = np.repeat(b.column(0).to_numpy().astype(np.uint64) << kernels.U64(32), np.diff(offs) // 16) | word >> kernels.U64(32)
            parts.append((key, word.astype(np.uint32), line))
            size += len(data)
            rows |= size > most
            if rows:
                for key, _, line in parts:
                    yield from out(kernels.mix(key), line, None)
                parts = []
        if not parts:
            return
        key, sketch, line = (np.concatenate(x) for x in zip(*parts))
        parts = []
        h = np.sort(key)
        twice, places = np.zeros(1 << 22, bool), kernels.U64((1 << 22) - 1)
        twice[h[1:][h[1:] == h[:-1]] >> kernels.U64(2) & places] = True
        some = np.flatnonzero(twice[key >> kernels.U64(2) & places])  # keys of one entry are most
        key, sketch, line = key[some], sketch[some], line[some]
        order = np.lexsort((line, key))
        key, sketch, line = key[order], sketch[order], line[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        key, sketch, line = key[new], sketch[new], line[new]
        part = parted(key, sketch)
        order = np.argsort(part, kind="stable")
        line, off = line[order], groups.bounds(part[order])
        m = np.diff(off)
        name = kernels.mix(np.add.reduceat(kernels.mix(line), off[:-1]) + m.astype(np.uint64)) if len(line) else line
        use = np.repeat(m > 1, m)
        yield from out(np.repeat(name, m)[use], line[use], np.repeat(m, m)[use])

    def parted(key: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        """The first entry of the part of its bucket that each entry belongs to."""
        off = groups.bounds(key)
        m = np.diff(off)
        part = np.repeat(off[:-1], m)
        at = np.flatnonzero(np.repeat((m > 1) & (m <= PARTED), m))
        if not len(at):
            return part
        few, differ = m[(m > 1) & (m <= PARTED)], np.array([DIFFER, *(x[5] for x in SCALES)])
        near = [(at[:0], at[:0])]
        for x, y in groups.pairs_within(np.concatenate([[0], np.cumsum(few)])):
            x, y = at[x], at[y]
            ok = np.bitwise_count(sketch[x] ^ sketch[y]) <= differ[(key[x] % kernels.U64(SCALE_KEYS)).astype(np.int64)]
            near.append((x[ok], y[ok]))
        part[at] = groups.forest(len(key), *(np.concatenate(x) for x in zip(*near)))[at]
        return part

    def out(bucket, line, m) -> Iterator[pa.RecordBatch]:
        if m is None:
            cut = np.arange(len(line) + 1)
        else:
            off = groups.bounds(bucket)
            cut = np.append(np.flatnonzero((np.arange(len(line)) - np.repeat(off[:-1], np.diff(off))) % PARTED == 0), len(line))
        for lo in range(0, len(cut) - 1, 20_000):
            at = cut[lo : lo + 20_001]
            pieces = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(line[at[0] : at[-1]].copy().view(np.int64)))
            count = pa.array(m[at[:-1]]) if m is not None else pa.nulls(len(pieces), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]].copy().view(np.int64)), pieces, count], ["bucket", "lines", "m"])

    return run


def _fetch(wanted):
    """The texts of the lines of (doc_id, text) that wanted (a function of their identities and documents) picks, each once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, buf, offs in _chunks(b.column(1)):
                text, _, s, e = split(buf, offs)
                names, doc = identities(buf, s, e), ids[lo + text]
                first: dict = {}
                for i in wanted(names, doc):
                    first.setdefault((names[i], text[i]), i)
                if first:
                    data, at = buf.tobytes(), list(first.values())
                    yield pa.RecordBatch.from_arrays([*map(pa.array, _halves([names[i] for i in at])), pa.array(doc[at]), pa.array([data[s[i] : e[i]] for i in at], pa.binary())], ["a", "b", "doc_id", "text"])

    return run


def _in_level(level):
    def wanted(names: list[bytes], doc: np.ndarray) -> list[int]:
        if level is None or not names:
            return range(len(names))
        return np.flatnonzero(level.value.passes((_halves(names)[0] ^ doc).view(np.uint64))).tolist()

    return wanted


class Sketches:
    """A bitmap of each line's shingles. A bit that one line has and another lacks is a shingle that the other lacks, which
    bounds the similarity of the two from above: of sets, and of bags too."""

    def __init__(self, n: int, cut: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.bits, self.most = np.zeros((n, SKETCH // 64), np.uint64), np.zeros(n, np.int64)
        for rows, g, off in cut:
            many = np.diff(off)
            bit = (g >> kernels.U64(32)) * kernels.U64(SKETCH) >> kernels.U64(32)
            np.bitwise_or.at(self.bits.reshape(-1), np.repeat(rows * (SKETCH // 64), many) + (bit >> kernels.U64(6)).astype(np.int64), kernels.U64(1) << (bit & kernels.U64(63)))
            self.most[rows] = many

    def close(self, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        """Whether lines i[x] and j[x] may be similar."""
        x, y = self.bits[i], self.bits[j]
        both = x & y
        x, y = (np.bitwise_count(z ^ both).sum(axis=1, dtype=np.int64) for z in (x, y))
        shared = np.minimum(self.most[i] - x, self.most[j] - y)
        return (shared > 0) & (shared >= threshold * (shared + x + y) - 1e-6)


class Sets:
    """Sets of shingles that many pairs are compared on: g are the elements of all, line their sets' numbers, of which part is
    the component. Sets of different components have no element in common, so one of each is looked up at a time."""

    def __init__(self, g: np.ndarray, line: np.ndarray, part: np.ndarray):
        n, g = len(part), kernels.mix(g + part[line].astype(np.uint64) * kernels.U64(0x9E3779B97F4A7C15))
        order, new = kernels.ascending(g)
        line, code = line[order], np.concatenate([[0], np.cumsum(new)])[: len(g)]
        by_line = np.argsort(line.astype(np.uint16) if n < 1 << 16 else line, kind="stable")
        line, code = line[by_line], code[by_line]  # ascending by line and code
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (code[1:] != code[:-1])
        self.code = code[new]
        self.size = np.bincount(line[new], minlength=n)
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        self.held = np.zeros(len(g), bool)

    def _codes(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = np.cumsum(self.size[i])
        return self.code[np.repeat(self.off[:-1][i] - end + self.size[i], self.size[i]) + np.arange(end[-1])], end - self.size[i]

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many elements sets i[x] and j[x] have in common; none is empty, and those i of a component are the same."""
        one = np.zeros(len(self.size), bool)
        one[i] = True
        pivots, _ = self._codes(np.flatnonzero(one))
        self.held[pivots] = True
        out, at, lo = np.zeros(len(j), np.int64), np.concatenate([[0], np.cumsum(self.size[j])]), 0
        while lo < len(j):  # about a million elements at a time
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 20), "right")) - 1)
            codes, first = self._codes(j[lo:hi])
            out[lo:hi] = np.add.reduceat(self.held[codes], first, dtype=np.int64)
            lo = hi
        self.held[pivots] = False
        return out


def _verify(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups.whole_groups(batches, "gid"):
            lines = groups.one_chunk(t["lines"])
            many = lines.value_lengths().to_numpy()
            at = np.repeat(np.arange(t.num_rows), many)
            gid, block, first, other = (t[c].to_numpy()[at] for c in ("gid", "block", "lo", "hi"))
            line, text = lines.flatten().field("id").to_numpy(), lines.flatten().field("text")
            off = groups.bounds(gid)
            size = kernels.raw(text)[1]
            i = 0
            while i < len(off) - 1:  # groups of a few chunks together
                j = max(i + 1, int(np.searchsorted(size[off], size[off[i]] + 4 * kernels.CHUNK_BYTES, "right")) - 1)
                some = slice(off[i], off[j])
                yield from part(line[some], text.slice(off[i], off[j] - off[i]), block[some], first[some] == other[some], off[i : j + 1] - off[i])
                i = j

    def part(line: np.ndarray, text: pa.Array, block: np.ndarray, alone: np.ndarray, off: np.ndarray) -> Iterator[pa.RecordBatch]:
        # a line that stands in several buckets is cut into shingles once, and a link found in one bucket holds in all
        names, first, of = np.unique(line, return_index=True, return_inverse=True)
        chunks, root = list(characters(text.take(pa.array(first)))), np.arange(len(names))
        for size, least, most in ((k, 0, None), *((x[0], x[1], x[2]) for x in SCALES if x[0] < k)):
            open_ = np.minimum.reduceat(root[of], off[:-1]) != np.maximum.reduceat(root[of], off[:-1])
            at = np.flatnonzero(np.repeat(open_, np.diff(off)))  # only lines that are not linked yet are cut into shorter shingles
            if not len(at):
                break
            asked = np.zeros(len(names), bool)
            asked[of[at]] = True
            cut = list(shingled(chunks, asked, size, least, most))
            sketches = Sketches(len(names), cut)
            group = np.repeat(np.arange(len(off) - 1), np.diff(off))[at]
            at, group = at[(holds := sketches.most[of[at]] > 0)], group[holds]
            i, j = close(sketches, root, of, block, alone, at, groups.bounds(group))
            if len(i):
                component = groups.forest(len(names), i, j)
                root = linked(elements(cut, i, j, component, most is not None), component, root, i, j)
        some = np.flatnonzero(root != np.arange(len(names)))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[root[some]])], ["u", "v"])

    def characters(text: pa.Array) -> Iterator[tuple[int, np.ndarray, Characters]]:
        for lo, hi in kernels.chunks(kernels.raw(text)[1]):
            buf, offs = kernels.raw(text.slice(lo, hi - lo))
            yield lo, offs, Characters(buf)

    def shingled(chunks: list, asked: np.ndarray, size: int, least: int, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Those of the lines asked that shingles of this size hold for, their shingles and offsets."""
        for lo, offs, chars in chunks:
            some = np.flatnonzero(asked[lo : lo + len(offs) - 1])
            if most is not None:
                some = some[fitting(chars, offs[some], offs[some + 1], least, most)]
            if len(some):
                yield lo + some, *shingle_lines(chars, offs[some], offs[some + 1], size)

    def close(sketches: Sketches, root: np.ndarray, of: np.ndarray, block: np.ndarray, alone: np.ndarray, at: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of lines of the same group (runs off of at) that are not linked yet and that may be similar, each once."""
        found = [np.zeros(0, np.int64)]
        for x, y in groups.pairs_within(off, 8 * PAIRS):
            x, y = at[x], at[y]
            i, j = of[x], of[y]
            ask = (root[i] != root[j]) & (alone[x] | (block[x] != block[y]))
            pairs = np.unique(np.minimum(i[ask], j[ask]) * len(root) + np.maximum(i[ask], j[ask]))
            for lo in range(0, len(pairs), PAIRS):
                some = pairs[lo : lo + PAIRS]
                found.append(some[sketches.close(*np.divmod(some, len(root)), threshold)])
        return np.divmod(np.unique(np.concatenate(found)), len(root))

    def elements(cut: list, i: np.ndarray, j: np.ndarray, component: np.ndarray, bags: bool) -> Sets:
        """The exact sets of the lines of pairs."""
        asked, found = np.zeros(len(component), bool), []
        asked[i] = asked[j] = True
        for rows, g, off in cut:
            if (use := asked[rows]).any():
                many = np.diff(off)
                g, many = g[np.repeat(use, many)], many[use]
                found.append((numbered(g, np.concatenate([[0], np.cumsum(many)])) if bags else g, np.repeat(rows[use], many)))
        return Sets(*(np.concatenate(x) for x in zip(*found)), component)

    def linked(sets: Sets, component: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of each component of pairs one line after the other is compared with those that it is not linked to."""
        n = len(root)
        while len(i):
            pivot = np.full(n, n)
            np.minimum.at(pivot, component[i], i)
            now = pivot[component[i]] == i
            a, b = i[now], j[now]
            both = sets.shared(a, b)
            ok = both >= threshold * (sets.size[a] + sets.size[b] - both) - 1e-9
            if ok.any():
                root = groups.forest(n, root[a[ok]], root[b[ok]])[root]
            rest = ~now & (root[i] != root[j])
            i, j = i[rest], j[rest]
        return root

    return run


def _frequent(docs: DataFrame, lines: DataFrame, scratch: Scratch) -> tuple[set[bytes], DataFrame | None]:
    """The lines that occur more often than all lines' number / MOST_FREQUENT (and LEAST_FREQUENT times), so there are at most so many,
    and their texts, each once."""
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = lines.where(F.col("n") > max(LEAST_FREQUENT, total // MOST_FREQUENT)).select("a", "b", "place")
    got = often.select("a", "b").toArrow()
    if not got.num_rows:
        return set(), None
    names = {x.tobytes() for x in np.stack([got["a"].to_numpy(), got["b"].to_numpy()], axis=1)}
    with sent(docs.sparkSession, names) as shared:
        some = docs.join(F.broadcast(often.select(F.col("place.doc_id").alias("doc_id")).distinct()), "doc_id", "left_semi").select("doc_id", "text")
        texts = some.mapInArrow(_fetch(lambda found, _: [i for i, x in enumerate(found) if x in shared.value]), "a long, b long, doc_id long, text binary")
        return names, scratch.keep(texts.groupBy("a", "b").agg(F.first("text").cast("string").alias("text")), "frequent")


def _keyed(docs: DataFrame, frequent: set[bytes], frequent_texts: DataFrame | None, ranges: int, k: int, scratch: Scratch) -> DataFrame:
    """(bucket, a, m) of all buckets of two or more different lines, buckets of the same members once."""
    with sent(docs.sparkSession, frequent) as shared:
        packed = docs.select("text").mapInArrow(_pack(k, ranges, shared if frequent else None), "range int, entries binary")
        if frequent_texts is not None:
            packed = packed.unionByName(frequent_texts.select("text").mapInArrow(_pack(k, ranges, None), "range int, entries binary"))
        found = scratch.keep(packed.repartitionById(ranges, "range").mapInArrow(_buckets(RANGE_BYTES), "bucket long, lines array<long>, m long").distinct().select("bucket", F.explode("lines").alias("a"), "m"), "buckets")
    rows = found.where("m is null").select("bucket", "a")
    if rows.isEmpty():
        return found
    full = scratch.keep(rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "large-buckets")
    return found.where("m is not null").unionByName(rows.join(full, "bucket"))


def similar_lines(docs: DataFrame, scratch: Scratch, k: int = 8, threshold: float = 0.8, repeats: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (doc_id, row, text), whose ids repeat or not: all lines (doc_id, row, line_no, a, b, and whether its document has it before), the different ones (a, b, place,
    n) and those of these that are linked (a, b, place, n, root)."""
    places = scratch.keep(docs.mapInArrow(_places, "doc_id long, row long, line_no long, a long, b long, again boolean"), "places")
    # of ids that do not repeat, the least and the number of the line there need no sort, as a least struct does
    place = F.min(F.struct("doc_id", "row", "line_no")) if repeats else F.struct(F.min("doc_id").alias("doc_id"), F.lit(0).cast("long").alias("row"), F.expr("min_by(line_no, if(again, null, doc_id))").alias("line_no"))
    lines = scratch.keep(places.groupBy("a", "b").agg(place.alias("place"), F.count("*").alias("n")), "lines")
    ranges = max(8, -(-lines.count() * (BANDS + sum(x[4] for x in SCALES)) * 16 // (16 << 20)))
    frequent, frequent_texts = _frequent(docs, lines, scratch)
    buckets = _keyed(docs, frequent, frequent_texts, ranges, k, scratch)
    wanted = buckets.select("a").distinct()
    # the number of a candidate is written once, so it is the same for all that read it
    candidates = scratch.keep(lines.join(wanted, "a", "left_semi").withColumn("id", F.monotonically_increasing_id()), "candidates")
    asked = candidates.select("a", "b", F.col("place.doc_id").alias("doc_id"), "id")  # a line is fetched from its least place
    level = bloom.members(asked.select(F.col("a").bitwiseXOR(F.col("doc_id")).alias("h")), candidates.count())
    with sent(docs.sparkSession, level) as shared:
        fetched = docs.select("doc_id", "text").mapInArrow(_fetch(_in_level(shared if level is not None else None)), "a long, b long, doc_id long, text binary")
        found = fetched.join(asked, ["a", "b", "doc_id"]).select("a", "id", "text", F.octet_length("text").alias("size"))
        texts = scratch.keep(found.dropDuplicates(["id"]) if repeats else found, "texts")
    members = scratch.keep(buckets.join(texts.select("a", "id", "size"), "a").select("bucket", "id", "size"), "members")
    shape = scratch.keep(members.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("size").alias("size"), F.min("id").alias("least")).withColumn("blocks", F.expr(f"cast(greatest(ceil(m / {BLOCK}), ceil(size / {BLOCK_CHARS})) as int)")).where("m > 1").select("bucket", "blocks", "least"), "shapes")
    # buckets of one block that share their least line, and so most likely more, meet in one task
    line, none = F.array(F.struct("id", "text")), F.lit(0)
    tasks = members.select("bucket", "id").join(shape.where("blocks = 1"), "bucket").join(texts.select("id", "text"), "id").select(F.col("least").alias("near"), F.col("bucket").alias("gid"), line.alias("lines"), none.alias("block"), none.alias("lo"), none.alias("hi"))
    large = shape.where("blocks > 1")
    if not large.isEmpty():
        blocks = members.select("bucket", "id").join(large, "bucket").withColumn("block", F.expr("cast(pmod(xxhash64(id, bucket), blocks) as int)"))
        blocks = blocks.join(texts.select("id", "text"), "id").groupBy("bucket", "block", "blocks").agg(F.collect_list(F.struct("id", "text")).alias("lines"))
        blocks = blocks.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"lo": F.least("block", "o"), "hi": F.greatest("block", "o")})
        pair = F.xxhash64("bucket", "lo", "hi")
        tasks = tasks.unionByName(blocks.select(pair.alias("near"), pair.alias("gid"), "lines", "block", "lo", "hi"))
    links = tasks.repartition("near").sortWithinPartitions("near", "gid").mapInArrow(_verify(k, threshold), "u long, v long")
    roots = components(links, scratch)
    named = candidates.join(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), candidates["id"] == roots["node"])
    return places, lines, scratch.keep(named.select("a", "b", "place", "n", "root"), "named")


def repeated_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", k: int = 8, threshold: float = 0.8) -> DataFrame:
    """One row per line to drop: doc_id, line_no (from 0), and the place of the line that stays for it, kept_doc_id and
    kept_line_no."""
    return _repeated(docs, scratch, id_col, text_col, k, threshold).select("doc_id", "line_no", "kept_doc_id", "kept_line_no")


def _repeated(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, k: int = 8, threshold: float = 0.8) -> DataFrame:
    """As repeated_lines(), with row and kept_row, which tell rows of one id apart: hashes of their texts, or 0 if no id repeats."""
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null and text is not null")
    # most ids do not repeat, which is seen without the texts
    repeats = not ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").isEmpty()
    repeats = repeats and not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    docs = docs.select("doc_id", (F.xxhash64("text") if repeats else F.lit(0).cast("long")).alias("row"), "text")
    places, lines, named = similar_lines(docs, scratch, k, threshold, repeats)
    heads = scratch.keep(named.groupBy("root").agg(F.min("place").alias("kept")), "heads")
    linked = named.join(heads, "root").select("a", "b", "n", "place", "kept")
    alone = lines.where("n > 1").join(named, ["a", "b"], "left_anti").select("a", "b", "n", "place", F.col("place").alias("kept"))
    drop = linked.unionByName(alone).where("n > 1 or kept <> place")
    drop = scratch.keep(drop.select("a", "b", "n", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.row").alias("kept_row"), F.col("kept.line_no").alias("kept_line_no")), "drop")
    # lines that hold more than a hundred-thousandth of all places are at most so many: they are sent to the places
    often = F.col("n") > F.lit(max(100, places.count() // 100_000))
    gone = places.join(F.broadcast(drop.where(often)), ["a", "b"]).unionByName(places.join(drop.where(~often), ["a", "b"]))
    return gone.where("not (doc_id = kept_doc_id and row = kept_row and line_no = kept_line_no)")


def without_repeated_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the dropped lines taken out of their texts; documents that lose every line have an empty text."""
    gone = _repeated(docs, scratch, id_col, text_col, **options).groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("line_no").alias("__gone"))
    out = docs.join(gone, (F.col(f"`{id_col}`").cast("long") == F.col("__id")) & F.col("__row").isin(F.lit(0), F.xxhash64(F.col(f"`{text_col}`"))), "left")
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\\n', -1), (x, i) -> not array_contains(__gone, cast(i as bigint))), '\\n')")
    return out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)).select(docs.columns)
