"""Prefix dynamic programming: the exact token count of every prefix of a text, stored once and asked many times.

1. In a piece of the pre-tokeniser, byte-pair encoding has one last token for each prefix: the token t that ends there
   and may follow the last token of what stands before it, that is, whose pair encodes to itself. So a prefix has one
   token more than the prefix before t; a tree of the vocabulary finds the tokens at each byte, and
   whether a pair encodes to itself is asked of the library once.
2. Pieces never cross a place where white space follows another character, or where a letter is followed by an ASCII
   character that is none. What stands between two such places is a unit: its counts depend on it alone, so they are
   made once and repeated units look them up. The counts of a text are those of its units on top of all tokens before.
3. The end of a prefix is an end of text for the pre-tokeniser: white space at the end is one piece, and a contraction
   that is cut off is none. A special string is one token from its last character on.

A table of prefixes holds, for each document, the differences between the counts of neighbouring prefixes, one byte a
character (the few that need more stand apart). From it come the tokens of the first n characters, the longest prefix
within a budget of tokens, and the documents that fit a budget together, without another encoding.

Counts are those of the library with its defaults, without added tokens, truncation or padding. Null texts are as empty
ones. Repeated rows each have a row. An empty table gives an empty one. Columns other than id and text are not read.
Long texts are worked on in slices; what a task remembers of units has a bound and goes when it is exceeded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .scratch import Scratch
from .shards import read_vocabulary

VOCABULARY = "byte_bpe_50k.json"
PREFIX = "struct<deltas: binary, jumps: array<struct<at: long, by: long>>>"
#: Units that a task remembers, and bytes of their counts; they are forgotten together when they are more.
MOST_UNITS, MOST_BYTES = 400_000, 32 << 20
#: Pairs of tokens that a task remembers.
MOST_PAIRS, PAIR_SLOTS = 1_000_000, 1 << 19
CHUNK_BYTES = 1 << 20
#: White space, and the contractions of three characters that the pre-tokeniser knows.
WHITE_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CONTRACTIONS = frozenset((b"'re", b"'ve", b"'ll"))
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
#: First bytes of two whose characters are letters in every version of Unicode (but for U+00D7 and U+00F7).
LEADS = np.array([0xC3 <= b <= 0xC8 or 0xD0 <= b <= 0xD1 for b in range(256)])
_open: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def letters(buf: np.ndarray) -> np.ndarray:
    """Bytes of letters, of those that are known without a table of characters."""
    out = LETTER[buf]
    lead = np.flatnonzero(LEADS[buf[:-1]])
    lead = lead[(buf[lead] != 0xC3) | (buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = True
    return out


def unit_starts(buf: np.ndarray) -> np.ndarray:
    """Where ASCII white space follows another character that is no white space at all, or another ASCII character that is
    no letter follows a letter; and the first byte."""
    out = np.zeros(len(buf), bool)
    if len(buf):
        blank, letter = BLANK[buf], letters(buf)
        out[1:] = blank[1:] & ~blank[:-1] | letter[:-1] & ~letter[1:] & (buf[1:] < 0x80)
        out[0] = True
        if (buf >= 0x80).any():  # other white space: the last byte of U+0085, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000
            p = np.concatenate([np.zeros(2, np.uint8), buf])
            a, b, c = p[:-2], p[1:-1], p[2:]
            wide = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
            wide |= (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
            out[1:] &= ~wide[:-1]
    return out


def char_ends(buf: np.ndarray) -> np.ndarray:
    ends = np.ones(len(buf), bool)
    ends[:-1] = (buf[1:] & 0xC0) != 0x80
    return ends


class Trie:
    """The tokens as a tree of bytes: children in hash tables by (node, byte), looked up for many nodes at a time."""

    def __init__(self, tokens: dict[bytes, int]):
        nodes: dict[int, int] = {}
        token = [-1]
        for t, i in tokens.items():
            at = 0
            for b in t:
                key = at << 8 | b
                if (to := nodes.get(key)) is None:
                    nodes[key] = to = len(token)
                    token.append(-1)
                at = to
            token[at] = i
        self.token, self.tables = np.array(token, np.int32), []
        keys, to = np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes))
        self.shift = np.uint64(64 - max(1, len(nodes).bit_length() + 1))
        while len(keys):  # what has no place of its own goes to the next, smaller table
            mult = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED270B * len(self.tables))
            place = (keys.astype(np.uint64) * mult >> self.shift).astype(np.int64)
            _, first = np.unique(place, return_index=True)
            held, child = np.full(1 << (64 - int(self.shift)), -1, np.int64), np.zeros(1 << (64 - int(self.shift)), np.int32)
            held[place[first]], child[place[first]] = keys[first], to[first]
            self.tables.append((mult, held, child))
            keys, to = np.delete(keys, first), np.delete(to, first)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The children; -1 where there is none."""
        key = node.astype(np.int64) << 8 | byte
        out = np.full(len(key), -1, np.int32)
        for mult, held, child in self.tables:
            place = (key.astype(np.uint64) * mult >> self.shift).astype(np.int64)
            out = np.where(held[place] == key, child[place], out)
        return out

    def matches(self, buf: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, token) of every token in the pieces; stop has the end of each byte's piece."""
        start, node, size, out = np.arange(len(buf)), np.zeros(len(buf), np.int32), 0, []
        while len(start):
            node = self.step(node, buf[start + size])
            size += 1
            some = node >= 0
            start, node = start[some], node[some]
            found = self.token[node]
            hit = found >= 0
            out.append((start[hit], start[hit] + size, found[hit]))
            more = start + size < stop[start]
            start, node = start[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


class PrefixCounter:
    """Token counts of all prefixes by one vocabulary of byte-level pairs."""

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("prefix counts need a byte-level BPE without normaliser and with the byte-level pre-tokeniser")
        added = spec.get("added_tokens", [])
        self.special = [t["content"] for t in added]
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(a != b and b.startswith(a) for a in self.special for b in self.special):
            raise ValueError("special strings must be plain, none the beginning of another")
        self.any_special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.cut, self.encode = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
        #: Byte-level vocabularies write byte b as this character.
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = iter(range(0x100, 0x200))
        byte_of = {chr(b if b in shown else next(hidden)): b for b in range(256)}
        self.text_of = {i: t for t, i in model["vocab"].items()}
        # tokens that encoding cannot give are none
        self.trie = Trie({bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special and [x.id for x in self.encode(t)] == [i]})
        self.known: dict[int, bool] = {}
        self.pair_key, self.pair_fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pool, self.off, self.total = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64)

    def fits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the second token may follow the first: their joined bytes encode to these two."""
        key = first.astype(np.int64) << 32 | second
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_SLOTS.bit_length() + 1)).astype(np.int64)
        out, other = self.pair_fits[slot], np.flatnonzero(self.pair_key[slot] != key)
        if len(other):
            asked, code = np.unique(key[other], return_inverse=True)
            if len(self.known) + len(asked) > MOST_PAIRS:
                self.known.clear()
            answer = np.zeros(len(asked), bool)
            for k, x in enumerate(asked.tolist()):
                if (yes := self.known.get(x)) is None:
                    a, b = x >> 32, x & 0xFFFFFFFF
                    self.known[x] = yes = [t.id for t in self.encode(self.text_of[a] + self.text_of[b])] == [a, b]
                answer[k] = yes
            out[other] = answer[code]
            self.pair_key[slot[other]], self.pair_fits[slot[other]] = key[other], out[other]
        return out

    def pieces(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of the prefixes of pieces of the pre-tokeniser, by their last bytes; off has where each piece begins."""
        size = np.diff(off)
        begin = np.repeat(off[:-1], size)
        start, end, token = self.trie.matches(buf, begin + np.repeat(size, size))
        depth = end - begin[start]
        order = np.argsort(depth, kind="stable")
        start, end, token, depth = start[order], end[order], token[order], depth[order]
        last, count = np.zeros(len(buf), np.int64), np.zeros(len(buf), np.int32)
        bounds = np.searchsorted(depth, np.arange(1, int(size.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:]):  # prefixes of one byte, of two, ...: one token each fits
            s, e, t = start[lo:hi], end[lo:hi] - 1, token[lo:hi]
            whole = s == begin[s]
            ok = whole.copy()
            rest = np.flatnonzero(~whole)
            ok[rest] = self.fits(last[s[rest] - 1], t[rest])
            s, e, t, whole = s[ok], e[ok], t[ok], whole[ok]
            last[e], count[e] = t, np.where(whole, 0, count[s - 1]) + 1
        return count

    def _learn(self, units: list[bytes]) -> np.ndarray:
        """Adds units; the pool gets, by character, what each prefix has more than the one before."""
        k, n = len(self.place), len(units)
        size = np.fromiter(map(len, units), np.int64, n)
        off = np.concatenate([[0], np.cumsum(size)])
        buf = np.frombuffer(b"".join(units), np.uint8)
        strange = ~letters(buf)
        strange[off[:-1]] &= buf[off[:-1]] != 32
        alone = (np.add.reduceat(strange, off[:-1]) == 0) | (size == 1)  # a space perhaps, and letters: one piece
        begins, short, runs, where = [off], [], [], []
        for i in np.flatnonzero(~alone).tolist():
            string, at = units[i].decode(), int(off[i])
            parts = [string[a:b].encode() for _, (a, b) in self.cut(string)]
            ends = at + np.cumsum([0, *map(len, parts)])
            begins.append(ends[1:-1])
            short += [int(e) for e, p in zip(ends, parts) if p in CONTRACTIONS]
            for run in WHITE_RUN.finditer(string):
                runs.append(run.group().encode())
                where.append((at, at + len(string[: run.start()].encode())))
        begins = np.sort(np.concatenate(begins))
        counts = self.pieces(buf, begins).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(counts[begins[1:] - 1])])
        first = np.searchsorted(begins, off)
        base = total[:-1] - np.repeat(total[first[:-1]], np.diff(first))
        counts += np.repeat(base, np.diff(begins))
        for e in short:  # cut off after two characters it is none, and each of them is a piece
            counts[e + 1] = counts[e] + 1
        if runs:  # at the end of a prefix all its white space is one piece
            ends = np.cumsum([0, *map(len, runs)])
            of = self.pieces(np.frombuffer(b"".join(runs), np.uint8), ends)
            for (unit, a), x, y in zip(where, ends[:-1], ends[1:]):
                counts[a : a + y - x] = of[x:y] + (counts[a - 1] if a > unit else 0)
        ends = char_ends(buf)
        chars = np.concatenate([[0], np.cumsum(ends)])[off]
        counts = counts[ends]
        delta = np.diff(counts, prepend=0)
        delta[chars[:-1]] = counts[chars[:-1]]
        while k + n + 1 > len(self.off):
            self.off, self.total = np.concatenate([self.off, np.zeros_like(self.off)]), np.concatenate([self.total, np.zeros_like(self.total)])
        while self.off[k] // 4 + len(delta) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.off[k] // 4 : self.off[k] // 4 + len(delta)] = delta
        self.off[k + 1 : k + n + 1] = self.off[k] + 4 * chars[1:]
        self.total[k : k + n] = counts[chars[1:] - 1]
        self.place.update(zip(units, range(k, k + n)))
        return np.arange(k, k + n)

    def slice(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts without special strings, by character: the tokens that each prefix has more than the one before; and the
        offset of each text among the characters."""
        if len(self.place) > MOST_UNITS or self.off[len(self.place)] > MOST_BYTES:
            self.forget()
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        cut = unit_starts(buf)
        cut[offs[:-1][offs[:-1] < len(buf)]] = True
        s = np.flatnonzero(cut).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.append(s, np.int32(len(buf)))), pa.py_buffer(buf)]).dictionary_encode()
        data, ends = kernels.raw(units.dictionary)
        data, ends = data.tobytes(), ends.tolist()
        distinct = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
        get = self.place.get
        place = np.array([get(u, -1) for u in distinct])
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self._learn([distinct[i] for i in new])
        k = len(self.place)
        held = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(self.off[: k + 1]), pa.py_buffer(self.pool)])
        delta, ends = kernels.raw(held.take(pa.array(place[units.indices.to_numpy()])))
        return delta.view(np.int32), ends[np.searchsorted(s, offs)] // 4

    def text(self, buf: np.ndarray, most: int = CHUNK_BYTES) -> np.ndarray:
        """As slice(), of one text of any length."""
        data, parts, at = buf.tobytes(), [], 0
        string = data.decode() if any(t.encode() in data for t in self.special) else ""
        stops = [(len(string[: m.start()].encode()), len(m.group().encode())) for m in self.any_special.finditer(string)]
        for stop, size in [*stops, (len(data), 0)]:
            # the special string but for its last character is text as any other: prefixes may end in it
            plain = self._plain(buf[at : stop + max(0, size - 1)], most)
            parts.append(plain)
            if size:
                parts.append(np.array([self._plain(buf[at:stop], most).sum() + 1 - plain.sum()], np.int32))
            at = stop + size
        return np.concatenate(parts)

    def _plain(self, buf: np.ndarray, most: int) -> np.ndarray:
        if len(buf) <= most:
            return self.slice(buf, np.array([0, len(buf)]))[0]
        starts, parts, i = np.append(np.flatnonzero(unit_starts(buf)), len(buf)), [], 0
        while i < len(starts) - 1:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, "right")) - 1)
            parts.append(self.slice(buf[starts[i] : starts[j]], np.array([0, starts[j] - starts[i]]))[0])
            i = j
        return np.concatenate(parts)

    def prefixes(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows i to j; for each character of their texts what the prefix that ends there has more tokens than the one before;
        the offset of each text among these; and the texts' bytes."""
        buf, offs = kernels.raw(column)
        for i, j in kernels.chunks(offs, CHUNK_BYTES):
            part, local = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            held = part.tobytes()
            if j == i + 1 or any(t.encode() in held for t in self.special):
                each = [self.text(part[a:b]) for a, b in zip(local[:-1], local[1:])]
                delta, chars = np.concatenate(each), np.cumsum([0, *map(len, each)])
            else:
                delta, chars = self.slice(part, local)
            yield i, j, delta, chars, np.diff(local)


def _counter(shared) -> PrefixCounter:
    """The worker's counter; made again for another vocabulary."""
    if _open.get("of") != (key := hash(shared.value)):
        _open.update(of=key, counter=PrefixCounter(shared.value))
    return _open["counter"]


def prefix_table(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_chars, n_tokens, prefix) of every row. The vocabulary, a bounded file, goes to every task."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared)
        for b in batches:
            for i, j, delta, off, n_bytes in counter.prefixes(b.column(1)):
                small = np.clip(delta, -127, 127)
                odd = np.flatnonzero(small != delta)
                row = np.searchsorted(off, odd, "right") - 1
                jumps = pa.StructArray.from_arrays([pa.array(odd - off[row]), pa.array((delta - small)[odd].astype(np.int64))], ["at", "by"])
                jumps = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32), jumps)
                deltas = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(small.astype(np.int8))])
                total = np.concatenate([[0], np.cumsum(delta, dtype=np.int64)])
                total = total[off[1:]] - total[off[:-1]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n_bytes), pa.array(np.diff(off)), pa.array(total), pa.StructArray.from_arrays([deltas, jumps], ["deltas", "jumps"])], ["doc_id", "n_bytes", "n_chars", "n_tokens", "prefix"])
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_chars long, n_tokens long, prefix {PREFIX}")


def decode(deltas: bytes, jumps: list | None) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2 ... characters."""
    d = np.frombuffer(deltas, np.int8).astype(np.int64)
    for x in [] if jumps is None else jumps:
        d[x["at"]] += x["by"]
    return np.concatenate([[0], np.cumsum(d)])


def tokens_of(prefix: Column, n: Column) -> Column:
    """Tokens of the first n characters (all, if there are fewer); null if n is null."""

    @F.pandas_udf("long")
    def ask(p: pd.DataFrame, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(k) else int((c := decode(d, j))[min(max(int(k), 0), len(c) - 1)]) for d, j, k in zip(p["deltas"], p["jumps"], n)], dtype="Int64")

    return ask(prefix, n)


def longest_within(prefix: Column, budget: Column) -> Column:
    """Characters of the longest prefix that has at most so many tokens (a longer one may have fewer than a shorter)."""

    @F.pandas_udf("long")
    def ask(p: pd.DataFrame, budget: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(k) else int(np.flatnonzero(decode(d, j) <= max(int(k), 0))[-1]) for d, j, k in zip(p["deltas"], p["jumps"], budget)], dtype="Int64")

    return ask(prefix, budget)


def within_budget(table: DataFrame, budget: int, scratch: Scratch, order: tuple[str, ...] = ("doc_id",), parts: int = 64) -> DataFrame:
    """The documents that a budget of tokens reads in this order, with kept_chars: all but the last are whole, the last is
    cut to its longest prefix within what is left.

    The rows are ranged by the order; sums of the ranges say in which one the budget ends, and only that range is summed
    row by row. Documents of the same place in the order follow their prefixes.
    """
    by = [*(F.col(c) for c in order), F.col("n_tokens"), F.col("n_chars"), F.col("prefix.deltas")]
    ranged = scratch.keep(table.repartitionByRange(parts, *by).withColumn("range", F.spark_partition_id()), "ranges")
    sums = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a range
    left, end = int(budget), None
    for k in sorted(sums):
        if sums[k] > left:
            end = k
            break
        left -= sums[k]
    whole = ranged.where(F.col("range") < (end if end is not None else parts)).withColumn("kept_chars", F.col("n_chars"))
    if end is None:
        return whole.drop("range")
    from pyspark.sql import Window

    w = Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    last = ranged.where(F.col("range") == end).withColumn("left", left - F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).where("left > 0 or n_tokens = 0")
    cut = last.withColumn("kept_chars", F.when(F.col("n_tokens") <= F.col("left"), F.col("n_chars")).otherwise(longest_within(F.col("prefix"), F.col("left"))))
    return whole.unionByName(cut.drop("left")).drop("range")
