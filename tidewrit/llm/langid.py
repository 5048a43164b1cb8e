"""Language identification by cross-parsing entropy.

A suffix automaton holds all substrings of a language's sample. A text is parsed greedily into the longest matches with
substrings of the sample; each match is a phrase. The language that needs fewest phrases, each weighted with the bits
that point into its sample, log2(sample length), wins. The automata are tables of transitions over the letters of the
samples and the blank; all texts of a chunk advance through all of them together, a letter at a time.

Texts are lower-cased; each run of other characters than letters is one blank. Letters outside the samples match nothing
and are a phrase each. Texts are parsed whole, in blocks of ``BLOCK`` letters (a phrase ends with its block).

Samples: all different texts of a language are cut into pieces of ``chars // 8`` characters, and those of least hash (of
text and place) are taken until ``chars`` characters are gathered, or all if the language has less (at most ``most_table``
table entries over all languages together, so more languages have shorter samples). So every part of every text can be
drawn, a sample has eight pieces at least, and a text or a piece that many rows repeat is in it once. Predictions always use the
whole text. Null ids, texts and languages and empty texts teach nothing. Texts that are null or have no letter get ``und``
and 0. The score is 1 - best / second best. With one language known the score is 1; with none every text is ``und``. Ties
go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import kernels

BLOCK = 1024
#: Languages whose totals are sent to the tasks; more are joined.
MOST_SENT = 10_000
_letters: dict = {}


def letter_table() -> np.ndarray:
    """Of the basic plane, which code points are letters."""
    if "all" not in _letters:
        _letters["all"] = np.array([chr(c).isalpha() for c in range(0x10000)])
    return _letters["all"]


def automaton(codes: list[int], n_codes: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence of codes: state x code -> state, 0 for none; state 1 is the root."""
    go: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in codes:
        go.append({})
        new = len(go) - 1
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                go.append(dict(go[q]))
                copy = len(go) - 1
                length.append(length[p] + 1)
                link.append(link[q])
                while p and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.zeros((len(go), n_codes), np.int32)
    for s, row in enumerate(go):
        for c, t in row.items():
            table[s, c] = t
    return table


def letters(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, runs of non-letters as one blank (0); offsets; letters per text."""
    low = kernels.lower(text)
    strings = ["" if t is None else t for t in low.to_pylist()]
    offs = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    code = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    high = code > 0xFFFF
    is_letter = letter_table()[np.where(high, 0, code)]
    if high.any():
        is_letter[high] = [chr(c).isalpha() for c in code[high]]
    n = np.concatenate([[0], np.cumsum(is_letter)])
    count = n[offs[1:]] - n[offs[:-1]]
    code = np.where(is_letter, code, 0)
    stay = is_letter.copy()
    stay[1:] |= is_letter[:-1]
    first = offs[:-1][offs[:-1] < len(code)]
    stay[first] = is_letter[first]
    kept = np.concatenate([[0], np.cumsum(stay)])
    return code[stay], kept[offs], count


class Parser:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, np.ndarray], most_table: int = 40_000_000):
        self.names = sorted(samples)
        known = np.unique(np.concatenate([*samples.values(), np.zeros(1, np.uint32)])) if samples else np.zeros(1, np.uint32)
        self.codes = known[known > 0]
        n = len(self.codes) + 2  # blank, the letters, any other letter
        most = most_table // max(1, 2 * n * len(samples))
        tables, self.roots, self.bits, base = [], [], [], 0
        for name in self.names:
            codes = self.encode(samples[name][:most])
            t = automaton(codes.tolist(), n)
            t[t > 0] += base
            tables.append(t)
            self.roots.append(base + 1)
            self.bits.append(np.log2(max(2, len(codes))))
            base += len(t)
        self.width = n
        self.table = np.concatenate(tables).reshape(-1) if tables else np.zeros(0, np.int32)
        self.roots, self.bits = np.array(self.roots, np.int32), np.array(self.bits)

    def encode(self, code: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.where(code == 0, 0, 1).astype(np.int32)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        out = np.where(self.codes[at] == code, at + 1, len(self.codes) + 1)
        return np.where(code == 0, 0, out).astype(np.int32)

    def phrases(self, code: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Number of phrases of each text (rows) in each language (columns)."""
        code = self.encode(code)
        blocks = -(-np.diff(offs) // BLOCK)
        text = np.repeat(np.arange(len(blocks)), blocks)
        start = offs[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        size = np.minimum(offs[1:][text] - start, BLOCK)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        n_lang, total = len(self.roots), np.zeros((len(self.roots), len(start)), np.int32)
        state = np.repeat(self.roots[:, None], len(start), axis=1)
        root_row = (self.roots * self.width)[:, None]
        active = np.searchsorted(-size, -np.arange(1, (int(size[0]) if len(size) else 0) + 1), "right")
        for i, a in enumerate(active.tolist()):
            c = code[start[:a] + i][None, :]
            now = state[:, :a]
            step = self.table[now * self.width + c]
            miss = step == 0
            total[:, :a] += miss | (now == self.roots[:, None])  # a phrase begins where none is open or the open one ends
            again = self.table[root_row + c]
            state[:, :a] = np.where(miss, np.where(again == 0, self.roots[:, None], again), step)
        out = np.zeros((len(blocks), n_lang), np.int64)
        np.add.at(out, text[order], total.T)
        return out

    def predict(self, text: pa.Array) -> tuple[list, np.ndarray]:
        code, offs, count = letters(text)
        cost = self.phrases(code, offs) * self.bits[None, :]
        lang, score = np.full(len(count), "und", object), np.zeros(len(count))
        some = count > 0
        if len(self.names) and some.any():
            best = cost[some].argmin(axis=1)
            lang[some] = np.array(self.names, object)[best]
            two = np.sort(cost[some], axis=1)
            score[some] = 1 - two[:, 0] / two[:, 1] if len(self.names) > 1 else 1.0
        return lang, np.clip(score, 0, 1)


def learn(docs: DataFrame, chars: int = 20_000, most_table: int = 40_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Parser:
    """Automata from the rows of docs (already without those held out)."""
    piece = max(1, chars // 8)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(17), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    different = rows.groupBy("lang", "row").agg(F.max(F.length("text")).alias("n"))
    total = different.groupBy("lang").agg((20.0 * chars / F.sum("n")).alias("limit"))  # about 20 times the need
    known = total.limit(MOST_SENT + 1).collect()
    total = F.broadcast(docs.sparkSession.createDataFrame(known, total.schema)) if len(known) <= MOST_SENT else total
    places = F.sequence(F.lit(0), F.expr(f"(length(text) - 1) div {piece}").cast("int"))
    # drawn inside the row: only the pieces below the limit leave it, so no whole text is shuffled
    drawn = rows.join(total, "lang").withColumn("place", F.explode(F.filter(places, lambda k: _uniform(F.xxhash64("row", k)) <= F.col("limit"))))
    drawn = drawn.select("lang", _uniform(F.xxhash64("row", "place")).alias("u"), F.expr(f"substring(text, place * {piece} + 1, {piece})").alias("text"))
    drawn = drawn.groupBy("lang", "text").agg(F.min("u").alias("u"))
    by = Window.partitionBy("lang").orderBy("u", "text").rowsBetween(Window.unboundedPreceding, -1)
    texts = drawn.withColumn("before", F.coalesce(F.sum(F.length("text")).over(by), F.lit(0))).where(F.col("before") < chars).orderBy("lang", "u", "text").select("lang", "text").toArrow()
    samples: dict[str, list] = {}
    for lang, text in zip(texts["lang"].to_pylist(), texts["text"].to_pylist()):
        samples.setdefault(lang, []).append(text)
    return Parser({k: letters(pa.array(["\n".join(v)]))[0][:chars] for k, v in samples.items()}, most_table)


def _uniform(h: Column) -> Column:
    return F.pmod(h, F.lit(1_000_000_007)) / 1_000_000_007.0


def identify(docs: DataFrame, parser: Parser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row, whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in kernels.chunks(kernels.raw(b.column(1))[1], 1 << 20):
                lang, score = shared.value.predict(b.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
