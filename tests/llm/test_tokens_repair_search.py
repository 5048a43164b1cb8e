"""Token counts of prefixes against the library, repair against dynamic programming, search against scoring every document."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewrit.llm import queries, repair, search, tokencounts
from tidewrit.llm.scratch import Scratch

# --- 11 --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return tokencounts.PrefixCounter(open(tokencounts.vocabulary_path(), "rb").read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokencounts.vocabulary_path())
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def prefix_counts(counter, texts):
    out = []
    for _, _, delta, off, _ in counter.prefixes(pa.array(texts, pa.string())):
        out += [np.cumsum(delta[a:b]).tolist() for a, b in zip(off[:-1], off[1:])]
    return out


PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "\xa0", "　", "é", "日本", "😀", "'", "'re", "'ll", "'v", "1", "23", ".", "!!", "<|endoftext|>", "<|endof", "\r", "\x1c", "\x85", "​", "Ａ", "ß", "ё", "=", "-", "A", "é", "\x00"]


def test_every_prefix_has_the_tokens_of_the_library(counter, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["", "=" * 130, " " * 90 + "x", "don't we'll they've I'm"]
    for text, got in zip(texts, prefix_counts(counter, texts), strict=True):
        assert got == [library(text[:n]) for n in range(1, len(text) + 1)], repr(text)


def test_units_may_be_forgotten_and_texts_sliced(counter, library, monkeypatch):
    monkeypatch.setattr(tokencounts, "MOST_UNITS", 40)
    monkeypatch.setattr(tokencounts, "MOST_PAIRS", 50)
    monkeypatch.setattr(tokencounts, "CHUNK_BYTES", 300)
    text = " ".join(f"word{i} é{i}" for i in range(300)) + "<|endoftext|>" + "x" * 700 + "  tail "
    counts = np.cumsum(counter.text(np.frombuffer(text.encode(), np.uint8), 200))
    assert len(counts) == len(text) and all(counts[n - 1] == library(text[:n]) for n in [*range(1, len(text), 53), *range(len(text) - 725, len(text) + 1, 7)])
    assert [c[-1] if c else 0 for c in prefix_counts(counter, [text, "a", None, text])] == [library(text), 1, 0, library(text)]


def test_prefix_table_answers_questions(spark, library):
    rows = [(1, "one two three", "x"), (2, None, "x"), (3, "", "x"), (None, "é 😀 日本", "x"), (4, "same", "x"), (4, "same", "x"), (5, "w " * 3000, "x")]
    table = tokencounts.prefix_table(spark.createDataFrame(rows, "doc_id long, text string, prefix string"))
    got = table.select("*", tokencounts.tokens_of(F.col("prefix"), F.lit(5)).alias("five"), tokencounts.longest_within(F.col("prefix"), F.lit(4)).alias("cut"), tokencounts.tokens_of(F.col("prefix"), F.lit(None).cast("int")).alias("none")).collect()
    texts = {i: t or "" for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_chars"], r["n_tokens"]) == (len(t.encode()), len(t), library(t)) and r["none"] is None
        assert r["five"] == library(t[:5]) and r["cut"] == max(n for n in range(min(len(t), 40) + 1) if library(t[:n]) <= 4)
    assert tokencounts.prefix_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_within_a_budget(spark, library):
    rows = [(i, f"some words number {i} " * (i % 4 + 1)) for i in range(40)]
    table = tokencounts.prefix_table(spark.createDataFrame(rows, "doc_id long, text string"))
    for budget in (0, 100, 333, 10_000):
        left, want = budget, {}
        for i, t in rows:
            n = library(t)
            if left <= 0:
                break
            want[i] = len(t) if n <= left else max(k for k in range(len(t) + 1) if library(t[:k]) <= left)
            left -= n
        got = {r["doc_id"]: r["kept_chars"] for r in tokencounts.within_budget(table, budget, Scratch(spark, "t"), parts=5).collect()}
        assert got == want, budget


def test_jumps_restore_large_steps():
    assert tokencounts.decode(bytes([1, 127, 255]), [{"at": 1, "by": 500}]).tolist() == [0, 1, 628, 627]


# --- 12 --------------------------------------------------------------------------------------------------------------


def cheapest_by_tables(symbols, start=0, goals=(0, 3), trailing=True):
    best = {start: (0, "")}

    def put(table, q, way):
        if q not in table or way < table[q]:
            table[q] = way

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for q, (cost, letters) in list(out.items()):
                for c, to in repair.NEXT[q].items():
                    if c in "ua":
                        put(out, to, (cost + 5, letters + "I"))
        return out

    for s in symbols:
        new: dict = {}
        for q, (cost, letters) in inserted(best).items():
            put(new, q, (cost + 2, letters + "D"))
            more = 5 if s.isupper() or s == "!" else 0
            for c, to in repair.NEXT[q].items() if s != "-" else ():
                if c == s.lower():
                    put(new, to, (cost + more, letters + "K"))
                if c in "ua":
                    put(new, to, (cost + more + 1, letters + "R"))
        best = new
    if trailing:
        best = inserted(best)
    return min((best[g] for g in goals if g in best), default=None)


def test_repair_finds_the_cheapest_and_least_edits():
    every = ["".join(x) for n in range(4) for x in itertools.product("suaxUA-", repeat=n)]
    rng = random.Random(3)
    every += ["".join(rng.choice("suaxSUA!-uaua") for _ in range(rng.randint(4, 40))) for _ in range(400)]
    for symbols in every:
        assert repair.cheapest(symbols) == cheapest_by_tables(symbols), symbols
        for start, goal in ((0, 2), (2, 3), (3, 0), (1, 2)):
            assert repair.cheapest(symbols, start, (goal,), False) == cheapest_by_tables(symbols, start, (goal,), False), (symbols, start, goal)


def audited(rows):
    """The contract, in plain loops over (conv, turn, role, text, copies)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x, n) for c, t, r, x, n in rows if c == conv))
        mine = [(t if some else None, r, x) for some, t, r, x, n in mine for _ in range(n)]
        count, symbols, seen = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), "", set()
        for i, (_, role, text) in enumerate(mine):
            if i and mine[i - 1][1][:1] + role[:1] not in ("su", "ua", "au"):
                count["illegal"] += 1
            written = re.findall(r"[^\x20\x09-\x0D]", text)
            kind = "blank" if not written else "duplicate" if (role, text) in seen else "truncated" if written[-1] not in ".!?" else ""
            seen.add((role, text))
            if kind:
                count[kind] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "-" if kind in ("blank", "duplicate") else (c.upper() if c != "x" else "!") if kind else c
        cost, letters = cheapest_by_tables(symbols)
        body, at, q = [], 0, 0
        for e in letters:
            row = mine[at] if e != "I" else None
            at += e != "I"
            if e == "D":
                continue
            c = row[1][0] if e == "K" else next(c for c in repair.NEXT[q] if c in "ua")
            body.append(f"{row[1]}:{row[2]}" if e == "K" else f"{dict(u='user', a='assistant')[c]}:{row[2] if row else ''}")
            q = repair.NEXT[q][c]
        turns = {t for t, _, _ in mine if t is not None}
        out[conv] = {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **count, "cost": cost, "audit": letters, "repaired_sha256": hashlib.sha256("\n".join(body).encode()).hexdigest(), "body": body}
    return out


def odd_conversations():
    rng = random.Random(5)
    rows = [(None, 1, "user", "No conversation?", 1), (1, None, None, None, 1), (1, 2, "", "Empty role.", 1), (2, 1, "user", "gone", 0), (3, 7, "tool", "No role fits.", 2), (4, 0, "assistant", " \t\v\n", 1), (4, 9, "system", "Late. ", 1)]
    for conv in range(10, 40):
        for turn in range(rng.choice([1, 3, 8, 40])):
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rng.choice(["Yes.", "No", "Why?", "", None, f"Text {turn}.", f"Cut {turn}"]), rng.choice([0, 1, 1, 1, 2])))
    return rows + rows[-5:]


@pytest.mark.parametrize("piece", [512, 3])
def test_audit_against_plain_loops(spark, piece):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, copies int, repeats string")
    want = audited(rows)
    got = {r["conv_id"]: r.asDict() for r in repair.audit(df, Scratch(spark, "t"), piece).collect()}
    assert set(got) == set(want)
    for conv, w in want.items():
        assert {k: got[conv][k] for k in w if k != "body"} == {k: v for k, v in w.items() if k != "body"}, conv
    lines: dict = {}
    for r in repair.repaired_rows(df, Scratch(spark, "t"), piece, "copies").collect():
        lines.setdefault(r["conv_id"], []).append((r["position"], f"{r['role']}:{r['text']}"))
    assert {c: [t for _, t in sorted(x)] for c, x in lines.items()} == {c: w["body"] for c, w in want.items() if w["body"]}
    assert repair.audit(df.limit(0), Scratch(spark, "t")).count() == 0


def test_damage_follows_crc32(spark):
    rows = [(c, t, "assistant", "So. Is it? Yes!") for c in range(20) for t in range(6)] + [(None, None, None, None)]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in got:
        kind = zlib.crc32(f"{' ' if r['conv_id'] is None else r['conv_id']}:{' ' if r['turn'] is None else r['turn']}".encode()) % 20
        text = "So. Is it? Yes!" if r["conv_id"] is not None else " "
        assert r["copies"] == {0: 0, 3: 2}.get(kind, 1) and r["role"] == ("user" if kind == 4 else "assistant" if r["conv_id"] is not None else " ")
        assert kind == 0 or r["text"] == ("" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)


# --- 13 --------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked(docs, items, k):
    words = [(i, terms_of(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df: dict = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        asked = {t for i, text in items if i == item for t in terms_of(text)}
        found = []
        for doc, w in words:
            score = 0
            for t in asked & set(w):
                m = 100 - 90 + 90 * len(w) * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_against_scores_of_every_document(spark, monkeypatch, small):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(150)] + ["É", "é", "日本", "x" * 600, "x" * 599 + "y"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=p / p.sum()))
    docs = [(int(i), text(int(rng.integers(1, 60)))) for i in range(300)] + [(None, "w140 w141 w142"), (7, "w140 w141 w142"), (7, "w140 w141 w142"), (400, None), (401, ""), (402, " .,! ")]
    docs += [(500 + i, "w130 W131, w132!") for i in range(40)] + [(900, " ".join(f"w{i % 150}" for i in range(5000)))]
    items = [(i, text(12)) for i in range(25)] + [(30, "w140 w141 W142 w130"), (31, None), (32, "nothing here"), (33, "w1 w2"), (33, "w130"), (None, "É 日本"), (34, "x" * 600), (35, "the w130 w131 w132")]
    if small:
        for name, value in (("SEGMENT_DOCS", 40), ("BLOCK", 3), ("SLICE", 64)):
            monkeypatch.setattr(search, name, value)
        spark.sparkContext.broadcast  # tasks import the module anew, so the small sizes hold in the driver's own pass below
        found = search.Items.of([i for i, _ in items[:25]], [[t] for _, t in items[:25]])
        df, n_docs, n_terms = np.zeros(len(found.hash), np.int64), 0, 0
        column = pa.array([t for _, t in docs], pa.string())
        for _, _, n, row, term in found.hits(column):
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
            for t in np.unique(np.stack([row, term]), axis=1)[1]:
                df[t] += 1
        found.weigh(df, n_docs, n_terms)

        class Shared:
            value = found

        batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()).slice(a, 50), column.slice(a, 50)], ["doc_id", "text"]) for a in range(0, len(docs), 50)]
        got = [(r["item_id"], r["doc_id"], r["score"]) for b in search._search(Shared, 10)(iter(batches)) for r in b.to_pylist()]
        assert sorted(got, key=str) == sorted([(i, d, s) for i, _, d, s in ranked(docs, items[:25], 10)], key=str)
        return
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, item long").repartition(3)
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    for chars in (8_000_000, 400):
        got = [tuple(r) for r in search.rank(frame, bench, 10, block_chars=chars, keep=Scratch(spark, "t").keep).collect()]
        assert sorted(got, key=str) == sorted(ranked(docs, items, 10), key=str)
    assert search.rank(frame.limit(0), bench, keep=Scratch(spark, "t").keep).count() == 0 == search.rank(frame, bench.limit(0), keep=Scratch(spark, "t").keep).count()


def test_blocks_are_skipped(spark):
    rng = np.random.default_rng(6)
    items = search.Items.of([0], [["rare common"]])
    column = pa.array([f"{'rare ' if i < 12 else ''}common {'filler ' * int(rng.integers(1, 90))}" for i in range(3000)])
    items.weigh(np.array([{4: 12, 6: 2999}[n] for n in items.size.tolist()]), 3000, 150_000)
    best, opened = search.Best(items, 10), []
    blocks = search.Segment.blocks

    class Shared:
        value = items

    try:
        search.Segment.blocks = lambda self, t, b: (opened.append(int(items.size[t])), blocks(self, t, b))[1]
        out = list(search._search(Shared, 10)(iter([pa.RecordBatch.from_arrays([pa.array(range(3000)), column], ["doc_id", "text"])])))
    finally:
        search.Segment.blocks = blocks
    assert opened == [4] and sum(b.num_rows for b in out) == 10 and best is not None


def test_queries_of_the_three_are_registered():
    assert {"op11_token_counts", "op12_conversation_repair", "op13_lexical_search"} <= set(queries.queries()) and {"op12_conversation_repair", "op13_lexical_search"} <= set(queries.oracle_sql())
