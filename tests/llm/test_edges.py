"""Repeats, ties, clashing names, empty tables and other ways of the operators, against brute force."""

import importlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrit.llm import ann, decontam, langid, licenses, lines, mixing, queries, shards, urls
from tidewrit.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, h1 string, __src string, __found string"


def docs(spark, rows):
    """Rows of documents with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "f") for i, t, s in rows], DOCS)


def keep(spark):
    return Scratch(spark, "t").keep


def test_repeated_rows_push_no_neighbour_out(spark):
    near, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, near)] * 15 + [(6, near), (7, near), (100, [1.0, 0.1, 0.0]), (8, [1.0, 0.5, 0.0]), (9, far), (9, near)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, verified string")
    got = ann.search(df, F.col("vec_id") == 100, k=4, keep=keep(spark)).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [5, 6, 7, 9] and abs(got[3]["score"] - 0.1) < 1e-12
    every = ann.search(df, F.col("vec_id") == 100, k=10, keep=keep(spark)).orderBy("rank").collect()
    assert [r["vec_id"] for r in every] == [5, 6, 7, 9, 8]


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 32))[rng.integers(0, 40, 2000)] * 6 + rng.normal(size=(2000, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 100 == 0, cell_rows=200, keep=keep(spark)).collect()
    hits = 0
    for q in range(0, 2000, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(2000), d)) if i != q][:10]
        hits += len(set(want) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * 200 and np.mean([r["verified"] for r in got]) < 0.1 * 2000


def test_every_sequence_stands_at_its_slot(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 9), "a") for i in range(60)]
    df = docs(spark, rows).repartition(3, "doc_id")
    parts = [[(r["doc_id"], r["text"]) for r in p] for p in df.rdd.glom().collect()]
    out = {r["slot"]: r for r in shards.materialise(df, f"file://{tmp_path}/s", length=16, per_shard=7, key=9, keep=keep(spark)).collect()}
    p, sequences = shards.Pieces(shards.read_vocabulary(shards.VOCABULARY)), []
    for part in parts:
        stream = [(x, i) for i, t in part for x in [*p.bpe.encode_ordinary(t), shards.END]]
        sequences += [stream[a : a + 16] for a in range(0, len(stream), 16)]
    read = list(shards.read_sequences(f"file://{tmp_path}/s"))
    slots = shards.feistel(np.arange(len(sequences)), len(sequences), 9)
    assert len(read) == len(out) == len(sequences)
    for slot, s in zip(slots.tolist(), sequences):
        r = out[slot]
        assert read[slot][: len(s)].tolist() == [x for x, _ in s] and r["n_tokens"] == len(s) and list(dict.fromkeys(i for _, i in s)) == r["doc_ids"] and (r["shard"], r["byte_offset"]) == (slot // 7, slot % 7 * 32)
    with pytest.raises(Exception):
        shards.materialise(df, "nowhere://x/y", keep=keep(spark))


def test_pieces_have_a_bound_and_long_ones_are_encoded_whole(monkeypatch):
    import pyarrow as pa

    from tidewrit.llm import kernels

    p = shards.Pieces(shards.read_vocabulary(shards.VOCABULARY))
    monkeypatch.setattr(shards, "PIECE_BYTES", 1000)
    texts = ["x" * 3000 + " y", "a b", "日本" * 400 + " z", *(f"w{i} v{i}" for i in range(50))]
    for _ in range(2):
        ids, off = p.encode(*kernels.raw(pa.array(texts)))
        assert all(ids[off[i] : off[i + 1]].tolist() == [*p.bpe.encode_ordinary(t), shards.END] for i, t in enumerate(texts))


def test_rules_in_parts_and_clashing_names(spark):
    rows = [(i, u, "a", "b", "c", "d") for i, u in enumerate(["http://a.com/x", "http://www.example.com/en/1", "http://example.com/en/", None, "", "http://n.net/es/q", "http://n.org/"])]
    df = spark.createDataFrame(rows, "page_id long, url string, __host string, host string, rule string, __found string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    whole = {r["page_id"]: r for r in urls.judge(df, rules, keep=keep(spark)).collect()}
    parts = {r["page_id"]: r for r in urls.judge(df, rules, part_rules=2, keep=keep(spark)).collect()}
    assert whole == parts and all(r["__host"] == "a" and r["__found"] == "d" for r in whole.values())
    assert [whole[i]["rule"] for i in range(7)] == ["com/", "www.example.com/en/", "example.com/en/", None, None, "net/es/", None]


def test_common_words_open_no_regions(spark):
    common = "one of the most it is the end of the day and in the same way".split()
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.permutation(common).tolist() + ["one", "of", "the", f"own{i}", "end", "of", "the", "day"]), "a") for i in range(300)]
    items = [(k, " ".join(["one", "of", "the", *(f"z{k}x{j}" for j in range(12)), "end", "of", "the", "day"])) for k in range(40)]
    rows += [(1000 + k, f"before it {items[k][1]} and after", "a") for k in range(5)]
    rows += [(2000, " ".join(w for j, w in enumerate(items[9][1].split()) if j % 8 != 5), "a")]
    bench = spark.createDataFrame([*items, (77, items[3][1]), (None, items[4][1])], "item_id long, text string")
    found = decontam.contamination(docs(spark, rows), bench, keep=keep(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1000 + k, k) for k in range(5)} | {(1003, 77), (1004, None), (2000, 9)}


def test_mixture_against_brute_force(spark):
    rows = [(i, "w " * (i % 5 + 1), ("big", "mid", "low", None)[0 if i % 2 else 1 if i % 6 == 0 else 2 if i % 10 == 0 else 3]) for i in range(1500)] + [(9000, "", "big"), (9001, None, "low")]
    df = docs(spark, rows)
    out = mixing.mix(df, block_docs=40, seed=5, keep=keep(spark)).collect()
    hashed = df.select("doc_id", mixing.source_key("source").alias("__src"), F.xxhash64(F.lit(5), "doc_id", "text").alias("__row"))
    m = mixing.mixture(df.select(mixing.source_key("source").alias("__src"), mixing.word_count("text").alias("mix_words")), None, None, 0.98, 1.25, keep(spark))
    sources = {r["src"]: r for r in m.sources.collect()}
    blocks = {s: max(1, -(-r["docs"] // 40)) for s, r in sources.items()}
    table = spark.createDataFrame(list(blocks.items()), "__src string, blocks long")
    hashed = hashed.join(table, "__src").withColumn("block", F.pmod("__row", "blocks")).withColumns({"order": mixing._order(5, "block", "block"), "inner": mixing._order(5, "row", "__row")})
    words = {i: len((t or "").split()) for i, t, _ in rows}
    want = {}
    for s in sources:
        mine = [r for r in hashed.collect() if r["__src"] == s]
        epochs = sources[s]["epochs"]
        whole = int(epochs + 1e-9)
        left, paid = max(0.0, (epochs - whole) * sources[s]["words"]), set()
        for r in sorted((r for r in mine if words[r["doc_id"]]), key=lambda r: (r["order"], r["block"], r["inner"], r["__row"])):
            if words[r["doc_id"]] > left + 1e-6:
                break
            left -= words[r["doc_id"]]
            paid.add(r["doc_id"])
        for r in mine:
            want[r["doc_id"]] = (whole + (r["doc_id"] in paid) if words[r["doc_id"]] else 1, r["block"])
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["mix_epoch"], r["mix_block"]))
    assert {i: (len(x), x[0][1]) for i, x in got.items()} == {i: x for i, x in want.items() if x[0]} and all(sorted(e for e, _ in x) == list(range(len(x))) for x in got.values())
    same = mixing.mixture(spark.createDataFrame([("a", 10), ("b", 10)], "__src string, mix_words long"), None, None, 0.5, None, keep(spark))
    assert same.exponent == 1.0 and not same.met


def test_full_texts_of_many_licenses(spark):
    rng = np.random.default_rng(8)
    words = [f"t{i}" for i in range(3000)]
    texts = [(f"license {k}", " ".join(rng.choice(words, int(n)))) for k, n in enumerate(rng.integers(20, 900, 500))]
    rows = []
    for k in range(0, 500, 25):
        w = texts[k][1].split()
        cut = w[: int(len(w) * 0.85)] if k % 50 else w
        rows.append((k, " ".join([*rng.choice(words, int(rng.integers(0, 300))), *cut, *rng.choice(words, 50)]), "a"))
    rows += [(1000, " ".join(rng.choice(words, 400)), "a"), (1001, " ".join(texts[3][1].split()[: len(texts[3][1].split()) // 2]), "a")]
    table = spark.createDataFrame([*texts, ("nothing", None), ("blank", " ")], "license string, text string")
    for block in (1000, 120):
        got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(docs(spark, rows), table, block_templates=block, keep=keep(spark)).collect()}
        assert set(got) == {(k, f"license {k}") for k in range(0, 500, 25)} and all(c == 1.0 for (k, _), c in got.items() if k % 50 == 0)


def test_texts_without_their_repeated_lines(spark):
    rows = [(1, "First line of all\n\nsecond one here\nFirst line of all", "a"), (2, "second one here\nown words", "a"), (3, "  first LINE of all ", "a"), (4, None, "a"), (5, "", "a"), (None, "second one here", "a")]
    got = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(docs(spark, rows), Scratch(spark, "t")).collect()}
    assert got == {1: "First line of all\n\nsecond one here", 2: "own words", 3: "", 4: None, 5: "", None: "second one here"}


def test_stages_of_the_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeats, equal ids, clashing names and empty tables pass each stage."""
    pipeline = importlib.import_module("corpus_pipeline")
    rng = np.random.default_rng(2)
    vocabulary = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(i, text(40) + (". you scoundrel villain." if i % 4 == 0 else "."), "a" if i % 3 else "b") for i in range(240)]
    copy = rows[5][1]
    odd = [(500, copy, "a"), (500, text(40), "a"), (None, copy, "b"), (None, text(30), None), (501, None, "a"), (502, "", "a"), (503, " \n ", None), (504, text(30_000), "a"), (505, f"{text(20)} {item} {text(20)}", "a"), (None, f"{item} {text(9)}", "a"), (506, "x", "a"), (506, "x", "a")]
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, df = dict(pipeline.STAGES), docs(spark, rows + odd)
    clean = stages["toxicity"](spark, df, str(tmp_path))
    assert clean.columns == df.columns
    ids = [r["doc_id"] for r in clean.collect()]
    assert len([i for i in ids if i is not None and i < 240 and i % 4 == 0]) <= 3 and len([i for i in ids if i is not None and i < 240 and i % 4]) >= 177 and {501, 502, 503, 506} <= set(ids)
    one = stages["ngram_jaccard_join"](spark, docs(spark, [*rows[1:4], rows[5], *odd]), str(tmp_path)).collect()
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1 for r in one))
    assert kept == sorted([1, 2, 3, 5, 500, -1, -1, 501, 502, 503, 504, 505, 506])
    left = stages["benchmark_decontamination"](spark, docs(spark, odd), str(tmp_path)).collect()
    assert len(left) == len(odd) - 2 and 505 not in {r["doc_id"] for r in left}
    mixed = stages["mixing_sources"](spark, docs(spark, odd), str(tmp_path))
    assert mixed.columns == df.columns and {(r["doc_id"], r["text"]) for r in mixed.collect()} == {(i, t) for i, t, _ in odd}
    out = stages["token_id_output"](spark, docs(spark, odd), str(tmp_path)).collect()
    assert sorted(r["slot"] for r in out) == list(range(len(out))) and {d for r in out for d in r["doc_ids"]} == {i for i, _, _ in odd}
    empty = df.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_registered_queries_name_their_operators():
    assert [n for n in queries.queries() if n.startswith("op")] == [f"op{k}_{x}" for k, x in enumerate("nearest_neighbours training_order url_filter language toxicity decontamination mixture licenses ngram_jaccard line_dedup".split(), 1)]


def test_ids_of_several_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(5, [1.0, 0.001 * i, 0.0]) for i in range(15)] + [(i, [1.0, 0.1, 0.01 * i]) for i in range(6, 20)] + [(100, [1.0, 0.0, 0.0]), (100, [1.0, 0.2, 0.3]), (200, [1.0, 0.0, 0.0])]
    rows += [(7, [1.0, 0.05, 0.0]), (300 + 7, [1.0, 0.05, 0.0])] + [(1001 + i, (rng.normal(size=3) * 3).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def want(q, k):
        own = [np.array(v) for i, v in rows if i == q]
        least: dict = {}
        for i, v in rows:
            if i != q:
                least[i] = min([least.get(i, np.inf), *(float(np.sqrt(((np.array(v) - o) ** 2).sum())) for o in own)])
        return sorted((d, i) for i, d in least.items())[:k]

    for cell_rows in (8192, 20):  # one cell; many, some of them cut into parts
        got = {}
        for r in ann.search(df, F.col("vec_id").isin(100, 200, 5, 7), k=10, m=2, confidence=0.999, cell_rows=cell_rows, keep=keep(spark)).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
        for q in (100, 200, 5, 7):
            assert [(round(d, 9), i) for _, d, i in sorted(got[q])] == [(round(d, 9), i) for d, i in want(q, 10)], (q, cell_rows)


def test_large_cells_are_cut_into_parts(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(900, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, confidence=0.999, cell_rows=50, sample=8, keep=keep(spark)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        hits += len(got[q] & {int(i) for i in np.argsort(d)[1:11]})
    assert hits >= 0.95 * 90


def test_a_text_that_many_rows_repeat_is_in_a_sample_once(spark):
    rng = np.random.default_rng(4)
    made = {lang: [f"{a}{b}" for a in parts for b in parts] for lang, parts in (("de", ["ung", "sch", "ein", "keit", "zu"]), ("en", ["the", "ing", "ou", "er", "wh"]))}
    text = lambda lang, n: " ".join(rng.choice(made[lang], n))
    rows = [(i, text("de", 400), "de") for i in range(40)] + [(100 + i, text("en", 400), "en") for i in range(40)]
    hot = "the ing ou er " * 700  # the language of these rows, and nothing like it
    rows += [(1000, hot, "de")] * 400 + [(2000 + i, hot, "de") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = langid.learn(df)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df.where("doc_id < 1000"), parser).collect()}
    assert all(got[i] == "de" for i in range(40)) and all(got[100 + i] == "en" for i in range(40))


def test_no_exchange_of_the_samples_carries_whole_texts(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"wort {i} " * 900, "de") for i in range(30)], "doc_id long, text string, lang string")
    seen = []
    to_arrow = type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: (seen.append(self._jdf.queryExecution().executedPlan().toString()), to_arrow(self))[1])
    langid.learn(df)
    assert len(seen) == 1 and "SortMergeJoin" not in seen[0] and "BroadcastHashJoin" in seen[0]


def test_rows_of_one_id_keep_their_own_lines(spark):
    df = docs(spark, [(1, "A line of its own words\nB line that stands nowhere else", "a"), (1, "C line of the second row\nA line of its own words", "a"), (2, "D line\nC line of the second row", "b")])
    got = sorted((r["doc_id"], r["text"]) for r in lines.without_repeated_lines(df, Scratch(spark, "t")).collect())
    text = "\n".join(t for _, t in got)
    assert all(text.count(x) == 1 for x in ("A line of its own words", "B line that stands nowhere else", "C line of the second row", "D line"))
