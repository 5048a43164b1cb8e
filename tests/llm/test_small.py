"""Operators against brute force and on odd rows."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewrit.llm import ann, decontam, jaccard, kernels, langid, licenses, lines, mixing, shards, toxicity, urls
from tidewrit.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, h string"
LONG = " ".join(f"w{i}" for i in range(30_000))


def docs(spark, rows):
    """Rows of documents with two more columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], DOCS)


ODD = [(1, "one two three four five six seven", "a"), (2, "one two three four five six seven", None), (3, "", "a"), (4, None, "b"), (None, "one two three four five six seven", "b"), (5, " \n\t ", "a"), (6, "x", "a"), (6, "x", "a"), (7, LONG, "a"), (8, "É à la 日本 😀 " * 3, "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, []) if False else spark.createDataFrame([], DOCS)


def test_kernels_hash_words_as_python_splits_them():
    texts = ["a b  a", "", None, " lead", "É é", "tab\tb\nc"]
    h, off = kernels.words(*kernels.raw(kernels.lower(pa.array(texts))))
    want = [(t or "").lower().split() for t in texts]
    assert np.diff(off).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert all((flat[i] == flat[j]) == (h[i] == h[j]) for i, j in itertools.combinations(range(len(flat)), 2))
    g, goff = kernels.shingles(h, off, 2)
    assert np.diff(goff).tolist() == [max(len(w) - 1, 1 if w else 0) for w in want]


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 16)) + rng.integers(0, 4, (400, 1)) * 3
    v[200:320] = v[7]  # a third are one vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0]), (None, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, cell_rows=60, keep=Scratch(spark, "t").keep).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 50))
    hit = 0
    for q, rows in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for _, i, s in rows)
        hit += len(set(order) & {i for _, i, _ in rows})
    assert hit >= 0.9 * 10 * len(got)
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0, keep=Scratch(spark, "t").keep).count() == 0
    assert ann.search(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0, keep=Scratch(spark, "t").keep).count() == 2


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(shards.feistel(np.arange(n), n, 5).tolist()) == list(range(n))
    assert shards.feistel(np.arange(1000), 1000, 5).tolist() != shards.feistel(np.arange(1000), 1000, 6).tolist()


def test_tokens_equal_those_of_whole_texts():
    p = shards.Pieces(shards.read_vocabulary(shards.VOCABULARY))
    texts = ["a b  c\n\n d ", "", None, "it's 12 %% x", "a\u00a0 b", "\n", " \u3000日本 x", "x" * 3000]
    for _ in range(2):
        ids, off = p.encode(*kernels.raw(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == [*p.bpe.encode_ordinary(t or ""), shards.END]


def test_shards_hold_every_token_once(spark, odd, empty, tmp_path):
    df = odd.repartition(3)
    df = spark.createDataFrame(df.collect(), DOCS)
    out = shards.materialise(df, str(tmp_path / "s"), length=8, per_shard=100, keep=Scratch(spark, "t").keep).collect()
    n = len(out)
    assert sorted(r["slot"] for r in out) == list(range(n))
    read = list(shards.read_sequences(str(tmp_path / "s")))
    assert len(read) == n and all(np.array_equal(a, b) for a, b in zip(read[137:], shards.read_sequences(str(tmp_path / "s"), 137)))
    by_slot = {r["slot"]: r for r in out}
    kept = sorted(x for i, s in enumerate(read) for x in s[: by_slot[i]["n_tokens"]].tolist())
    p = shards.Pieces(shards.read_vocabulary(shards.VOCABULARY))
    assert kept == sorted(x for _, t, _ in ODD for x in [*p.bpe.encode_ordinary(t or ""), shards.END])
    assert {d for r in out for d in r["doc_ids"]} == {i for i, _, _ in ODD}
    assert shards.materialise(empty, str(tmp_path / "e"), keep=Scratch(spark, "t").keep).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_url_rules_against_brute_force(spark):
    urls_ = ["http://A.com/x", "http://a.com", "https://example.com/en/a?b", "https://x.example.com/en/", "http://www.example.com/en/1#f", "http://b.www.example.com/en/", "http://q.net/es/", "http://net/fr/z", "http://anet/es/", "//x", None, "", "a://b://com/", "http://u@com:80/", "http://com?x", "http://.com/", "http://example.com/e", "http://com/en/ "] * 3
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls_)], "page_id long, url string, h string")

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = urls.judge(df, rules, keep=Scratch(spark, "t").keep).collect()
    assert len(got) == len(urls_) and all((r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"]) for r in got)
    assert urls.judge(df, rules.limit(0), keep=Scratch(spark, "t").keep).where("rule is not null").count() == 0
    assert urls.judge(df.limit(0), rules, keep=Scratch(spark, "t").keep).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("h"))
    inside, outside = spark.range(1500).select(F.xxhash64("id").alias("h")), spark.range(1500, 4000).select(F.xxhash64("id").alias("h"))
    levels = urls.cascade(inside, outside, Scratch(spark, "t").keep)
    h = np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64)
    assert len(levels) > 1 and urls.listed(levels, h).tolist() == [i < 1500 for i in range(4000)]


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_phrases_against_brute_force():
    p = langid.Parser({k: langid.letters(pa.array([t]))[0] for k, t in (("a", "banana bandana"), ("b", "ontology tonic"))})

    def brute(t, s):
        n, i = 0, 0
        while i < len(t):
            j = i
            while j < len(t) and t[i : j + 1] in s:
                j += 1
            n, i = n + 1, max(j, i + 1)
        return n

    for text in ("banan tonicq ontolog zz", "aqb", "aqbqc", "zz", "a", "ontology", " qa"):
        code, off, _ = langid.letters(pa.array([text]))
        seen = code.tobytes().decode("utf-32-le").replace("\0", " ")
        assert p.phrases(code, off)[0].tolist() == [brute(seen, s) for s in ("banana bandana", "ontology tonic")]


def test_language_of_odd_rows(spark, odd, empty):
    rows = [(i, f"the quick brown fox number {'abc' * (i % 3)} jumps over the lazy dog", "en") for i in range(40)] + [(i, f"der schnelle braune fuchs {'xyz' * (i % 3)} springt über den faulen hund", "de") for i in range(40, 80)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = langid.learn(train)
    assert p.names == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.identify(odd, p).collect()}
    assert got[4]["lang_pred"] == got[3]["lang_pred"] == got[5]["lang_pred"] == "und" and got[4]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    new = spark.createDataFrame([(1, "The dog jumps over the brown fox"), (2, "Der Hund springt über den Fuchs")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(new, p).orderBy("doc_id").collect()] == ["en", "de"]
    assert langid.identify(odd, langid.learn(train.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, p).count() == 0


def test_long_texts_fill_a_languages_sample(spark):
    rng = np.random.default_rng(8)
    text = lambda a, n: "".join(rng.choice(list(a), n))
    rows = [(i, text("abcdefgh", 20_000), "many long") for i in range(40)] + [(100, text("ijklmnop", 2_000_000), "one huge")]
    rows += [(101 + i, text("ijklmnop", 200), "one huge") for i in range(40)] + [(200, text("qrstuvwx", 5000), "one row"), (300, "", "empty")]
    rows += [(400 + i, text("yz", 30), "short") for i in range(3)]
    p = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=800)
    assert dict(zip(p.names, np.round(2**p.bits).astype(int).tolist())) == {"many long": 800, "one huge": 800, "one row": 800, "short": 92}


# --- 5 ---------------------------------------------------------------------------------------------------------------


def test_toxic_sentences_are_found_from_document_labels(spark, odd, empty):
    rng = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        s = [" ".join(rng.choice(vocabulary, 8)) + "." for _ in range(6)]
        if i % 3 == 0:
            s[int(rng.integers(6))] = " ".join([*rng.choice(vocabulary, 5), "scoundrel", "word1."])
        rows.append((i, " ".join(s), "a"))
        labels.append((i, int(i % 3 == 0)))
    df, lab = docs(spark, rows), spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.train(df, lab, Scratch(spark, "t").keep)
    got = toxicity.score(df, model).withColumn("held", toxicity.held_out()).where("held").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 3 == 0) for r in got]) > 0.95
    found = toxicity.offending_sentences(df, model).collect()
    assert found and np.mean(["scoundrel" in r["sentence"] for r in found]) > 0.9
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert scores[3] == scores[4] == scores[5] == 0.0 and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.score(empty, model).count() == 0


def test_long_documents_teach_with_their_whole_texts(spark):
    rng = np.random.default_rng(10)
    vocabulary = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(120):
        clean = ". ".join(" ".join(rng.choice(vocabulary, 8)) for _ in range(420))
        rows.append((i, clean + (". you word1 scoundrel word2" if i % 3 == 0 else ". you word1 word2"), "a"))
    df, lab = docs(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    assert min(len(t) for _, t, _ in rows) > 21_000
    model = toxicity.train(df, lab, Scratch(spark, "t").keep)
    new = docs(spark, [(1, "word5 scoundrel word6", "a"), (2, "word5 word6", "a")])
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(new, model).collect()}
    assert scores[1] > 2 * scores[2]
    some = toxicity.labelled_sample(df, lab, 10, 100_000).collect()
    assert 1 <= len(some) < 10 and all(r["text"] in {x for _, x, _ in rows} for r in some)


# --- 6 ---------------------------------------------------------------------------------------------------------------


def brute_sw(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_smith_waterman_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, m = rng.integers(1, 9, 2)
        a, b = rng.integers(0, 4, n).astype(np.uint64), rng.integers(0, 4, m).astype(np.uint64)
        pad = lambda x, k, f: np.concatenate([x, np.full(k - len(x), f, np.uint64)])[None]
        best, _, _ = decontam.smith_waterman(pad(a, 10, 98), np.array([n]), pad(b, 12, 99), np.array([m]))
        assert best[0] == brute_sw(a.tolist(), b.tolist())


def test_edited_copies_are_found_and_clean_texts_are_left(spark, odd, empty):
    words = [f"q{i}" for i in range(40)]
    item = " ".join(words)
    edited = " ".join(w for i, w in enumerate(words) if i % 9).replace("q20", "changed")
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, "")], "item_id long, text string")
    rows = [(1, f"{LONG[:3000]} {item.upper()}, {LONG[3000:5000]}", "a"), (2, f"noise {edited} noise", "a"), (3, "q1 q2 q3 and nothing else of it", "a"), (4, "a tiny item here", "a"), (5, "tiny, but no", "a")]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contamination(docs(spark, rows), bench, keep=Scratch(spark, "t").keep).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2)} and got[(1, 1)] == 1.0
    split = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contamination(docs(spark, rows), bench, block_chars=100, keep=Scratch(spark, "t").keep).collect()}
    assert split == got
    for d, b in ((odd, bench), (empty, bench), (odd, bench.limit(0))):
        assert decontam.contamination(d, b, keep=Scratch(spark, "t").keep).count() == 0


def test_long_excerpts_of_longer_items_are_found(spark):
    words = [f"q{i}" for i in range(300)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(1, "noise " * 20 + " ".join(words[100:180]) + " noise" * 20, "a"), (2, "noise " + " ".join(words[100:130]), "a")]
    got = {r["doc_id"]: r["score"] for r in decontam.contamination(docs(spark, rows), bench, keep=Scratch(spark, "t").keep).collect()}
    assert set(got) == {1} and abs(got[1] - 80 / 300) < 1e-9


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_mixture_meets_its_limits(spark, odd, empty):
    rows = [(i, "w " * (i % 7 + 1), "big" if i % 3 else f"s{i % 5}") for i in range(3000)]
    df = docs(spark, rows)
    m = mixing.mixture(df.select(mixing.source_key("source").alias("__src"), mixing.word_count("text").alias("mix_words")), None, None, 0.98, 1.25)
    src = {r["src"]: r for r in m.sources.collect()}
    p = np.array([r["share"] for r in src.values()])
    w = p**m.exponent / (p**m.exponent).sum()
    assert abs(sum(r["weight"] for r in src.values()) - 1) < 1e-9 and np.allclose(w, [r["weight"] for r in src.values()])
    assert max(r["epochs"] for r in src.values()) <= 1.25 + 1e-6 and abs(min(r["epochs"] for r in src.values()) - 1) < 1e-9
    out = mixing.mix(df, block_docs=50, keep=Scratch(spark, "t").keep).collect()
    assert {r["doc_id"] for r in out} == set(range(3000))
    for s, r in src.items():
        read = sum(x["mix_words"] for x in out if "=" + x["source"] == s)
        assert r["epochs"] * r["words"] - 7 <= read <= r["epochs"] * r["words"] + 1e-6
    tight = mixing.mix(df, budget=2000.0, entropy_share=None, max_repeats=None, block_docs=50, keep=Scratch(spark, "t").keep)
    assert 2000 - 7 * 6 <= tight.agg(F.sum("mix_words")).first()[0] <= 2000
    assert mixing.mix(odd, keep=Scratch(spark, "t").keep).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert mixing.mix(empty, keep=Scratch(spark, "t").keep).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_licenses_against_brute_force(spark, odd, empty):
    filler = " ".join(f"f{i}" for i in range(200))
    rows = [(i, f"{filler[: 37 * i]} {s} {filler}", "a") for i, (_, s) in enumerate(licenses.TEMPLATES)]
    rows += [(100, filler, "a"), (101, "ALL\nrights   Reserved", "a"), (102, "released under the license of someone", "a"), (103, None, "a"), (104, "", "a"), (105, licenses.TEMPLATES[2][1].replace("law", "lore"), "a")]

    def grams(t):
        w = [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    want = {(i, name) for i, t, _ in rows if t for name, s in licenses.TEMPLATES if len(grams(s) & grams(t)) >= 0.8 * len(grams(s))}
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs(spark, rows), keep=Scratch(spark, "t").keep).collect()}
    assert got == want and (101, "all-rights-reserved") in got and (105, "apache-2.0-header") in got
    assert licenses.scan(odd, keep=Scratch(spark, "t").keep).count() == 0 and licenses.scan(empty, keep=Scratch(spark, "t").keep).count() == 0


# --- 9 and 10 --------------------------------------------------------------------------------------------------------


def roots(n, linked):
    r = list(range(n))
    for a, b in linked:
        x, y = r[a], r[b]
        r = [min(x, y) if v in (x, y) else v for v in r]
    return r


def test_jaccard_against_brute_force(spark, odd, empty):
    rng = np.random.default_rng(5)
    base = [[f"v{x}" for x in rng.integers(0, 500, 80)] for _ in range(12)]
    texts = []
    for b in base:
        for k in (0, 0, 1, 2, 3, 6):
            w = list(b)
            for at in rng.integers(0, 80, k):
                w[at] = "edit"
            texts.append(" ".join(w).title() if k == 1 else " ".join(w))
    hot = [f"h{x}" for x in range(300)]
    texts += [" ".join(hot[:i] + ["z"] + hot[i:]) for i in range(280)]  # one large group of near copies
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want, links = roots(len(texts), pairs), np.bincount(np.array(pairs).reshape(-1), minlength=len(texts))
    df = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    for r in jaccard.near_duplicates(df, Scratch(spark, "t")).collect():
        assert (r["class_id"], r["n_links"]) == (want[r["doc_id"]], links[r["doc_id"]])
    kept = {r["doc_id"] for r in jaccard.keep_representatives(df, Scratch(spark, "t")).collect()}
    assert kept == set(want)
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(odd, Scratch(spark, "t")).collect() if r["doc_id"]}
    assert got[2]["class_id"] == 1 and got[2]["n_links"] == 2 and got[3]["class_id"] == 3 and got[4]["n_links"] == 0 and got[5]["class_id"] == 5
    assert jaccard.near_duplicates(empty, Scratch(spark, "t")).count() == 0
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in jaccard.keep_representatives(odd, Scratch(spark, "t")).collect())
    assert left == [(False, i) for i in (1, 3, 4, 5, 6, 7, 8)]  # the row without an id is a copy of 1


def test_lines_against_brute_force(spark, odd, empty):
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("abcdefgh "), 90)).strip() for _ in range(20)]
    rows = []
    for i in range(60):
        a, b = base[i % 20], base[(i * 7) % 20]
        rows.append((i, "\n".join([a.upper() if i % 2 else a, "", b[: 40] + "é" * (i % 4) + b[40:], f"  own line {i * 997} of text ", "ab"]), "a"))
    places, own = {}, []
    for i, t, _ in rows:
        for n, x in enumerate(t.lower().split("\n")):
            if x.strip():
                places.setdefault(x.strip(), []).append((i, n))
    own = list(places)
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in own]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(own)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = {}
    for k, r in enumerate(roots(len(own), pairs)):
        group.setdefault(r, []).extend(places[own[k]])
    want = {(*p, *min(g)) for g in group.values() for p in g if p != min(g)}
    df = docs(spark, rows)
    got = {tuple(r) for r in lines.repeated_lines(df, Scratch(spark, "t")).collect()}
    assert got == want
    left = {r["doc_id"]: r["text"].split("\n") for r in lines.without_repeated_lines(df, Scratch(spark, "t")).collect()}
    assert sum(len(x) for x in left.values()) >= 60 * 5 - len(want) - 60 and len(left) == 60
    assert {tuple(r)[:2] for r in lines.repeated_lines(odd, Scratch(spark, "t")).collect()} == {(2, 0)}
    assert lines.repeated_lines(empty, Scratch(spark, "t")).count() == 0


def test_short_lines_with_changed_characters_are_found(spark):
    rng = np.random.default_rng(9)
    rows, want = [], set()
    for n in [*range(29, 71), 90, 120, 150, 192, 193]:
        line = "".join(rng.choice(list("abcdefgh "), n - 2)).join("xy")
        changed = line[: n // 2] + "7" + line[n // 2 + 1 :]
        if n == 120:
            changed = changed[:25] + "8" + changed[26:]
        rows += [(n, line, "a"), (1000 + n, changed, "a"), (2000 + n, line[: n // 2] + line[n // 2 + 1 :] if n > 30 else "", "a")]
        want |= {(1000 + n, 0, n, 0)} | ({(2000 + n, 0, n, 0)} if n > 30 else set())
    rows += [(5000 + i, f"page {i} of 45", "a") for i in range(10, 20)]  # other lines, not changed ones
    for df in (docs(spark, rows), docs(spark, rows[::-1]).repartition(3)):
        assert {tuple(r) for r in lines.repeated_lines(df, Scratch(spark, "t")).collect()} == want


def test_rows_that_share_an_id_are_compared_each_for_itself(spark):
    """Twelve ids with two texts each, and one near copy of each text: no link is lost and none counted twice."""
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for i in range(12):
        for side in range(2):
            w = [f"x{x}" for x in rng.integers(0, 900, 60)]
            rows += [(i, " ".join(w), "a"), (i, " ".join(w), "b"), (100 + 2 * i + side, " ".join([*w, "more"]), "a")]
            want[100 + 2 * i + side] = i
    df = docs(spark, rows)
    got = [r for r in jaccard.near_duplicates(df, Scratch(spark, "t")).collect()]
    assert len(got) == len(rows) and {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] >= 100} == want
    assert all(r["n_links"] == 1 and r["n_copies"] == 1 for r in got)
    kept = jaccard.keep_representatives(df, Scratch(spark, "t")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(list(range(12)) * 2)


def test_components_with_a_hub(spark):
    from tidewrit.llm.components import components

    rng = np.random.default_rng(13)
    edges = [(5000 + i, 7) for i in range(300)] + [(6000 + i, 6001 + i) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(8000, 8200, (150, 2))] + [(1, 1), (None, 3)]
    want = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = want.setdefault(a, a), want.setdefault(b, b)
            want = {k: min(x, y) if v in (x, y) else v for k, v in want.items()}
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()
    assert {r["node"]: r["root"] for r in got} == {k: v for k, v in want.items() if k != v}


def test_very_frequent_lines_and_large_ranges_take_the_other_ways(spark, monkeypatch):
    """A line of every document, lines like it, and ranges over their bound: the same lines are dropped either way."""
    rng = np.random.default_rng(14)
    base = "this very line stands in all of the documents of this table"
    rows = [(i, "\n".join([base, "".join(rng.choice(list("abcdefghij "), 80)), base.replace("line", "lyne") if i % 50 == 3 else f"tail {i}"]), "a") for i in range(200)]
    df = docs(spark, rows)
    want = {tuple(r) for r in lines.repeated_lines(df, Scratch(spark, "t")).collect()}
    assert {(i, 0, 0, 0) for i in range(1, 200)} | {(i, 2, 0, 0) for i in range(200) if i % 50 == 3} <= want
    for name, value in (("LEAST_FREQUENT", 20), ("RANGE_BYTES", 1), ("BLOCK", 2), ("BLOCK_CHARS", 100)):
        monkeypatch.setattr(lines, name, value)
        assert {tuple(r) for r in lines.repeated_lines(df, Scratch(spark, "t")).collect()} == want, name


def test_rows_leave_by_their_keys(spark, odd, monkeypatch):
    """Few keys are sent, many go through a filter or, without one, by a shuffle: the same rows stay."""
    from tidewrit.llm import bloom
    from tidewrit.llm.scratch import row_keys

    keys = row_keys("doc_id", "text")
    gone = odd.where("doc_id in (1, 4) or doc_id is null").select(*keys)
    again = odd.where("doc_id = 6").select(*keys)
    want = sorted([2, 3, 5, 6, 7, 8])
    for few, largest in ((100, 1 << 20), (0, 1 << 20), (0, 0)):
        monkeypatch.setattr(bloom, "FEW", few)
        monkeypatch.setattr(bloom, "LARGEST_LEVEL", largest)
        got = bloom.without(odd, gone, Scratch(spark, "t"), keys, again)
        assert got.columns == odd.columns and sorted(r["doc_id"] for r in got.collect()) == want, (few, largest)
    assert bloom.without(odd, gone.limit(0), Scratch(spark, "t"), keys, again.limit(0)).count() == odd.count()
