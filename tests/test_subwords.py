"""Subwords against a public vocabulary's library, and records of several layouts read as variants."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewrit.operators import subwords
from tidewrit.sources import readers

PATH = "/opt/tokenizers/word_bpe_49k.json"


def test_words_have_the_subwords_of_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    with open(PATH, encoding="utf-8") as f:
        text = f.read()
    library = tokenizers.Tokenizer.from_str(text)
    bpe = subwords.Subwords.from_json(text, begin_mark="<|startoftext|>", end_mark="<|endoftext|>", lower=True)
    rng = random.Random(2)
    words = ["hello", "Unbelievable", "a", "aaaaaaaa", "strasse", "tokenization", *("".join(rng.choice("abcdeghnorst") for _ in range(rng.randint(1, 14))) for _ in range(300))]
    for w in words:
        assert bpe.word(w) == library.encode(w, add_special_tokens=False).ids, w
    rows = [words[:5], [], None, words[5:9], ["", None, "a"]]
    out = bpe.rows(pa.array(rows, pa.list_(pa.string()))).to_pylist()
    assert out[2] is None and out[1] == {"ids": [49406, 49407], "words": []}
    for row, e in zip(rows, out):
        if row:
            assert (e["ids"][0], e["ids"][-1]) == (49406, 49407)
            assert [e["ids"][w["first"] : w["last"] + 1] for w in e["words"]] == [bpe.word(w) for w in row] and all(w["first"] <= w["last"] for w in e["words"])


def test_pooled_words(spark):
    bpe = subwords.Subwords({"ab</w>": 0, "c": 1, "d</w>": 2, "<unk>": 3}, [("a", "b</w>")])
    df = spark.createDataFrame([(["ab", "cd", "x"],)], "words array<string>").withColumn("e", subwords.encoder(spark, bpe)("words"))
    vectors = F.transform("e.ids", lambda i: F.array(i.cast("double"), F.lit(1.0)))
    r = df.select("e", subwords.counts(F.col("e")).alias("n"), subwords.word_vectors(F.col("e"), vectors, 2).alias("v")).first()
    assert r["e"]["ids"] == [0, 1, 2, 3] and r["n"] == [1, 2, 1] and r["v"] == [[0.0, 1.0], [1.5, 1.0], [3.0, 1.0]]


def test_records_of_every_layout_are_variants(spark, tmp_path):
    lines = [
        {"id": "1", "tokens": ["a", ",", "b"], "bio_tags": ["O", "O", "O"], "normalized_text": "A, b"},
        {"id": "2", "tokens": [{"text": "x", "start": 0}, {"other": 1}], "bio_tags": ["O", "O"], "punctuation_targets": ["O", "PERIOD"]},
        {"id": 3, "words": ["w"], "punct": ["O"], "spans": [[0, 0, "DATE"]], "tokens": None},
        {"id": "4", "tokens": "no list", "spans": {"no": "list"}},
        {"id": "5", "tokens": []},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([*map(json.dumps, lines), "no json {", ""]), encoding="utf-8")
    got = readers.read_variant_bundle(spark, f"file://{tmp_path}/in").collect()
    by = {r["id"]: r for r in got if r["id"]}
    assert by["1"]["tokens"] == ["a", ",", "b"] and not by["1"]["objects"] and by["1"]["normalized_text"] == "A, b"
    assert by["2"]["tokens"] == ["x", ""] and by["2"]["objects"] and by["2"]["punctuation_targets"] == ["O", "PERIOD"]
    assert by["3"]["spans"] == [["0", "0", "DATE"]] and by["3"]["tokens"] is None and by["4"]["tokens"] is None and by["4"]["spans"] is None
    assert by["5"]["tokens"] == [] and not by["5"]["objects"] and len(got) == 6 and sum(r["id"] is None for r in got) == 1


def test_many_inputs_are_one_scan(spark, tmp_path):
    (tmp_path / "more").mkdir()
    for i in range(12):
        (tmp_path / f"f{i}.csv").write_text(f'h{i},other\n"Một, ""hai"" {chr(97 + i)}",x\nchung,y\n' if i % 2 else f"\ufeffdòng {chr(97 + i)}\nlặp\n\nlặp,z\n", "utf-8")
    (tmp_path / "more" / "x.txt").write_text("trong thư mục\nchung\nmã 7\n", "utf-8")
    (tmp_path / "more" / "empty.csv").write_text("", "utf-8")
    paths = [*(str(tmp_path / f"f{i}.csv") for i in range(12)), str(tmp_path / "more")]
    out = readers.read_inputs(spark, paths)
    got = [(r["line"], r["file"]) for r in out.collect()]
    want, seen = [], set()
    for i in range(12):
        lines = [f'một, "hai" {chr(97 + i)}', "chung"] if i % 2 else ["lặp"]
        for x in lines:
            if x not in seen:
                want.append((x, paths[i]))
                seen.add(x)
    assert got == [*want, ("trong thư mục", paths[-1])]
    assert out._jdf.queryExecution().analyzed().toString().count("Union") == 0
    assert [r["line"] for r in readers.read_inputs(spark, paths, min_words=3).collect()] == [x for x, _ in got if len(x.split(" ")) >= 3]
