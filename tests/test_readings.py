"""Readings of catalogues, reports, and readers of files."""

import json

import pytest
from pyspark.sql import functions as F

from tidewrit.operators import corpus, diff, metrics, readings
from tidewrit.operators.normalize import Normalization
from tidewrit.sources import readers


def test_spelling_and_plausibility():
    assert readings.spells("i xi đi ai ét", "ECDIS") and readings.spells("vê hát ép", "VHF") and not readings.spells("vê hát", "VHF") and not readings.spells("", "A")
    assert readings.implausible("ét u ba lăm", "Su-35") is None and readings.implausible("ét u ba sáu", "Su-35") == "another number" and readings.implausible("ba lăm", "Su-35") == "no letters"
    assert readings.implausible("ét u", "Su-35") == "no number" and readings.implausible("gạch pa tri ốt", "Patriot") == "separator at an edge" and readings.implausible("con mèo", "Patriot") == "sounds otherwise"


def test_readings_that_disturb_others_are_refused(spark):
    entries = {"foreign_names": {"Patriot": ["pa tri ốt"], "Pariot": ["pa ri ốt ơi"]}}
    df = spark.createDataFrame([("foreign_names", "Patriot", "Pa-tri ớt"), ("foreign_names", "Patriot", "ba tri ốt tờ"), ("foreign_names", "Nope", "x"), ("foreign_names", "Patriot", ""), ("other", "Patriot", "x"), ("foreign_names", "Patriot", "một hai ba bốn năm sáu bảy tám chín")], "catalogue string, canonical string, reading string")
    got = {r["reading"]: r["reason"] for r in readings.gated(spark, df, entries).collect()}
    assert got["pa tri ớt"] == "redundant" and got["x"] == "no such form" and got[""] == "empty" and got["một hai ba bốn năm sáu bảy tám chín"] == "too long"
    assert got["ba tri ốt tờ"] in (None, "redundant", "reads as another form")
    assert readings.gated(spark, df.limit(0), entries).count() == 0


def test_files_of_both_sides_are_paired(spark):
    w = spark.createDataFrame([("a", 1, "Một. Hai."), ("b", 1, "x")], "topic string, idx int, text string")
    s = spark.createDataFrame([("a", 1, "một. hai."), ("c", 2, "y")], "topic string, idx int, text string")
    got = {(r["topic"], r["idx"]): (r["text"], r["spoken_text"]) for r in diff.pair_files(w, s, ["topic", "idx"]).collect()}
    assert got == {("a", 1): ("Một. Hai.", "một. hai."), ("b", 1): ("x", None), ("c", 2): (None, "y")}
    side = lambda rows: spark.createDataFrame([("f", i, t) for i, t in enumerate(rows)], "f string, n int, text string")
    got = diff.pair_sentences(side(["Xin chào anh.", "Thêm một.", "Đi về nhà!"]), side(["xin chào anh", "đi về nhà"]), ["f"]).collect()
    assert [(r["written"], r["spoken"]) for r in got] == [("Xin chào anh.", "xin chào anh"), ("Đi về nhà!", "đi về nhà")]


def test_acronyms_are_harvested(spark):
    rows = [("Đài TTXVN báo", "đài tê tê ích vê en báo")] * 3 + [("Đại hội XIII họp", "đại hội mười ba họp")] * 3 + [("Tàu SAR đến", "tàu ét a rờ đến")] + [("Tàu UAV bay", "tàu u a vê bay")] * 2
    df = spark.createDataFrame(rows, "written string, spoken string")
    known = spark.createDataFrame([("u a vê", "UAV")], "spoken string, canonical string")
    assert [tuple(r) for r in diff.acronyms(df, known).collect()] == [("TTXVN", "tê tê ích vê en", 3)]


def test_readers_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Xin chào\n1. Tạm biệt\nmã 7\n", "utf-8")
    (tmp_path / "b.csv").write_text("text,x\nTạm biệt,1\nLần nữa,2\n", "utf-8")
    got = readers.read_inputs(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.csv")]).collect()
    assert [(r["line"], r["file"].rsplit("/", 1)[1]) for r in got] == [("xin chào", "a.txt"), ("tạm biệt", "a.txt"), ("lần nữa", "b.csv")]
    (tmp_path / "bundle.jsonl").write_text(json.dumps({"id": "1", "split": "dev", "tokens_json": '["a", "b"]', "bio_tags_json": '["O", "B-DATE"]', "normalized_text": "A b"}), "utf-8")
    r = readers.read_bundle(spark, str(tmp_path / "bundle.jsonl")).first()
    assert r["tokens"] == ["a", "b"] and r["bio_tags"] == ["O", "B-DATE"]
    (tmp_path / "t.jsonl").write_text(json.dumps({"id": "1", "tokens": [{"text": "a", "start": 0, "end": 1}], "bio_tags": ["B-DATE"], "punctuation_targets": ["PERIOD"], "normalized_text": "A.", "source_type": "s"}), "utf-8")
    r = readers.read_token_bundle(spark, str(tmp_path / "t.jsonl")).first()
    assert r["words"] == ["a"] and [tuple(s) for s in r["spans"]] == [(0, 0, "DATE")] and r["punct"] == ["PERIOD"]
    (tmp_path / "old.jsonl").write_text(json.dumps({"tokens": ["a", "b", "c"], "itn_tags": ["NUM", "NUM", "ODD"], "punc_tags": ["O", "O", "O"]}), "utf-8")
    r = readers.read_old_corpus(spark, str(tmp_path / "old.jsonl"), {"NUM": "CARDINAL"}).first()
    assert [tuple(s) for s in r["spans"]] == [(0, 1, "CARDINAL"), (2, 2, None)] and r["unmapped"] == ["ODD"]
    (tmp_path / "seed.csv").write_text("text\n" + "x" * 50 + "\nshort\n" + "y" * 60 + "\n", "utf-8")
    assert readers.read_style_seeds(spark, str(tmp_path / "seed.csv"), 1).count() == 1 and readers.read_style_seeds(spark, str(tmp_path / "seed.csv"), 9).count() == 2
    (tmp_path / "cat.json").write_text(json.dumps({"entries": [{"canonical": "X", "spoken": [f"r{i}" for i in range(1500)]}, {"canonical": "Y", "spoken": []}]}), "utf-8")
    c = readers.read_catalogue(spark, str(tmp_path / "cat.json"), "n")
    assert c.count() == c.select("ord").distinct().count() == 1502 and c.orderBy("ord").collect()[-1]["canonical"] == "Y"
    assert [r["sentence"] for r in readers.sentences(spark.createDataFrame([('An: "Xin chào các anh". Đi. Hẹn gặp lại nhé!',)], "text string")).collect()] == ["Xin chào các anh.", "Hẹn gặp lại nhé!"]


def test_gates_and_predicates(spark):
    t = lambda f, rows: [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]
    assert t(corpus.is_fragment, ["000 tấn", "tấn hàng", "Hàng về", "Có function và window", "Có function"]) == [True, True, False, True, False]
    assert t(lambda c: corpus.lost_boundaries(F.split(c, " ")), ["Anh về Trong mưa", "Anh về. Trong mưa", "Trong mưa"]) == [1, 0, 0]
    words = lambda s, spans=(): (s.split(), list(spans))
    rows = [words("một hai ba"), words("đi đến nhà anh kia"), words("đi đến nhà ok anh"), words("đi đến www.a.vn nhé anh", [(2, 2, "ELECTRONIC")]), words("đi đến www.a.vn nhé anh"), words("hai mươi ba bốn năm", [(0, 3, "CARDINAL")])]
    df = spark.createDataFrame(rows, "words array<string>, spans array<struct<start:int,end:int,type:string>>")
    assert [r[0] for r in df.select(corpus.generated_reason()).collect()] == ["too short", None, "junk", None, "foreign letters", "too little context"]


def test_scores_and_topics(spark):
    rows = spark.createDataFrame([("a", "x y", "x y"), ("a", "x y", "x"), ("b", "p", "q")], "topic string, gold string, pred string")
    got = [tuple(r) for r in metrics.by_topic(rows).collect()]
    assert got[0][:3] == ("a", 2, 1) and abs(got[0][3] - (1 + 2 / 3) / 2) < 1e-9 and got[1][:3] == ("b", 1, 0)
    report = metrics.per_type_report(*(spark.createDataFrame([(1, 0, 1, "DATE")], "id int, start int, end int, type string"),) * 2)
    assert report.count() == 46 and report.where("type = 'DATE'").first()["f1"] == 1.0


@pytest.mark.parametrize("kind,text", [("MMSI_ID", "em em ét i một hai ba bốn năm sáu bảy tám chín")])
def test_parsed_is_the_grammar_alone(spark, kind, text):
    r = spark.range(1).select(Normalization(spark).parsed(F.array(F.lit(kind)), F.array(F.lit(text))).alias("r")).first()["r"][0]
    assert r["valid"] and r["normalized"].endswith("123456789")
