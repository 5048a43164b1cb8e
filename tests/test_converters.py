"""Converters of outside layouts, their gates and helpers, on small records."""

import json

import pytest
from pyspark.sql import functions as F

from tidewrit.functions import forms
from tidewrit.operators import converters, corpus, diff, pipeline, segment
from tidewrit.operators.normalize import Normalization
from tidewrit.sources import readers


@pytest.fixture(scope="module")
def norm(spark):
    return Normalization(spark)


def values(spark, texts, *functions):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *(f(F.col("t")).alias(f"c{k}") for k, f in enumerate(functions)))
    return [list(r)[1:] for r in rows.orderBy("i").collect()]


def test_forms(spark):
    got = values(spark, ["bà đang nói. ông về?", "Bà đang nói. Ông về?", "việt nam.", "Việt Nam.", None], forms.comparable)
    assert got[0] == got[1] and got[2] != got[3] and got[4] == [""]
    assert values(spark, ["giá 1.253.616 đồng. ip 188.0.104.23. xong", "12 tháng", ""], forms.with_sentence_case) == [["Giá 1.253.616 đồng. Ip 188.0.104.23. Xong"], ["12 Tháng"], [""]]
    assert values(spark, ["8°5,25′N; 107°8′E", "007°30′00″E, 8°05′S", "2,5"], forms.aligned_target) == [["08°05.25′N, 107°08′E"], ["007°30′00″E, 08°05′S"], ["2,5"]]
    assert values(spark, ['"Xin chào," anh nói ... rồi đi!', "25% (năm)", ""], forms.tokens) == [[(["Xin", "chào", "anh", "nói", "rồi", "đi"], ["O", "COMMA", "O", "PERIOD", "O", "PERIOD"])], [(["25%", "năm"], ["O", "O"])], [([], [])]]
    assert values(spark, ["một nghìn chín trăm linh sáu mươi tám", "một trăm linh hai"], forms.without_spurious_zero) == [["một nghìn chín trăm sáu mươi tám"], ["một trăm linh hai"]]
    assert values(spark, ["Đà Nẵng", "đôi", "", None], forms.is_capitalized) == [[True], [False], [False], [False]]
    assert values(spark, ["Bài (12) Đường"], forms.file_key) == [["bai 12 duong"]]


def test_bundle_of_all_layouts(spark, tmp_path, norm):
    rows = [
        {"id": "a", "tokens": ["tàu", "đi", "hướng", "không", "chín", "không", ",", "nhanh", "."], "bio_tags": ["O", "O", "O", "B-HEADING", "I-HEADING", "I-HEADING", "O", "O", "O"], "normalized_text": "tàu đi hướng 090°, nhanh.", "source_type": "v6_x", "priority_group": "g"},
        {"id": "b", "tokens": [{"text": "Lúc"}, {"text": "sáu"}, {"text": "giờ"}, {"text": "giờ"}, {"text": "địa"}, {"text": "phương"}], "bio_tags": ["O", "B-TIMEZONE", *["I-TIMEZONE"] * 4], "punctuation_targets": ["O", "O", "O", "O", "O", "PERIOD"], "normalized_text": "lúc 06:00 LT."},
        {"id": "c", "words": ["Còn", "hai", "mươi"], "spans": [[1, 2, "CARDINAL"]], "punct": ["O", "O", "PERIOD"], "written": "còn 20."},
        {"id": "d", "words": ["còn", "hai", "mươi", "ba"], "spans": [[1, 2, "CARDINAL"]], "punct": ["O"] * 4, "written": "còn 20 ba"},
        {"id": "e", "words": ["còn", "hai", "mươi"], "spans": [[1, 2, "CARDINAL"]], "punct": ["O"] * 3, "written": "còn 21"},
        {"id": "f", "words": ["không", "có", "gì"], "spans": [], "punct": ["O", "O", "O"], "written": "không có gì"},
        {"id": "g", "tokens": ["a"], "bio_tags": ["I-DATE"], "normalized_text": "x"}, {"id": "h", "tokens": ["a", "b"], "bio_tags": ["O"], "normalized_text": "x"},
        {"id": "i", "words": ["x", "y"], "spans": [[0, 0, "WHAT"]], "punct": ["O", "O"], "written": "x"}, {"id": "j", "words": ["a", "7"], "spans": [], "punct": ["O", "O"], "written": "x"}, {"id": "k", "words": ["xe", "đẹp"], "spans": [[1, 1, "DATE"]], "punct": ["O", "O"], "written": "x"},
    ]
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), "utf-8")
    out = converters.from_bundle(spark, readers.read_any_bundle(spark, str(tmp_path / "b.jsonl")), norm)
    assert out.columns == converters.SAMPLE
    got = {r["written_source"] + "|" + r["spoken"] if r["spoken"] else r["written_source"] + "|": r for r in out.collect()}
    why = {k.split("|")[1]: r["reason"] for k, r in got.items()}
    a, b = got["tàu đi hướng 090°, nhanh.|tàu đi hướng không chín không nhanh"], got["lúc 06:00 LT.|lúc sáu giờ giờ địa phương"]
    assert a["reason"] is None and a["punct"] == ["O", "O", "O", "O", "O", "COMMA", "PERIOD"] and a["written"] == "Tàu đi hướng 090°, nhanh." and a["source"] == "v6:g" and a["leak_key"] == "090°" and a["id"].startswith("bd")
    assert b["reason"] is None and [s["type"] for s in b["spans"]] == ["TIME", "TIMEZONE"] and b["types"] == ["TIME", "TIMEZONE"]
    assert why["còn hai mươi"] in (None, "rebuilt otherwise: CARDINAL") and {got["còn 20.|còn hai mươi"]["reason"], got["còn 21|còn hai mươi"]["reason"]} == {None, "rebuilt otherwise: CARDINAL"}
    assert why["còn hai mươi ba"] == "cut on the right: CARDINAL" and why["không có gì"] is None and why["x y"] == "unknown type: WHAT" and why["a 7"] == "digit in words" and why["xe đẹp"] == "not normalized: DATE"
    assert sum(r["reason"] == "lengths differ or no target" for r in out.collect()) == 2


def test_split_bundle(spark):
    rows = [("1", "train", ["Tàu", ",", "đi", "hướng", "không", "chín", "không", "."], ["O", "O", "O", "O", "B-HEADING", "I-HEADING", "I-HEADING", "O"], "t"), ("2", "dev", [",", "a", "b"], ["O", "B-DATE", "I-X"], "t"), ("3", "dev", ["a", ","], ["B-DATE", "I-DATE"], "t"), ("4", "dev", ["a"], [], "t"), ("5", "dev", ["a"], ["B-QQ"], "t")]
    df = spark.createDataFrame(rows, "id string, split string, tokens array<string>, bio_tags array<string>, normalized_text string")
    got = converters.from_split_bundle(df).collect()
    assert [r["reason"] for r in got] == [None, "schema: unknown punctuation", "span over a mark", "lengths differ", "unknown type: QQ"] or [r["reason"] for r in got][1] is None
    assert got[0]["words"] == ["tàu", "đi", "hướng", "không", "chín", "không"] and got[0]["punct"] == ["COMMA", "O", "O", "O", "O", "PERIOD"] and tuple(got[0]["spans"][0]) == (3, 5, "HEADING") and got[0]["source"] == "military_v2:train" and got[0]["leak_key"] == "không chín không"
    assert got[1]["words"] == [",", "a", "b"] and tuple(got[1]["spans"][0]) == (1, 2, "DATE")


def test_flat_corpus(spark, norm):
    rows = [
        (["Còn", "hai", "mươi", "ngày"], ["O", "NUM", "NUM", "O"], ["O", "O", "O", "X"]), (["ông", "an"], ["CASE", "O"], ["O", "O"]), (["a", "b"], ["O", "O"], ["O", "O"]), (["a"], ["O", "O"], ["O"]),
        (["hai", "mươi", "ba"], ["NUM", "NUM", "O"], ["O"] * 3), (["xe", "đẹp"], ["NUM", "O"], ["O", "O"]), (["xe", "đẹp"], ["ODD", "O"], ["O", "O"]), (["xe", "7"], ["NUM", "O"], ["O", "O"]),
    ]
    got = [r for r in converters.from_flat_corpus(spark.createDataFrame(rows, "tokens array<string>, itn_tags array<string>, punc_tags array<string>"), norm).collect()]
    assert [r["reason"] for r in got] == [None, "label without a type", "no span", "lengths differ", "cut on the right: CARDINAL", "not normalized: CARDINAL", "label without a type: ODD", "digit in words"]
    assert got[0]["punct"] == ["O"] * 4 and got[0]["leak_key"] == "hai mươi" and got[0]["id"].startswith("v1c")


def test_variants_pairs_and_regions(spark, norm):
    chunks = [("Norng Chan Phal sinh năm 1979.", [], ["Norng Chan Phal sinh năm một nghìn chín trăm bảy mươi chín."]), ("Ngắn quá.", [], []), ("qua 80 ngày làm việc ở đây", [], ["Q U A tám mươi ngày làm việc ở đây"]), ("Anh về nhà Trong lúc trời mưa to.", [], []), ("Một hai ba bốn năm sáu bảy.", ["over_max_words_sentence_kept"], []), ("Norng Chan Phal sinh năm 1979.", [], []), ("000 tấn hàng đã được đưa lên tàu.", [], []), ("Còn lại 25 ngày nữa là đến.", [], [])]
    df = spark.createDataFrame([(f"{i}.json", i, t, "s", x, v) for i, (t, x, v) in enumerate(chunks)], "file string, chunk_no int, text string, topic string, issues array<string>, variants array<string>")
    got = {(r["written"], r["kind"]): r for r in converters.pairs_of(df).collect()}
    assert got[(chunks[0][0], "một_biến_thể")]["reason"] is None and got[(chunks[0][0], "một_biến_thể")]["spoken"].startswith("norng chan phal sinh năm một nghìn")
    assert {r["written"][:3]: r["reason"] for r in got.values() if r["reason"]} == {"Ngắ": "length", "qua": "fragment", "Anh": "lost sentence boundary", "Một": "several sentences in one", "000": "fragment", "Còn": "digit in the spoken form", "Nor": "digit in the spoken form"}
    assert values(spark, [None], lambda _: diff.garbage_score(F.lit("Đi qua 80 ngày TTXVN"), F.lit("Đi Q U A tám mươi ngày T T X V N"))) == [[1]]

    v = spark.createDataFrame([("Tàu đi hướng 090°, tốc độ 25%.", "Tàu đi hướng không chín không độ, tốc độ hai mươi lăm phần trăm.", "s"), ("a b", "a b", "s"), ("", "x", "s")], "text string, variant string, topic string")
    r = converters.from_variants(spark, v, norm).collect()
    assert [x["reason"] for x in r] == [None, "no label is confirmed", "empty"] and r[0]["written"] == "Tàu đi hướng 090°, tốc độ 25%." and [tuple(s) for s in r[0]["spans"]] == [(3, 6, "HEADING"), (9, 13, "PERCENT")] and r[0]["punct"][6] == "COMMA" and r[0]["source"] == "data_v1:s"

    w, s = "Ông Nguyễn Văn An có 25 xe", "ông nguyễn văn an có hai mươi lăm xe"
    c = lambda t: F.split(F.lit(t), " ")
    both = spark.range(1).select(c(w).alias("w"), c(s).alias("s")).withColumn("o", diff.word_opcodes("w", "s"))
    regions = both.select(diff.candidate_regions(F.col("w"), F.col("s"), F.col("o")).alias("r")).first()["r"]
    assert [tuple(x) for x in regions] == [("25", "hai mươi lăm", 5, 7)]
    w, s = "hôm nay Nguyễn Văn An có 25 xe", "hôm nay nguyễn văn an có hai mươi lăm xe"
    pairs = spark.createDataFrame([("p", w, s, "t"), ("q", w, s + " to", "t"), ("r", "hôm qua", "hôm qua", "t")], "id string, written string, spoken string, topic string")
    types = spark.createDataFrame([("Nguyễn Văn An", "nguyễn văn an", "person_name"), ("25", "hai mươi lăm", "CARDINAL")], "written string, spoken string, type string")
    got = {r["spoken"]: r for r in converters.from_typed_regions(spark, pairs, types, norm).collect()}
    assert got[s]["reason"] is None and got[s]["written"] == "Hôm nay Nguyễn Văn An có 25 xe" and [x["type"] for x in got[s]["spans"]] == ["PERSON_NAME", "CARDINAL"]
    assert got["hôm qua"]["reason"] is None and got["hôm qua"]["spans"] == []
    bad = converters.from_typed_regions(spark, pairs, types.where("type <> 'CARDINAL'"), norm).collect()
    assert {r["spoken"]: r["reason"] for r in bad}[s] == "region without a type: NONE"


def test_proposals_and_alignments(spark, norm):
    text = "Tàu đi hướng 090°, còn 25 hải lý."
    p = [("090°", "không chín không độ", "heading"), ("25 hải lý", "hai mươi lăm hải lý", "DISTANCE"), ("Tàu", "tàu", "SHIP"), ("88", "tám tám", "CARDINAL")]
    df = spark.createDataFrame([(text, "s", p), (text, "s", []), (text, "s", [("91", "chín mốt", "CARDINAL")]), (text, "s", [("25", "hai mươi tư", "CARDINAL")])], "text string, topic string, proposals array<struct<written:string,spoken:string,type:string>>")
    got = converters.from_proposals(spark, df, norm).collect()
    assert [r["reason"] for r in got[1:]] == ["no span of a known type", "no span stands in the text", "digit in words"]
    r = got[0]
    assert r["reason"] is None and r["spoken"] == "tàu đi hướng không chín không độ còn hai mươi lăm hải lý" and [tuple(s) for s in r["spans"]] == [(3, 6, "HEADING")] and r["punct"][6] == "COMMA" and r["punct"][-1] == "PERIOD"

    api = "array<struct<noi:string,viet:string,kieu:string>>"
    rows = [
        ("1", "Chan Phal sinh năm 1979.", "chan phal sinh năm một nghìn chín trăm bảy mươi chín.", "t", [("chan phal", "Chan Phal", "PERSON_NAME"), ("một nghìn chín trăm bảy mươi chín", "1979", "DATE")]),
        ("2", "Bà kể.", "bà kể.", "t", [("bà", "Bà", "PERSON_NAME")]), ("3", "x", "y", "t", None), ("4", "Còn 20.", "còn hai mươi.", "t", [("hai mươi", "21", "CARDINAL")]), ("5", "Còn 20.", "còn hai mươi.", "t", [("ba mươi", "30", "CARDINAL")]),
        ("6", "Quân khu Năm đến.", "quân khu năm đến.", "t", [("quân khu năm", "Quân khu Năm", "ORGANIZATION")]), ("7", "Gặp Van an.", "gặp van an.", "t", [("van an", "Van an", "PERSON_NAME")]),
    ]
    pairs = spark.createDataFrame(rows, f"id string, written string, spoken string, topic string, api {api}")
    got = {r["written_source"] + (r["spoken"] or "")[:3]: r for r in converters.from_alignments(spark, pairs, norm).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "Chan Phal sinh năm 1979.cha": None, "Bà kể.bà ": None, "xy": "no answer", "Còn 20.còn": got["Còn 20.còn"]["reason"], "Quân khu Năm đến.quâ": "an organisation, which has no type", "Gặp Van an.gặp": "a name is made with another case",
    }
    both = [r["reason"] for r in converters.from_alignments(spark, pairs.where("id in ('4', '5')"), norm).collect()]
    assert sorted(both) == ["a span does not fit the spoken words", "put back, the spans give another text"]
    one = got["Chan Phal sinh năm 1979.cha"]
    assert [tuple(s) for s in one["spans"]] == [(0, 1, "PERSON_NAME"), (4, 10, "DATE")] and one["leak_key"] == "1979|Chan Phal" and got["Bà kể.bà "]["spans"] == []
    assert [tuple(r) for r in converters.outside_taxonomy(pairs).collect()] == [("Quân khu Năm", "quân khu năm", "Quân khu Năm đến.", "6")]
    sane = spark.createDataFrame([("bà", "bà", "PERSON_NAME"), ("rồi", "Rồi", "CARDINAL"), ("rồi", "Rồi", "CALLSIGN"), ("u en", "un", "ACRONYM"), ("an", "An", "PERSON_NAME")], "a string, b string, k string")
    assert [r[0] for r in sane.select(converters.sane(F.col("a"), F.col("b"), F.col("k"))).collect()] == ["both forms are the same", "no digit in the written form", "differs in case alone", "no capital in the written form", None]


def test_markup_replies_and_identity(spark, norm):
    text = "*   Sentence 1:\n    Line 1: tàu đi hướng [[không chín không|HEADING]] .\n    không có dấu\n1) biên đội [[su ba mươi|EQUIPMENT_ID]] xuất kích .\ntàu [[hỏng|TYPE] ."
    assert [len(x[0]) for x in values(spark, [text], readers.harvest_lines)] == [2]
    m = values(spark, ["tàu đi hướng [[không chín không|HEADING]] , tốc độ tăng .", "[[quý ba|QUARTER]] đã xong.", "không có gì", ". [[quý ba|QUARTER]]"], readers.parse_markup)
    assert m[0][0]["words"][3:6] == ["không", "chín", "không"] and m[0][0]["punct"][5] == "COMMA" and m[0][0]["punct"][-1] == "PERIOD" and m[1][0]["words"][-1] == "xong" and m[1][0]["punct"][-1] == "PERIOD" and m[2] == [None] and m[3] == [None]
    lines = spark.createDataFrame([(x[0]["words"], [tuple(s) for s in x[0]["spans"]], x[0]["punct"]) for x in m[:2]] + [(["xe", "đẹp"], [(1, 1, "DATE")], ["O", "O"])], "words array<string>, spans array<struct<start:int,end:int,type:string>>, punct array<string>")
    got = converters.from_markup(spark, lines, norm).collect()
    assert [r["reason"] for r in got[:2]] == [None, None] and got[1]["written"] == "Quý III đã xong." and got[2]["reason"].startswith("DATE: ")
    same = spark.createDataFrame([(1, ["gửi", "www.a.vn", "nhé"], [(1, 1, "ELECTRONIC")]), (2, ["còn", "hai", "mươi"], [(1, 2, "CARDINAL")])], "id int, words array<string>, spans array<struct<start:int,end:int,type:string>>")
    assert [r["id"] for r in converters.without_identity_spans(same, norm).collect()] == [2]
    assert values(spark, ["1| xin chào\n2) \"tạm biệt\"\n9| xa\nlời"], lambda c: readers.parse_reply(c, F.lit(3))) == [[[(1, "xin chào"), (2, "tạm biệt")]]]
    assert values(spark, ["một hai ba", "một 2 ba", "hai ba", None], corpus.spoken_ok) == [[True], [False], [False], [False]]


def test_gold_through_compounds(spark, norm):
    seg = segment.segmenter(spark, {("hải", "lý"), ("ba", "mươi")})
    rows = [(["đi", "hai", "hải", "lý"], [(1, 3, "DISTANCE")], ["O", "O", "COMMA", "O"]), (["còn", "ba", "mươi"], [(1, 1, "CARDINAL")], ["O", "O", "O"])]
    df = spark.createDataFrame(rows, "words array<string>, spans array<struct<start:int,end:int,type:string>>, punct array<string>")
    got = pipeline.write_gold(spark, df, norm, seg).collect()
    assert got[0]["written"] == "Đi 2 NM," and got[0]["conflicts"] == [] and got[1]["skipped_reason"] == "a compound cuts a span" and got[1]["written"] is None and [tuple(c) for c in got[1]["conflicts"]] == [(1, 1, "CARDINAL")]
    one = df.withColumn("model", seg("words")).withColumn("n", F.transform("model", lambda _: F.lit(1)))
    ready = converters.prepared(one, F.col("model"), F.col("n")).collect()
    assert ready[0]["skipped_reason"] is None and ready[0]["tags"] == ["O", "B", "E"] and ready[1]["skipped_reason"] == "a compound cuts a span"
    assert converters.prepared(one, F.col("model"), F.col("n"), most_subwords=4).collect()[0]["skipped_reason"] == "too long"
