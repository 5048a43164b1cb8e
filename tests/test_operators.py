import itertools

import numpy as np
import pytest
from goldens import UTTERANCES
from pyspark.sql import functions as F

from tidewrit.functions.validators import valid, valid_column
from tidewrit.operators import corpus, diff, lookup, metrics, pipeline, segment, sequence, spans as S, windows
from tidewrit.operators.normalize import Normalization
from tidewrit.sources import readers, writers


def locate(words, text):
    t = text.split()
    i = next(i for i in range(len(words)) if words[i : i + len(t)] == t)
    return i, i + len(t) - 1


@pytest.fixture(scope="module")
def golden(spark):
    rows = []
    for n, (spoken, spans, _) in enumerate(UTTERANCES):
        w = spoken.split()
        rows.append((n, w, [(*locate(w, s), k) for s, k in spans], ["O"] * (len(w) - 1) + ["PERIOD"]))
    df = spark.createDataFrame(rows, "id int, words array<string>, gold array<struct<start:int,end:int,type:string>>, punct array<string>")
    return df.withColumn("spans", pipeline.with_gold_confidence(F.col("gold")))


def test_all_groups_are_written_exactly(spark, golden):
    out = {r["id"]: r for r in pipeline.write(spark, golden).select("id", "written", F.forall("outputs", lambda o: o["emitted"]).alias("all")).collect()}
    for n, (_, _, want) in enumerate(UTTERANCES):
        assert (out[n]["written"], out[n]["all"]) == (want, True)


def test_gate_stops_low_confidence_and_bad_rows_get_a_reason(spark, golden):
    low = golden.where("id = 7").withColumn("spans", F.transform("spans", lambda s: s.withField("boundary_conf", F.lit(0.5))))
    t = pipeline.trace(pipeline.write(spark, low)).first()
    assert (t["valid"], t["emitted"], t["reason"]) == (True, False, "below threshold")
    assert pipeline.write(spark, low).first()["written"] == "Vị trí mười độ hai mươi lăm phút bắc."
    bad = golden.where("id = 0").withColumn("punct", F.array(F.lit("O")))
    r = pipeline.write(spark, bad).first()
    assert r["written"] is None and "punctuation" in r["skipped_reason"]


def brute_decode(tags):
    out, begin = [], None
    for i, t in enumerate(tags):
        if t in "OBS" and begin is not None:
            out.append((begin, i - 1))
            begin = None
        if t == "S":
            out.append((i, i))
        elif t == "E":
            out.append((i if begin is None else begin, i))
            begin = None
        elif t == "B" or (t == "I" and begin is None):
            begin = i
    return out + ([(begin, len(tags) - 1)] if begin is not None else [])


def test_decode_every_sequence(spark):
    every = [list(x) for n in range(1, 5) for x in itertools.product("OBIES", repeat=n)]
    rows = spark.createDataFrame([(x,) for x in every], "tags array<string>").select("tags", S.decode(F.col("tags")).alias("s"), S.illegal_steps(F.col("tags")).alias("bad")).collect()
    for r in rows:
        assert [(x["start"], x["end"]) for x in r["s"]] == brute_decode(r["tags"])
        t = r["tags"]
        assert r["bad"] == sum(b not in S.NEXT[a] for a, b in zip(t, t[1:])) + (t[0] in "IE") + (t[-1] in "BI")


def test_encode_is_the_inverse(spark):
    df = spark.createDataFrame([([(0, 2, "A"), (3, 3, "B")], 5), ([], 2), ([], 0)], "s array<struct<start:int,end:int,type:string>>, n int")
    assert [r[0] for r in df.select(S.encode(F.col("s"), F.col("n"))).collect()] == [list("BIESO"), list("OO"), []]


def test_signature_projection_and_bio(spark):
    df = spark.createDataFrame([("biên đội su ba mươi xuất kích".split(), [(2, 4, "EQUIPMENT_ID")])], "w array<string>, s array<struct<start:int,end:int,type:string>>")
    assert df.select(S.template_signature(F.col("w"), F.col("s"))).first()[0] == "biên đội <EQUIPMENT_ID> xuất kích"
    model = F.array(*(F.struct(F.lit(a).alias("raw_start"), F.lit(b).alias("raw_end")) for a, b in [(0, 1), (2, 2), (3, 3), (4, 5), (6, 6)]))
    assert tuple(df.select(F.get(S.project(F.col("s"), model), F.lit(0)).alias("x")).select("x.*").first()) == (1, 3, "EQUIPMENT_ID", True)
    tags = spark.createDataFrame([(["B-A", "I-A", "O", "B-B"],), (["I-A"],), (["B-A", "I-B"],)], "t array<string>")
    strict = [r[0] for r in tags.select(S.bio_spans(F.col("t"))).collect()]
    assert [tuple(x) for x in strict[0]] == [(0, 1, "A"), (3, 3, "B")] and strict[1:] == [None, None]
    assert [tuple(x) for x in tags.select(S.bio_spans(F.col("t"), strict=False)).collect()[2][0]] == [(0, 1, "A")]


def test_sequence_model_against_every_path():
    rng = np.random.default_rng(0)
    batch = [rng.normal(size=(n, 5)) for n in (5, 1, 3, 4)]
    e, size = sequence.pad(batch)
    z, p, best = sequence.partition(e, size), sequence.marginals(e, size), sequence.viterbi(e, size)
    for i, x in enumerate(batch):
        paths = list(itertools.product(range(5), repeat=len(x)))
        scores = np.array([sequence.score(x, list(q)) for q in paths])
        total = sequence.logsumexp(scores[None], 1)[0]
        assert abs(total - z[i]) < 1e-9 and best[i] == list(paths[int(scores.argmax())])
        for t in range(len(x)):
            for k in range(5):
                want = sum(np.exp(s - total) for q, s in zip(paths, scores) if q[t] == k)
                assert abs(want - p[i, t, k]) < 1e-9


def test_windows_cover_every_word():
    for counts in ([2] * 300, [3] * 200, [500, 2, 2], [], [1], [224, 1, 224]):
        plan = windows.plan(counts)
        assert [w for a, b, _ in plan for w in range(a, b)] or not counts
        assert {w for a, b, _ in plan for w in range(a, b)} == set(range(len(counts)))
        for (a, b, n), nxt in itertools.zip_longest(plan, plan[1:]):
            assert n <= 224 or b == a + 1
            assert nxt is None or (nxt[0] > a and nxt[0] <= b)


def test_lookup_agrees_with_the_engine(spark):
    from tidewrit.functions.catalogues import Catalogue, defaults

    said = ["pa tri ốt", "pa tri ót", "oa sinh tân", "hy mác", "cờ lô ri ban đờ", "", "tô ma hốc ca"]
    got = lookup.lookup(spark.createDataFrame([(s,) for s in said], "s string"), lookup.table(spark), "foreign_names", F.col("s")).collect()
    own = Catalogue(defaults()["foreign_names"])
    for r in got:
        found, score, tier = own.lookup(r["s"])
        assert (r["canonical"], r["tier"]) == (found, tier) and (found is None or abs(r["score"] - score) < 1e-9)


def test_metrics_on_hand_computed_frames(spark):
    span = "id int, start int, end int, type string"
    gold = spark.createDataFrame([(1, 0, 2, "COORD"), (1, 4, 4, "CARDINAL")], span)
    pred = spark.createDataFrame([(1, 4, 4, "DIGIT_SEQ")], span)
    by = {r["type"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.type_f1(gold, pred).collect()}
    assert by == {"COORD": (0, 0, 1), "CARDINAL": (0, 0, 1), "DIGIT_SEQ": (0, 1, 0), None: (0, 1, 2)}
    b = metrics.boundary_f1(gold, pred).first()
    assert (b["tp"], b["fp"], b["fn"]) == (1, 0, 1)
    r = spark.createDataFrame([("O", None, "con mèo", "con mèo"), ("O", None, "3 con", "ba con"), ("DATE", None, "x", "y")], "gold_type string, must_keep boolean, pred string, raw string")
    assert metrics.false_normalization_rate(r).first()["rate"] == 0.5
    f = spark.createDataFrame([("a b b", "b b c"), ("", "a"), ("a.", "a"), (None, "a")], "g string, p string").select(metrics.token_f1(F.col("g"), F.col("p"))).collect()
    assert [round(x[0], 6) for x in f] == [round(2 / 3, 6), 0.0, 1.0, 0.0]
    t = spark.createDataFrame([("A", 0.9, True), ("A", 0.8, False), ("A", 0.7, True), ("A", 0.6, True), ("B", 0.5, True)], "type string, confidence double, ok boolean")
    assert {x["type"]: x["threshold"] for x in metrics.best_threshold(t).collect()} == {"A": 0.6, "B": 0.6}
    assert metrics.boundary_f1(gold.limit(0), pred.limit(0)).first()["f1"] == 0.0
    assert metrics.per_type_report(gold, pred).count() == 46


def test_gates_and_splits(spark):
    df = spark.createDataFrame([(["ba", "3"], [], ["O", "O"]), (["a", "b", "c", "d"], [(0, 2, "DATE"), (1, 3, "DATE")], ["O"] * 4), (["a"], [(0, 0, "NOPE")], ["O"]), (["a"], [], ["O"])], "words array<string>, spans array<struct<start:int,end:int,type:string>>, punct array<string>")
    assert [r[0] for r in df.select(corpus.utterance_reason()).collect()] == ["digit in words", "spans overlap", "unknown type", None]
    b = spark.createDataFrame([(["đi", "hai", "ba", "bốn"], [(2, 2, "CARDINAL")])], "words array<string>, spans array<struct<start:int,end:int,type:string>>")
    assert b.select(corpus.boundary_reason()).first()[0] == "number word beside a span"
    rows = spark.createDataFrame([(i, f"k{i % 10}", f"t{i % 6}") for i in range(600)], "id int, leak_key string, signature string")
    split = corpus.build_splits(rows)
    assert corpus.leakage(split).count() == 0
    first = corpus.first_by_key(rows, F.col("leak_key"), ["id"])
    assert {r["id"] for r in first.collect()} == set(range(10))


def test_rebalance_takes_rows_below_a_cap(spark):
    rows = spark.createDataFrame([(i, ["A"] if i % 2 else ["A", "B"]) for i in range(40)], "id int, types array<string>")
    out = corpus.rebalance(rows.where("id < 4"), rows, {"A": 10, "B": 6}).collect()
    assert len({r["id"] for r in out}) == len(out)
    assert sum("B" in r["types"] for r in out) <= 10 and sum("A" in r["types"] for r in out) >= 10


def test_same_value_and_diff(spark):
    df = spark.createDataFrame([("1.000", "1000"), ("01", "1"), ("10 km", "10 m"), ("a", "a")], "a string, b string")
    assert [r[0] for r in df.select(corpus.same_value(F.col("a"), F.col("b"))).collect()] == [True, True, False, True]  # equal texts have one value
    assert diff.regions("tàu đi 25 km".split(), "tàu đi hai mươi lăm km".split()) == [("25", "hai mươi lăm", 2, 4)]
    w = spark.createDataFrame([("a b a b".split(), ["a b", "a b", "c"])], "w array<string>, p array<string>")
    assert w.select(diff.find_runs("w", "p")).first()[0] == [(0, 1), (2, 3), None]


def test_segments_are_reversible(spark):
    seg = segment.segmenter(spark, segment.lexicon(["hải_lý", "tàu_ngầm</w>", "x"]))
    r = spark.createDataFrame([("Tàu ngầm đi hải lý".split(),), ([],)], "t array<string>").withColumn("m", seg("t")).select("m", segment.reversible(F.col("t"), F.col("m"))).collect()
    assert [m["word"] for m in r[0]["m"]] == ["Tàu_ngầm", "đi", "hải_lý"] and r[0][1] and r[1][1]


def test_native_validators_agree(spark):
    cases = [("COORD", "10°25'N"), ("COORD", "95°25'N"), ("COORD", "10°25′N, 107°61′E"), ("HEADING", "359°"), ("HEADING", "400°"), ("TELEPHONE", "+84 908 123 456"), ("IMO_ID", "IMO 9074729"), ("MMSI_ID", None), ("RANK", "x"), ("VEHICLE_PLATE", "30A-1234")]
    df = spark.createDataFrame(cases, "k string, v string").select("k", "v", valid_column(F.col("k"), F.col("v")).alias("ok"))
    assert all(r["ok"] == valid(r["k"], r["v"]) for r in df.collect())


def test_distinct_reads_each_pair_once(spark):
    df = spark.createDataFrame([("CARDINAL", "hai"), ("CARDINAL", "hai"), ("CARDINAL", None), (None, "x")], "k string, t string")
    out = Normalization(spark).distinct(df, "k", "t").collect()
    assert len(out) == 4 and sum(r["result"] is not None and r["result"]["normalized"] == "2" for r in out) == 2


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "spoken": "xin"}\nbroken\n', encoding="utf-8")
    rows = readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()
    assert [r["id"] for r in rows] == ["1", None] and rows[1]["_corrupt_record"] == "broken"
    art = tmp_path / "json/x"
    art.mkdir(parents=True)
    (art / "d.json").write_text('{"article": {"topic": "t"}, "chunks": [{"text": "A", "all_text_results": [{"type": "v", "text": "a"}]}, {"text": "B"}]}', encoding="utf-8")
    (art / "e.json").write_text("{", encoding="utf-8")
    got = readers.read_articles(spark, str(tmp_path / "json")).collect()
    assert sorted((r["text"], r["variants"]) for r in got if not r["broken"]) == [("A", ["a"]), ("B", [])] and sum(r["broken"] for r in got) == 1
    tree = tmp_path / "txt/topic"
    tree.mkdir(parents=True)
    (tree / "bài (7).txt").write_text("Một hai ba bốn. Năm sáu bảy tám!", encoding="utf-8")
    t = readers.read_text_tree(spark, str(tmp_path / "txt"))
    assert tuple(t.first()) == ("topic", 7, "Một hai ba bốn. Năm sáu bảy tám!") and readers.sentences(t).count() == 2
    m = spark.createDataFrame([("tàu đi hướng [[không chín không|HEADING]] tốc độ",)], "l string").select(readers.parse_markup(F.col("l")).alias("m")).first()["m"]
    assert m["words"] == "tàu đi hướng không chín không tốc độ".split() and [tuple(x) for x in m["spans"]] == [(3, 5, "HEADING")]
    writers.write_csv(spark.createDataFrame([("é", 1)], "a string, b int").coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbf")
    writers.split_sinks(spark.range(4).toDF("n"), F.when(F.col("n") > 2, "large"), str(tmp_path / "ok"), str(tmp_path / "no"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 3
